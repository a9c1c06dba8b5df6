"""Sources of offline files: heap segments, commit log, control file, configuration."""
