"""Spark-native reading, checking and repairing of offline heap files and their catalogs."""
