"""Following a heap feed as it arrives."""
