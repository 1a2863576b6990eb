"""Where records go: one ordered text file, part files, staged runs."""
