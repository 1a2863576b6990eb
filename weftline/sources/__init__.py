"""Where records come from: text files, staged runs, the generator."""
