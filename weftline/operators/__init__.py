"""DataFrame operators: order, runs, merges, ranks, checks."""
