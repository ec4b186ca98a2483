"""DataFrame operators: search, aligned columns, k-mers, merging, intervals, trees, distances."""
