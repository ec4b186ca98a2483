"""Column functions: strings, streams of strings, predicates and sequence letters."""
