"""External programs on standard input and output; no unbounded streams."""
