"""Column expressions and the k-mer generator."""
