"""Column functions on k-mer strings."""
