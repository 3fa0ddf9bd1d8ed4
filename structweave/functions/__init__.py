"""Column expressions and Arrow-batch kernels."""
