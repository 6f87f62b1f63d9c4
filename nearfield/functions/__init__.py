"""Column expressions over vectors, and their numpy kernels."""
