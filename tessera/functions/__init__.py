"""Column functions and text kernels."""
