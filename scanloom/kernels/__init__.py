"""NumPy kernels over blocks of patterns, and how Arrow batches are fed to them."""
