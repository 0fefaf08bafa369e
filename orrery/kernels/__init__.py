"""Numpy kernels of orbit propagation, over many objects and times at once."""
