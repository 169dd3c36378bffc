"""Array kernels for graphs that are small enough for one task."""
