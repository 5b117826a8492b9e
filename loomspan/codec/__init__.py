"""Byte-level kernels: they run in Arrow workers, on one chunk of a tensor at a time."""
