"""The same kernels over documents as they arrive: extensions."""
