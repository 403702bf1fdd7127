"""Signal kernels in numpy, applied to array or binary columns by Arrow functions."""
