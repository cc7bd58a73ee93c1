"""Value semantics and text kernels as column expressions."""
