"""Numerical algebra of path features: word and tree bases, truncated tensor and tree algebras, kernels."""
