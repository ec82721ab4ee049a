"""Operators for building training corpora from document tables."""
