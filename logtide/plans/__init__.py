"""Shared physical building blocks and the end-to-end analysis."""
