"""Typed views over the input tables."""
