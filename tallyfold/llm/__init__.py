"""Operators for preparing training text."""
