"""Operators for building training data from text and web pages. Nothing else in the package imports this one."""
