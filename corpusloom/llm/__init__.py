"""Operators for training-text problems. Nothing outside this subpackage imports it."""
