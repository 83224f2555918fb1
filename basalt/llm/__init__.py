"""Operators that prepare text for training. Nothing outside this subpackage imports it."""
