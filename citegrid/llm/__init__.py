"""Operators that prepare text collections for training language models. Nothing outside this folder imports it."""
