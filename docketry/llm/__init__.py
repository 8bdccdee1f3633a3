"""Operators that prepare texts for training language models. Nothing outside this folder imports it."""
