"""Operators that prepare mail text for training language models; nothing else in the library imports them."""
