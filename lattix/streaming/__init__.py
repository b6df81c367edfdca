"""Matrices that arrive in batches.

The reference domain has no event streams. What does change over time is a matrix whose entries come
in files: :func:`accumulate` keeps the running canonical matrix of a folder of coordinate files.
"""

from lattix.streaming.matrix_stream import accumulate, entry_stream

__all__ = ["accumulate", "entry_stream"]
