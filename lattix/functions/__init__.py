"""Column functions: 64-bit words, index arithmetic and order-free signatures."""

from lattix.functions.words import andnot, bit_positions, bit_rank, bits_of, low_mask, single_bit, trailing_zeros, word_of

__all__ = ["andnot", "bit_positions", "bit_rank", "bits_of", "low_mask", "single_bit", "trailing_zeros", "word_of"]
