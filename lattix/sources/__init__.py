"""Readers, writers and generators of matrices, vectors, coordinates and owner labels."""

from lattix.sources.generators import block_diagonal, chain, grid7, poisson_1d, spd_surrogate
from lattix.sources.matrix_market import MatrixMarketInfo, read_matrix_market, read_spd, write_matrix_market
from lattix.sources.text import csr_to_matrix, read_coordinates, read_labels, read_owned_rows, read_vector, write_graph, write_labels, write_owned_rows

__all__ = [
    "MatrixMarketInfo", "block_diagonal", "chain", "csr_to_matrix", "grid7", "poisson_1d", "read_coordinates", "read_labels", "read_matrix_market", "read_owned_rows", "read_spd", "read_vector",
    "spd_surrogate", "write_graph", "write_labels", "write_matrix_market", "write_owned_rows",
]
