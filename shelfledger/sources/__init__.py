"""Readers for the logical tables and the mapping of the driver tables onto them."""
