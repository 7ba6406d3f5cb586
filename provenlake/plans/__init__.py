"""Whole queries: derivations of ledger tables from the given tables, and the flows over them."""
