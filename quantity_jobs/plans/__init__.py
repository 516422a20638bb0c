"""Composed workloads, adapters from the given tables, and the catalogue of queries."""
