"""Registered queries (catalog), the batch job and the bench plan list."""
