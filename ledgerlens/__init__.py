"""Ledger, token and market analytics on Spark."""
