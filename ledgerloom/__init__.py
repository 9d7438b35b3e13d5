"""Ledger analytics on Spark."""
