"""Spark jobs that turn payment messages and bank statements into a ledger, and corpus jobs beside them."""
