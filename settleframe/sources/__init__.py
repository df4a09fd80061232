"""Readers of stored tables, and jobs that turn landed raw records into them."""
