"""Incremental versions of the jobs."""
