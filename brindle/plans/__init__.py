"""Benchmark plans and the SQL entry point."""
