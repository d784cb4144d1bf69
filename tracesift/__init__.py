"""Tail-based trace sampling analytics on Spark."""
