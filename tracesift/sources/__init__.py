"""Inputs: span adapters, event bodies, rules files."""
