"""Scalar expressions: value formatting and conversion, hashing, extraction helpers."""
