"""Helpers of the tests and of the oracle check."""
