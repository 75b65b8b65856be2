"""Cadenza operators."""
