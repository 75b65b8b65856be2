"""Cadenza plans."""
