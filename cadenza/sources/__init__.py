"""Cadenza sources."""
