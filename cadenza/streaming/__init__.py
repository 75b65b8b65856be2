"""Cadenza streaming."""
