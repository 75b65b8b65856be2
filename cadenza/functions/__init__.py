"""Cadenza functions."""
