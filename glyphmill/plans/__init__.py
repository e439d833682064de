"""Profiles, strategies and whole jobs composed from the operators."""
