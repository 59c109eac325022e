"""Registered queries over the reference operators."""
