"""Operators of tidewater."""
