"""Streaming of tidewater."""
