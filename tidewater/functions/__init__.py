"""Functions of tidewater."""
