"""Sources of tidewater."""
