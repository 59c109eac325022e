"""tidewater: subtitle and text analytics as Spark DataFrame jobs."""
