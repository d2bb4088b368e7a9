"""Reading reports and writing results."""
