"""Special functions as Column expressions, as numpy functions and as pandas UDFs."""
