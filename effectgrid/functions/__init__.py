"""Column functions: labels, scalars and special functions. No UDFs here."""
