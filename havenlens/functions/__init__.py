"""Column builders: no shuffles, no UDFs."""
