"""DataFrame operators: catalog, units, resolution, alignment, constraints, ledgers."""
