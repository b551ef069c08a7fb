"""Column and series functions that operators share."""
