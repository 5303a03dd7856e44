"""Point sources: array, pandas and table adapters."""
