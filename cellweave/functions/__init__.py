"""Column expressions on 32-bit coordinates."""
