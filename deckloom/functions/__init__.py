"""Column expressions shared by the operators (no Python UDFs)."""
