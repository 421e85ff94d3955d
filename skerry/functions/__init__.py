"""Column-level text, vector and scoring expressions."""
