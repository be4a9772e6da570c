"""Records from and to JSON text, flat columns and pairs."""
