"""Column functions: numeric comparison, wide numbers and the typed bag."""
