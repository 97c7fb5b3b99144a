"""A small expression language over frames."""
