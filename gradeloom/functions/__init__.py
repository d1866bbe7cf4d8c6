"""Part of gradeloom."""
