"""factloom.functions."""
