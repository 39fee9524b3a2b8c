"""factloom.operators."""
