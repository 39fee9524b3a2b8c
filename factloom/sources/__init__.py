"""factloom.sources."""
