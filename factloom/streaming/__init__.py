"""factloom.streaming."""
