"""Question planning and the catalogue of runnable queries."""
