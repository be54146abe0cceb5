"""Training-data operators: independent of, and never imported by, the rest of the library."""
