"""Training-data operators: one module each, plus the queries that apply them."""
