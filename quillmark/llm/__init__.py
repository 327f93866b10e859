"""Training-data operators: one module for each, plus the queries and SQL that apply them."""
