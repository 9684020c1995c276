"""Training-data operators: one module for each, with their queries in ``queries.py``."""
