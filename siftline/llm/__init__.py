"""Preparation of training text: each operator is one module, its queries and SQL are in queries.py."""
