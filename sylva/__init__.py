"""Exact analytics over collections of trees, and text-corpus operators, on PySpark."""
