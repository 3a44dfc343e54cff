"""Whole searches and data set builds put together from the operators."""
