"""Operators on tables of trees."""
