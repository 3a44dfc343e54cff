"""Operators of a training-data pipeline: scoring, filtering, matching, counting and mixing of documents."""
