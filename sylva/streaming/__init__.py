"""The search as a stream of chunks of trees."""
