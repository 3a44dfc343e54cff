"""Sources of trees: enumeration, orders, edge lists, data sets of texts."""
