"""Analytics over recipes, kitchen inventory and shopping data on Spark."""
