"""Training-data operators. Nothing else in yieldloom imports this package."""
