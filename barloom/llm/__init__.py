"""Operators on texts and vectors for building training data. Nothing else in barloom imports this."""
