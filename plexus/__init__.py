"""Graph edge construction, attention and set analytics as lazy Spark plans."""
