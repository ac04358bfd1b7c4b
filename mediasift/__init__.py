"""Library clean-up analytics as pure DataFrame transformations on Spark."""
