"""Analytics of binary-outcome markets, and preparation of training data, on Spark."""
