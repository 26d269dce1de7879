"""Analytics for randomised-search experiments on Spark."""
