"""barspark: market-bar analytics and training-corpus operators on PySpark."""
