"""Analytics for training data and scaling studies on PySpark."""
