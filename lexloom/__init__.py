"""Document analytics and training-data preparation on PySpark."""
