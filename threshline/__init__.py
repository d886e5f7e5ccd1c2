"""Review-traffic analytics and training-data preparation on plain PySpark."""
