"""Financial-network analytics on PySpark."""
