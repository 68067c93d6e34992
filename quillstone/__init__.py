"""Semi-structured document engine on PySpark."""
