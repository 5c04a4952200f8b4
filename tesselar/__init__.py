"""tesselar: sharded analytics on PySpark."""
