"""Panel analytics as lazy PySpark DataFrame plans."""
