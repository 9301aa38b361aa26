"""Repository-intelligence analytics as composable PySpark DataFrame operators."""
