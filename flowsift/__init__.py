"""Flow-anomaly analytics as PySpark DataFrame operators."""
