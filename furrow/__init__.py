"""furrow: crop-economics analytics as PySpark DataFrame operators."""
