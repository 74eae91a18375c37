"""A PySpark engine that prepares, annotates and evaluates move-prediction data."""
