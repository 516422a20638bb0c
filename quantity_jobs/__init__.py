"""PySpark jobs over construction quantity take-off records, keyed by project."""
