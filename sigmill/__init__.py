"""sigmill: a PySpark engine for free-text trouble reports and rolling-window incident signals."""
