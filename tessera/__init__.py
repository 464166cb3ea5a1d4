"""A small analytics engine on PySpark: strict SQL over versioned Parquet tables."""
