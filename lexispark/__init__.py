"""lexispark: lexical reference data as PySpark DataFrame jobs."""
