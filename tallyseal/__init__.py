"""Record canonicalization, receipts and verification as Spark DataFrame operations."""
