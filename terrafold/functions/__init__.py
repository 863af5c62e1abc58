"""Column functions: exact integer arithmetic, ranges and buckets, labels."""
