"""Readers and writers: JDBC, layered Parquet storage, catalog tables, reports."""
