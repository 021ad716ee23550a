"""Readers and writers: WKT text lines, the Parquet key table, WKB."""
