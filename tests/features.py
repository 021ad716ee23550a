"""Feature tables for tests."""


def features_from_wkt(spark, rows):
    """Feature table from (wkt, oid, tags) tuples through the WKT ingest path."""
    from geotables.sources.wkt_text import ingest_lines
    lines = spark.createDataFrame([("\t".join(r),) for r in rows], "value string")
    return ingest_lines(lines)
