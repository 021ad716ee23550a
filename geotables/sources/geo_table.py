"""The key table: features stored as Parquet, range-partitioned and sorted by ``key`` (= cell '_' oid), and
directory-partitioned by a short cell prefix. A geohash-prefix scan then touches only the matching directories
(partition pruning) and row groups (min/max on ``key``), which is what a row-key prefix scan does on a sorted
key-value store.

A feature without a common cell (its envelope straddles the first division) lies in the directory ``NO_CELL``. The prefix
length is stored with the table (``_layout``, which Parquet readers skip) and comes back as metadata of ``cell_prefix``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotables.functions.shapes import RINGS_T
from geotables.model import FEATURE_COLUMNS
from geotables.operators.rebuild import repair_features
from geotables.session import scratch_path

PREFIX_LEN = 2
MAX_HEADS = 2000   # beginnings of prefixes that are looked up among the directories; more of them prune nothing
NO_CELL = "_"
LAYOUT = "_layout"
SCHEMA = ("key STRING, oid STRING, tags STRING, gtype STRING, rings " + RINGS_T + ", xmin DOUBLE, ymin DOUBLE, xmax DOUBLE,"
          " ymax DOUBLE, cell STRING, region STRING, cell_prefix STRING")


def _laid_out(df: DataFrame, prefix_len: int) -> DataFrame:
    out = df.select(*FEATURE_COLUMNS).withColumn(
        "cell_prefix", F.expr(f"coalesce(nullif(substring(cell, 1, {int(prefix_len)}), ''), '{NO_CELL}')"))
    # sorted by the directory first: the writer keeps this order, and with it the order by key within each file
    return out.repartitionByRange("cell_prefix", "key").sortWithinPartitions("cell_prefix", "key")


def write_geo_table(df: DataFrame, path: str, prefix_len: int = PREFIX_LEN, mode: str = "overwrite") -> None:
    """Write a feature table. Range partitioning keeps each task's output within a few cell-prefix directories and each
    file sorted by key, so files do not multiply with the number of prefixes."""
    _laid_out(df, prefix_len).write.mode(mode).partitionBy("cell_prefix").parquet(path)
    df.sparkSession.range(1).selectExpr(f"{int(prefix_len)} AS prefix_len").coalesce(1).write.mode("overwrite").json(
        f"{path.rstrip('/')}/{LAYOUT}")


def table_prefix_len(spark: SparkSession, path: str) -> int | None:
    """The stored prefix length, or None for a table that was written elsewhere, without one: its scans prune nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{LAYOUT}")
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return None
    return spark.read.schema("prefix_len INT").json(where.toString()).first().prefix_len


def read_geo_table(spark: SparkSession, path: str, num_partitions: int | None = None) -> DataFrame:
    df = spark.read.schema(SCHEMA).parquet(path)
    n = table_prefix_len(spark, path)
    if n is not None:
        df = df.withMetadata("cell_prefix", {"prefix_len": n})
    return df.repartition(num_partitions) if num_partitions else df


def read_repaired(spark: SparkSession, path: str, num_partitions: int | None = None,
                  rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of a stored table whose polygons are repaired as they are read (``repair_features``)."""
    return repair_features(read_geo_table(spark, path, num_partitions).select(*FEATURE_COLUMNS), rebuild)


def table_layout(df: DataFrame) -> int | None:
    """The length of the directory prefixes of a stored table that was read with it; None if it isn't known."""
    if "cell_prefix" not in df.columns:
        return None
    return df.schema["cell_prefix"].metadata.get("prefix_len")


def _pruning(prefix: str, n: int | None) -> Column | None:
    """Predicate on the partition column that every key starting with ``prefix`` meets; None if there is none."""
    cell, ended, _ = prefix.partition("_")
    if n is None or (not cell and not ended):
        return None
    if ended or len(cell) >= n:
        return F.col("cell_prefix") == F.lit(cell[:n] or NO_CELL)
    return F.col("cell_prefix").startswith(cell)


def _pruning_any(prefixes: list[str], n: int) -> Column:
    """``_pruning`` of any of the prefixes, as one set of directories and one of their beginnings for each shorter length: a
    condition for each prefix would nest deeper with every one of them."""
    by_length: dict[int, set[str]] = {}
    for prefix in prefixes:
        cell, ended, _ = prefix.partition("_")
        head = cell[:n] or NO_CELL
        by_length.setdefault(n if ended or len(cell) >= n else len(cell), set()).add(head)
    return reduce(lambda a, b: a | b, [
        (F.col("cell_prefix") if length == n else F.substring("cell_prefix", 1, length)).isin(sorted(heads))
        for length, heads in sorted(by_length.items())])


def _spread(df: DataFrame, num_partitions: int | None) -> DataFrame:
    return df.repartition(num_partitions) if num_partitions else df


def scan_prefixes(df: DataFrame, prefixes: list[str], keep_overlaps: bool = False,
                  num_partitions: int | None = None) -> DataFrame:
    """Rows whose key starts with any of a *small literal list* of geohash prefixes (duplicates in the list are
    scanned once; '' is a prefix of every key). The predicate is pushed to Parquet (StringStartsWith) and prunes
    cell-prefix directories.

    keep_overlaps=True returns one copy per matching prefix with a ``prefix`` column (nested prefixes repeat rows).
    An empty list gives an empty result. ``num_partitions`` deals the result out anew.
    """
    targets = list(dict.fromkeys(prefixes))
    n = table_layout(df)

    def one(p: str) -> Column:
        cond = F.col("key").startswith(p) if p else F.col("key").isNotNull()
        prune = _pruning(p, n)
        return cond if prune is None else cond & prune

    if not targets:
        out = df.where("false")
        return out.withColumn("prefix", F.lit("")) if keep_overlaps else out
    if not keep_overlaps:
        return _spread(df.where(reduce(lambda a, b: a | b, map(one, targets))), num_partitions)
    parts = [df.where(one(p)).withColumn("prefix", F.lit(p)) for p in targets]
    return _spread(reduce(DataFrame.unionByName, parts), num_partitions)


def _prefix_free(prefixes: DataFrame) -> DataFrame:
    """Drop every prefix that has a shorter prefix in the set: each key then matches at most one survivor."""
    shorter = prefixes.where("length(prefix) > 0").selectExpr(
        "prefix", "explode(transform(sequence(0, length(prefix) - 1), n -> substring(prefix, 1, n))) AS pp")
    covered = shorter.join(prefixes.withColumnRenamed("prefix", "pp"), "pp", "left_semi").select("prefix").distinct()
    return prefixes.join(covered, "prefix", "left_anti")


def scan_by_cell_prefix(df: DataFrame, prefixes: DataFrame, keep_overlaps: bool = False,
                        num_partitions: int | None = None) -> DataFrame:
    """Prefix scan driven by a *table* of prefixes (column ``prefix``): one scan, whose rows carry their key's prefixes at
    the lengths asked for (a small set read back once), and one equi-join with the prefixes.

    keep_overlaps=False joins with the prefix-free reduction of the set, so a row matches once at most and needs no
    ``distinct``; True gives one row per (row, prefix). The directories the prefixes can lie in prune the scan, unless there are
    more than ``MAX_HEADS`` of them.
    """
    targets = prefixes.select("prefix").where("prefix IS NOT NULL").distinct()
    if not keep_overlaps:
        targets = _prefix_free(targets)
    lengths = sorted(r[0] for r in targets.selectExpr("length(prefix) AS n").distinct().collect())
    if not lengths:
        out = df.where("false")
        return out.withColumn("prefix", F.lit("")) if keep_overlaps else out
    n = table_layout(df)
    if n is not None and lengths[0] > 0:
        head = f"substring(prefix, 1, {n + 1})"
        head = f"IF(contains({head}, '_'), {head}, substring(prefix, 1, {n}))"
        heads = [r[0] for r in targets.selectExpr(f"{head} AS p").distinct().limit(MAX_HEADS + 1).collect()]
        if len(heads) <= MAX_HEADS:
            df = df.where(_pruning_any(heads, n))
    arr = "array(" + ", ".join(str(v) for v in lengths) + ")"
    rows = df.selectExpr("*", f"explode(transform(filter({arr}, n -> n <= length(key)), n -> substring(key, 1, n))) AS prefix")
    out = rows.join(targets, "prefix").select(*df.columns, "prefix")
    return _spread(out if keep_overlaps else out.drop("prefix"), num_partitions)


def one_per_key(df: DataFrame) -> DataFrame:
    """One row of each key: the greatest one, column by column."""
    cols = [c for c in df.columns if c != "key"]
    return df.groupBy("key").agg(F.max(F.struct(*cols)).alias("r")).select("key", *[F.col(f"r.`{c}`").alias(c) for c in cols]) \
        .select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (one of each key) replace rows of ``existing`` with the same key (a put on an existing row key
    overwrites it); other rows of both are kept."""
    new = one_per_key(incoming.select(*existing.columns))
    return existing.join(new.select("key"), "key", "left_anti").unionByName(new)


def put_geo_table(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Put features into a stored table: rows with a known key are replaced, others added. Only the directories of the
    incoming cells are written; their new content is complete in a table of its own before the first of them changes."""
    n = table_prefix_len(spark, path)
    if n is None:
        raise ValueError(f"{path} says nothing of its directories; write it anew with write_geo_table")
    new = _laid_out(one_per_key(incoming.select(*FEATURE_COLUMNS)), n)
    heads = [r[0] for r in new.select("cell_prefix").distinct().collect()]  # no more than the table has directories
    if not heads:
        return
    old = spark.read.schema(SCHEMA).parquet(path).where(F.col("cell_prefix").isin(heads))
    whole = old.join(new.select("key"), "key", "left_anti").select(*FEATURE_COLUMNS).unionByName(new.select(*FEATURE_COLUMNS))
    staged = scratch_path(spark, "put")
    whole.write.parquet(staged)
    rows = spark.read.schema(whole.schema).parquet(staged)
    _laid_out(rows, n).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_prefix").parquet(path)
