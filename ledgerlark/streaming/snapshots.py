"""A price snapshot kept up to date from landed quotes, and a write-once table of execution prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerlark.operators.valuation import latest
from ledgerlark.streaming import manifests
from ledgerlark.streaming.manifests import Manifest

#: Seconds between two polls that may be chosen; the first is the default.
INTERVALS = (900, 1800, 3600)
#: Why a line is in quarantine; the stream that a replay counts as.
MALFORMED, KEYLESS, REFUSED, REPLAY = "malformed", "keyless", "refused", "replay"
_BAD = "__malformed"


def trigger(seconds: int | None = INTERVALS[0]) -> dict:
    """Polling at an interval, or once over what has arrived (a manual refresh) with None."""
    if seconds is None:
        return {"availableNow": True}
    if seconds not in INTERVALS:
        raise ValueError(f"not one of {INTERVALS}: {seconds}")
    return {"processingTime": f"{seconds} seconds"}


def keep_latest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, order: str, seconds: int | None = None, accept: Callable[[DataFrame], bool] | None = None, buckets: int = 64) -> StreamingQuery:
    """Keeps under `target` the last row of each key among all rows that have arrived under `source` (JSON lines).

    Every batch that changes anything makes a version (see manifests.py). Keys
    are dealt into buckets, and a version rewrites only the buckets that its keys
    are in. A manifest names a version's folders, the number of buckets, and the
    last batch of each stream that has written here. So a batch that runs twice
    counts once, a stream with a new checkpoint goes on from what is there, and
    another number of buckets deals all rows anew.

    A line that is no JSON of the schema, one without key, and all lines of a
    batch that `accept` refuses are put into quarantine, in the same version: each
    line that arrives is either merged or there, once. See quarantined() and
    replay().
    """

    def merge(batch: DataFrame, number: int) -> None:
        owner = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        before = manifests.last(spark, target)
        if number > before.owners.get(owner, -1):
            _merged(spark, target, before, batch.select("value"), schema, key, order, buckets, accept, owner, number)

    return spark.readStream.text(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger(seconds)).start()


def _merged(spark: SparkSession, target: str, before: Manifest, lines: DataFrame, schema: str, key: str, order: str, buckets: int, accept: Callable[[DataFrame], bool] | None, owner: str, number: int, cleared: bool = False) -> Manifest:
    """Writes the version that lines lead to; with `cleared`, what was in quarantine before is dropped from it."""
    columns = [c for c in StructType.fromDDL(schema).fieldNames() if c != key]
    parsed = F.from_json("value", f"{schema}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD})
    reason = F.when(F.col("row").isNull() | F.col(f"row.{_BAD}").isNotNull(), MALFORMED).when(F.col(f"row.{key}").isNull(), KEYLESS)
    lines = lines.filter(F.length(F.trim("value")) > 0).select("value", parsed.alias("row")).withColumn("reason", reason).persist()
    try:
        good = lines.filter("reason is null").select(*[F.col(f"row.{c}").alias(c) for c in (key, *columns)])
        n_good, n_bad = lines.agg(F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())).first()
        if n_good + n_bad == 0 and not cleared:
            return before
        bad = lines.filter("reason is not null")
        if n_good and accept and not accept(good):
            bad, n_good, n_bad = lines.withColumn("reason", F.coalesce("reason", F.lit(REFUSED))), 0, n_good + n_bad
        after = before.following(owner, number, merged=n_good)
        if cleared:
            after.quarantine, after.quarantined = [], 0
        if n_bad:
            bad.select("value", "reason", F.lit(owner).alias("owner"), F.lit(number).cast("bigint").alias("batch")).write.parquet(f"{target}/{after.attempt}/quarantine")
            after.quarantine.append(f"{after.attempt}/quarantine")
            after.quarantined += n_bad
        if n_good:
            _merge_rows(spark, target, before, after, good, schema, key, order, columns, buckets)
        manifests.commit(spark, target, after)
        return after
    finally:
        lines.unpersist()


def _merge_rows(spark: SparkSession, target: str, before: Manifest, after: Manifest, good: DataFrame, schema: str, key: str, order: str, columns: list[str], buckets: int) -> None:
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    if before.buckets in (None, buckets):
        touched = {str(r[0]) for r in good.select(bucket).distinct().collect()}
    else:  # dealt anew, all of them
        touched, after.folders = set(before.folders), {}
    folders = [f"{target}/{f}" for b, f in before.folders.items() if b in touched]
    rows = good.unionByName(spark.read.schema(schema).parquet(*folders).select(key, *columns)) if folders else good
    latest(rows, key, order, columns).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{target}/{after.attempt}/rows")
    after.buckets = buckets
    after.folders |= {f.rsplit("=", 1)[1]: f"{after.attempt}/rows/{f}" for f in manifests.names(spark, f"{target}/{after.attempt}/rows", "bucket=*")}


def snapshot(spark: SparkSession, target: str, schema: str) -> DataFrame | None:
    """The last version, None if there is none."""
    folders = manifests.last(spark, target).folders.values()
    return spark.read.schema(schema).parquet(*[f"{target}/{f}" for f in folders]) if folders else None


def quarantined(spark: SparkSession, target: str) -> DataFrame:
    """Lines that are not in the snapshot: value, reason (malformed, keyless, refused), owner (the stream) and batch."""
    schema = "value string, reason string, owner string, batch bigint"
    folders = manifests.last(spark, target).quarantine
    return spark.read.schema(schema).parquet(*[f"{target}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def replay(spark: SparkSession, target: str, schema: str, key: str, order: str, mend: Callable[[DataFrame], DataFrame] = lambda lines: lines, accept: Callable[[DataFrame], bool] | None = None) -> None:
    """Merges what is in quarantine, as `mend` gives it (a table with the column value), in one version; what is still bad stays there.

    It is for times when no stream writes: of two writers of one version one fails.
    """
    before = manifests.last(spark, target)
    if before.quarantine:
        number = before.owners.get(REPLAY, -1) + 1
        _merged(spark, target, before, mend(quarantined(spark, target)).select("value"), schema, key, order, before.buckets or 64, accept, REPLAY, number, cleared=True)


def has_all(key: str, value: str, wanted: list[str]) -> Callable[[DataFrame], bool]:
    """Whether a table has a value for each of the wanted keys."""

    def complete(df: DataFrame) -> bool:
        return df.filter(F.col(key).isin(wanted) & F.col(value).isNotNull()).agg(F.count_distinct(key)).first()[0] == len(set(wanted))

    return complete


def written_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], complete: Callable[[DataFrame], bool] = lambda df: not df.isEmpty()) -> DataFrame:
    """A table that is made at its first use and read ever after.

    One that is not complete (by default an empty one; has_all() asks for each
    key) is returned, but not kept, so the next use tries again.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(conf).exists(done):
        return spark.read.parquet(path)
    made = make()
    if not complete(made):
        return made
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
