"""Exact deduplication as a stream with keyed, disk-backed state that never expires.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D].
A batch pass computes each row's digest; the small rows (digest, identifier, locator,
length) are the stream's arrivals. A streaming aggregation keyed on the digest keeps, in
RocksDB state without watermark or expiry, how many arrivals share the digest and which of
them stays, with its identifier and the locator of its content. A digest met more than
once is a hit: the row that stays is found by its locator and identifier, and the full normalised
bytes of every row of the digest are compared with its own. Where they differ, all rows of that digest are grouped again by their full
bytes. All of it is DataFrame code.

Defined results: null text counts as empty, and empty texts equal each other; of equal texts
the one with the most code points stays, ties go to the smaller doc_id; a null doc_id loses every
tie; rows that share doc_id and length with the one that stays count as kept; repeated rows each count in group_size and share their fate; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded, matching, materialise, scratch, text_key, unused

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # one store a partition: without this each reserves disk ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Files of arrivals that one micro-batch takes, and arrivals of one state store.
FILES, STORE = 10_000, 1_000_000
#: Rows of one group whose bytes one task compares; larger groups are dealt to several.
CHUNK = 1024


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _order() -> Column:
    """Larger for the row that stays: code points, then the smaller identifier (null last), then the smaller key of its text."""
    return F.struct("points", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("text_key").alias("not_key"), "locator")


def run_state(spark: SparkSession, arrivals_path: str, schema, files_per_trigger: int = FILES, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Stream the arrivals through the keyed state; its last value for each digest.

    With the checkpoint and out of an earlier run, only arrivals since then are read and its state goes on.
    """
    out, checkpoint = out or scratch(spark, "dedup-state"), checkpoint or scratch(spark, "dedup-stream")
    # a store takes memory of its own, so there are no more than the arrivals or the cores need
    rows = spark.read.schema(schema).parquet(arrivals_path).count()
    settings = STATE | {"spark.sql.shuffle.partitions": str(max(2 * spark.sparkContext.defaultParallelism, -(-rows // STORE)))}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)

    def save(df: DataFrame, batch: int) -> None:  # overwriting: a batch that runs again leaves one copy
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    try:
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(arrivals_path)
        state = arrivals.groupBy("digest").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(_order()).alias("best"),
        )
        query = (
            state.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    result_schema = "digest string, group_size bigint, best struct<points:bigint,not_id:bigint,not_key:bigint,locator:string>, batch int"
    if not query.recentProgress or not any(p["numInputRows"] for p in query.recentProgress):
        try:
            spark.read.parquet(out)
        except AnalysisException:  # no batch has ever been written
            return spark.createDataFrame([], result_schema).drop("batch")
    changes = spark.read.schema(result_schema).parquet(out)
    # the count only grows, so the largest row of a digest is its last
    return changes.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("last")).select("digest", "last.*")


def dedup(docs: DataFrame, digest: Callable[[Column], Column] | None = None, files_per_trigger: int = FILES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    digest maps the SHA-256 hex text to the state's key; a weaker one gives the same rows.
    """
    return _rows(docs, digest, files_per_trigger).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _rows(docs: DataFrame, digest=None, files_per_trigger: int = FILES) -> DataFrame:
    """The rows of dedup with text_key, which tells apart rows of one identifier, and the keeper's, keep_key."""
    spark = docs.sparkSession
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), text_key(F.col("text")).alias("text_key"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("points"), F.input_file_name().alias("locator"),
    )
    rows = _with_digest(source, digest).drop("norm", "text")
    path = scratch(spark, "dedup-arrivals")
    rows.write.mode("overwrite").parquet(path)
    arrivals = spark.read.schema(rows.schema).parquet(path)
    state = run_state(spark, path, rows.schema, files_per_trigger)
    hits = state.where("group_size > 1").select(
        "digest", "group_size", F.bitwise_not("best.not_id").alias("keep_id"), F.bitwise_not("best.not_key").alias("keep_key"),
        F.col("best.points").alias("keep_points"), F.col("best.locator").alias("keep_locator"),
    )
    hits = materialise(hits, "dedup-hits")
    n_hits, n_bad, bad = hits.count(), 0, None
    if n_hits:
        bad = materialise(_differing(source, arrivals, hits, n_hits, digest), "dedup-differing")
        n_bad = bad.count()
    verified = hits.select("digest", "group_size", "keep_id", "keep_key")
    rest = arrivals
    if n_bad:
        verified = verified.join(bounded(bad, n_bad), "digest", "left_anti")
        rest = arrivals.join(bounded(bad, n_bad), "digest", "left_anti")
    found = rest.join(bounded(verified, n_hits), "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        "text_sha256", "text_key", F.coalesce("keep_key", "text_key").alias("keep_key"),
    )
    if n_bad:
        found = found.unionByName(_by_bytes(source, bounded(bad, n_bad), digest))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _with_digest(source: DataFrame, digest) -> DataFrame:
    found = source.withColumn("norm", normalised(F.col("text")))
    found = found.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    return found.withColumn("digest", digest(F.col("text_sha256")) if digest else F.col("text_sha256"))


def _differing(source: DataFrame, arrivals: DataFrame, hits: DataFrame, n_hits: int, digest) -> DataFrame:
    """Digests of which some row's bytes differ from those of the row that stays.

    The locator that the state holds leads to the one row of a digest that stays: of the source's rows those with
    its locator, identifier and length are read for it. The rows of a digest are dealt to chunks by a number of their own,
    and each chunk meets one copy of the row that stays.
    """
    small = bounded(hits, n_hits)
    # only rows that share a digest need their bytes; the arrivals tell which they are
    ids = arrivals.join(bounded(hits.select("digest"), n_hits), "digest", "left_semi").select("text_key").distinct()
    ids = materialise(ids, "dedup-met")
    some = source.join(bounded(ids, ids.count()), "text_key", "left_semi")
    copies = _with_digest(some, digest).join(small, "digest").withColumn("chunks", F.ceil(F.col("group_size") / CHUNK).cast("int"))
    mine = copies.select("digest", "norm", F.pmod(F.monotonically_increasing_id(), F.col("chunks")).cast("int").alias("part"))
    located = (F.col("locator") == F.col("keep_locator")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    located &= (F.col("points") == F.col("keep_points")) & (F.col("text_key") == F.col("keep_key"))
    kept = copies.where(located).groupBy("digest").agg(F.min("norm").alias("kept_norm"), F.min("chunks").alias("chunks"))
    kept = kept.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
    kept = materialise(kept, "dedup-kept")
    if kept.select("digest").distinct().count() != n_hits:
        raise RuntimeError("a row that stays is no longer where its locator says; the source changed while it was read")
    return mine.join(kept, ["digest", "part"]).where("norm <> kept_norm").select("digest").distinct()


def _by_bytes(source: DataFrame, bad: DataFrame, digest) -> DataFrame:
    """The rows of digests that different texts share, grouped by their full bytes."""
    rows = _with_digest(source, digest).join(bad, "digest", "left_semi")
    groups = rows.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(_order()).alias("best"))
    return rows.join(groups, "norm").select(
        "doc_id", F.bitwise_not("best.not_id").alias("keep_id"), "group_size", "text_sha256", "text_key", F.bitwise_not("best.not_key").alias("keep_key")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group; all columns stay.

    Rows that share an identifier stand or fall by their own text. Where a row that stays is
    repeated, with its identifier and text, one of the repetitions stays.
    """
    found = materialise(_rows(docs), "dedup-result")
    dropped = found.where("not kept or text_key <> keep_key").select("doc_id", "text_key")
    left = matching(docs, dropped, dropped.count(), "left_anti")
    again = found.where("kept and text_key = keep_key and group_size > 1").groupBy("doc_id", "text_key").count().where("count > 1")
    again = materialise(again, "dedup-again")
    n = again.count()
    if not n:
        return left
    key = unused(docs, "_text_key")
    twice = matching(left, again, n, "left_semi").withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key])
    return matching(left, again, n, "left_anti").unionByName(twice.drop(key))


ORACLE_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
g as (
  select norm, count(*) as group_size,
         arg_min(doc_id, row(-points, doc_id)) as keep_id
  from n group by norm)
select n.doc_id, g.keep_id, g.group_size::bigint as group_size, n.doc_id = g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g on n.norm = g.norm
"""
