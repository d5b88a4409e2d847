"""Corpora and logs read off the driver's tables, in Spark and as the oracle's common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.schema import METADATA_FILE, Snapshot

SCOPE = "5f" * 32
#: Galleries of a snapshot: the old one lacks one source, the new one another.
SNAPSHOTS = {"all": "true", "old": "source <> 'src3'", "new": "source <> 'src4'"}
LEASE_SECONDS, SCAN_SECONDS, POLL_SECONDS = 12 * 3600, 24 * 3600, 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, snapshot: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = table(spark, sf_dir, "documents").where(SNAPSHOTS[snapshot]).join(labels, "doc_id", "left")
    return rows.withColumn("gallery_key", F.lpad(F.col("doc_id").cast("string"), 8, "0"))


def document_corpus(spark: SparkSession, sf_dir: str, snapshot: str = "all") -> Snapshot:
    """A gallery per document, a file per line. The new snapshot has re-numbered and edited galleries."""
    d = _documents(spark, sf_dir, snapshot)
    new = snapshot == "new"
    gid = F.expr("1 + (doc_id + if(lang = 'es', 1, 0)) % 400" if new else "1 + doc_id % 400")
    galleries = d.select(
        "gallery_key", F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("gallery_name"), gid.cast("bigint").alias("gid"),
        F.left(F.substring_index("text", "\n", 1), F.lit(24)).alias("title"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 97 as int), 0)").alias("download_time"),
    )
    first = F.when(F.col("quality") == 0, 1).otherwise(0) if new else F.lit(0)
    lines = d.select("gallery_key", first.alias("first"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("pos >= first")
    name = F.concat(F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit(".txt"))

    def as_file(df, name, content):
        return df.select("gallery_key", name.alias("name"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("size_bytes"))

    files = as_file(lines, name, F.col("line")).unionByName(as_file(galleries, F.lit(METADATA_FILE), F.col("title")))
    tag = lambda df, ordinal, namespace, value: df.select("gallery_key", F.lit(ordinal).alias("ordinal"), F.lit(namespace).alias("namespace"), value.alias("value"))
    tags = tag(d, 0, "artist", F.col("source"))
    tags = tags.unionByName(tag(d.where("doc_id % 5 = 0"), 1, "artist", F.col("lang")))
    tags = tags.unionByName(tag(d, 2, "language", F.col("lang")))
    tags = tags.unionByName(tag(d.where("toxic = 1"), 3, "status", F.lit("Already Uploaded")))
    return Snapshot(galleries, files, tags)


def document_sql(p: str = "", snapshot: str = "all") -> str:
    new = snapshot == "new"
    gid = "1 + (doc_id + case when lang = 'es' then 1 else 0 end) % 400" if new else "1 + doc_id % 400"
    first = "case when quality = 0 then 1 else 0 end" if new else "0"
    return f"""
{p}d as (select d.doc_id, text, lang, source, quality, toxic, lpad(d.doc_id::varchar, 8, '0') as gallery_key
  from documents d left join labels l on d.doc_id = l.doc_id where {SNAPSHOTS[snapshot]}),
{p}g as (select gallery_key, source || '-' || doc_id as gallery_name, ({gid})::bigint as gid,
  left(split_part(text, chr(10), 1), 24) as title, timestamp '2024-01-01' + to_minutes(doc_id % 97) as download_time from {p}d),
{p}x as (select gallery_key, {first} as first_, unnest(string_split(text, chr(10))) as line,
  unnest(range(len(string_split(text, chr(10))))) as pos from {p}d),
{p}f as (select gallery_key, lpad(pos::varchar, 6, '0') || '.txt' as name, sha256(line) as sha256, strlen(line)::bigint as size_bytes from {p}x where pos >= first_
  union all select gallery_key, 'galleryinfo.txt', sha256(title), strlen(title)::bigint from {p}g),
{p}t as (select gallery_key, 0 as ordinal, 'artist' as namespace, source as value from {p}d
  union all select gallery_key, 1, 'artist', lang from {p}d where doc_id % 5 = 0
  union all select gallery_key, 2, 'language', lang from {p}d
  union all select gallery_key, 3, 'status', 'Already Uploaded' from {p}d where toxic = 1)"""


def order_corpus(spark: SparkSession, sf_dir: str) -> Snapshot:
    """A gallery per order, a file per line item; many share their content."""
    o = table(spark, sf_dir, "orders").withColumn("gallery_key", F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    galleries = o.select(
        "gallery_key", F.col("gallery_key").alias("gallery_name"), (F.col("o_custkey") + 1).cast("bigint").alias("gid"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp_ntz").alias("download_time"),
    )
    item = table(spark, sf_dir, "lineitem")
    text = F.concat_ws("|", "l_partkey", "l_returnflag", "l_linestatus")
    files = item.select(
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("gallery_key"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".txt")).alias("name"),
        F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("bigint").alias("size_bytes"),
    ).join(galleries.select("gallery_key"), "gallery_key", "left_semi")
    tags = o.select("gallery_key", F.lit(0).alias("ordinal"), F.lit("artist").alias("namespace"), F.col("o_orderstatus").alias("value"))
    done = o.where("o_orderstatus = 'P' and o_orderkey % 2 = 0").select("gallery_key", F.lit(1).alias("ordinal"), F.lit("status").alias("namespace"), F.lit("already UPLOADED").alias("value"))
    return Snapshot(galleries, files, tags.unionByName(done))


def order_sql(p: str = "") -> str:
    return f"""
{p}g as (select lpad(o_orderkey::varchar, 10, '0') as gallery_key, lpad(o_orderkey::varchar, 10, '0') as gallery_name,
  (o_custkey + 1)::bigint as gid, o_orderpriority as title, o_orderdate::timestamp as download_time from orders),
{p}f as (select lpad(l_orderkey::varchar, 10, '0') as gallery_key, l_linenumber || '.txt' as name,
  sha256(l_partkey || '|' || l_returnflag || '|' || l_linestatus) as sha256, strlen(l_partkey || '|' || l_returnflag || '|' || l_linestatus)::bigint as size_bytes
  from lineitem where l_orderkey in (select o_orderkey from orders)),
{p}t as (select lpad(o_orderkey::varchar, 10, '0') as gallery_key, 0 as ordinal, 'artist' as namespace, o_orderstatus as value from orders
  union all select lpad(o_orderkey::varchar, 10, '0'), 1, 'status', 'already UPLOADED' from orders where o_orderstatus = 'P' and o_orderkey % 2 = 0)"""


def policy_sql(p: str = "") -> str:
    """Oracle of the policy over {p}g, {p}f and {p}t, written from its rules."""
    return f"""
{p}pf as (select * from {p}f where name <> 'galleryinfo.txt'),
{p}occ as (select sha256, gallery_key, count(*) as n from {p}pf group by all),
{p}art as (select distinct gallery_key, value as artist from {p}t where namespace = 'artist'),
{p}ga as (select gallery_key, count(*) as c from {p}art group by 1),
{p}st as (select sha256, count(distinct artist) as da, max(c) as ma from {p}occ join {p}art using (gallery_key) join {p}ga using (gallery_key) group by 1),
{p}tot as (select sha256, sum(n)::bigint as total from {p}occ group by 1),
{p}spam as (select sha256, coalesce(total >= 3 and ma > 0 and da > 2 * ma, false) as is_spam from {p}tot left join {p}st using (sha256)),
{p}con as (select g.gallery_key, c.content_sha256 from {p}g g left join
  (select gallery_key, sha256(unhex(string_agg(sha256, '' order by sha256))) as content_sha256 from {p}pf
   where sha256 not in (select sha256 from {p}spam where is_spam) group by 1) c using (gallery_key)),
{p}up as (select distinct gallery_key from {p}t where lower(value) = 'already uploaded'),
{p}cand as (select g.gallery_key, gid, title, download_time, content_sha256, (g.gallery_key in (select gallery_key from {p}up)) as already_uploaded
  from {p}g g join {p}con c using (gallery_key)),
{p}own as (select content_sha256, arg_max(gallery_key, row(not already_uploaded, length(title), download_time, gid, gallery_key)) as gallery_key
  from {p}cand where content_sha256 is not null group by 1),
{p}comp as (select c.* from {p}cand c left join {p}own o on c.content_sha256 = o.content_sha256 where c.content_sha256 is null or o.gallery_key = c.gallery_key),
{p}win as (select gid, arg_max(gallery_key, row(not already_uploaded, length(title), download_time, gallery_key)) as gallery_key from {p}comp group by 1)"""


def _hex(prefix: str) -> str:
    return prefix.encode().hex().upper() + "00"


def artifact_sql(p: str = "", version: int = 1) -> str:
    """Oracle of plans, manifests and inputs, after policy_sql. Names are ASCII."""
    frame = lambda x: f"(printf('%016X', strlen({x})) || hex({x}))"
    return f"""
{p}plan as (select f.gallery_key, row_number() over (partition by f.gallery_key order by lower(name), name) - 1 as position, name, f.sha256, size_bytes,
  (name <> 'galleryinfo.txt' and f.sha256 in (select sha256 from {p}spam where is_spam)) as excluded from {p}f f),
{p}pd as (select gallery_key, count(*) as members, sha256(unhex(string_agg({frame("name")} || upper(sha256) || printf('%016X', size_bytes)
  || case when excluded then '01' else '00' end, '' order by position))) as plan_digest from {p}plan group by 1),
{p}fh as (select gallery_key, string_agg(printf('%016X', strlen(name) + 1 + 8 + 32) || hex(name) || '00' || printf('%016X', size_bytes) || upper(sha256), '' order by lower(name), name) as h from {p}f group by 1),
{p}th as (select gallery_key, string_agg(printf('%016X', strlen(namespace) + 1 + strlen(value)) || hex(namespace) || '00' || hex(value), '' order by ordinal) as h from {p}t group by 1),
{p}man as (select g.gallery_key, sha256(unhex('{_hex("shelfmark.source-manifest.1")}' || {frame("g.gallery_key")} || {frame("gallery_name")} || {frame("gid::varchar")}
  || {frame("title")} || {frame("strftime(download_time, '%Y-%m-%dT%H:%M:%S')")} || coalesce({p}th.h, '') || coalesce({p}fh.h, ''))) as source_manifest_sha256
  from {p}g g left join {p}th on g.gallery_key = {p}th.gallery_key left join {p}fh on g.gallery_key = {p}fh.gallery_key),
{p}inp as (select g.gallery_key, g.gid, m.source_manifest_sha256, pd.plan_digest, pd.members, c.content_sha256 as effective_content_sha256,
  o.gallery_key as content_owner_gallery_key,
  (c.content_sha256 is null or o.gallery_key = g.gallery_key) and coalesce(w.gallery_key = g.gallery_key, false) as selected, {version}::bigint as policy_version
  from {p}g g join {p}con c on g.gallery_key = c.gallery_key left join {p}own o on c.content_sha256 = o.content_sha256 left join {p}win w on g.gid = w.gid
  join {p}man m on g.gallery_key = m.gallery_key left join {p}pd pd on g.gallery_key = pd.gallery_key)"""


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators and directory entries of the pages table."""
    pages = table(spark, sf_dir, "pages")
    rows = pages.withColumn("components", F.filter(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), lambda x: x != ""))
    size = F.octet_length("html").cast("bigint")
    return rows.select(
        "page_id", "components", F.array_join("components", "/").alias("gallery_key"), F.lpad(F.col("page_id").cast("string"), 6, "0").alias("name"),
        F.lit(8).cast("bigint").alias("device"), (F.col("page_id") + 1000).alias("inode"), size.alias("size_bytes"),
        (size * 1000).alias("modified_ns"), (size * 1000 + F.col("page_id")).alias("changed_ns"), (F.col("page_id") % 4).cast("int").alias("file_type"),
    )


PAGES_SQL = """
pe as (select page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') as components, html from pages),
e as (select page_id, components, array_to_string(components, '/') as gallery_key, lpad(page_id::varchar, 6, '0') as name, 8::bigint as device, page_id + 1000 as inode,
  strlen(html)::bigint as size_bytes, strlen(html)::bigint * 1000 as modified_ns, strlen(html)::bigint * 1000 + page_id as changed_ns, (page_id % 4)::int as file_type,
  '00000001' || printf('%08X', len(components)) || list_aggregate(list_transform(components, lambda x: printf('%08X', strlen(x)) || hex(x)), 'string_agg', '') as payload from pe)"""


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as calls of workers on their leases."""
    kind = F.expr("case event_type when 'signup' then 'claim' when 'view' then 'renew' when 'purchase' then 'complete' when 'error' then 'fail' else 'poll' end")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"), kind.alias("kind")
    )


LEASE_SQL = """
ev as (select user_id as worker, event_id as seq, epoch_us(ts) as at_micros,
  case event_type when 'signup' then 'claim' when 'view' then 'renew' when 'purchase' then 'complete' when 'error' then 'fail' else 'poll' end as kind from events)"""


def token_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("token"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "release").otherwise("protect").alias("op"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("locator"),
    )


def published_states(spark: SparkSession, sf_dir: str):
    """The old and the new snapshot, evaluated in full."""
    from shelfmark.operators.incremental import Evaluation, stored

    return tuple(Evaluation(stored(document_corpus(spark, sf_dir, x)), ascii_names=True) for x in ("old", "new"))


def projections(spark: SparkSession, sf_dir: str):
    """Pending paths (winners of the new snapshot), current ones (of the old) and what is seen on disk."""
    from shelfmark.functions.paths import friendly_leaf
    from shelfmark.session import written

    def published(state):
        rows = state.winners.join(state.candidates.drop("gid"), "gallery_key").where("content_sha256 is not null")
        leaf = friendly_leaf(F.col("gid"), F.col("title")).alias("path_name")
        return written(rows.select(leaf, "gid", F.col("content_sha256").alias("artifact_sha256"), (F.col("gid") * 10).alias("size_bytes")), "published")

    old, new = published_states(spark, sf_dir)
    pending, current = published(new), published(old).withColumn("signature", F.substring("artifact_sha256", 1, 8))
    both = pending.select("path_name", F.col("artifact_sha256").alias("p"), F.col("size_bytes").alias("ps")).join(
        current.select("path_name", F.col("artifact_sha256").alias("c"), F.col("signature").alias("sig")), "path_name", "full_outer"
    )
    case = F.pmod(F.conv(F.substring(F.md5("path_name"), 1, 4), 16, 10).cast("int"), F.lit(5))
    seen = both.withColumn("case", case).where("case <> 0")
    observed = seen.select(
        "path_name", F.when(F.col("case") == 3, "directory").when(F.col("case") == 4, "other").otherwise("regular").alias("kind"),
        F.when(F.col("case") == 1, F.coalesce("sig", F.lit("none"))).otherwise("other").alias("signature"),
        F.when(F.col("case") == 1, F.col("p")).otherwise(F.lit("0" * 64)).alias("sha256"), F.col("ps").alias("size_bytes"),
    )
    return pending, current, observed


def projection_sql() -> str:
    leaf = """gid || ' - ' || (case when strlen(s) <= 251 - strlen(gid || ' - ') then s
      else left(s, list_max(list_filter(range(0, least(length(s), 251)::bigint + 1), lambda n: strlen(left(s, n::int)) <= 251 - strlen(gid || ' - ')))::int) end) || '.cbz'"""

    def side(p):
        return f"""
{p}s as (select w.gid, c.content_sha256, case when c.title = '' then 'gallery' else replace(replace(c.title, '/', '_'), '\\', '_') end as s
  from {p}win w join {p}cand c on w.gallery_key = c.gallery_key where c.content_sha256 is not null),
{p}pub as (select {leaf} as path_name, gid, content_sha256 as artifact_sha256, gid * 10 as size_bytes, substr(content_sha256, 1, 8) as signature from {p}s)"""

    return ",".join([document_sql("o_", "old"), policy_sql("o_"), document_sql("n_", "new"), policy_sql("n_"), side("o_"), side("n_")]) + """,
obs0 as (select coalesce(p.path_name, c.path_name) as path_name, p.artifact_sha256 as p, p.size_bytes as ps, c.artifact_sha256 as c, c.signature as sig,
  ('0x' || substr(md5(coalesce(p.path_name, c.path_name)), 1, 4))::int % 5 as k from n_pub p full join o_pub c on p.path_name = c.path_name),
obs as (select path_name, case k when 3 then 'directory' when 4 then 'other' else 'regular' end as kind,
  case when k = 1 then coalesce(sig, 'none') else 'other' end as signature, case when k = 1 then p else repeat('0', 64) end as sha256, ps as size_bytes from obs0 where k <> 0)"""


#: A log of projection events that reaches every transition.
PHASE_EVENTS = [
    ("a", 1, "begin", 5, "r5", None), ("a", 2, "append", 5, "r5", "k1"), ("a", 3, "append", 5, "r5", "k1"), ("a", 4, "append", 5, "r5", "k2"),
    ("a", 5, "begin", 5, "r5", None), ("a", 6, "begin", 6, "r6", None), ("a", 7, "begin", 5, "rx", None), ("a", 8, "reconcile", 5, "r5", None),
    ("a", 9, "seal", 5, "r5", None), ("a", 10, "append", 5, "r5", "k3"), ("a", 11, "begin", 5, "r5", None), ("a", 12, "crash", 5, "r5", None),
    ("a", 13, "begin", 5, "r5", None), ("a", 14, "reconcile", 5, "r5", None), ("a", 15, "begin", 5, "r5", None), ("a", 16, "begin", 5, "ry", None),
    ("a", 17, "begin", 4, "r4", None), ("b", 1, "seal", 1, "s1", None), ("b", 2, "begin", 1, "s1", None), ("b", 3, "append", 1, "s1", "m"),
    ("c", 1, "begin", 2, "t2", None), ("c", 2, "seal", 2, "t2", None), ("d", 1, "append", 1, "u1", "z"),
]


def phase_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHASE_EVENTS, "projection string, seq bigint, event string, revision bigint, receipt string, key string")
