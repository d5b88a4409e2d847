"""The catalogue's queries over the driver's tables, each with its oracle in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import codec, paths
from shelfmark.operators import artifacts, audit, delta, evidence, incremental, lease, paging, projection, tokens, winners
from shelfmark.plans import fixtures as fx
from shelfmark.schema import Context, Policy, Snapshot, is_component, is_int63, is_key_segment, is_sha256, is_uint64, violations
from shelfmark.sources import sinks
from shelfmark.sources.adapter import SourceAdapter
from shelfmark.sources.tree import local_folder, planted
from shelfmark.streaming.leases import lease_stream_check

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _ORACLES[name or f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _f1(rest: str, policy: bool = True, artifact: bool = False) -> str:
    steps = [fx.document_sql()] + ([fx.policy_sql()] if policy or artifact else []) + ([fx.artifact_sql()] if artifact else [])
    return "with " + ",".join(steps) + "\n" + rest


def _f2(rest: str) -> str:
    return "with " + fx.order_sql() + "," + fx.policy_sql() + "\n" + rest


def _f3(rest: str) -> str:
    steps = [fx.document_sql("o_", "old"), fx.policy_sql("o_"), fx.artifact_sql("o_"), fx.document_sql("n_", "new"), fx.policy_sql("n_"), fx.artifact_sql("n_")]
    return "with " + ",".join(steps) + "\n" + rest


def _full(spark, d, snapshot="all", policy=Policy()):
    return incremental.Evaluation(incremental.stored(fx.document_corpus(spark, d, snapshot)), policy, ascii_names=True)


def _orders(spark, d):
    return incremental.Evaluation(incremental.stored(fx.order_corpus(spark, d)), ascii_names=True)


def _step(spark, d):
    return incremental.Step(_full(spark, d, "old"), incremental.stored(fx.document_corpus(spark, d, "new")))


# --- evidence and spam -----------------------------------------------------------------


@query(_f1("select gallery_key, name, sha256, size_bytes from pf"))
def policy_files(spark, d):
    return evidence.policy_files(fx.document_corpus(spark, d).files)


@query(_f1("select gallery_key, artist from art"))
def gallery_artists(spark, d):
    return evidence.artists(fx.document_corpus(spark, d).tags)


@query(_f1("select gallery_key from up"))
def already_uploaded(spark, d):
    return evidence.uploaded(fx.document_corpus(spark, d).tags)


@query(_f1("select sha256, gallery_key, n as occurrence_count from occ"))
def hash_occurrences(spark, d):
    return evidence.occurrences(fx.document_corpus(spark, d).files)


@query(_f1("select sha256, total as occurrence_count from tot"))
def hash_totals(spark, d):
    return evidence.totals(fx.document_corpus(spark, d).files)


@query(_f1("select sha256, da as distinct_artists, ma as max_artists from st"))
def hash_artist_stats(spark, d):
    s = fx.document_corpus(spark, d)
    return evidence.artist_stats(evidence.occurrences(s.files), s.tags)


@query(_f1("""select sha256, string_agg(gallery_key || '=' || n || '[' || coalesce(a, '') || ']', ';' order by gallery_key) as evidence
from occ left join (select gallery_key, string_agg(artist, ',' order by artist) as a from art group by 1) using (gallery_key) group by 1"""))
def hash_evidence_nested(spark, d):
    found = evidence.evidence(fx.document_corpus(spark, d))
    item = F.transform("evidence", lambda e: F.concat(e["gallery_key"], F.lit("="), e["occurrence_count"].cast("string"), F.lit("["), F.array_join(e["artists"], ","), F.lit("]")))
    return found.select("sha256", F.array_join(item, ";").alias("evidence"))


_SPAM = "select s.sha256, is_spam, total as occurrence_count from spam s join tot using (sha256)"


@query(_f1(_SPAM))
def spam_hashes(spark, d):
    s = fx.document_corpus(spark, d)
    return evidence.spam(s).join(evidence.totals(s.files), "sha256")


@query(_f2(_SPAM))
def spam_hashes_orders(spark, d):
    s = fx.order_corpus(spark, d)
    return evidence.spam(s).join(evidence.totals(s.files), "sha256")


# --- content, owners, winners ------------------------------------------------------------


@query(_f1("select gallery_key, content_sha256 from con"))
def effective_content(spark, d):
    return _full(spark, d).content


@query(_f2("select gallery_key, content_sha256 from con"))
def effective_content_orders(spark, d):
    return _orders(spark, d).content


@query(_f1("select gallery_key, gid, title, epoch_us(download_time) as download_micros, content_sha256, already_uploaded from cand where content_sha256 is not null"))
def content_candidates(spark, d):
    rows = _full(spark, d).candidates.where("content_sha256 is not null")
    return rows.select("gallery_key", "gid", "title", codec.wall_micros(F.col("download_time")).alias("download_micros"), "content_sha256", "already_uploaded")


@query(_f1("select content_sha256, count(*) as candidates from cand where content_sha256 is not null group by 1"))
def content_groups(spark, d):
    return winners.content_groups(_full(spark, d).candidates)


@query(_f1("select content_sha256, gallery_key from own"))
def content_owners(spark, d):
    return _full(spark, d).owners


@query(_f2("select content_sha256, gallery_key from own"))
def content_owners_orders(spark, d):
    return _orders(spark, d).owners


@query(_f1("select gallery_key, gid, content_sha256 from comp"))
def gid_candidates(spark, d):
    return _full(spark, d).competing.select("gallery_key", "gid", "content_sha256")


@query(_f1("select gid, gallery_key from win"))
def catalog_winners(spark, d):
    return _full(spark, d).winners


@query(_f2("select gid, gallery_key from win"))
def catalog_winners_orders(spark, d):
    return _orders(spark, d).winners


# --- artifacts -------------------------------------------------------------------------


@query(_f1("""select gallery_key, position, 'source' as entry_kind, name as source_name, sha256 as source_sha256, size_bytes as source_size_bytes, excluded,
case when name = 'galleryinfo.txt' then 'metadata' else 'content' end as file_role, case when not excluded then name end as archive_member_name, 'source_copy' as transform_kind from plan""", artifact=True))
def member_plan(spark, d):
    s = fx.document_corpus(spark, d)
    return artifacts.member_plan(s.files, evidence.spam(s), ascii_names=True).drop("generated_identity", "payload_sha256")


@query(_f1("select gallery_key, source_manifest_sha256 from man", artifact=True))
def source_manifest(spark, d):
    return artifacts.source_manifest(fx.document_corpus(spark, d), ascii_names=True)


_INPUTS = "select gallery_key, gid, source_manifest_sha256, plan_digest, members, effective_content_sha256, content_owner_gallery_key, selected, policy_version from inp"


@query(_f1(_INPUTS, artifact=True))
def artifact_inputs(spark, d):
    return _full(spark, d).inputs


@query(_f1(_INPUTS + " where selected", artifact=True))
def selected_artifacts(spark, d):
    return artifacts.selected(_full(spark, d).inputs)


@query(_f1("select gallery_key, gid, effective_content_sha256 from inp where selected and effective_content_sha256 is not null", artifact=True))
def publications(spark, d):
    return artifacts.publications(_full(spark, d).inputs).select("gallery_key", "gid", "effective_content_sha256")


@query(_f1("select count(*) as publications from inp where selected and effective_content_sha256 is not null", artifact=True))
def publication_count(spark, d):
    return artifacts.publications(_full(spark, d).inputs).agg(F.count(F.lit(1)).alias("publications"))


# --- deltas ------------------------------------------------------------------------------

_EVIDENCE_OF = """(select sha256, string_agg(gallery_key || '=' || n || '[' || coalesce(a, '') || ']', ';' order by gallery_key) as e
  from {p}occ left join (select gallery_key, string_agg(artist, ',' order by artist) as a from {p}art group by 1) using (gallery_key) group by 1)"""


@query(_f3(f"""select coalesce(a.sha256, b.sha256) as sha256, case when a.e is null then 'added' when b.e is null then 'removed' else 'changed' end as change
from {_EVIDENCE_OF.format(p="o_")} a full join {_EVIDENCE_OF.format(p="n_")} b on a.sha256 = b.sha256 where a.e is distinct from b.e"""))
def evidence_delta(spark, d):
    old, new = (evidence.evidence_digest(fx.document_corpus(spark, d, x)) for x in ("old", "new"))
    return delta.evidence_delta(old, new)


_CHANGED_SPAM = "(select coalesce(a.sha256, b.sha256) as sha256 from o_spam a full join n_spam b on a.sha256 = b.sha256 where coalesce(a.is_spam, false) <> coalesce(b.is_spam, false))"


@query(_f3(f"select sha256 from {_CHANGED_SPAM}"))
def changed_spam(spark, d):
    return _step(spark, d).changed_spam


@query(_f3(f"""select gallery_key from (select coalesce(a.gallery_key, b.gallery_key) as gallery_key from o_man a full join n_man b on a.gallery_key = b.gallery_key
where a.source_manifest_sha256 is distinct from b.source_manifest_sha256) union select gallery_key from n_pf where sha256 in (select sha256 from {_CHANGED_SPAM})"""))
def content_impacted(spark, d):
    return _step(spark, d).impacted


def _workset(relation: str, group: str) -> str:
    row = "row({0}.gid, {0}.title, {0}.download_time, {0}.content_sha256, {0}.already_uploaded)"
    where = f"(a.gallery_key is null or b.gallery_key is null or {row.format('a')} is distinct from {row.format('b')})"
    both = f"(select * from o_{relation}) a full join (select * from n_{relation}) b on a.gallery_key = b.gallery_key where {where}"
    return f"select {group} from (select a.{group} from {both} union select b.{group} from {both}) where {group} is not null"


@query(_f3(_workset("cand", "content_sha256")))
def owner_workset(spark, d):
    return _step(spark, d).owner_workset


@query(_f3("select content_sha256 from o_own except select content_sha256 from n_own"))
def owner_tombstones(spark, d):
    return _step(spark, d).owner_tombstones


@query(_f3(_workset("comp", "gid")))
def winner_workset(spark, d):
    return _step(spark, d).winner_workset


@query(_f3("select gid from o_win except select gid from n_win"))
def winner_tombstones(spark, d):
    return _step(spark, d).winner_tombstones


_OWNERS_GONE = "select content_sha256 from o_own except select content_sha256 from n_own"
_WINNERS_GONE = "select gid from o_win except select gid from n_win"


@query(_f3(f"""select 'owner' as relation, count(*) as outside from ({_OWNERS_GONE}) where content_sha256 not in ({_workset("cand", "content_sha256")})
union all select 'winner', count(*) from ({_WINNERS_GONE}) where gid not in ({_workset("comp", "gid")})"""))
def tombstones_outside_workset(spark, d):
    """Tombstones that their workset lacks: none."""
    step = _step(spark, d)
    count = lambda a, b, key, name: a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("outside")).select(F.lit(name).alias("relation"), "outside")
    return count(step.owner_tombstones, step.owner_workset, "content_sha256", "owner").unionByName(
        count(step.winner_tombstones, step.winner_workset, "gid", "winner")
    )


_DELTA = """(select coalesce(a.gallery_key, b.gallery_key) as gallery_key, case when a.gallery_key is null then 'create' when b.gallery_key is null then 'delete'
  when row(a.gid, a.source_manifest_sha256, a.plan_digest, a.effective_content_sha256, a.content_owner_gallery_key, a.policy_version)
   is not distinct from row(b.gid, b.source_manifest_sha256, b.plan_digest, b.effective_content_sha256, b.content_owner_gallery_key, b.policy_version) then 'unchanged' else 'rebuild' end as op
  from (select * from o_inp where selected) a full join (select * from n_inp where selected) b on a.gallery_key = b.gallery_key)"""


@query(_f3(f"select gallery_key, op from {_DELTA}"))
def artifact_delta(spark, d):
    return _step(spark, d).artifact_delta


@query(_f3(f"""select op, count(*) as galleries, max(n) as ops_of_a_gallery
from (select gallery_key, max(op) as op, count(*) as n from {_DELTA} group by 1) group by 1"""))
def artifact_delta_partition_check(spark, d):
    rows = _step(spark, d).artifact_delta
    each = rows.groupBy("gallery_key").agg(F.count(F.lit(1)).alias("n"), F.max("op").alias("op"))
    return each.groupBy("op").agg(F.count(F.lit(1)).alias("galleries"), F.max("n").alias("ops_of_a_gallery"))


@query(_f3(_INPUTS.replace("from inp", "from n_inp")))
def incremental_state(spark, d):
    """The state reached step by step; the oracle evaluates the new snapshot in full."""
    return _step(spark, d).inputs


@query(_f3("select gid, gallery_key from n_win"))
def incremental_winners(spark, d):
    return _step(spark, d).winners


@query(_f1("select gallery_key, 'rebuild' as op from inp where selected", artifact=True))
def policy_change_rebuild(spark, d):
    """Under another policy version every selected artifact is built again."""
    snapshot = incremental.stored(fx.document_corpus(spark, d))
    old, new = (incremental.Evaluation(snapshot, Policy(version=v), ascii_names=True) for v in (1, 2))
    return delta.artifact_delta(old.inputs, new.inputs)


@query(_f1("select sha256, is_spam, (('0x' || substr(sha256, 1, 8))::bigint % 16)::int as shard from spam"))
def shard_classification(spark, d):
    return incremental.sharded_spam(fx.document_corpus(spark, d), Policy(), 16)


_CONTEXTS = {
    "same": (Context("s", "stable", 3, 1), Context("s", "stable", 3, 1), Context("s", "stable", 4, 2), 1, 1),
    "policy": (Context("s", "stable", 3, 1), Context("s", "stable", 3, 1), Context("s", "stable", 4, 2), 1, 2),
    "revision": (Context("s", "stable", 3, 1), Context("s", "stable", 2, 1), Context("s", "stable", 4, 2), 1, 1),
    "generation": (Context("s", "stable", 3, 1), Context("s", "stable", 3, 0), Context("s", "stable", 4, 2), 1, 1),
    "channel": (Context("s", "stable", 3, 1), Context("s", "stable", 3, 1), Context("s", "preview", 4, 2), 1, 1),
    "scope": (Context("s", "stable", 3, 1), Context("s", "stable", 3, 1), Context("u", "stable", 4, 2), 1, 1),
}


@query("""select * from (values ('same', 'ok'), ('policy', 'policy'), ('revision', 'baseline'), ('generation', 'baseline'), ('channel', 'channel'), ('scope', 'scope')) v("case", result)""")
def context_guard(spark, d):
    rows = [(k, delta.context_error(a, b, c, Policy(version=p), Policy(version=q)) or "ok") for k, (a, b, c, p, q) in _CONTEXTS.items()]
    return spark.createDataFrame(rows, "case string, result string")


_BROKEN_GALLERIES = [("g1", "n", 1, "t", None), ("g1", "n", 2, "t", None), ("g2", "n", 0, None, None)]
_BROKEN_FILES = [("g1", "a", "ab" * 32, 1), ("g1", "a", "ab" * 32, 1), ("g2", "..", "zz", -1), ("g3", "b", "cd" * 32, 0)]


@query("""select * from (values ('gid_positive', 'g2', '0'), ('title_present', 'g2', null), ('gallery_key_unique', 'g1', '2'), ('file_name_unique', 'g1', 'a'),
('file_name_component', 'g2', '..'), ('file_sha256', 'g2', 'zz'), ('file_size', 'g2', '-1'), ('file_gallery_exists', 'g3', 'b'), ('tag_gallery_exists', 'g9', '0')) v(rule, gallery_key, detail)""")
def constraint_violations(spark, d):
    """Broken literal rows, beside the whole document corpus, which breaks no rule."""
    broken = Snapshot(
        spark.createDataFrame(_BROKEN_GALLERIES, "gallery_key string, gallery_name string, gid bigint, title string, download_time timestamp_ntz"),
        spark.createDataFrame(_BROKEN_FILES, "gallery_key string, name string, sha256 string, size_bytes bigint"),
        spark.createDataFrame([("g9", 0, "artist", "x")], "gallery_key string, ordinal int, namespace string, value string"),
    )
    return violations(broken).unionByName(violations(fx.document_corpus(spark, d)))


_DOMAINS = [("a", "ab" * 32, "1"), ("..", "AB" * 32, "-1"), ("x/y", "ab" * 31, "18446744073709551615"), ("back\\slash", "", "18446744073709551616"), ("", None, "9223372036854775807"), ("é" * 128, "0" * 64, "0")]


@query("""select * from (values (0::bigint, true, true, true, true, true), (1, false, false, false, false, false), (2, false, false, false, true, true),
(3, true, false, false, false, true), (4, false, false, false, true, true), (5, false, false, true, true, true)) v(id, component, segment, sha256, uint64, int63)""")
def domain_checks(spark, d):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(_DOMAINS)], "id bigint, name string, hash string, number string")
    n = F.col("number").cast("decimal(38,0)")
    return rows.select("id", is_component(F.col("name")).alias("component"), is_key_segment(F.col("name")).alias("segment"), is_sha256(F.col("hash")).alias("sha256"), is_uint64(n).alias("uint64"), is_int63(n).alias("int63"))


# --- codecs, paging, audits --------------------------------------------------------------

_LIST_PAYLOAD = "list_aggregate(list_transform({0}, lambda x: printf('%08X', strlen(x)) || hex(x)), 'string_agg', '')"


@query(f"with {fx.document_sql()} select gallery_key, sha256(unhex('{codec.prefix_hex(codec.GALLERY_KEY_PREFIX)}' || '00000001' || upper('{fx.SCOPE}') || printf('%08X', 2) || {_LIST_PAYLOAD.format('[source, gallery_key]')})) as stable_key from d")
def stable_gallery_key(spark, d):
    rows = fx._documents(spark, d, "all")
    return rows.select("gallery_key", codec.gallery_key(F.lit(fx.SCOPE), F.array("source", "gallery_key")).alias("stable_key"))


@query(_f1(f"select distinct gid, sha256(unhex('{codec.prefix_hex(codec.PUBLICATION_PREFIX)}' || '00000001' || printf('%016X', gid))) as publication_key from g"))
def publication_key(spark, d):
    return fx.document_corpus(spark, d).galleries.select("gid", codec.publication_key(F.col("gid")).alias("publication_key")).distinct()


@query(_f1("select distinct content_sha256, 'sha256/' || substr(content_sha256, 1, 2) || '/' || content_sha256 || '.cbz' as locator, true as valid, content_sha256 as derived from con where content_sha256 is not null"))
def artifact_locator(spark, d):
    rows = _full(spark, d).content.where("content_sha256 is not null").select("content_sha256").distinct()
    locator = codec.artifact_locator(F.col("content_sha256"))
    return rows.withColumn("locator", locator).withColumn("valid", codec.is_artifact_locator(F.col("locator"))).withColumn("derived", codec.locator_digest(F.col("locator")))


def _p4(rest: str) -> str:
    return "with " + fx.PAGES_SQL + "\n" + rest


def _payloads(spark, d):
    return fx.page_entries(spark, d).withColumn("payload", codec.locator_payload(F.col("components")))


@query(_p4("select page_id, payload, row_number() over (order by unhex(payload), page_id) - 1 as place from e"))
def locator_order(spark, d):
    key = F.struct("payload", "page_id")
    rows = paging.ranged(_payloads(spark, d).withColumn("key", key), "key", 128)
    return rows.select("page_id", F.hex("payload").alias("payload"), "place")


@query(_p4("""select page, count(*) as items, min(payload) as first_payload, case when (page + 1) * 128 < max(total) then max(payload) end as next_after
from (select payload, (row_number() over (order by unhex(payload), page_id) - 1) // 128 as page, count(*) over () as total from e) group by page"""))
def locator_pages(spark, d):
    rows = paging.ranged(_payloads(spark, d).withColumn("key", F.struct("payload", "page_id")), "key", 128)
    rows = rows.groupBy("page").agg(F.count(F.lit(1)).alias("items"), F.min("payload").alias("a"), F.max("payload").alias("b"), F.bool_or("terminal").alias("t"))
    return rows.select("page", "items", F.hex("a").alias("first_payload"), F.hex(F.when(~F.col("t"), F.col("b"))).alias("next_after"))


@query(_p4("select page_id, array_to_string(components, '/') as components, true as same from e"))
def locator_roundtrip(spark, d):
    rows = _payloads(spark, d).withColumn("decoded", codec.decode_locator(F.col("payload")))
    return rows.select("page_id", F.array_join("decoded", "/").alias("components"), (F.col("decoded") == F.col("components")).alias("same"))


_ENTRY = "printf('%08X', strlen(name)) || hex(name) || printf('%016X', device) || printf('%016X', inode) || printf('%016X', size_bytes) || printf('%016X', modified_ns) || printf('%016X', changed_ns) || printf('%02X', file_type)"
_AUDIT = f"(select gallery_key, sha256(unhex('{codec.prefix_hex(codec.ENTRY_PREFIX)}' || string_agg({_ENTRY}, '' order by name))) as entry_audit, count(*) filter (file_type = 0) as regular_files from e group by 1)"


@query(_p4(f"select * from {_AUDIT}"))
def entry_audit(spark, d):
    return audit.entry_audit(fx.page_entries(spark, d))


@query(_f1(f"""select gallery_key, sha256(unhex('{codec.prefix_hex(codec.METADATA_PREFIX)}' || {" || ".join(f"repeat('0', 16) || printf('%016X', {c})" for c in ("gid", "epoch_us(download_time) - 60000000", "epoch_us(download_time)", "0", "1", "n", "n - 1"))}
 || {" || ".join(f"printf('%016X', strlen({c})) || hex({c})" for c in ("title", "gallery_name", "''"))})) as metadata_audit from g join (select gallery_key, count(*) as n from f group by 1) using (gallery_key)"""))
def metadata_audit(spark, d):
    s = fx.document_corpus(spark, d)
    n = s.files.groupBy("gallery_key").agg(F.count(F.lit(1)).alias("source_file_count"))
    rows = s.galleries.join(n, "gallery_key").withColumn("download_micros", codec.wall_micros(F.col("download_time")))
    return audit.metadata_audit(rows.select(
        "gallery_key", "gid", (F.col("download_micros") - 60_000_000).alias("upload_time"), "download_micros", F.lit(0).cast("bigint").alias("modified_time"),
        F.lit(1).cast("bigint").alias("scan_version"), "source_file_count", (F.col("source_file_count") - 1).alias("page_count"), "title",
        F.col("gallery_name").alias("comment"), F.lit("").alias("upload_account"),
    ))


@query(_p4("select gallery_key, 'changed' as fault from e group by 1 having bool_or(file_type = 2)"))
def replay_violations(spark, d):
    """Seen again, symbolic links have other times: their directories are reported."""
    rows = fx.page_entries(spark, d)
    again = rows.withColumn("changed_ns", F.col("changed_ns") + F.when(F.col("file_type") == 2, 1).otherwise(0))
    return audit.replay_violations(audit.entry_audit(rows), audit.entry_audit(again))


@query(_p4(f"select l.gallery_key, entry_audit, entry_audit is null as observe from (select distinct gallery_key from e) l left join (select * from {_AUDIT} where regular_files > 0) using (gallery_key)"))
def audit_lookup(spark, d):
    rows = fx.page_entries(spark, d)
    return audit.audit_lookup(rows.select("gallery_key").distinct(), audit.entry_audit(rows).where("regular_files > 0"))


def _page_sql(source: str, partition: str, key: str, limit: int, none: str = "null") -> str:
    return f"""select {partition}, page, count(*) as items, case when (page + 1) * {limit} < max(total) then max({key}) else {none} end as next_after
from (select {partition}, {key}, (row_number() over (partition by {partition} order by {key}) - 1) // {limit} as page, count(*) over (partition by {partition}) as total from {source}) group by {partition}, page"""


@query(_f1(_page_sql("f", "gallery_key", "name", 16), policy=False))
def file_pages(spark, d):
    return paging.cursors(paging.numbered(fx.document_corpus(spark, d).files, ["gallery_key"], ["name"], 16), ["gallery_key"], "name").drop("terminal")


@query(_p4(_page_sql("e", "gallery_key", "name", 2)))
def entry_pages(spark, d):
    return paging.cursors(paging.numbered(fx.page_entries(spark, d), ["gallery_key"], ["name"], 2), ["gallery_key"], "name").drop("terminal")


@query(_page_sql("(select conv_id, turn::bigint as turn from conversations)", "conv_id", "turn", 3, "-1"))
def tag_pages(spark, d):
    rows = fx.table(spark, d, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"))
    return paging.cursors(paging.numbered(rows, ["conv_id"], ["turn"], 3), ["conv_id"], "turn").drop("terminal").withColumn("next_after", F.coalesce("next_after", F.lit(-1)))


@query(_f1("select * from (select gallery_key, gid, title from g) where gallery_key > '00000100' order by gallery_key limit 128", policy=False))
def gallery_keyset_page(spark, d):
    """One page of 128 after a cursor: the limit is what is asked for."""
    rows = fx.document_corpus(spark, d).galleries.select("gallery_key", "gid", "title")
    return paging.keyset_page(rows, "gallery_key", "00000100", 128).items


@query("""select conv_id, bool_and(coalesce(b < turn, true)) as increasing, min(turn) as first_key, max(turn) as last_key
from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as b from conversations) group by 1""")
def spool_order_check(spark, d):
    return paging.increasing(fx.table(spark, d, "conversations"), ["conv_id"], "turn", "turn")


@query("""select conv_id, page, first_key, last_key, coalesce(first_key > lag(last_key) over (partition by conv_id order by page), true) as advances
from (select conv_id, place // 3 as page, min(turn) as first_key, max(turn) as last_key from (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as place from conversations) group by all)""")
def spool_cursor(spark, d):
    from pyspark.sql import Window

    rows = paging.numbered(fx.table(spark, d, "conversations"), ["conv_id"], ["turn"], 3)
    pages = rows.groupBy("conv_id", "page").agg(F.min("turn").alias("first_key"), F.max("turn").alias("last_key"))
    cursor = F.lag("last_key").over(Window.partitionBy("conv_id").orderBy("page"))
    return pages.withColumn("advances", paging.advances(F.col("first_key"), cursor))


# --- projection --------------------------------------------------------------------------

_SAFE = "replace(replace(gallery_name, '/', '_'), '\\', '_')"
_LEAF = f"gid || ' - ' || {_SAFE} || '.cbz'"


@query("""select * from (values (0::bigint, '12 - ' || repeat('あ', 82) || '.cbz'), (1, '7 - a_b_c.cbz'), (2, '3 - gallery.cbz'), (3, '1 - ' || repeat('x', 247) || '.cbz'),
(4, '1 - ' || repeat('x', 245) || 'é' || '.cbz'), (5, '1 - ' || repeat('x', 246) || '.cbz')) v(id, leaf)""")
def friendly_leaf(spark, d):
    names = [(0, 12, "あ" * 100), (1, 7, "a/b\\c"), (2, 3, ""), (3, 1, "x" * 300), (4, 1, "x" * 245 + "é"), (5, 1, "x" * 246 + "é")]
    rows = spark.createDataFrame(names, "id bigint, gid bigint, name string")
    return rows.select("id", paths.friendly_leaf(F.col("gid"), F.col("name")).alias("leaf"))


def _friendly(grouping: str, pattern: str | None):
    lead = f"strftime(make_timestamp(epoch_us(download_time)), '{pattern}') || '/' || " if pattern else ""

    @query(_f1(f"select gallery_key, {lead}{_LEAF} as path_name, true as safe from g", policy=False), name=f"friendly_path_{grouping}")
    def run(spark, d):
        rows = fx.document_corpus(spark, d).galleries
        path = paths.friendly_path(F.col("gid"), F.col("gallery_name"), codec.wall_micros(F.col("download_time")), grouping)
        return rows.select("gallery_key", path.alias("path_name")).withColumn("safe", paths.is_safe_path(F.col("path_name")))


for _grouping, _pattern in (("flat", None), ("yyyy", "%Y"), ("yyyy_mm", "%Y/%m"), ("yyyy_mm_dd", "%Y/%m/%d")):
    _friendly(_grouping, _pattern)


def _p7(rest: str) -> str:
    return "with " + fx.projection_sql() + "\n" + rest


def _actions_sql(recovering: bool) -> str:
    unknown = "case when kind = 'regular' and p.artifact_sha256 = o.sha256 and p.size_bytes = o.size_bytes then 'ADOPT_RECOVERED' else 'REFUSE_MISMATCH' end" if recovering else "'REFUSE_UNKNOWN'"
    return f"""select coalesce(p.path_name, c.path_name, o.path_name) as path_name, coalesce(p.artifact_sha256, c.artifact_sha256) as artifact_sha256, case
 when p.path_name is not null and c.path_name is null then case when kind is null then 'COPY_NEW' else {unknown} end
 when p.path_name is not null then case when kind = 'directory' then 'REFUSE_DIRECTORY'
   when p.artifact_sha256 = c.artifact_sha256 and kind = 'regular' and c.signature = o.signature then 'KEEP'
   when p.artifact_sha256 = c.artifact_sha256 and kind = 'other' then 'REFUSE_NOT_REGULAR' else 'REPLACE_MANAGED' end
 when c.path_name is not null then case when kind is null then 'STALE_GONE' when kind = 'regular' and c.signature = o.signature then 'DELETE_STALE' else 'REFUSE_CHANGED_STALE' end
 else 'UNTOUCHED' end as action
from n_pub p full join o_pub c on p.path_name = c.path_name full join obs o on coalesce(p.path_name, c.path_name) = o.path_name"""


@query(_p7(_actions_sql(False)))
def projection_actions(spark, d):
    return projection.actions(*fx.projections(spark, d))


@query(_p7(_actions_sql(True)))
def projection_actions_recovering(spark, d):
    return projection.actions(*fx.projections(spark, d), recovering=True)


@query(_p7("select path_name, artifact_sha256 from o_pub where path_name not in (select path_name from n_pub)"))
def stale_paths(spark, d):
    pending, current, _ = fx.projections(spark, d)
    return projection.stale(pending, current)


@query(_p7("select p.path_name, p.artifact_sha256, c.artifact_sha256 as current_sha256 from n_pub p left join o_pub c on p.path_name = c.path_name"))
def pending_current(spark, d):
    pending, current, _ = fx.projections(spark, d)
    return projection.pending_current(pending, current)


_TIMELINE = [
    ("a", 1, "OPENED", "OPEN", 0, 5), ("a", 2, "APPENDED", "OPEN", 0, 5), ("a", 3, "ERROR_ORDER", "OPEN", 0, 5), ("a", 4, "APPENDED", "OPEN", 0, 5),
    ("a", 5, "SPOOL", "OPEN", 0, 5), ("a", 6, "ERROR_UNFINISHED", "OPEN", 0, 5), ("a", 7, "ERROR_RECEIPT", "OPEN", 0, 5), ("a", 8, "ERROR_PHASE", "OPEN", 0, 5),
    ("a", 9, "SEALED", "SEALED", 0, 5), ("a", 10, "ERROR_PHASE", "SEALED", 0, 5), ("a", 11, "RECONCILE", "SEALED", 0, 5), ("a", 12, "INTERRUPTED", "APPLYING", 0, 5),
    ("a", 13, "RECONCILE", "APPLYING", 0, 5), ("a", 14, "INSTALLED", "IDLE", 5, None), ("a", 15, "COMPLETE", "IDLE", 5, None), ("a", 16, "ERROR_RECEIPT", "IDLE", 5, None),
    ("a", 17, "ERROR_OLDER", "IDLE", 5, None), ("b", 1, "ERROR_PHASE", "IDLE", 0, None), ("b", 2, "OPENED", "OPEN", 0, 1), ("b", 3, "APPENDED", "OPEN", 0, 1),
    ("c", 1, "OPENED", "OPEN", 0, 2), ("c", 2, "SEALED", "SEALED", 0, 2), ("d", 1, "ERROR_PHASE", "IDLE", 0, None),
]


def _values(rows) -> str:
    cell = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


@query(f"select projection, seq::bigint as seq, result, phase, current_revision::bigint as current_revision, coalesce(pending_revision, 0)::bigint as pending_revision from (values {_values(_TIMELINE)}) v(projection, seq, result, phase, current_revision, pending_revision)")
def projection_phase_timeline(spark, d):
    return projection.timeline(fx.phase_events(spark)).drop("event", "cursor").withColumn("pending_revision", F.coalesce("pending_revision", F.lit(0)))


@query("""select * from (values ('a', 'IDLE', 5::bigint, 0::bigint, null, 'COMPLETE'), ('b', 'OPEN', 0, 1, 'm', 'SPOOL'), ('c', 'SEALED', 0, 2, null, 'RECONCILE'), ('d', 'IDLE', 0, 0, null, 'COMPLETE'))
v(projection, phase, current_revision, pending_revision, cursor, resume)""")
def projection_checkpoint(spark, d):
    return projection.checkpoint(projection.timeline(fx.phase_events(spark))).withColumn("pending_revision", F.coalesce("pending_revision", F.lit(0)))


@query(_p7("""select artifact_sha256 from (select content_sha256 as artifact_sha256 from o_con union select content_sha256 from n_con) where artifact_sha256 is not null
 and artifact_sha256 not in (select artifact_sha256 from o_pub) and artifact_sha256 not in (select artifact_sha256 from n_pub)
 and artifact_sha256 not in (select content_sha256 from n_own join n_g using (gallery_key) where gid < 50)"""))
def gc_eligible(spark, d):
    """Artifacts of either snapshot that neither publication nor a protection of low gids holds."""
    (old, new), (pending, current, _) = fx.published_states(spark, d), fx.projections(spark, d)
    present = old.content.union(new.content).where("content_sha256 is not null").select(F.col("content_sha256").alias("artifact_sha256"))
    held = new.owners.join(new.snapshot.galleries.select("gallery_key", "gid"), "gallery_key").where("gid < 50").select(F.col("content_sha256").alias("artifact_sha256"))
    return projection.collectable(present, current, pending, held)


# --- tokens, leases, schedules -----------------------------------------------------------


@query("""select user_id as token, sha256(user_id::varchar) as locator, case when bool_or(event_type = 'error') then 'RELEASED' else 'PROTECTED' end as state, count(*) as events from events group by 1""")
def token_states(spark, d):
    return tokens.states(fx.token_log(spark, d))


@query("""select user_id as token, event_id as seq, case when event_type = 'error' then case when r > 0 then 'ALREADY_RELEASED' else 'RELEASED' end
 when r > 0 then 'NOT_STORED' when p > 0 then 'ALREADY_PROTECTED' else 'PROTECTED' end as result
from (select *, count(*) filter (event_type = 'error') over w as r, count(*) filter (event_type <> 'error') over w as p from events
 window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))""")
def token_outcomes(spark, d):
    return tokens.outcomes(fx.token_log(spark, d)).select("token", "seq", "result")


#: The oracle folds each worker's events one by one: a recursive query carries the lease's end, or null.
_FOLD = f"""{fx.LEASE_SQL},
n as (select *, row_number() over (partition by worker order by at_micros, seq) as k from ev),
r as (
  select worker, seq, at_micros, kind, k, (kind = 'claim') as live, case when kind = 'claim' then at_micros + {fx.LEASE_SECONDS}000000 end as ends from n where k = 1
  union all
  select n.worker, n.seq, n.at_micros, n.kind, n.k, n.kind = 'claim' or coalesce(n.at_micros <= r.ends, false),
    case when n.kind = 'claim' then n.at_micros + {fx.LEASE_SECONDS}000000 when n.kind = 'complete' then null
         when n.kind = 'renew' then case when n.at_micros <= r.ends then n.at_micros + {fx.LEASE_SECONDS}000000 end else r.ends end
  from r join n on n.worker = r.worker and n.k = r.k + 1),
l as (select worker, seq, k, at_micros, kind, live, ends, case kind when 'claim' then 'granted' when 'renew' then case when live then 'extended' else 'rejected' end
  when 'complete' then case when live then 'completed' else 'rejected' end when 'fail' then case when live then 'failed' else 'idle' end else case when live then 'busy' else 'idle' end end as result from r)"""


def _lines(spark, d):
    return lease.timeline(fx.lease_events(spark, d), fx.LEASE_SECONDS)


_TIMELINE_SQL = f"with recursive {_FOLD} select worker, seq, kind, live, result, case when result in ('granted', 'extended') then ends else -1 end as expires_micros from l"


@query(_TIMELINE_SQL)
def lease_timeline(spark, d):
    """The call's result and the lease's new end (-1: unchanged)."""
    return _lines(spark, d).select("worker", "seq", "kind", "live", "result", F.coalesce("expires_micros", F.lit(-1)).alias("expires_micros"))


@query(f"""with recursive {_FOLD},
g as (select *, count(*) filter (kind = 'claim') over (partition by worker order by k) as claim from l),
t as (select worker, claim, max(case when result in ('granted', 'extended') then ends end) as expires_micros, bool_or(result = 'completed') as done from g where claim > 0 group by all)
select worker, claim, expires_micros from t where not done and expires_micros < (select max(at_micros) from ev)""")
def lease_expired(spark, d):
    lines = _lines(spark, d)
    now = fx.lease_events(spark, d).agg(F.max("at_micros").alias("now_micros"))
    rows = lease.expired(lines, now)
    claims = lines.where("kind = 'claim'").select("worker", "term")
    from pyspark.sql import Window

    claims = claims.withColumn("claim", F.row_number().over(Window.partitionBy("worker").orderBy("term")).cast("bigint"))
    return rows.join(claims, ["worker", "term"]).select("worker", "claim", "expires_micros")


@query(f"""with recursive {_FOLD},
g as (select *, count(*) filter (kind in ('claim', 'complete')) over (partition by worker order by k) - (kind = 'complete')::int as term from l)
select worker, seq, coalesce(bool_or(result = 'failed') over (partition by worker, term order by k rows between unbounded preceding and 1 preceding), false) as poisoned from g""")
def sticky_failure(spark, d):
    return lease.sticky(_lines(spark, d)).select("worker", "seq", "poisoned")


@query(f"""with {fx.LEASE_SQL},
s as (select *, (at_micros - first_value(at_micros) over w) // {fx.SCAN_SECONDS}000000 as tick from ev window w as (partition by worker order by at_micros, seq))
select worker, seq, tick, coalesce(lag(tick) over (partition by worker order by at_micros, seq) <> tick, true) as scan,
 at_micros + case when kind = 'complete' then 0 else {fx.POLL_SECONDS}000000 end as next_poll_micros from s""")
def resident_schedule(spark, d):
    return lease.schedule(fx.lease_events(spark, d), fx.SCAN_SECONDS, fx.POLL_SECONDS)


@query("""select * from (values (1::bigint, 'SOURCE', true), (2, 'ANALYSIS', true), (3, 'ANALYSIS', true), (4, 'PUBLICATION', true), (5, 'SOURCE', false), (6, 'PUBLICATION', true), (7, 'FINALIZATION', true)) v(seq, phase, valid)""")
def step_phases(spark, d):
    """Steps may stay in their phase or go on to the next; going back is an error."""
    from shelfmark.operators.coordination import phase_checks

    names = ["SOURCE", "ANALYSIS", "ANALYSIS", "PUBLICATION", "SOURCE", "PUBLICATION", "FINALIZATION"]
    return phase_checks(spark.createDataFrame(list(enumerate(names, 1)), "seq bigint, phase string"))


@query("""select p_partkey as id, case when w > bw or h > bh then bw else w end::bigint as width,
 case when w > bw or h > bh then bh else h end::bigint as height from (select *, case when tall then s else greatest(1, s * w // h) end as bw, case when tall then greatest(1, s * h // w) else s end as bh
 from (select p_partkey, 100 + p_partkey % 3000 as w, 100 + (p_partkey * 7) % 3000 as h, 1200 as s, 100 + (p_partkey * 7) % 3000 >= 100 + p_partkey % 3000 as tall from part))""")
def thumbnail_geometry(spark, d):
    rows = fx.table(spark, d, "part").select("p_partkey", (100 + F.col("p_partkey") % 3000).alias("w"), (100 + (F.col("p_partkey") * 7) % 3000).alias("h"), F.lit(1200).cast("bigint").alias("s"))
    width, height = paths.thumbnail_size("w", "h", "s")
    return rows.select(F.col("p_partkey").alias("id"), width.alias("width"), height.alias("height"))


@query("""select o_orderkey as id, lpad(hex((o_orderkey::hugeint * 30744573456181)::ubigint), 16, '0') as blob, (o_orderkey::hugeint * 30744573456181)::varchar as number from orders""")
def stat_codec(spark, d):
    """Device and inode numbers as eight stored bytes, and back.

    A number outside 0 to 2^64 - 1 cannot be stored: its blob is null, and the number stays as it was given. (The SQL's cast
    to ubigint is an error there, at keys past 600,000.)
    """
    number = F.col("o_orderkey").cast("decimal(20,0)") * F.lit("30744573456181").cast("decimal(18,0)")
    rows = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), number.cast("string").alias("given"), number.alias("device"), number.alias("inode"),
        *[F.lit(0).cast("bigint").alias(c) for c in audit.STAT[2:]],
    )
    encoded = audit.encode_stat(rows).withColumn("blob", F.hex("device"))
    stored = audit.decode_stat(encoded.where("blob is not null")).select("id", "blob", F.col("inode").cast("string").alias("number"))
    return stored.unionByName(encoded.where("blob is null").select("id", "blob", F.col("given").alias("number")))


_PRODUCERS = [("w1", "cpython-313", "10.1", "3.0", "1.3.1"), ("w1", "cpython-313", "10.1", "3.0", "1.3.2"), ("", "é", "unknown", "unknown", "1")]


@query("select x[1] as writer, x[5] as zlib, sha256(unhex('" + codec.prefix_hex(codec.PRODUCER_PREFIX) + "' || " + _LIST_PAYLOAD.format("x") + ")) as fingerprint_sha256 from (values "
       + ", ".join(f"({list(p)})" for p in _PRODUCERS) + ") v(x)")
def producer_fingerprint(spark, d):
    rows = spark.createDataFrame(_PRODUCERS, "writer string, python string, images string, jpeg string, zlib string")
    return artifacts.with_fingerprint(rows).select("writer", "zlib", "fingerprint_sha256")


@query("select event_id, epoch_us(ts) as micros from events")
def wall_time_micros(spark, d):
    return fx.table(spark, d, "events").select("event_id", codec.wall_micros(F.col("ts")).alias("micros"))


def _tree(spark, what: str, *columns) -> DataFrame:
    rows = planted(spark).relation(what)
    return rows.select(F.array_join("locator", "/").alias("locator"), *columns)


_NAME = "cast(name_bytes as string) as name"


@query("""select * from (values ('nested/1001', '001.jpg', sha256('first'), 5::bigint), ('nested/1001', '002.jpg', sha256('second'), 6),
('1002', '001.jpg', sha256('first'), 5)) v(locator, name, sha256, size_bytes)""")
def tree_scan(spark, d):
    """Files of a directory tree made for the purpose, frozen and read off its one walk."""
    return _tree(spark, "files", F.expr(_NAME), "sha256", "size_bytes").where("name <> 'galleryinfo.txt'")


@query("""select *, 'someone' as upload_account, epoch_us(timestamp '2024-01-02 03:04:00') as upload_time, epoch_us(timestamp '2024-02-03 04:05:00') as download_time
from (values ('nested/1001', 1001::bigint, 'A title', 3::bigint, 2::bigint), ('1002', 1002, 'B', 2, 1)) v(locator, gid, title, source_file_count, page_count)""")
def tree_galleries(spark, d):
    """Metadata of the tree's galleries, read twice and counted."""
    return _tree(spark, "galleries", "gid", "title", "source_file_count", "page_count", "upload_account", "upload_time", "download_time")


@query("""select * from (values ('nested/1001', '001.jpg', 0), ('nested/1001', '002.jpg', 0), ('nested/1001', 'galleryinfo.txt', 0),
('1002', '001.jpg', 0), ('1002', 'galleryinfo.txt', 0), ('1002', 'child', 1), ('1002', 'linked', 2)) v(locator, name, file_type)""")
def tree_entries(spark, d):
    """All direct entries, links and folders among them."""
    return _tree(spark, "entries", F.expr(_NAME), "file_type")


@query("""select * from (values ('nested/1001', 0, 'artist', 'first'), ('nested/1001', 1, '', 'plain')) v(locator, ordinal, namespace, value)""")
def tree_tags(spark, d):
    return _tree(spark, "tags", "ordinal", "namespace", "value")


@query("""select * from (values ('galleries', 0, '1002', '1002'), ('galleries', 1, 'nested/1001', null), ('files', 0, '001.jpg', '001.jpg'), ('files', 1, '002.jpg', '002.jpg'),
('files', 2, 'galleryinfo.txt', null), ('tags', 0, 'first', '0'), ('tags', 1, 'plain', null)) v(relation, page, item, next_after)""")
def source_pages(spark, d):
    """The adapter's pages of one item each, with their cursors, over a frozen tree."""
    adapter, place = SourceAdapter(planted(spark)), ["nested", "1001"]
    lists = {
        "galleries": (lambda after: adapter.list_galleries(after, 1), F.array_join("locator", "/"), lambda x: "/".join(x)),
        "files": (lambda after: adapter.list_files(place, after, 1), F.col("name_bytes").cast("string"), lambda x: bytes(x).decode()),
        "tags": (lambda after: adapter.list_tags(place, after, 1), F.col("value"), str),
    }
    found = []
    for relation, (page_after, item, shown) in lists.items():
        after, terminal = None, False
        while not terminal:
            page = page_after(after)
            items, after, terminal = [r[0] for r in page.items.select(item).collect()], page.next_after, page.terminal
            number = sum(r[0] == relation for r in found)
            found += [(relation, number, x, None if after is None else shown(after)) for x in items]
    return spark.createDataFrame(found, "relation string, page int, item string, next_after string")


@query("select conv_id, turn::bigint as turn from conversations where conv_id = (select min(conv_id) from conversations) and turn >= 1 and turn < 4")
def tag_offset_page(spark, d):
    """Three places of one list from place 1 on."""
    rows = fx.table(spark, d, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"))
    first = rows.agg(F.min("conv_id")).first()[0]
    return paging.offset_page(rows.where(F.col("conv_id") == first), "turn", 1, 3).items


@query("select 's/' || lpad(s_suppkey::varchar, 9, '0') || '.cbz' as path_name, sha256(s_name) as artifact_sha256, 'seen' as signature from supplier")
def projection_installed(spark, d):
    """Pages of a relation appended to an intent, sealed, applied and made current."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    rows = fx.table(spark, d, "supplier").select(
        key.alias("publication_key"), F.concat(F.lit("s/"), key, F.lit(".cbz")).alias("path_name"), F.lit("a").alias("artifact_locator"),
        F.sha2("s_name", 256).alias("artifact_sha256"), F.lit(1).cast("bigint").alias("size_bytes"),
    )
    folder = local_folder(spark, "projection")
    plan, receipt, after, terminal = sinks.Projection(folder), b"0123456789abcdef", None, False
    with sinks.publication_guard(f"{folder}/lock"):
        plan.begin(1, receipt)
        while not terminal:
            page = paging.keyset_page(rows, "publication_key", after, paging.PROJECTION_PAGE, paging.PROJECTION_PAGE)
            plan.append_page(1, [r.asDict() for r in page.items.collect()])
            after, terminal = page.next_after, page.terminal
        plan.seal(1)
        plan.apply(1)
        plan.install(1, {r[0]: "seen" for r in plan.pending(spark).select("path_name").collect()})
    return plan.current(spark).select("path_name", "artifact_sha256", "signature")


@query(_TIMELINE_SQL)
def lease_stream(spark, d):
    """The lease timeline by a stateful stream over the events table."""
    found = lease_stream_check(spark, fx.lease_events(spark, d), fx.LEASE_SECONDS)
    return found.withColumn("expires_micros", F.coalesce("expires_micros", F.lit(-1)))
