"""Tree source, sinks, configuration and coordination."""

import hashlib
import json
import os

import pytest

from shelfmark import schema
from shelfmark.functions import codec
from shelfmark.operators import coordination as co
from shelfmark.operators.incremental import Evaluation
from shelfmark.sources import config, sinks, tree
from shelfmark.sources.adapter import SourceAdapter

SCOPE = "ab" * 32


@pytest.fixture
def root(tmp_path):
    path = tmp_path / "source"
    tree.plant(str(path), {"nested/1001": {"title": "A title", "tags": ["artist:first", "language:english"], "files": {"002.jpg": b"second", "001.jpg": b"first", "_x.jpg": b"x"}}})
    os.mkdir(path / "nested/1001/child")
    os.symlink(path / "nested", path / "nested/1001/linked")
    return str(path)


def test_tree_relations(spark, root):
    g = tree.load(spark, root, "galleries").collect()
    assert [(list(r["locator"]), r["gid"], r["title"], r["source_file_count"], r["page_count"], r["upload_account"]) for r in g] == [(["nested", "1001"], 1001, "A title", 4, 3, "someone")]
    files = {bytes(r["name_bytes"]): r["sha256"] for r in tree.load(spark, root, "files").collect()}
    assert files[b"001.jpg"] == hashlib.sha256(b"first").hexdigest() and set(files) == {b"001.jpg", b"002.jpg", b"_x.jpg", b"galleryinfo.txt"}
    kinds = {bytes(r["name_bytes"]): r["file_type"] for r in tree.load(spark, root, "entries").collect()}
    assert kinds[b"child"] == 1 and kinds[b"linked"] == 2 and kinds[b"001.jpg"] == 0
    assert [(r["namespace"], r["value"]) for r in tree.load(spark, root, "tags").orderBy("ordinal").collect()] == [("artist", "first"), ("language", "english")]


def test_tree_faults(spark, root, tmp_path):
    os.makedirs(tmp_path / "b/1")
    os.symlink(os.path.join(root, "nested/1001/galleryinfo.txt"), tmp_path / "b/1/galleryinfo.txt")
    with pytest.raises(tree.TreeChanged):
        list(tree.walk(str(tmp_path / "b"), ()))
    with pytest.raises(tree.TreeChanged):
        list(tree.walk(os.path.join(root, "nested/1001"), ()))


def test_a_frozen_tree_is_one_walk(spark, root, monkeypatch):
    frozen = tree.freeze(spark, root)
    for what in tree.RELATIONS:
        same = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
        assert same(frozen.relation(what)) == same(tree.load(spark, root, what))
    adapter = SourceAdapter(frozen)
    place = ["nested", "1001"]
    adapter.list_files(place, None, 1)  # the relation is written once
    monkeypatch.setattr(os, "scandir", lambda *_: pytest.fail("a later page scanned a directory"))
    names, after = [], None
    while True:
        page = adapter.list_files(place, after, 2)
        names += [bytes(r["name_bytes"]) for r in page.items.collect()]
        if page.terminal:
            break
        after = bytes(page.next_after)
    assert names == [b"001.jpg", b"002.jpg", b"_x.jpg", b"galleryinfo.txt"]
    first = adapter.list_tags(place, None, 1)
    second = adapter.list_tags(place, first.next_after, 1)
    assert [r["value"] for r in first.items.collect()] == ["first"] and first.next_after == 0
    assert [r["value"] for r in second.items.collect()] == ["english"] and second.terminal
    assert adapter.observe_gallery(place)["gid"] == 1001 and adapter.list_entries(place, None, 128).items.count() == 6
    with pytest.raises(tree.TreeChanged):
        adapter.observe_gallery(["other"])


def test_pages_of_galleries_and_a_wide_tree(spark, tmp_path):
    path = str(tmp_path / "wide")
    tree.plant(path, {f"one/sub{i % 3}/{1000 + i}": {"title": f"t{i}", "tags": [], "files": {"a": b"x"}} for i in range(12)})
    parts = tree.TreeReader(path, "discovery").partitions()
    assert len(parts) >= 12  # one folder at the top does not make one task
    adapter, seen, after = SourceAdapter(tree.freeze(spark, path)), [], None
    while True:
        page = adapter.list_galleries(after, 5)
        seen += [tuple(r["locator"]) for r in page.items.collect()]
        if page.terminal:
            break
        after = page.next_after
    assert seen == sorted({("one", f"sub{i % 3}", str(1000 + i)) for i in range(12)})


def test_changes_are_noticed(spark, root):
    frozen = tree.freeze(spark, root)
    frozen.verify()
    observed = os.path.join(root, "nested/1001/001.jpg")
    sha = hashlib.sha256(b"first").hexdigest()
    assert b"".join(tree.content_parts(observed, sha)) == b"first"
    with pytest.raises(tree.TreeChanged):
        list(tree.content_parts(observed, "0" * 64))
    with open(observed, "wb") as f:
        f.write(b"other")
    with pytest.raises(Exception, match="not as it was|changed since"):
        frozen.verify()
    frozen = tree.freeze(spark, root)
    tree.plant(root, {"7": {"title": "new", "tags": [], "files": {}}})
    with pytest.raises(tree.TreeChanged, match="appeared"):
        frozen.verify()


def test_end_to_end_from_trees(spark, tmp_path):
    page = {"001.jpg": b"same page"}
    path = str(tmp_path / "e2e")
    tree.plant(path, {"1001": {"title": "t", "tags": ["artist:a"], "files": page}})
    from shelfmark.operators.artifacts import publications

    assert publications(Evaluation(tree.snapshot(spark, path, SCOPE)).inputs).count() == 1
    tree.plant(path, {f"{1001 + i}": {"title": "t", "tags": [f"artist:{a}"], "files": page} for i, a in enumerate("abc")})
    assert publications(Evaluation(tree.snapshot(spark, path, SCOPE)).inputs).count() == 0


def test_casefold_and_locator_codecs(spark):
    rows = spark.createDataFrame([("Straße.txt",), ("ABC",), ("İ",)], "name string")
    assert {r["name"]: r["fold"] for r in codec.fold(rows).collect()} == {n: n.casefold() for n in ("Straße.txt", "ABC", "İ")}
    locators = [["z"], ["a", "b"], ["b"], ["aa"]]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in locators], "c array<string>").withColumn("p", codec.locator_payload(F.col("c")))
    assert [r["c"] for r in rows.orderBy("p").collect()] == [["b"], ["z"], ["aa"], ["a", "b"]]
    bad = spark.createDataFrame([(b"\0\0\0\1\0\0\0\1\0\0\0\2a",), (b"",), (b"\0\0\0\1\0\0\0\0",)], "p binary")
    assert [r[0] for r in bad.select(codec.decode_locator("p")).collect()] == [None] * 3


def test_artifacts_are_immutable(spark, tmp_path):
    sha = hashlib.sha256(b"x").hexdigest()
    locator = f"sha256/{sha[:2]}/{sha}.cbz"
    assert sinks.write_artifact(str(tmp_path), locator, sha, [b"x"])
    assert not sinks.write_artifact(str(tmp_path), locator, sha, [b"x"])
    with pytest.raises(ValueError):
        sinks.write_artifact(str(tmp_path), "sha256/00/other.cbz", sha, [b"y"])
    (tmp_path / locator).write_bytes(b"z")
    with pytest.raises(ValueError):
        sinks.write_artifact(str(tmp_path), locator, sha, [b"x"])
    rows = spark.createDataFrame([(f"p/{i}", hashlib.sha256(bytes([i])).hexdigest(), bytearray([i])) for i in range(5)], "locator string, sha256 string, content binary")
    sinks.write_artifacts(rows, str(tmp_path))
    assert sorted(os.listdir(tmp_path / "p")) == [str(i) for i in range(5)]


def test_tokens(tmp_path):
    store, other = (sinks.TokenStore(str(tmp_path / "tokens")) for _ in range(2))
    assert [store.protect("t", "l"), other.protect("t", "l"), store.release("t", "l"), other.release("t", "l"), store.protect("t", "l")] == [
        "PROTECTED", "ALREADY_PROTECTED", "RELEASED", "ALREADY_RELEASED", "NOT_STORED"]
    with open(tmp_path / "tokens", "ab") as f:
        f.write(b'["u", "l"')  # cut short
    assert sinks.TokenStore(str(tmp_path / "tokens")).protect("u", "m") == "PROTECTED"
    with pytest.raises(ValueError):
        sinks.TokenStore(str(tmp_path / "tokens")).release("t", "other")


def item(key, path="p"):
    return {"publication_key": key, "path_name": path, "artifact_locator": "a", "artifact_sha256": "s", "size_bytes": 1}


def test_projection_pages_and_swap(spark, tmp_path):
    p, receipt = sinks.Projection(str(tmp_path / "p")), b"r" * 16
    with pytest.raises(RuntimeError, match="guard"):
        p.begin(1, receipt)
    with sinks.publication_guard(str(tmp_path / "lock")):
        for wrong in (0, True, 1 << 63):
            with pytest.raises(ValueError):
                p.begin(wrong, receipt)
        with pytest.raises(ValueError):
            p.begin(1, b"short")
        assert p.begin(1, receipt) == "SPOOL"
        p.append_page(1, [item("a", "pa"), item("b", "pb")])
        for wrong, error in (([item("b")], ValueError), ([item("d"), item("c")], ValueError), ([item("c", "pa")], RuntimeError), ([item("c", "x"), item("d", "x")], RuntimeError),
                             ([item(f"k{i:03}", str(i)) for i in range(129)], ValueError)):
            with pytest.raises(error):
                p.append_page(1, wrong)
        p = sinks.Projection(str(tmp_path / "p"))  # a restart
        assert p.begin(1, receipt) == "SPOOL"
        with pytest.raises(RuntimeError):
            p.begin(2, receipt)
        with pytest.raises(RuntimeError):
            p.begin(1, b"x" * 16)
        p.append_page(1, [item("c", "pc")])
        p.seal(1)
        with pytest.raises(RuntimeError):
            p.append_page(1, [item("d", "pd")])
        assert [r["path_name"] for r in p.pending(spark).collect()] == ["pa", "pb", "pc"] and p.begin(1, receipt) == "RECONCILE"
        p.apply(1)
        assert p.current(spark) is None
        p.install(1, {"pa": "1", "pb": "2", "pc": "3"})
        assert p.begin(1, receipt) == "COMPLETE" and p.pending(spark) is None
        assert [(r["path_name"], r["signature"]) for r in p.current(spark).collect()] == [("pa", "1"), ("pb", "2"), ("pc", "3")]
        assert p.begin(2, receipt) == "SPOOL"
        p.seal(2)
        p.apply(2)
        p.install(2, {})
        assert p.current(spark).count() == 0
        with pytest.raises(RuntimeError):
            p.begin(1, receipt)


def test_disabled_projection_and_guards(tmp_path):
    off = sinks.projection_of(config.Config(source="s", artifacts="a"))
    assert off.begin(1, b"r" * 16) == "COMPLETE"
    for call in (lambda: off.append_page(1, []), lambda: off.seal(1), lambda: off.install(1, {})):
        with pytest.raises(RuntimeError):
            call()
    with sinks.publication_guard(str(tmp_path / "lock")):
        with pytest.raises(RuntimeError):
            with sinks.publication_guard(str(tmp_path / "lock")):
                pass
    assert schema.token(b"t" * 184) and schema.receipt(b"r" * 16)
    for wrong in (b"t" * 183, bytearray(184)):
        with pytest.raises(ValueError):
            schema.token(wrong)


def test_no_links_among_parents(tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    root.mkdir()
    other.mkdir()
    (tmp_path / "src").write_bytes(b"x")
    os.symlink(other, root / "linked")
    os.symlink(tmp_path / "src", tmp_path / "src-link")
    sha = hashlib.sha256(b"x").hexdigest()
    for path in ("linked/p", "../p", "a//p", "/p", "a/./p"):
        with pytest.raises(ValueError):
            sinks.atomic_copy(str(tmp_path / "src"), str(root), path, sha, 1, managed=False)
    with pytest.raises((OSError, tree.TreeChanged)):
        sinks.atomic_copy(str(tmp_path / "src-link"), str(root), "q", sha, 1, managed=False)
    sinks.atomic_copy(str(tmp_path / "src"), str(root), "a/b/p", sha, 1, managed=False)
    assert (root / "a/b/p").read_bytes() == b"x" and not os.listdir(other)


def test_producers(spark):
    from shelfmark.operators.artifacts import Producer

    a, b = Producer.current(), Producer.current("other")
    rows = spark.range(1).select(a.fingerprint().alias("a"), b.fingerprint().alias("b")).first()
    assert len(rows["a"]) == 64 and rows["a"] != rows["b"]


def test_reconcile(tmp_path):
    art, out = tmp_path / "art", tmp_path / "out"
    art.mkdir()
    out.mkdir()
    sha = hashlib.sha256(b"one").hexdigest()
    (art / "a").write_bytes(b"one")
    step = {"path_name": "y/p.cbz", "action": "COPY_NEW", "locator": "a", "artifact_sha256": sha, "size_bytes": 3, "signature": None}
    with sinks.publication_guard(str(tmp_path / "lock")):
        held = sinks.reconcile([step], str(out), str(art))
    assert (out / "y/p.cbz").read_bytes() == b"one" and held["y/p.cbz"] == sinks.signature(str(out / "y/p.cbz"))
    with pytest.raises(FileExistsError):
        sinks.reconcile([step], str(out), str(art))
    with pytest.raises(ValueError):
        sinks.reconcile([step | {"action": "REFUSE_UNKNOWN"}], str(out), str(art))
    with pytest.raises(ValueError):
        sinks.reconcile([step | {"action": "DELETE_STALE", "signature": "other"}], str(out), str(art))
    sinks.reconcile([step | {"action": "DELETE_STALE", "signature": held["y/p.cbz"]}], str(out), str(art))
    assert not (out / "y/p.cbz").exists()


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"source": "${HERE}/s", "artifacts": str(tmp_path / "a"), "max_rows": 5}))
    (tmp_path / "s").mkdir()
    c = config.load_config(str(path), {"HERE": str(tmp_path)})
    assert c.max_rows == 5 and not c.projects
    config.ensure_paths(c)
    for wrong in ({"extra": 1}, {"max_rows": 0}, {"max_rows": True}, {"grouping": "x"}, {"lease_seconds": 1}):
        path.write_text(json.dumps({"source": "s", "artifacts": "a"} | wrong))
        with pytest.raises((ValueError, TypeError)):
            config.load_config(str(path), {})
    path.write_text(json.dumps({"source": "${NOT_SET_ANYWHERE}", "artifacts": "a"}))
    with pytest.raises(KeyError):
        config.load_config(str(path), {})


def test_long_logs_are_folded_and_phases_belong_to_runs(spark):
    from pyspark.sql import functions as F

    from shelfmark.operators.projection import timeline

    n, LOG = 30_000, "projection string, seq bigint, event string, revision bigint, receipt string, key string"
    log = spark.range(n).select(
        F.lit("p").alias("projection"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "begin").otherwise("append").alias("event"),
        F.lit(1).cast("bigint").alias("revision"), F.lit("r").alias("receipt"), F.lpad(F.col("id").cast("string"), 6, "0").alias("key"),
    )
    found = timeline(log.union(spark.createDataFrame([("q", 0, "append", 1, "r", "x"), ("q", 1, "begin", None, None, None)], LOG)))
    assert {(r["projection"], r["result"]): r["count"] for r in found.groupBy("projection", "result").count().collect()} == {
        ("p", "OPENED"): 1, ("p", "APPENDED"): n - 1, ("q", "ERROR_PHASE"): 1, ("q", "ERROR_OLDER"): 1}
    steps = spark.createDataFrame([("a", 1, "SOURCE"), ("b", 2, "SOURCE"), ("a", 3, "ANALYSIS"), ("b", 4, "PUBLICATION")], "run string, seq bigint, phase string")
    assert [r["valid"] for r in co.phase_checks(steps).orderBy("seq").collect()] == [True, True, True, False]
    with pytest.raises(RuntimeError):
        co.preflight_of(0, steps.limit(0), steps.limit(0))
    co.preflight_of(0, steps.limit(0), steps)


def test_leases_and_runs():
    now = [0.0]
    lease = co.Lease(10, clock=lambda: now[0])
    a = lease.claim("a")
    assert a and lease.claim("b") is None
    now[0] = 9
    session = co.Session(lease, a)
    session.renew()
    now[0] = 30
    with pytest.raises(co.LeaseLost):
        session.renew()
    with pytest.raises(co.LeaseLost):
        session.call(lambda: 1)  # the failure stays
    assert lease.claim("b")
    lease = co.Lease(10, clock=lambda: now[0])
    with pytest.raises(RuntimeError):
        co.attempt(lease, "a", lambda: co.bootstrap_preflight(1, 0, False), lambda s: None)
    assert co.attempt(lease, "b", lambda: None, lambda s: None)  # a failed preflight gave the lease back
    with pytest.raises(ZeroDivisionError):
        co.attempt(lease, "c", lambda: None, lambda s: 1 / 0)
    assert not co.attempt(lease, "d", lambda: None, lambda s: None)  # a failed service keeps it


def test_step_loop_and_resident():
    session = co.Session(co.Lease(100), 1)
    session.lease.claim("a")
    work = iter([co.StepResult("SOURCE", False), co.StepResult("SOURCE", True, 7)])
    assert co.run_steps(session, "SOURCE", lambda: 1, lambda w: w, lambda p: next(work)) == 7
    with pytest.raises(RuntimeError):
        co.run_steps(session, "SOURCE", lambda: 1, lambda w: w, lambda p: co.StepResult("ANALYSIS", True))
    co.check_receipts(True, "snapshot_manifest", "FINALIZATION")
    with pytest.raises(RuntimeError):
        co.check_receipts(False, "snapshot_manifest", "FINALIZATION")
    now, log = [0.0], []
    turns = iter([True, False, False])

    def wait(seconds):
        now[0] += seconds
        return len(log) >= 3

    r = co.Resident(lambda scan: log.append(scan) or next(turns), 5, 8, clock=lambda: now[0], wait=wait)
    r.run()
    assert log == [True, False, False]
