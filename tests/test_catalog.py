"""Every catalogue query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

from shelfmark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{tiny}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_oracle(spark, tiny, oracle, name):
    df = catalog.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rows = oracle.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.oracle_sql()[name]}) q").fetchall()
    assert got == sorted(map(repr, rows))


def test_names_agree():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_keyset_scan_pushes_its_predicate(spark, tiny):
    from shelfmark.operators.paging import keyset_page

    page = keyset_page(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang"), "doc_id", 5, 10)
    plan = page.items._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,5)" in plan and "TakeOrderedAndProject" in plan
    assert [r[0] for r in page.items.collect()] == list(range(6, 16)) and not page.terminal and page.next_after == 15


def test_long_lists_are_numbered_without_gaps(spark):
    """More rows than a sample of the ranges holds: places and pages are those of one sorted list."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from shelfmark.operators.paging import ranged

    rows = spark.range(150_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    found = ranged(rows, "key", 128)
    want = rows.withColumn("want", F.row_number().over(Window.orderBy("key")) - 1)
    both = found.join(want, "key")
    assert both.count() == 150_000 and both.where("place <> want or page <> want div 128").count() == 0
    assert found.where("terminal").count() == 150_000 % 128


def test_scratch_folder_is_never_a_machines_own_on_a_cluster():
    from types import SimpleNamespace

    from shelfmark.session import scratch_root

    def session(master, set_=None, context=None):
        made = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: context, setCheckpointDir=lambda x: None)
        return SimpleNamespace(sparkContext=made, conf=SimpleNamespace(get=lambda k, d: set_))

    assert scratch_root(session("yarn", "hdfs://x/c/")) == "hdfs://x/c/shelfmark/app"
    assert scratch_root(session("yarn", None, "s3://b/d")) == "s3://b/d/shelfmark/app"
    assert scratch_root(session("local[4]")).startswith("file:///tmp/")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            scratch_root(session(master))


def test_the_entry_hides_no_import_faults(tmp_path):
    """Without the training-data operators the entry works; a fault inside them is raised."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "shelfmark"), tmp_path / "shelfmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(catalog.queries()))] * 2
    os.mkdir(tmp_path / "shelfmark/llm")  # a folder that is left over is no package
    assert run().returncode == 0
    (tmp_path / "shelfmark/llm/queries.py").write_text("import no_such_module\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_module" in run().stderr


def test_stat_codec_of_numbers_that_eight_bytes_do_not_hold(spark, tmp_path):
    """Every order has its row: the number as in the SQL, the blob as in the SQL wherever its cast is no error."""
    keys = [None, -1, 0, 1, 7, 7, 599_999, 600_000, 600_001, 3_600_000, 36_000_000, 2**62]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    sql = catalog.oracle_sql()["stat_codec"].replace("::ubigint", "::hugeint")  # a view of all rows; blobs past 64 bits are left out below
    want = [(i, None if n is None or not 0 <= int(n) < 2**64 else b, n) for i, b, n in con.execute(f"select id, blob, number from ({sql})").fetchall()]
    got = [tuple(r) for r in catalog.queries()["stat_codec"](spark, str(tmp_path)).select("id", "blob", "number").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(keys)
