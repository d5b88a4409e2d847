"""The pipeline against its stages done by brute force."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from shelfmark.llm import mixing
from tests.llm.test_operators import check_packing, linked


def test_stages_and_run(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept, out = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, tiny)
        out.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    assert out[0] <= set(rows) and len(out[0]) >= 0.98 * len(rows)
    best = defaultdict(list)
    for i in out[0]:
        t = rows[i]["text"] or ""
        best[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    assert out[1] == {min(v)[1] for v in best.values()}
    found = linked([(i, rows[i]["text"]) for i in sorted(out[1])])
    assert out[2] == {c for _, _, c in found}
    chosen = mixing.select(docs.where(docs.doc_id.isin(sorted(out[2]))), corpus_pipeline.MIX).where("copies > 0")
    assert out[3] == {r["doc_id"] for r in chosen.collect()}
    check_packing(corpus_pipeline.run(spark, tiny), [(i, rows[i]["text"]) for i in out[3]])


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated identifiers and clashing columns run through all stages; no document is lost unseen."""
    german = "der schnelle braune Fuchs springt über den faulen Hund und läuft weiter durch den dunklen Wald "
    rows = [(i, f"this is the plain english text number {i} about many different things {i * 7} " * 3, "en", f"src{i % 3}", 9) for i in range(60)]
    rows += [(100 + i, german + str(i) * 3, "de", "src1", 9) for i in range(40)]
    rows += [(200, None, "en", "src1", None), (201, "", None, None, 0), (202, " \t\n", "en", None, 3), (203, "12345 67", "en", "src1", 8), (None, german, "de", "src2", 9)]
    rows += [(0, rows[0][1], "en", "src0", 9), (1, rows[1][1] + " and a tail of other words that nobody else has", "en", "src1", 9), (300, "long words " * 40_000, "en", None, 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, digest string, copies int, _text_key int"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)
    df.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    kept = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, "")
        assert kept.columns == df.columns
        if name == "language":
            assert not {r["doc_id"] for r in kept.collect()} & {200, 201, 202, 203}
        if name == "exact_dedup":
            texts = Counter(re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in kept.collect())
            assert set(texts.values()) == {1} and len(texts) == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in before.collect()})
    check_packing(corpus_pipeline.STAGES[-1][1](spark, kept, ""), [(r["doc_id"], r["text"]) for r in kept.collect()])
    check_packing(corpus_pipeline.run(spark, str(tmp_path / "odd")), [(r["doc_id"], r["text"]) for r in kept.collect()])
