"""The ten operators against brute force, round trips and held-out accuracy, with the odd cases of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ann, jaccard_join, langid, mixing, packing, pii, queries, stream_dedup, token_counts, token_store, tokenize, toxicity
from shelfmark.llm.common import text_slices

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, None, None, None, None), (2, "", "en", "src1", 0), (3, " \t\n\x0b\x0c\r ", "en", "src1", 7), (4, "one", "en", "src2", 3),
    (5, "one two three", "en", "src2", 13), (6, "One  two\nthree", "fr", "src3", 14), (7, "one two three", "en", "src2", 13), (7, "one two three", "en", "src2", 13),
    (None, "one two three", "en", "src2", 13), (8, "word " * 30_000, "de", "hot", 150_000), (9, "x" * 50_000, "es", "hot", 50_000),
    (10, "a b c d e f g h", "en", "hot", 15), (11, "a b c d e f g h", "en", "hot", 15), (12, "<|endoftext|> é日本 😀 's  x  y", None, "src9", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in ODD], SCHEMA + ", n int, digest int, copies string, length int")
    return rows.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


# --- op10 ------------------------------------------------------------------------------


def deduped(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((i, t or ""))
    out = []
    for key, some in groups.items():
        keep = min(some, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(some), i == keep, hashlib.sha256(key.encode()).hexdigest()) for i, _ in some]
    return Counter(out)


@pytest.mark.parametrize("digest", [None, lambda sha: F.substring(sha, 1, 1)])
def test_dedup_is_exact_even_with_colliding_digests(odd, docs, digest):
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert Counter(map(tuple, stream_dedup.dedup(df, digest).collect())) == deduped(rows)


def test_dedup_keeps_one(odd, empty):
    kept = stream_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    found = Counter(re.sub(r"\s", "", r["text"] or "") for r in kept.collect())
    assert max(found.values()) == 1 and len(found) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in ODD})
    assert stream_dedup.dedup(empty).count() == 0


def test_dedup_state_meets_later_copies_and_lives_on(spark, docs, tmp_path):
    """Several micro-batches, so that state is stored and restored, and a stream that goes on from its checkpoint."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    many = docs.repartition(5)
    assert Counter(map(tuple, stream_dedup.dedup(many, files_per_trigger=1).collect())) == deduped(rows)
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    for k, some in enumerate(([(1, "a b"), (2, "c")], [(0, "ab"), (3, "a  b")])):
        spark.createDataFrame(some, "doc_id bigint, text string").select(
            "doc_id", F.length("text").cast("bigint").alias("points"), stream_dedup.normalised(F.col("text")).alias("digest"),
            stream_dedup.text_key(F.col("text")).alias("text_key"), F.lit(str(k)).alias("locator"),
        ).coalesce(1).write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        state = stream_dedup.run_state(spark, folder, schema, checkpoint=checkpoint, out=out)
    found = {r["digest"]: (r["group_size"], ~r["best"]["not_id"], r["best"]["locator"]) for r in state.collect()}
    assert found == {"ab": (3, 3, "1"), "c": (1, 2, "0")}


# --- op2 -------------------------------------------------------------------------------


def linked(rows, size=5, percent=80):
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append((i, frozenset(s)))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is None or j is None or not s or not t:
                continue
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def near_copies(rng, n):
    """Groups of near copies with edits at all places, of sizes across the bands."""
    out, base = [], []
    for k in range(n):
        if k % 12 == 0:
            base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 9, 14, 25, 40, 80, 300]))]
        words = list(base)
        for _ in range(rng.randrange(0, 1 + max(1, len(words) // 25))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], ["two", "words"]])
        out.append((k, " ".join(words) or "w"))
    return out


def test_jaccard_join_matches_all_pairs(spark, odd):
    rows = near_copies(random.Random(8), 260)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, jaccard_join.link(df).collect())) == linked(rows)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, jaccard_join.link(odd).collect())) == linked(rows)


def test_jaccard_join_on_the_documents(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = jaccard_join.link(docs)
    assert Counter(map(tuple, found.collect())) == linked(rows)
    assert jaccard_join.link(empty).count() == 0
    assert jaccard_join.keep_one(docs).count() == len({c for _, _, c in linked(rows)})


def test_every_linked_pair_shares_a_kept_signature():
    """The pigeonhole, with segment skipping by an arbitrary order, on random pairs near the threshold."""
    rng = np.random.default_rng(4)
    seen = 0
    for _ in range(1500):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(rng.integers(0, 1 + len(x) // 8))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(x) // 8))).astype(np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        seen += 1

        def kept(s):
            out = set()
            for keys, marks in jaccard_join.signatures(s):
                short = marks[0] >> 24 < jaccard_join.SHORT_BANDS
                paid, cost = {}, 0
                for empty, k, mark in sorted(((bool(m & jaccard_join.EMPTY) and short, int(k), int(m)) for k, m in zip(keys, marks)), key=lambda r: (not r[0], r[1])):
                    price = 1 if not short or not mark & jaccard_join.WHOLE else 2  # any fixed order of keys will do
                    at = mark >> 8 & 255 if short else k
                    cost += max(0, price - paid.get(at, 0))
                    paid[at] = max(price, paid.get(at, 0))
                    if cost > mark & (255 if short else 0xFFFFFF):
                        out.add(k)
            return out

        assert len(x) == len(y) == both or kept(x) & kept(y)
    assert seen > 300


def test_jaccard_join_of_many_short_texts_stays_linear(spark, monkeypatch):
    """Distinct texts of one shingle, and unrelated ones of six, meet in no large bucket; nor do near copies in all pairs."""
    seen = {}
    written = jaccard_join.materialise

    def counted(df, name):
        out = written(df, name)
        if name in ("join-buckets", "join-stars", "join-across"):
            seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    for n in (500, 2000):
        seen.clear()
        rows = [(i, f"only{i} word") for i in range(n)] + [(n + i, " ".join(f"q{i}x{k}" for k in range(10))) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        found = jaccard_join.link(df)
        assert found.where("doc_id = component_id").count() == 2 * n
        assert sum(seen.values()) <= n / 10
    base = [f"b{k}" for k in range(120)]
    made = {}
    for n in (200, 400, 800):
        seen.clear()
        rng = random.Random(3)
        rows = []
        for i in range(n):
            words = list(base)
            for at in rng.sample(range(120), 2):
                words[at] = f"n{i}x{at}"
            rows.append((i, " ".join(words)))
        assert Counter(map(tuple, jaccard_join.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())) == linked(rows)
        made[n] = seen["join-across"] + seen["join-stars"]
    assert all(made[n] <= 5 * n for n in made)


def test_near_dedup_and_odd_rows(spark, odd, empty):
    """Rows that share an identifier stand or fall by their own text."""
    x, y, z = "a b c d e f g h", "i j k l m n o p", " ".join(map(str, range(40)))
    rows = [(3, x), (5, x), (5, y), (6, z), (6, z + " more"), (7, z), (None, x), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(r["text"] for r in jaccard_join.keep_one(df).collect() if r["doc_id"] == 6) in (Counter([z]), Counter([z + " more"]))
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(df).collect() if r["doc_id"] != 6]
    assert Counter(kept) == Counter([(3, x), (5, y), (None, x), (8, None), (9, "")])
    found = stream_dedup.keep_one(df)
    assert Counter(map(tuple, found.collect())) in ([Counter([(3, x), (5, y), (6, z), (6, z + " more"), (8, None)]), Counter([(3, x), (5, y), (6, z), (6, z + " more"), (9, "")])])
    assert jaccard_join.keep_one(odd).columns == odd.columns and jaccard_join.keep_one(empty).count() == 0


def test_words_of_long_texts_are_hashed_piece_by_piece(monkeypatch):
    from shelfmark.llm import common

    some = ["Ab c  d", "x" * 300, " y" * 90 + "z" * 50, "", "one two"]
    want = [common.word_hashes(o, d, (2,)) for _, _, o, d in text_slices(pa.array(some), 1 << 20)][0]
    low = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in some)
    flat = [w for t in low for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert len(set(want[0].tolist())) == len(set(flat)) and len(want[0]) == len(flat)
    monkeypatch.setattr(common, "PIECE", 64)
    common._powers.cache_clear()
    got = [common.word_hashes(o, d, (2,)) for _, _, o, d in text_slices(pa.array(some), 1 << 20)][0]
    common._powers.cache_clear()
    assert (got[0] == want[0]).all() and (got[1][0] == want[1][0]).all() and (got[2] == want[2]).all()


# --- op5, op7, op8 ----------------------------------------------------------------------


def strange_texts(n=400):
    rng = random.Random(5)
    letters = "aB é'\n \t  s1!😀́<| "
    parts = ["the", " don't", "'re", "'ll", "'l", " '", "<|endoftext|>", "  ", "\n\n", "123", "éÉ", "!!", "<|endoftext", "|>", " <|startoftext|>", "Σ", "İ"]
    out = ["", None, "a" * 3000, " " * 500, "!" * 700]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenize.tokenizer_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(tokenize, "CACHE", 900 * 210)  # the cache starts anew several times
    some = strange_texts()
    encode, want = tokenize.Encoder(tokenize.tokenizer_path(name)), library(name)
    for lo, hi, offsets, data in text_slices(pa.array(some, pa.string()), 4000):
        ids, at = encode(offsets, data)
        for t, a, b in zip(some[lo:hi], at, at[1:]):
            assert ids[a:b].tolist() == want.encode(t or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark, odd, empty):
    path, want = tokenize.tokenizer_path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    some = strange_texts()
    counter, kinds = token_counts.Counter(path), np.frombuffer(token_counts.character_classes(path), np.uint8)
    got = np.concatenate([token_counts.count_run(counter, kinds, o, d) for _, _, o, d in text_slices(pa.array(some, pa.string()), 4000)])
    assert got.tolist() == [len(want.encode(t or "", add_special_tokens=False).ids) for t in some]
    for r, t in zip(token_counts.count(odd.orderBy("doc_id", "text"), path).orderBy("doc_id", "n_bytes").collect(), odd.orderBy("doc_id", F.octet_length("text")).collect()):
        n = len(want.encode(t["text"] or "", add_special_tokens=False).ids)
        assert tuple(r) == (t["doc_id"], len((t["text"] or "").encode()), n, n > 512)
    assert token_counts.count(empty, path).count() == 0


def test_long_pieces_are_counted_in_chunks():
    """Pieces of a hundred thousand bytes without a cut, periodic ones among them, count as in the library."""
    path, want, rng = tokenize.tokenizer_path("byte_bpe_50k.json"), library("byte_bpe_50k.json"), random.Random(4)
    counter, kinds = token_counts.Counter(path), np.frombuffer(token_counts.character_classes(path), np.uint8)
    some = ["x" * 100_001, "ab" * 9_999, "the" * 7_000 + "n", "!" * 30_000, "=-" * 20_000, "".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "日本" * 5_000]
    got = np.concatenate([token_counts.count_run(counter, kinds, o, d) for _, _, o, d in text_slices(pa.array(some), 1 << 20)])
    assert got.tolist() == [len(want.encode(t, add_special_tokens=False).ids) for t in some]


def test_state_maps_compose_to_the_sequential_run():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, len(token_counts.CLASSES), 2000).astype(np.uint8)
    state, found = token_counts.CLOSED, set()
    for i, k in enumerate(kinds.tolist()):
        state, begins = token_counts._step(state, k)
        found |= {i} if begins & token_counts.HERE else set()
        found |= {i - 1} if begins & token_counts.BEFORE else set()
    assert set(token_counts.begins(kinds).tolist()) == found


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (1, 2, 50, 5000, 49408, 1 << 20, 1 << 32):
            ids = rng.integers(0, top, n)
            offsets, words, escapes = token_store.encode(ids)
            assert (token_store.decode(n, words, escapes) == ids).all()
            names, sizes, back = token_store.read_frame(token_store.pack_frame([3, None], [n, 0], ids))
            assert names == [3, None] and sizes.tolist() == [n, 0] and (back == ids).all()
            if not len(escapes):
                frame = token_store.pack_frame([1], [n], ids)
                for k in range(len(offsets)):
                    assert (token_store.read_block(frame, k) == ids[k * 256 : k * 256 + 256]).all()


def test_token_store(odd, empty):
    want = library("word_bpe_49k.json")
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start, expected = 0, []
    for i, t in rows:
        ids = np.array(want.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    path = tokenize.tokenizer_path("word_bpe_49k.json")
    assert Counter(map(tuple, token_store.store(odd, path).collect())) == Counter(expected)
    assert token_store.store(empty, path).count() == 0


def check_packing(df, rows, capacity=1024):
    want = library("byte_bpe_50k.json")
    expected, total = Counter(), 0
    for i, t in rows:
        ids = np.array(want.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        start = 0
        for k, size in enumerate(packing.piece_lengths(len(ids), capacity)):
            expected[i, k, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            start += size
        total += len(ids)
    found = df.collect()
    assert Counter(tuple(r)[:5] for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_packing(odd, docs, empty):
    path = tokenize.tokenizer_path("byte_bpe_50k.json")
    check_packing(packing.pack(odd, path), [(r["doc_id"], r["text"]) for r in odd.collect()])
    bins, least = check_packing(packing.pack(docs, path), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bins <= 1.1 * least
    assert packing.pack(empty, path).count() == 0


def test_plan_with_thousands_of_pieces_a_length():
    """Pieces placed many at a time: every piece has a place, no bin overflows, and hardly more bins than the sum needs."""
    rng, capacity = random.Random(7), 64
    histogram = {n: rng.randrange(1000, 9000) for n in range(1, capacity + 1)}
    rows, bins = packing.best_plan(histogram, capacity)
    assert {n: int(rows[rows[:, 0] == n, 2].sum()) for n in histogram} == histogram
    filled = np.zeros(bins, np.int64)
    for length, _, count, first, offset in rows.tolist():
        assert (filled[first : first + count] == offset).all()
        filled[first : first + count] += length
    assert filled.max() <= capacity
    # pieces longer than half a bin share none; small ones fill what those leave
    least = 0
    for k in range(capacity // 2 + 1):
        big = sum(c for n, c in histogram.items() if n > capacity - k)
        middle = {n: c for n, c in histogram.items() if capacity < 2 * n and n <= capacity - k}
        room = sum((capacity - n) * c for n, c in middle.items())
        small = sum(n * c for n, c in histogram.items() if k <= n and 2 * n <= capacity)
        least = max(least, big + sum(middle.values()) + max(0, -(-(small - room) // capacity)))
    assert bins <= 1.03 * least


def test_sum_of_squares_places_one_by_one_as_by_definition():
    """With few pieces the plan takes the place with the smallest sum of squares at each step."""
    rng, capacity = random.Random(2), 20
    histogram = Counter(rng.randint(1, capacity) for _ in range(60))
    rows, bins = packing.plan(histogram, capacity, rounds=64)
    gaps: list[int] = []
    squares = lambda g: sum(v * v for k, v in Counter(g).items() if k)
    for length, _, count, first, offset in rows.tolist():
        assert count == 1
        tried = [squares([*gaps[:i], g - length, *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= length] + [squares([*gaps, capacity - length])]
        if first == len(gaps):
            gaps.append(capacity)
        assert gaps[first] == capacity - offset
        gaps[first] -= length
        assert squares(gaps) == min(tried)
    assert bins == len(gaps)


# --- op9 -------------------------------------------------------------------------------


def test_mixing_meets_its_budgets(odd, docs, empty):
    import duckdb

    for df, mix in ((docs, mixing.Mix()), (odd.where("doc_id is not null"), mixing.Mix(percent=70, max_epochs=3)), (docs, mixing.Mix(percent=100, max_epochs=1))):
        con = duckdb.connect()
        con.register("documents", df.select("doc_id", "text", "lang", "source").toPandas())
        con.execute("create table d as select doc_id::bigint as doc_id, text, lang, source from documents")
        sql = mixing.oracle_sql(mix).replace("from documents", "from d")
        columns = ["doc_id", "domain", "lang", "source", "n_tokens", "copies"]
        want = con.execute(f"select {', '.join(columns)} from ({sql}) q").fetchall()
        assert Counter(map(tuple, mixing.select(df, mix).select(columns).collect())) == Counter(want)
    assert mixing.select(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)]
    tokens = spark.createDataFrame(rows, "domain string, lang string, source string, n_tokens bigint")
    mix = mixing.Mix(domain={"d0": 1, "d1": 1}, lang={}, source={}, percent=50, max_epochs=1)
    got = {r["source"]: r["budget"] for r in mixing.budgets(tokens, mix).collect()}
    assert got == {"a": 10, "b": 492, "c": 503} or got == {"a": 10, "b": 493, "c": 502}
    assert sum(got.values()) == 2010 * 50 // 100


def test_mixed_repeats_rows(docs):
    out = mixing.mixed(docs, mixing.Mix(percent=100, max_epochs=2))
    copies = {r["doc_id"]: r["copies"] for r in mixing.select(docs, mixing.Mix(percent=100, max_epochs=2)).collect()}
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({k: v for k, v in copies.items() if v})
    assert out.columns == docs.columns


def test_mixed_takes_rows_of_one_identifier_by_their_own_leaf(spark, odd, empty):
    rows = [(1, "a b c", "en", "s0"), (1, "a b c", "xx", "s9"), (2, "d " * 50, "en", "s0"), (None, "z", "en", "s0"), (3, "e", None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, lang string, source string, copies int, leaf int")
    mix = mixing.Mix(percent=100, max_epochs=2)
    want = Counter()
    for r in mixing.select(df, mix).where("doc_id is not null").collect():
        want[r["doc_id"], r["lang"], r["source"]] += r["copies"]
    out = mixing.mixed(df, mix)
    found = Counter((r["doc_id"], r["lang"] or "", r["source"] or "") for r in out.collect())
    assert found == Counter({k: v for k, v in want.items() if v}) and out.columns == df.columns
    assert mixing.mixed(odd, mix).columns == odd.columns and mixing.mixed(empty, mix).count() == 0


# --- op3 -------------------------------------------------------------------------------


def exact(rows, k, every):
    out = {}
    for i, v in rows.items():
        if i % every == 0:
            best = sorted((-float(np.dot(v, w)), j) for j, w in rows.items() if j != i and len(w) == len(v))[:k]
            out[i] = [j for _, j in best]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16))
    rows = {i: (centres[i % 30] + 0.7 * rng.standard_normal(16)) * (1 + i % 3) for i in range(3000)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id bigint, embedding array<double>")
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, k=10, shard=1500).orderBy("query_id", "rank").collect():
        assert abs(r["score"] - float(np.dot(rows[r["query_id"]], rows[r["vec_id"]]))) < 1e-9
        found[r["query_id"]].append(r["vec_id"])
    want = exact(rows, 10, 100)
    assert sum(len(set(found[i]) & set(w)) for i, w in want.items()) / sum(map(len, want.values())) >= 0.9
    assert all(len(v) == 10 for v in found.values())


def test_neighbours_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    clean = {r["vec_id"]: np.array(r["embedding"], float) for r in table.where(ann.valid("embedding")).collect()}
    found = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, k=20, shard=700).collect():
        assert abs(r["score"] - float(np.dot(clean[r["query_id"]], clean[r["vec_id"]]))) < 1e-9
        found[r["query_id"]].append(r["vec_id"])
    want = exact(clean, 20, 20)
    assert {k: len(v) for k, v in found.items()} == {k: 20 for k in want}
    recall = sum(len(set(found[i]) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (9, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0])]
    rows += [(100 + i, [2.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    clean = {0: [1.0, 0.0], 7: [2.0, 0.0], 8: [2.0, 0.0], 20: [0.0, 1.0], 9: [1.0, 2.0, 3.0], 40: [1.0, 1.0, 1.0]} | {100 + i: [2.0, 0.0] for i in range(60)}
    assert dict(got) == exact(clean, 20, 20)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- op4, op1 ---------------------------------------------------------------------------


def test_language_accuracy_and_odd_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) >= 0.97
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in found)
    rows = langid.predict(odd, langid.train(docs)).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == len(ODD) and got[1] == got[2] == got[3] == ("und", 0.0) and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(empty).count() == 0 and langid.accepted(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.accepted(docs).count() >= 0.99 * docs.count()


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        at = np.unique(np.append(rng.integers(0, langid.DIM, 20), i % 3))
        rows.append((at.astype(np.int16), np.full(len(at), 0.3, np.float32)))
    y = np.array([0 if 0 in r[0] else 1 if 1 in r[0] else 2 for r in rows])
    w, b = langid.ftrl(rows, y, 3, l1=0.2)
    assert (np.argmax(langid.dense(rows) @ w + b, axis=1) == y).mean() > 0.98 and (w == 0).mean() > 0.5
    assert langid.calibrate(np.array([[9.0, 0.0], [0.0, 9.0], [9.0, 0.0], [9.0, 0.0]]), np.array([0, 1, 0, 1])) > 1


def test_toxicity(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in found)
    hits = sum(r["predicted"] and r["toxic"] for r in found)
    assert right / len(found) >= 0.95 and hits >= 0.8 * sum(r["toxic"] for r in found)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.classify(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.classify(odd, labels.limit(0)).collect()} == {0.0}


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """Model and thresholds come from all labels that may be learned from, in several shards, the same ones each time."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(12_000):
        toxic = int(i % 3 == 0)
        rows.append((i, " ".join(rng.choices(words, k=6) + (["zzz" if i % 2 else "yyy"] if toxic else [])), "en" if i % 5 else None))
        marks += [(i, toxic)] * (2 if i == 9 else 1)
    marks += [(None, 1), (99_999, 1), (3, None), (4, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    learnable = Counter(t for i, t in marks if i is not None and i < 12_000 and t in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2)
    assert learnable[1] > 2_500 and learnable[0] > 5_000  # more than a sample of either class held once
    monkeypatch.setattr(toxicity, "SHARD", 3_000)
    table = toxicity.labelled(docs, labels)
    sums = toxicity._summed(table, toxicity._counted)
    model = toxicity.train(docs, labels)
    judged = Counter()
    for _, _, t, n in toxicity._logits(table, model, True):
        judged[t] += n
    fitted = dict(enumerate(sums[2 * toxicity.ROWS : 2 * toxicity.ROWS + 2]))
    assert {t: fitted[t] + judged[t] for t in (0, 1)} == dict(learnable) and min(judged.values()) > 0
    assert sums[2 * toxicity.ROWS + 2] > 1 and sums[-1] == sum(zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None for i, _, lang in rows)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert sum(found[i]["predicted"] == (i % 3 == 0) for i in found) >= 0.99 * len(found)
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert all(np.array_equal(model.parameters[k], again.parameters[k]) for k in model.parameters) and model.thresholds == again.thresholds


def test_toxicity_of_few_labels_with_a_document(spark):
    """Many labels, of which but a few have a document: these alone teach, whichever part they would fall in."""
    docs = spark.createDataFrame([(i, "bad" if i % 2 else "good") for i in range(4)], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    for own in (0, 1, 2, 3):
        labels = spark.createDataFrame([(i, 1) for i in range(100, 200)] + [(i, i % 2) for i in range(4) if i % 2 == 0 or i == own], "doc_id bigint, toxic int")
        taught = {i % 2 for i in range(4) if zlib.crc32(str(i).encode()) % 4 != 2 and (i % 2 == 0 or i == own)}
        assert (toxicity.train(docs, labels) is not None) == (taught == {0, 1})


def plain_logit(p, words):
    """The convolution of one text in plain loops: words are rows of three table places; two blank words follow them."""
    vectors = [sum(p["embed"][k].astype(float) for k in w) for w in words] + [np.zeros(toxicity.WIDTH)] * 2
    pooled = []
    for w in toxicity.SPANS:
        for f in range(toxicity.FILTERS):
            best = max(
                [-np.inf] + [sum(float(vectors[a + j][d]) * float(p[f"filter{w}"][j][d][f]) for j in range(w) for d in range(toxicity.WIDTH))
                for a in range(len(vectors) - w + 1)]
            )
            pooled.append(max(0.0, best + float(p[f"bias{w}"][f])))
    return sum(h * float(o) for h, o in zip(pooled, p["out"])) + float(p["last"][0])


def test_toxicity_is_that_of_plain_loops_and_of_the_text_alone():
    rng = np.random.default_rng(8)
    p = toxicity._starting(2)
    p["embed"] += rng.standard_normal(p["embed"].shape).astype(np.float32)
    p["embed"][toxicity.PAD] = 0
    some = ["kind words", "", "a", "some thing else that is longer than the others", None, "kind words", " x  y "]
    run = lambda texts: next(text_slices(pa.array(texts, pa.string())))[2:]
    rows, begin = toxicity.tokens(*run(some))
    got = toxicity.forward(p, rows, begin)
    assert got[0] == got[5] and got[1] == got[4]
    for t, z, a, b in zip(some, got, begin[:-1], begin[1:]):
        assert abs(plain_logit(p, rows[a : b - 2].tolist()) - z) < 1e-3
        assert abs(float(toxicity.forward(p, *toxicity.tokens(*run([t])))[0]) - z) < 1e-4
    back = toxicity.forward(p, *toxicity.tokens(*run(some[::-1])))
    assert np.abs(back[::-1] - got).max() < 1e-4


def test_language_by_plain_loops():
    """Features, weights and softmax written out for single texts."""
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b", "c"], rng.random(langid.DIM).astype(np.float32) + 1, rng.standard_normal((langid.DIM, 3)).astype(np.float32), np.zeros(3, np.float32), 0.7)
    low = 0xFFFFFFFF
    scramble = lambda x: (((x ^ (x >> 15)) * 0x2C1B3C6D) & low) >> 19

    def plain(text):
        points = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
        one = [(x * 0x9E3779B1) & low for x in points]
        two = [((points[i] * 0x85EBCA6B) & low) ^ (one[i + 1] >> 3) for i in range(len(points) - 1)]
        three = [((two[i] * 0xC2B2AE35) & low) ^ (one[i + 2] >> 5) for i in range(len(points) - 2)]
        count = Counter(map(scramble, [*one, *((x * 0x27D4EB2F) & low for x in two), *three]))
        x = {k: np.log1p(n) * float(model.idf[k]) for k, n in count.items()}
        size = sum(v * v for v in x.values()) ** 0.5
        z = [sum(v / size * float(model.weights[k][c]) for k, v in x.items()) / model.temperature for c in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        return max(range(3), key=z.__getitem__), max(e) / sum(e)

    some = ["Hello, World", "é", "日本語 text", "a1b2", "The  quick BROWN fox " * 40]
    _, _, offsets, data = next(text_slices(pa.array(some)))
    best, score, letters = model.judge(offsets, data)
    assert letters.all()
    for t, b, s in zip(some, best, score):
        k, v = plain(t)
        assert k == b and abs(v - s) < 1e-4


def test_samples_are_bounded_with_repeated_and_null_identifiers(spark):
    rows = [(None if i % 2 else 7, f"text number {i} of many", "en") for i in range(3000)] + [(i, f"other {i}", "de") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.sample(df, ["text", "lang"], 50)
    assert len(found) == 50 and found == langid.sample(df.repartition(7), ["text", "lang"], 50)
    assert sum(len(r[0]) for r in langid.sample(df, ["text", "lang"], 50, most_bytes=200)) <= 200


def test_toxicity_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in toxicity._starting(1).items()}
    p["embed"] += rng.standard_normal(p["embed"].shape)
    p["embed"][toxicity.PAD] = 0
    texts = pa.array(["a b c d e", "f g h i", "j k a b"])
    _, _, offsets, data = next(text_slices(texts))
    rows, begin = toxicity.tokens(offsets, data)
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z = toxicity.forward(p, rows, begin)
        return float((np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)).mean())

    g, _, _ = toxicity._gradient(p, rows, begin, y, weight)
    for name in ("out", "filter2", "bias3", "last"):
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        old, step = p[name][at], 1e-5
        p[name][at] = old + step
        up = loss()
        p[name][at] = old - step
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-4


# --- op6 -------------------------------------------------------------------------------


def spans_by_definition(t):
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in pii.EMAIL.finditer(t)]
    out["ip"] = [m.span() for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", pii.CARD, 16, 19), ("phone", pii.PHONE, 8, 15)):
        for m in pattern.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out[kind].append(m.span())
    return out


def test_base_spans_by_definition(docs):
    rng = random.Random(2)
    for letters in ("ab.@-+%1 2(5)0\né", "0123456789 -", "1.25", "a@b.-"):
        for _ in range(6000):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
            assert pii.base_spans(t) == spans_by_definition(t)
    for t in texts(docs).values():
        assert pii.base_spans(t) == spans_by_definition(t)


def test_field_on_unseen_sentences_and_viterbi_by_enumeration():
    from itertools import product

    field = pii.trained()
    table = pii.labelled_table(200, seed=5)
    found = field.viterbi([pii.features(w) for w, _ in table])
    assert sum((p == y).sum() for p, (_, y) in zip(found, table)) / sum(len(y) for _, y in table) >= 0.98
    for words, _ in table[:6]:
        run = pii.features(words[:4])
        s = field.scores([run])
        score = lambda p: field.first[p[0]] + sum(s[i, a] for i, a in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(product(range(len(pii.LABELS)), repeat=len(run)), key=score)
        assert abs(score(best) - score(tuple(field.viterbi([run])[0].tolist()))) < 1e-9


def test_windows_decode_as_the_whole_text(docs):
    """Cutting a text to the words near evidence gives the spans of decoding all its words."""
    field, some = pii.trained(), [t for t in texts(docs).values() if t][:120]
    base = [pii.base_spans(t) for t in some]
    near = pii.added_spans(some, base, field)
    whole = pii.windows
    try:
        pii.windows = lambda t: [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]] if t.strip() else []
        assert pii.added_spans(some, base, field) == near
    finally:
        pii.windows = whole


def test_all_words_are_decoded_whatever_stands_near(monkeypatch):
    """Spans are those of one Viterbi run over all features of the whole text, also far from digits, signs and cues."""
    field, strip = pii.trained(), ".,:;!?\"'"

    def plain(t, base):
        words, out = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)], {}
        path = field.viterbi([pii.features([t[a:b] for a, b in words])])[0].tolist() if words else []
        i = 0
        while i < len(path):
            end = i
            while end + 1 < len(path) and path[end + 1] == path[i]:
                end += 1
            a, b = words[i][0], words[end][1]
            a, b = a + len(t[a:b]) - len(t[a:b].lstrip(strip)), b - len(t[a:b]) + len(t[a:b].rstrip(strip))
            if path[i] and b > a and not any(a < q and p < b for s in base.values() for p, q in s):
                out.setdefault(pii.LABELS[path[i]], []).append((a, b))
            i = end + 1
        return out

    rng = random.Random(4)
    vocab = "the of Anna Ben Clara MILLER name Mr. + ( ) - = a+b (foo) 12 3456 call @ % ++-- beta Dr. word, é Ünder +-( =%= a.b.c.d .... 4111 a@b.co 10.0.0.1 host".split()
    some = ["", " ", ") é (foo) ++--"] + [rng.choice([" ", "\n", " \u2003 "]).join(rng.choices(vocab, k=rng.randrange(1, 40))) for _ in range(600)]
    base = [pii.base_spans(t) for t in some]
    found = pii.added_spans(some, base, field)
    assert found[2] == {"phone": [(10, 14)]} and found == [plain(t, b) for t, b in zip(some, base)]
    monkeypatch.setattr(pii, "PIECE", 7)
    monkeypatch.setattr(pii, "CHUNK", 5)
    monkeypatch.setattr(pii, "WORDS", 3)
    assert pii.added_spans(some, base, field) == found


def test_personal_data_rows(spark, odd, empty):
    t = "Please contact Anna Miller or call +1 (555) 010-9999, é a.b@c.example.com 10.0.0.1 and 4111 1111 1111 1111"
    r = pii.find(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first()
    base = pii.base_spans(t)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(pii.joined(base, pii.KINDS).encode()).hexdigest()
    found = [x.split(":") for x in r["spans"].split(",")]
    assert [t[int(a) : int(b)] for k, a, b in found if k == "name"] == ["Anna Miller"]
    assert {tuple(x) for x in found} >= {(k, str(a), str(b)) for k, s in base.items() for a, b in s}
    rows = pii.find(odd).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" for r in rows if r["doc_id"] in (1, 2, 3))
    assert pii.find(empty).count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
