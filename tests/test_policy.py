"""The policy against an evaluator in plain Python, on literal and generated snapshots."""

import hashlib
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from shelfmark.operators import delta
from shelfmark.operators.artifacts import publications
from shelfmark.operators.incremental import Evaluation, Step
from shelfmark.schema import FILES, GALLERIES, TAGS, Context, Policy, Snapshot

H = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(6)]
T0 = datetime(2024, 1, 1)


def gallery(key, gid, title="t", minutes=0, artists=(), uploaded=False, hashes=(), metadata=False):
    return {"key": key, "gid": gid, "title": title, "time": T0 + timedelta(minutes=minutes), "artists": artists, "uploaded": uploaded, "hashes": hashes, "metadata": metadata}


def relations(spark, galleries):
    g = [(x["key"], "n-" + x["key"], x["gid"], x["title"], x["time"]) for x in galleries]
    f = [(x["key"], f"{i:03}.jpg", h, i) for x in galleries for i, h in enumerate(x["hashes"])]
    f += [(x["key"], "galleryinfo.txt", H[5], 1) for x in galleries if x["metadata"]]
    t = [(x["key"], i, "artist", a) for x in galleries for i, a in enumerate(x["artists"])]
    t += [(x["key"], 99, "status", "Already UPLOADED") for x in galleries if x["uploaded"]]
    return Snapshot(spark.createDataFrame(g, GALLERIES), spark.createDataFrame(f, FILES), spark.createDataFrame(t, TAGS))


def plain(galleries):
    """spam, content, owners and winners, computed one by one."""
    spam = {}
    for h in {h for g in galleries for h in g["hashes"]}:
        using = [g for g in galleries if h in g["hashes"]]
        n = sum(g["hashes"].count(h) for g in using)
        most = max(len(set(g["artists"])) for g in using)
        distinct = len({a for g in using for a in g["artists"]})
        spam[h] = n >= 3 and most > 0 and distinct > 2 * most
    content = {}
    for g in galleries:
        kept = sorted(h for h in g["hashes"] if not spam[h])
        content[g["key"]] = hashlib.sha256(bytes.fromhex("".join(kept))).hexdigest() if kept else None
    rank = lambda g: (not g["uploaded"], len(g["title"]), g["time"])
    owners, groups = {}, defaultdict(list)
    for g in galleries:
        if content[g["key"]]:
            groups[content[g["key"]]].append(g)
    for c, some in groups.items():
        owners[c] = max(some, key=lambda g: (*rank(g), g["gid"], g["key"]))["key"]
    winners, gids = {}, defaultdict(list)
    for g in galleries:
        c = content[g["key"]]
        if c is None or owners[c] == g["key"]:
            gids[g["gid"]].append(g)
    for gid, some in gids.items():
        winners[gid] = max(some, key=lambda g: (*rank(g), g["key"]))["key"]
    selected = {g["key"] for g in galleries if (content[g["key"]] is None or owners[content[g["key"]]] == g["key"]) and winners.get(g["gid"]) == g["key"]}
    return spam, content, owners, winners, selected


def state(e):
    rows = lambda df, a, b: {r[a]: r[b] for r in df.collect()}
    return (
        rows(e.spam, "sha256", "is_spam"), rows(e.content, "gallery_key", "content_sha256"), rows(e.owners, "content_sha256", "gallery_key"),
        rows(e.winners, "gid", "gallery_key"), {r["gallery_key"] for r in e.inputs.where("selected").collect()},
    )


def drawn(rng):
    out = []
    for slot in range(rng.randint(0, 6)):
        out.append(gallery(
            f"slot-{slot}", rng.randint(1, 4), "title" + "x" * rng.randint(0, 3), slot, rng.sample(["a", "b", "c"], rng.randint(0, 1)),
            rng.random() < 0.3, [rng.choice(H[:5]) for _ in range(rng.randint(0, 5))], rng.random() < 0.5,
        ))
    return out


CASES = {
    "inside one gallery": ([gallery("k", 1, artists=["a"], hashes=[H[0]] * 3)], False),
    "three artists": ([gallery(f"k{i}", i + 1, artists=[a], hashes=[H[0]]) for i, a in enumerate("abc")], True),
    "one without artist": ([gallery(f"k{i}", i + 1, artists=a, hashes=[H[0]]) for i, a in enumerate((["a"], ["b"], []))], False),
    "no artists": ([gallery(f"k{i}", i + 1, hashes=[H[0]]) for i in range(3)], False),
}


@pytest.mark.parametrize("name", CASES)
def test_spam_verdicts(spark, name):
    galleries, verdict = CASES[name]
    e = Evaluation(relations(spark, galleries))
    assert {r["sha256"]: r["is_spam"] for r in e.spam.collect()} == {H[0]: verdict}


def test_a_gallery_of_spam_is_selected_but_not_published(spark):
    first = [gallery("k0", 1001, artists=["a"], hashes=[H[0]])]
    assert publications(Evaluation(relations(spark, first)).inputs).count() == 1
    e = Evaluation(relations(spark, CASES["three artists"][0]))
    assert e.inputs.where("selected").count() == 3 and publications(e.inputs).count() == 0


def test_ties_and_priorities(spark):
    g = [gallery("a", 1, hashes=[H[0]]), gallery("b", 1, hashes=[H[0]]), gallery("c", 2, "longer", uploaded=True, hashes=[H[1]]), gallery("d", 2, hashes=[H[2]])]
    e = Evaluation(relations(spark, g))
    assert state(e)[3] == {1: "b", 2: "d"}
    lonely = [gallery("a", 1, hashes=[H[0]]), gallery("b", 2, "longer", hashes=[H[0]])]
    assert state(Evaluation(relations(spark, lonely)))[3] == {2: "b"}  # gid 1 has no winner


CASES_AT_ONCE = 500


def apart(case, galleries):
    """The galleries of one case under keys, numbers and hashes of their own, so that many cases share a Spark job."""
    own = lambda h: hashlib.sha256(f"{case}:{h}".encode()).hexdigest()
    return [g | {"key": f"{case:04}/{g['key']}", "gid": case * 10 + g["gid"], "hashes": [own(h) for h in g["hashes"]]} for g in galleries]


def test_generated_transitions_agree_with_plain_python_and_with_full_evaluation(spark):
    rng = random.Random(20240501)
    cases = [(apart(i, drawn(rng)), apart(i, drawn(rng))) for i in range(CASES_AT_ONCE)]
    old, new = ([g for case in cases for g in case[k]] for k in (0, 1))
    a, b = Evaluation(relations(spark, old)), Evaluation(relations(spark, new))
    step = Step(a, relations(spark, new))

    def each(k):
        """Plain Python, case by case."""
        out = ({}, {}, {}, {}, set())
        for case in cases:
            for total, part in zip(out, plain(case[k])):
                total.update(part)
        return out

    before, after = each(0), each(1)
    assert state(a) == before
    assert state(step) == state(b) == after
    gone = {r[0] for r in step.owner_tombstones.collect()}
    assert gone == set(before[2]) - set(after[2])
    assert gone <= {r[0] for r in step.owner_workset.collect()}
    ops = [(r["gallery_key"], r["op"]) for r in step.artifact_delta.collect()]
    assert len(ops) == len({k for k, _ in ops}) and {k for k, _ in ops} == before[4] | after[4]


def test_empty_snapshots(spark):
    e = Evaluation(relations(spark, []))
    step = Step(e, relations(spark, []))
    assert state(step) == ({}, {}, {}, {}, set())
    assert step.artifact_delta.count() == 0 and step.evidence_delta.count() == 0


def test_contexts(spark):
    a, b = Context("s", "stable", 1, 0), Context("s", "preview", 2, 1)
    assert delta.context_error(a, a, b, Policy(), Policy()) == "channel"
    with pytest.raises(ValueError):
        Context("s", "stable", 0, 0)
    e = Evaluation(relations(spark, []), context=a)
    with pytest.raises(ValueError, match="channel"):
        Step(e, relations(spark, []), context=b)
    with pytest.raises(ValueError, match="policy"):
        Step(e, relations(spark, []), policy=Policy(version=2))
