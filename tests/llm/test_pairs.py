"""Substring dedup, near-dedup and decontamination against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.llm import decontam, graph, neardup, substring
from voxelith.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import check
from .conftest import prose

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACE):
    return re.findall(pattern, text or "")


def repeats(rows, k=20):
    seen, out = set(), {}
    for doc, text in rows:
        w, gone = words(text), set()
        for s in range(len(w) - k + 1):
            x = tuple(w[s : s + k])
            gone |= set(range(s, s + k)) if x in seen else set()
            seen.add(x)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches,max_runs", [(1, 2), (3, 1), (4, 2)])
def test_substring_matches_brute_force(spark, docs, batches, max_runs):
    got = {r[0]: tuple(r)[1:] for r in substring.remove_repeats(docs, batches=batches, max_runs=max_runs).collect()}
    assert got == repeats(sorted(tuple(r) for r in docs.select("doc_id", "text").collect()))


def test_substring_within_and_across_documents(spark):
    passage, other = prose(11, 55), prose(12, 40)
    rows = [(3, f"{prose(13, 30)} {passage}"), (1, passage), (2, f"{passage} {passage}"), (4, other + " " + other[:-3]), (5, "a " * 100)]
    rows += [(10 + i, f"{prose(100 + i, 25)} {passage} {prose(200 + i, 25)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in substring.remove_repeats(df).collect()}
    assert got == repeats(sorted(rows))


def test_substring_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(substring, "SAMPLE", 0.9)
    monkeypatch.setattr(substring, "HOT", 2)
    passage = prose(21, 30)
    rows = [(i, f"{prose(300 + i, 25)} {passage} {prose(400 + i, 25)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    monkeypatch.setattr(substring, "BROADCAST_KEYS", 0)
    got = {r[0]: tuple(r)[1:] for r in substring.remove_repeats(df, batches=2).collect()}
    assert got == repeats(rows)


def test_index_compacts(spark, docs, tmp_path):
    index = substring.WindowIndex(spark, str(tmp_path), max_runs=1)
    rows = substring.keyed(docs, "doc_id", "text")
    for lo, hi in ((0, 60), (60, 120), (120, 10_000)):
        index.add(rows.where((F.col("k") >= lo) & (F.col("k") < hi)), rows.where(F.col("k") < hi))
    entries = index.entries()
    assert len(index.runs) == 2 and entries.count() == entries.select("fp", "ctx").distinct().count()


def test_substring_keys(spark):
    """The largest key is no null, and null keys come after it; keys that don't say an order are refused."""
    p = prose(51, 30)
    rows = [(2**63 - 1, p), (None, p), (None, prose(52, 30)), (2**63 - 1, prose(53, 30))]
    got = sorted((r.doc_id is None, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 0), (False, 0), (True, 0), (True, 30)]
    with pytest.raises(TypeError):
        substring.remove_repeats(spark.createDataFrame([("a", p)], "doc_id string, text string"))


def test_substring_edges(spark, edge, empty):
    got = substring.remove_repeats(edge).collect()
    assert len(got) == edge.count() and substring.remove_repeats(empty).count() == 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(tuple(r)[1:])
    assert by[5] == [(300, 0, by[5][0][2])] * 3
    assert by[6][0][:2] == (300, 300) and by[6][0][2] == hashlib.sha256(b"").hexdigest()
    assert by[0][0][:2] == (0, 0) and by[8][0][0] == 30_000
    assert sorted(x[:2] for x in by[None]) == [(0, 0), (300, 300)]


def test_sliding_argmin():
    rng = np.random.default_rng(0)
    for k in (1, 2, 5, 13):
        x = rng.integers(0, 6, 50).astype(np.uint64)
        got = substring.sliding_argmin(x, k)
        assert [got[i] for i in range(len(x) - k + 1)] == [i + int(np.argmin(x[i : i + k])) for i in range(len(x) - k + 1)]


def weights(text, k=5):
    w = words(text)
    k = min(k, len(w))
    counts = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else {}
    return {x: 1 + np.log(n) for x, n in counts.items()}


def j_p(a, b):
    both, out = set(a) & set(b), 0.0
    union = set(a) | set(b)
    if {*a.values(), *b.values()} == {1.0}:
        return len(both) / len(union)
    for d in both:
        out += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in union)
    return out


def classes(rows, t=0.8):
    own = [weights(x) for _, x in rows]
    texts = [x or "" for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = texts[i] == texts[j] or (own[i] and own[j] and len(set(own[i]) & set(own[j])) > 0.6 * max(len(own[i]), len(own[j])) and j_p(own[i], own[j]) >= t)
            if near and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_probability_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a = {int(x): float(w) for x, w in zip(rng.choice(30, 12, False), rng.integers(1, 4, 12), strict=True)}
        b = {int(x): float(w) for x, w in zip(rng.choice(30, 15, False), rng.integers(1, 4, 15), strict=True)}
        parts = [f(x) for x in (a, b) for f in (lambda d: np.array(sorted(d), np.uint64), lambda d: np.array([d[k] for k in sorted(d)]))]
        assert neardup.probability_jaccard(*parts) == pytest.approx(j_p(a, b), abs=1e-12)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    a = {x: float(rng.integers(1, 5)) for x in range(200)}
    b = {x: (a.get(x) or float(rng.integers(1, 5))) for x in range(40, 240)}
    m = 4000
    doc = np.array([0] * len(a) + [1] * len(b))
    from voxelith.llm.textnum import mix

    element = mix(np.array([*a, *b]).astype(np.uint64) + np.uint64(1))
    sig = neardup.prob_minhash(doc, element, np.array([*a.values(), *b.values()]), 3, m)
    assert abs((sig[0] == sig[1]).mean() - j_p(a, b)) < 0.03 and (sig[2] == 0).all()


def test_near_classes_match_brute_force(spark, docs):
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    want = classes(rows)
    got = {r.doc_id: r for r in neardup.near_classes(docs).collect()}
    assert [got[i].class_id for i, _ in rows] == [rows[c][0] for c in want]
    assert sum(r.keep for r in got.values()) == len(set(want))


def group(n=120, size=200):
    rng, base = np.random.default_rng(5), prose(31, size).split()
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:150])), (3, " ".join(base[:140]))]
    for i in range(4, n):
        w = list(base)
        for j in rng.choice(size, int(rng.integers(0, 14)), False):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("holders,pairs", [(128, 64), (2, 0)])
def test_near_classes_in_a_large_group(spark, monkeypatch, holders, pairs):
    monkeypatch.setattr(neardup, "HOLDERS", holders)
    monkeypatch.setattr(neardup, "PAIRS_A_MEMBER", pairs)
    rows = group()
    want = classes(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [rows[c][0] for c in want]


@pytest.mark.parametrize("holders", [128, 0])
def test_near_classes_of_shortened_copies(spark, monkeypatch, holders):
    """A text and copies that lack a run of words, have others, or both: links that no leader has."""
    monkeypatch.setattr(neardup, "HOLDERS", holders)
    rng, base = np.random.default_rng(6), prose(41, 150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 100):
        a, n, at = int(rng.integers(0, 150)), int(rng.integers(0, 45)), int(rng.integers(0, 150))
        w = base[:a] + base[a + n :]
        rows.append((i, " ".join(w[:at] + [f"v{i % 7}x{j}" for j in range(int(rng.integers(0, 12)))] + w[at:])))
    want = classes(rows)
    assert 3 < len(set(want)) < 90
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [rows[c][0] for c in want]


def test_near_classes_of_edits_of_edits(spark):
    """A text, 60 edits of it, and 40 texts that are near enough to their own edit, but not to the text."""
    base = prose(33, 200).split()
    rows, edits = [(0, " ".join(base))], []
    for i in range(60):
        w = list(base)
        w[3 * i + 7] = f"a{i}"
        edits.append(w)
        rows.append((1 + i, " ".join(w)))
    for i in range(40):
        w, out = list(edits[i]), 0
        own = weights(" ".join(w))
        for j in range(199, -1, -1):
            if abs(j - 3 * i - 7) > 5:
                x = [*w[:j], f"b{i}x{j}", *w[j + 1 :]]
                if j_p(weights(" ".join(x)), own) < 0.8:
                    break
                w, out = x, out + 1
        rows.append((100 + i, " ".join(w)))
        assert out and j_p(weights(rows[-1][1]), own) >= 0.8 > j_p(weights(rows[-1][1]), weights(rows[0][1]))
    got = {r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def offspring(n, first, second):
    """A text, then n pairs: x has a run of ``first`` words of its own, y is x with a run of ``second`` words of its own elsewhere."""
    base = prose(32, 200).split()
    rows = [(0, " ".join(base))]
    for i in range(n):
        x = [f"x{i}w{j}" for j in range(first)] + base[first:]
        at = 70 + i % 100
        y = x[:at] + [f"y{i}w{j}" for j in range(second)] + x[at + second :]
        rows += [(2 * i + 1, " ".join(x)), (2 * i + 2, " ".join(y))]
    return rows


def test_near_classes_of_pairs_that_no_leader_binds(spark):
    rows = offspring(80, 50, 14)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=6, rows=1).collect()}
    assert [got[i] for i, _ in rows] == [0] + [i for i in range(1, 160, 2) for _ in range(2)]


def test_near_classes_through_bound_members(spark):
    rows = offspring(80, 14, 14)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=6, rows=1).collect()}
    assert set(got.values()) == {0} and len(got) == 161


def test_near_edges(spark, edge, empty):
    out = neardup.near_classes(edge)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert out.count() == edge.count() and neardup.near_classes(empty).count() == 0
    assert {r.class_id for i in (5, 6, 7) for r in got[i]} == {5} and [r.keep for r in got[7]] == [False]
    assert got[3][0].class_id == 3 and got[8][0].class_size == 1
    kept = neardup.dedup(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id IN (6, 7)").count() == 0
    assert kept.where("doc_id = 3").count() == 2
    assert neardup.dedup(empty).count() == 0
    twice = edge.where("doc_id = 5").limit(1).withColumn("__node", F.lit(3)).unionByName(edge.where("doc_id = 5").limit(1).withColumn("__node", F.lit(4)))
    one = [neardup.dedup(x).collect() for x in (twice, twice.repartition(2, "__node"))]
    assert one[0] == one[1] and len(one[0]) == 1 and one[0][0]["__node"] in (3, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 102), (101, 102)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in range(100, 104)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def held(rows, items, t=0.8, k=5):
    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = set()
    for item, text in items:
        w = words((text or "").translate(LOWER), ALNUM)
        n = min(k, len(w))
        want = grams(w, n) if w else set()
        out |= {(doc, item) for doc, x in rows if want and len(want & grams(words((x or "").translate(LOWER), ALNUM), n)) >= t * len(want)}
    return out


def test_leaks_match_brute_force(spark, sf, docs, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    own = [tuple(r) for r in items.select("item_id", "text").collect()]
    cut = []
    for i, t in own[:20]:
        w = t.split()
        cut += [(1000 + i, " ".join(w[: int(len(w) * 0.87)]) + " " + prose(i, 400)), (2000 + i, prose(i, 50) + " " + t.upper()), (3000 + i, " ".join(w[: len(w) // 2]))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(cut, "doc_id long, text string"))
    want = held([tuple(r) for r in both.collect()], own)
    for a_pass in (20_000, 7):
        monkeypatch.setattr(decontam, "ITEMS_A_PASS", a_pass)
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(both, items).collect()} == want
        clean = {r.doc_id for r in decontam.without_leaks(both, items).select("doc_id").collect()}
        assert clean == {r.doc_id for r in both.select("doc_id").collect()} - {d for d, _ in want}


def test_sketches_lose_nothing():
    for n in range(1, 400):
        assert n - decontam.sketch_size(n, 0.8) < np.ceil(0.8 * n - 1e-9) or decontam.sketch_size(n, 0.8) == n


def test_leak_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "ONE", 5), (4, "...", 5), (5, "one!", 5), (None, prose(2, 300), 5)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(edge, items).collect()}
    assert {(3, 3), (3, 5), (5, None), (6, None), (None, None), (10, None)} <= got and not any(i in (1, 2, 4) for _, i in got)
    assert decontam.leaks(edge, items.limit(0)).count() == decontam.leaks(empty, items).count() == 0
    assert decontam.without_leaks(edge, items.limit(0)).count() == edge.count() and decontam.without_leaks(empty, items).count() == 0
    assert decontam.without_leaks(edge, items).columns == edge.columns
    wide = edge.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), "text")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(wide, items.withColumn("item_id", F.col("item_id").cast("double"))).collect()} == got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLE_SQL[name])
