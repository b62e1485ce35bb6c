"""Operators that judge each text by itself, mixing and sharding."""

import collections
import hashlib
import json
import math
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxelith.llm import chat, langid, licenses, mixing, quality, sharding, tokens
from voxelith.llm.queries import QUERIES

from .conftest import prose

SPACE = r"[^\x20\x09-\x0D]+"


def plans(df):
    return df._jdf.queryExecution().toString()


# -- mixing


def water(sizes, total, cap=2.0):
    """Targets by bisection on the level."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    lo, hi = 0.0, total + 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * sizes[s], mid * w[s]) for s in names) < total else (lo, mid)
    return {s: min(cap * sizes[s], hi * w[s]) for s in names}


def check_mix(docs):
    own = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = collections.Counter()
    for _, s, t in own:
        sizes[s] += len(re.findall(SPACE, t or ""))
    out = mixing.mix_sources(docs)
    got = out.collect()
    assert len(got) == len(own)
    target = water(sizes, 1.5 * sum(sizes.values()))
    by = collections.defaultdict(int)
    key = {(d, len(re.findall(SPACE, t or ""))): s for d, s, t in own}
    for r in got:
        s = key[r.doc_id, r.size]
        by[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6)
    for s in sizes:
        assert abs(by[s] - target[s]) <= max(0.02 * target[s], 3)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix(docs):
    check_mix(docs)


def test_mix_edges(edge, empty):
    check_mix(edge.where("doc_id IS NULL OR doc_id <> 5"))
    assert mixing.mix_sources(edge).count() == edge.count()
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(edge).columns == edge.columns


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix_sources(df).collect()] == [(0, 0.0)] * 2


def test_mix_takes_small_sources_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 100)
    rows = [(i, "w " * 1000, "a") for i in range(300)] + [(1000 + i, "v " * 100, "b") for i in range(5)] + [(2000 + i, "u " * 50, s) for s in "cd" for i in range(4)]
    df = spark.createDataFrame([(i + 10_000 * ord(s), t, s) for i, t, s in rows], "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert all(r.taken == 2 * r.size and r.first_slot is not None for r in got if r.size < 1000)
    assert sum(r.taken for r in got if r.size == 1000) == 451_350 - 2 * 900
    assert mixing.mixed(df).where("source <> 'a'").count() == 26


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(0, 50.0), (1, 20.0), (2, 30.0)], "sid int, target double")
    slots = mixing.schedule(targets, 1000).toPandas()
    for n in (10, 100, 1000):
        counts = slots[slots.slot < n].sid.value_counts()
        assert all(abs(counts.get(s, 0) - n * t) <= 3 for s, t in ((0, 0.5), (1, 0.2), (2, 0.3)))
    assert all((g.sort_values("slot")["rank"].to_numpy() == np.arange(len(g))).all() for _, g in slots.groupby("sid"))


# -- sharding


def check_shards(docs, n=24):
    out = sharding.assign_shards(docs, [1.0] * n)
    got = out.toPandas()
    assert len(got) == docs.count()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((got.shard == got.grown_shard) | (got.grown_shard == n)).all() and set(got.law) <= {"key"}
    assert (got.groupby("doc_id", dropna=False).shard.nunique() == 1).all()
    return got


def test_shards(docs):
    got = check_shards(docs).set_index("doc_id")
    for r in docs.limit(50).collect():
        assert got.loc[r.doc_id, "size"] == len(r.text.encode()) + 8 and got.loc[r.doc_id, "text_crc32"] == zlib.crc32(r.text.encode())
    again = check_shards(docs.repartition(7)).set_index("doc_id")
    assert (again.sort_index().slot == got.sort_index().slot).all()


def test_shard_edges(edge, empty):
    got = check_shards(edge)
    assert got[got.doc_id == 0]["size"].tolist() == [8]
    assert sharding.assign_shards(empty, [1.0] * 24).count() == 0
    assert sharding.assign_shards(edge, [1.0] * 3, carry=["text"]).columns[-1] == "text"
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("a"), [0.0])


def test_shards_match_brute_force(docs):
    """Every row's shard by the least -ln(u) over all shards, from MD5 of key and shard alone."""
    n = 24

    def score(key, s):
        half = hashlib.md5(f"k{key}|shard:{s // 2}".encode()).hexdigest()[16 * (s % 2) :]
        return -math.log((int(half[:13], 16) + 0.5) / 2.0**52)

    got = sharding.assign_shards(docs, [1.0] * n).collect()
    own = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        x = [score(r.doc_id, s) for s in range(n + 1)]
        assert r.shard == min(range(n), key=x.__getitem__) and r.grown_shard == min(range(n + 1), key=x.__getitem__)
        assert (r.size, r.text_crc32) == (len(own[r.doc_id].encode()) + 8, zlib.crc32(own[r.doc_id].encode()))


def test_shard_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 7, 8, 9), (1, "b", 7, 8, 9)], "doc_id long, text string, __h int, __key int, __part int")
    got = sharding.assign_shards(df, [1.0] * 3, carry=["__h", "__key", "__part"]).collect()
    assert all((r["__h"], r["__key"], r["__part"]) == (7, 8, 9) for r in got) and sorted(r.slot for r in got) == [0, 1]


def test_shard_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = sharding.assign_shards(df, [1.0, 2.0, 1.0, 0.0], [1.0, 2.0, 1.0, 0.0, 4.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert set(counts.index) == {0, 1, 2} and abs(counts[1] - 10_000) < 400
    same, logs = (sharding.best_of(sharding.scores(F.col("doc_id").cast("string"), [2.0] * 5, plain))["shard"] for plain in (True, False))
    assert df.where(same != logs).isEmpty()


# -- language


def test_languages(docs):
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all() and got.rejected.mean() < 0.06
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def test_language_rejects_what_is_no_language(spark, docs):
    """Code, other scripts, random letters and one word over and over go; prose of the learned languages stays."""
    own = [r for r in docs.where("length(text) > 300").select("doc_id", "text").collect() if len(set(r.text.split())) > 0.35 * len(r.text.split()) and not re.search(r"!!|###|\$\$", r.text)]
    rng = np.random.default_rng(3)
    junk = [
        "for (int i = 0; i < n; i++) { if (x[i] != NULL) printf(\"%d\", buf[i]); } #define MAX(a,b) ((a)>(b)?(a):(b)) return ptr->next; " * 3,
        "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 6,
        "天地玄黃宇宙洪荒日月盈昃辰宿列張" * 20,
        " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 9)) for _ in range(60)),
        "Wbpst " * 120,
        "天地玄黃",
    ]
    extra = spark.createDataFrame([(100_000 + i, t, None, None, None) for i, t in enumerate(junk)], docs.schema)
    gone = {r.doc_id for r in langid.identify(docs.unionByName(extra)).where("rejected").collect()}
    assert {100_000 + i for i in range(len(junk))} <= gone
    assert len(own) > 60 and not gone & {r.doc_id for r in own}


def brute_language(model, text):
    """Language, score and rejection by plain loops."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    data = b" " + bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))) + b" "
    counts = collections.Counter()
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if b != 32 or (a != 32 and c != 32):
            counts[((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 20] += 1
    x = {g: math.log1p(n) * float(model.idf[g]) for g, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    near = [sum(v / norm * float(c[g]) for g, v in x.items()) for c in model.centroids]
    best = max(near)
    n = sum(counts.values())
    size = min(15, int(math.log2(max(1, n))))
    return model.languages[model.owner[near.index(best)]], max(0.0, min(1.0, best)), best < model.floors[size] * n / (n + 24)


def test_language_matches_brute_force(docs):
    model = langid.learned(docs, 4, "doc_id", "text", "lang")
    assert len(model.centroids) == 4 * len(model.languages) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identify(docs).collect():
        lang, score, rejected = brute_language(model, texts[r.doc_id])
        assert math.isclose(r.score, score, abs_tol=1e-4) and (r.lang_pred, r.rejected) == (lang, rejected)


def test_language_never_sees_labels(docs):
    a = langid.identify(docs).orderBy("doc_id").collect()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    b = langid.identify(docs.withColumn("lang", F.when(fold, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))).orderBy("doc_id").collect()
    assert a == b


def test_language_edges(edge, empty, spark):
    got = collections.defaultdict(list)
    for r in langid.identify(edge).collect():
        got[r.doc_id].append(r)
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for i in (0, 1, 2, 4) for r in got[i])
    assert got[5][0].lang_pred in ("en", "fr") and len(got[5]) == 3
    assert langid.identify(empty).count() == langid.accepted(empty).count() == 0
    kept = langid.accepted(edge)
    assert kept.columns == edge.columns and kept.where("doc_id IN (0, 1, 2, 4)").count() == 0 and kept.where("doc_id = 5").count() == 3
    none = langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


# -- quality


def counts(text):
    w = re.findall(SPACE, text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for r in docs.collect():
        own = got[r.doc_id]
        n = counts(r.text)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert tuple(own)[1:6] == n and own.base_failed == failed and own.kept == (not failed and own.rule == 0)


def test_quality_learns(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.5))
    rules = quality.learn(x, bad)
    on = np.any([quality.covered(r, x, 900) for r in rules], axis=0)
    assert (on == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(900, bool)) == []


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(None, 0, 0), (5, None, 0), (5, 0, 0), (5, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(edge, labels).collect()
    assert sorted(tuple(r)[1:6] for r in got) == sorted(counts(r.text) for r in edge.collect())
    assert quality.judge(empty, labels).count() == 0 and quality.judge(edge, labels.limit(0)).count() == edge.count()


# -- tokens


@pytest.mark.parametrize("limit", [0, 3, 1000])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens(spark, edge, docs, monkeypatch, name, limit):
    monkeypatch.setattr(tokens, "BROADCAST_KEYS", limit)
    path = public_tokenizers.path(name)
    df = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(90, "a <|endoftext|> b <s>")], "doc_id long, text string")).unionByName(docs.select("doc_id", "text").limit(30))
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        count = lambda t, p=sentencepiece.SentencePieceProcessor(model_file=path): len(p.encode(t))
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), count(r.text or "")) for r in df.collect())
    got = tokens.count_tokens(df, path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_token_cache_grows_once(spark, edge, empty, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    tokens.count_tokens(edge, path, cache).count()
    rows = spark.read.parquet(cache)
    n = rows.count()
    assert n == rows.select("digest").distinct().count() == edge.select(F.coalesce("text", F.lit(""))).distinct().count()
    tokens.count_tokens(edge, path, cache).count()
    assert spark.read.parquet(cache).count() == n
    tokens.count_tokens(edge, public_tokenizers.path("piece_bpe_32k.model"), cache).count()
    assert spark.read.parquet(cache).count() == 2 * n
    assert tokens.count_tokens(empty, path).count() == 0
    with pytest.raises(ValueError):
        tokens.encoder("x.txt", b"")


# -- licenses

GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_truth(text, threshold=0.8):
    lower = str.maketrans(licenses.UPPER, licenses.LOWER)
    w = re.findall(GAP, (text or "").translate(lower))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = {x for _, x in places}
    best, found = 0.0, set()
    for line in (text or "").split("\n"):
        block = set(re.findall(GAP, line.translate(lower)))
        for label, t in licenses.TEMPLATES.items():
            own = set(licenses.template_words(t))
            if len(own & block) >= math.ceil(threshold * len(own) - 1e-9):
                found.add(label)
                best = max(best, len(own & block) / len(own))
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else best


def license_rows():
    texts = [r[:1] + ("\n".join([prose(i, 10), t, t[: int(len(t) * 0.85)], prose(i, 5)]),) for i, (r, t) in enumerate(((i + 500,), t) for i, t in enumerate(licenses.TEMPLATES.values()))]
    return texts + [(600, "MIT License mit-license\nGNU general PUBLIC license"), (601, "mİt license"), (602, "apache\nlicense"), (603, "mit licenKe")]


def test_licenses(spark, docs, edge):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(license_rows(), "doc_id long, text string")).unionByName(edge.select("doc_id", "text"))
    got = sorted(str((r.doc_id, *tuple(r)[1:7], round(r.score, 9))) for r in licenses.scan_licenses(df).collect())
    want = []
    for r in df.collect():
        *x, score = license_truth(r.text)
        want.append(str((r.doc_id, *x, round(score, 9))))
    assert got == sorted(want)


def test_licenses_wrapped_over_lines(spark):
    def wrapped(label, text, mark):
        return "\n".join([prose(1, 30), "", *[mark + x for x in textwrap.wrap(text, 72)], "", prose(2, 30)])

    rows = [(i, label, wrapped(label, text, mark)) for i, (label, text, mark) in enumerate((a, b, m) for a, b in licenses.TEMPLATES.items() for m in ("", "# ", " * ", "// "))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, label string, text string")).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1 for i, label, _ in rows)


def test_license_edges(empty, edge):
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(edge, templates={}).count() == edge.count()


def test_native_operators_run_no_python(docs):
    for df in (licenses.scan_licenses(docs), mixing.mix_sources(docs), sharding.assign_shards(docs, [1.0] * 24)):
        assert not re.search("Python|Pandas|Arrow|Batch Eval", plans(df))


# -- chats

EVENTS = "conv string, pos long, kind string, id string, parent string, name string, args string, text string, json string, level int"
SCHEMAS = {"f": {"a": "string", "b": "integer", "c": "boolean?"}}


def formatted(spark, rows):
    return {(r.conv, r.pos): r for r in chat.format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], EVENTS), SCHEMAS).collect()}


def test_chat_links_orders_and_validates(spark):
    got = formatted(spark, [
        ("a", 0, "message", None, None, None, None, 'say "hi"\n'), ("a", 1, "result", "c1", None, None, None, "r"),
        ("a", 2, "call", "c1", None, "f", '{"b": 2, "a": "é\\"q"}', None), ("a", 3, "call", "c2", "c3", "f", '{"a":"x","b":"no"}', None),
        ("a", 4, "call", "c3", None, "g", "{}", None), ("a", 5, "result", "zz", None, None, None, None), (None, 0, "message", None, None, None, None, None),
        ("b", 0, "call", "x", "y", "f", '{"a":"1","z":1,"b":1}', None), ("b", 1, "call", "y", "x", "f", "[1]", None), ("b", 2, "result", "y", None, None, None, ""),
        ("c", 0, "call", "k", None, "f", '{"a":"1"}', None), ("c", 0, "call", "k2", None, "f", '{"a":"1","b":7,"c":true}', None),
    ])
    assert got["a", 2].json == '{"arguments":{"a":"é\\"q","b":2},"id":"c1","name":"f","type":"call"}'
    assert got["a", 0].json == '{"content":"say \\"hi\\"\\n","type":"message"}' and got[None, 0].json == '{"content":null,"type":"message"}'
    assert got["a", 2].answers == 1 and got["a", 1].call_pos == 2 and got["a", 1].place > got["a", 2].place
    assert got["a", 3].place > got["a", 4].place and got["a", 5].orphan and got["a", 5].problem == "no call"
    assert got["a", 3].problem == "not integer: b" and got["a", 4].problem == "unknown tool"
    assert (got["b", 0].level, got["b", 1].level, got["b", 2].level) == (-1, -1, -1)
    assert got["b", 0].problem == "unknown: z" and got["b", 1].problem == "not an object"
    assert sorted(r.place for (c, _), r in got.items() if c == "a") == list(range(6))
    for r in got.values():
        x = json.loads(r.json)
        assert r.json == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_chat_types(spark):
    args = ['{"a":5,"b":1}', '{"a":"5","b":"2"}', '{"a":{"x":1},"b":2}', '{"a":"x","b":2.0}', '{"a":"x","b":2,"c":"true"}', '{"a":"x","b":2,"c":null}', '{"a":null,"b":2}', '{"a":"1","a":"2","b":2}', '{"a":"x","b":123456789012345678901234567890}', '{"a":"x","b":-7,"c":false}']
    got = formatted(spark, [("a", i, "call", f"c{i}", None, "f", x, None) for i, x in enumerate(args)])
    want = ["not string: a", "not integer: b", "not string: a", "not integer: b", "not boolean: c", None, "missing: a", "not an object", None, None]
    assert [got["a", i].problem for i in range(len(args))] == want
    assert '"b":123456789012345678901234567890' in got["a", 8].json and all(("arguments" in got["a", i].json) == (w is None) for i, w in enumerate(want))


def test_chat_long_chain_backwards(spark):
    n = 45
    rows = [("a", n - i, "call", f"c{i}", f"c{i - 1}" if i else None, "f", '{"a":"1","b":1}', None) for i in range(n)]
    rows += [("a", 0, "result", f"c{n - 1}", None, None, None, "r"), ("b", 0, "call", "x", "y", "f", "{}", None), ("b", 1, "call", "y", "x", "f", "{}", None), ("b", 2, "call", "z", "y", "f", "{}", None)]
    got = formatted(spark, rows)
    assert [got["a", n - i].level for i in range(n)] == [got["a", n - i].place for i in range(n)] == list(range(n))
    assert got["a", 0].place == n and {got["b", i].level for i in range(3)} == {-1}


def test_chat_query(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    got = QUERIES["op9_link_tool_calls"](spark, sf).toPandas().set_index(["conv", "pos"])
    assert len(got) == len(turns) and (got.level == 0).all()
    for c, g in turns.sort_values("turn").groupby("conv_id"):
        users = set(g[g.role == "user"].turn)
        for place, r in enumerate(g.itertuples()):
            own = got.loc[(c, r.turn)]
            assert own.place == place and own.orphan == (r.role == "assistant" and r.turn - 1 not in users)
            x = json.loads(own.json)
            assert (x["arguments"]["prompt"] if r.role == "user" else x["content"]) == r.text


def test_chat_edges(spark):
    assert chat.format_chats(spark.createDataFrame([], EVENTS), SCHEMAS).count() == 0
    same = ("a", 1, "call", "c", None, "f", '{"a":"1","b":1}', None)
    assert sorted(r.place for r in chat.format_chats(spark.createDataFrame([(*same, "", 0)] * 3, EVENTS), SCHEMAS).collect()) == [0, 1, 2]
    nothing = spark.createDataFrame([(None,) * 10], EVENTS)
    assert chat.format_chats(nothing, SCHEMAS).count() == 1
    turns = spark.createDataFrame([(None, None, None, None), (1, 0, "user", None), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.from_turns(turns), chat.TURN_SCHEMAS).count() == 3
