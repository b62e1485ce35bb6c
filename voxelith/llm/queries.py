"""The registered corpus queries: thin functions over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, langid, licenses, mixing, neardup, quality, sharding, substring, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), clusters=4)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8, k=5)


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 24)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), threshold=0.8)


def op9_link_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.from_turns(table(spark, sf_dir, "conversations")), chat.TURN_SCHEMAS)


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = neardup.near_classes(table(spark, sf_dir, "documents"), threshold=0.8, k=5)
    return classes.select("doc_id", "class_id", "class_size", "keep")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_mix_sources,
        op3_language_id,
        op4_decontaminate,
        op5_rendezvous_shards,
        op6_quality_rules,
        op7_token_counts,
        op8_license_scan,
        op9_link_tool_calls,
        op10_prob_minhash,
    )
}

#: SQL where it can express the whole query.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS s FROM w WHERE len(words) >= 20),
wins AS (SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS x FROM starts),
again AS (SELECT doc_id, s FROM wins QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM again),
lost AS (SELECT doc_id, list(i) AS out, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE [words[i + 1] FOR i IN range(0, len(words)) IF NOT list_contains(out, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
""",
    "op4_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[s + 1 : s + k], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, sizes WHERE len(w) >= k)),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS x FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM ds JOIN bs USING (k, x) GROUP BY doc_id, item_id)
SELECT doc_id, c.item_id AS item_id, n_shingles, n_common, n_common / n_shingles AS containment
FROM c JOIN n ON c.item_id = n.item_id WHERE n_common >= 0.8 * n_shingles - 1e-9
""",
    "op5_rendezvous_shards": r"""
WITH c AS (SELECT list(v ORDER BY n) AS c FROM (SELECT n, list_reduce([n::BIGINT] || [0::BIGINT FOR i IN range(8)], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('k' || doc_id, 'null') AS name, coalesce(text, '') AS t, CASE WHEN text IS NULL THEN 0 ELSE octet_length(encode(text)) END + 8 AS size FROM documents),
x AS (SELECT d.*, xor(list_reduce([4294967295::BIGINT] || [CAST('0x' || b AS BIGINT) FOR b IN regexp_extract_all(hex(encode(t)), '..')], lambda a, b: xor(a >> 8, c.c[xor(a & 255, b) + 1])), 4294967295) AS crc FROM d, c),
s AS (SELECT rid, s, -ln((CAST('0x' || substr(md5(name || '|shard:' || (s // 2)), 1 + 16 * (s % 2), 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE) AS score FROM d, range(25) r(s)),
b AS (SELECT rid, arg_min(s, score) FILTER (WHERE s < 24) AS shard, arg_min(s, score) AS grown_shard FROM s GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(name || chr(10) || t), 1, 15) AS BIGINT), doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM x JOIN b ON x.rid = b.rid
""",
    "op9_link_tool_calls": r"""
WITH t AS (SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations),
u AS (SELECT conv_id, turn, count(*) AS n FROM t WHERE role = 'user' GROUP BY conv_id, turn),
a AS (SELECT conv_id, turn, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY conv_id, turn)
SELECT t.conv_id AS conv, t.turn AS pos, kind,
       CASE kind WHEN 'call' THEN t.conv_id || ':' || t.turn WHEN 'result' THEN t.conv_id || ':' || (t.turn - 1) END AS id,
       CAST(row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) - 1 AS BIGINT) AS place, 0 AS level,
       CASE WHEN kind = 'result' THEN u.turn END AS call_pos, kind = 'result' AND u.turn IS NULL AS orphan,
       CASE WHEN kind = 'call' THEN CAST(coalesce(a.n, 0) AS BIGINT) END AS answers, CASE WHEN kind = 'result' AND u.turn IS NULL THEN 'no call' END AS problem,
       CASE kind WHEN 'call' THEN '{"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || t.turn || '},"id":"' || t.conv_id || ':' || t.turn || '","name":"reply","type":"call"}'
                 WHEN 'result' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"' || t.conv_id || ':' || (t.turn - 1) || '","type":"result"}'
                 ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"type":"message"}' END AS json
FROM t LEFT JOIN u ON u.conv_id = t.conv_id AND u.turn = t.turn - 1 LEFT JOIN a ON a.conv_id = t.conv_id AND a.turn = t.turn + 1
""",
    "op10_prob_minhash": r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS node, count(*) AS n FROM documents GROUP BY text),
w AS (SELECT node, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
runs AS (SELECT node, w, least(5, len(w)) AS k, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS s FROM w WHERE len(w) > 0),
sh AS (SELECT node, array_to_string(w[s + 1 : s + k], ' ') AS x, 1 + ln(count(*)) AS wt FROM runs GROUP BY node, x),
tot AS (SELECT node, sum(wt) AS total, count(*) AS m, max(wt) AS top FROM sh GROUP BY node),
near AS (SELECT a.node AS a, b.node AS b, sum(a.wt) AS oa, sum(b.wt) AS ob, count(*) AS o FROM sh a JOIN sh b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node),
cand AS (SELECT near.*, ta.total AS wa, tb.total AS wb, ta.m AS ma, tb.m AS mb, greatest(ta.top, tb.top) AS top FROM near JOIN tot ta ON ta.node = a JOIN tot tb ON tb.node = b
         WHERE ta.total / oa + tb.total / ob - 1 <= 1.25 + 1e-9),
plain AS (SELECT a, b, o / (ma + mb - o) AS sim FROM cand WHERE top = 1),
common AS (SELECT c.a AS a, c.b AS b, sa.wt AS x, sb.wt AS y, wa - oa AS ra, wb - ob AS rb FROM cand c JOIN sh sa ON sa.node = c.a JOIN sh sb ON sb.node = c.b AND sb.x = sa.x WHERE top > 1),
kinds AS (SELECT a, b, x, y, ra, rb, count(*) AS n FROM common GROUP BY a, b, x, y, ra, rb),
terms AS (SELECT d.a AS a, d.b AS b, d.n AS n, sum(e.n * greatest(e.x / d.x, e.y / d.y)) + max(d.ra) / d.x + max(d.rb) / d.y AS t
          FROM kinds d JOIN kinds e ON d.a = e.a AND d.b = e.b GROUP BY d.a, d.b, d.n, d.x, d.y),
sims AS (SELECT a, b, sim FROM plain UNION ALL SELECT a, b, sum(n / t) AS sim FROM terms GROUP BY a, b),
e AS (SELECT a, b FROM sims WHERE sim >= 0.8 UNION SELECT b, a FROM sims WHERE sim >= 0.8),
reach AS (SELECT node, node AS root FROM t UNION SELECT e.b, reach.root FROM reach JOIN e ON reach.node = e.a),
classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
sizes AS (SELECT root, CAST(sum(n) AS BIGINT) AS class_size FROM classes JOIN t ON t.node = classes.node GROUP BY root)
SELECT doc_id, c.root AS class_id, class_size, doc_id = c.root AS keep
FROM documents d JOIN t ON t.text = d.text JOIN classes c ON c.node = t.node JOIN sizes s ON s.root = c.root
""",
}
