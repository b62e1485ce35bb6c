"""Quality rules: learned decision lists over text statistics.

Sequential covering: a rule, a conjunction of thresholds on a few statistics, is grown on two thirds
of the labelled sample for the best information gain on low-quality texts, pruned on the other
third, and kept if it is precise there; the texts it covers leave, and the next rule is grown. The
list becomes one ordered Spark CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches
from .textnum import SPACE, Words, pieces, runs

#: Labelled texts that the rules are learned from, about.
SAMPLE = 4000
#: Precision that a rule must show on the texts it was not grown on, and texts it must cover there.
PRECISION, COVER = 0.9, 3
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_punct"]


def by_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(flag))
    return upto[offsets[1:]] - upto[offsets[:-1]]


def later_equal(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether an equal entry stands earlier in the same text."""
    order = np.lexsort([np.arange(len(h)), size, h, doc])
    out = np.zeros(len(h), bool)
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1]) & (size[order][1:] == size[order][:-1])
    out[order[1:][same]] = True
    return out


def statistics(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    words = Words(data, offsets, ~SPACE)
    n = words.n_docs
    whole = (data & 0xC0) != 0x80
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    upper, digit = (data >= 0x41) & (data <= 0x5A), (data >= 0x30) & (data <= 0x39)
    letter = ((data | 32) >= 0x61) & ((data | 32) <= 0x7A)
    out = {"n_words": words.count, "word_chars": by_text(whole & ~SPACE[data], offsets), "n_symbols": by_text(table[data], offsets), "n_chars": by_text(whole, offsets), "n_upper": by_text(upper, offsets), "n_digits": by_text(digit, offsets), "n_punct": by_text((data < 0x80) & ~letter & ~digit & ~SPACE[data], offsets)}

    # lines: whole byte strings between line feeds
    is_line = np.ones(256, bool)
    is_line[0x0A] = False
    lines = Words(data, offsets, is_line)
    upto = np.append(0, np.cumsum(~SPACE[data]))
    worded = upto[lines.end] > upto[lines.start]
    again = later_equal(lines.doc, lines.hashes(), lines.end - lines.start) & worded
    out["n_lines"] = np.bincount(lines.doc[worded], minlength=n)
    out["n_dup_lines"] = np.bincount(lines.doc[again], minlength=n)

    h = words.hashes()
    at = np.flatnonzero(words.valid(window))
    grams, doc = runs(h, window)[at], words.doc[at]
    order = np.lexsort([grams, doc])
    same = (doc[order][1:] == doc[order][:-1]) & (grams[order][1:] == grams[order][:-1])
    often = np.zeros(len(at), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[often], 1)
    np.add.at(cover, at[often] + window, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {c: out[c].astype(np.int64) for c in COUNTS}


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text) to (..., COUNTS)."""
    for part, data, offsets in pieces(batches, "text"):
        found = statistics(data, offsets)
        yield pa.record_batch([*part.columns[:-1], *[pa.array(found[c]) for c in COUNTS]], names=[*part.schema.names[:-1], *COUNTS])


def features() -> dict[str, Column]:
    """The statistics that rules see, each a ratio that does not grow with the text, but for the size."""

    def ratio(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbols_a_word": ratio("n_symbols", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "upper_share": ratio("n_upper", "word_chars"),
        "digit_share": ratio("n_digits", "word_chars"),
        "punct_share": ratio("n_punct", "word_chars"),
        "words_a_line": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self, named: dict[str, Column]) -> Column:
        return named[self.feature] > self.value if self.above else named[self.feature] <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


def covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    on = np.ones(n, bool)
    for c in rule:
        on &= c.holds(x)
    return on


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Adds the condition of the best gain (FOIL) until no good text is covered or nothing gains."""
    rule: list[Condition] = []
    on = np.ones(len(bad), bool)
    while len(rule) < most and (on & ~bad).any() and (on & bad).any():
        p0, n0 = (on & bad).sum(), (on & ~bad).sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for name in x:
            order = np.argsort(x[name][on], kind="stable")
            v, b = x[name][on][order], bad[on][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            low_p, low_n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
            for above, p, q in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gain = p * (np.log2(np.maximum(p, 1e-9) / (p + q)) - math.log2(p0 / (p0 + n0)))
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 3, rules: int = 12) -> list[list[Condition]]:
    """The ordered rules that say a text is bad; other texts are good."""
    n = len(bad)
    grown = np.arange(n) % 3 != 0
    left, out = np.ones(n, bool), []
    part = lambda on: {k: v[on] for k, v in x.items()}
    while len(out) < rules and (left & grown & bad).sum() >= COVER:
        rule = grow(part(left & grown), bad[left & grown], most)
        test, truth = part(left & ~grown), bad[left & ~grown]

        def worth(r: list[Condition], test: dict = test, truth: np.ndarray = truth) -> tuple[float, int]:
            on = covered(r, test, len(truth))
            return (truth[on].mean() if on.any() else 0.0), int((on & truth).sum())

        while len(rule) > 1:
            shorter = max(([c for c in rule if c is not d] for d in rule), key=worth)
            if worth(shorter)[0] < worth(rule)[0] or worth(shorter)[0] < PRECISION:
                break
            rule = shorter
        if not rule or worth(rule)[0] < PRECISION or worth(rule)[1] < COVER:
            break
        out.append(rule)
        left &= ~covered(rule, x, n)
    return out


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, COUNTS' first five, base_failed, kept, rule.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of 8. kept:
    false if base_failed, else whether no learned rule holds; rule: the number of the first that
    does, from 1, else 0. Learns from about SAMPLE labelled texts, drawn by a hash of the key. Null
    texts count as empty; null labels and keys teach nothing; without labels there is no rule. Equal
    rows get equal results; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in COUNTS)
    named = features()
    known = labels.select(F.col(key).alias("own"), F.col(label).cast("int").alias("label")).where("own IS NOT NULL AND label IS NOT NULL")
    n = known.count()
    draw = F.pmod(F.xxhash64("own"), F.lit(1_000_003)) / 1_000_003 < min(1.0, SAMPLE / max(n, 1))
    sample = known.where(draw).groupBy("own").agg(F.min("label").alias("label"))
    drawn = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("own")).select("doc_id", "label", "text")
    drawn = drawn.mapInArrow(count_rows, f"doc_id {kind}, label int, {fields}")
    seen = drawn.select("doc_id", "label", *[c.alias(name) for name, c in named.items()]).toPandas().sort_values(["doc_id", "n_words"])
    rules = learn({c: seen[c].to_numpy(float) for c in named}, seen["label"].to_numpy() == 0) if len(seen) else []
    counted = rows.mapInArrow(count_rows, f"doc_id {kind}, {fields}")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    first = F.lit(0)
    for i, rule in reversed([*enumerate(rules, 1)]):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(named)
        first = F.when(holds, i).otherwise(first)
    return counted.select("doc_id", *COUNTS[:5], base.alias("base_failed"), (~base & (first == 0)).alias("kept"), first.alias("rule"))
