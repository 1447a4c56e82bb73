"""Learned decision lists over text statistics.

Every document gets whole-text counts (one pass, no shuffle).  Labelled rows teach an ordered list of rules, each a
conjunction of thresholds, by sequential covering: a rule is grown condition by condition on one part of the sample
(information gain), pruned from its end on the other part, kept if it is precise there, and what it covers is taken out
before the next.  The list becomes one ordered Spark `when` expression over the counts of all documents.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.llm.arrow_text import bounded, byte_counts, slices, split_pieces, text_of, word_codes
from placerank.llm.common import bounded_sample, materialise

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
#: Labelled rows the list is learned from at most; those with the smallest hash of doc_id.
SAMPLE = 20_000
#: Share of wrong verdicts a rule may have on the pruning part.
MIN_PRECISION = 0.9


def repeated_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text, words that lie in a 3-word window whose words occur as a window twice or more in that text."""
    n, rows = len(codes), len(starts) - 1
    if n < 3:
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(starts))
    whole = row[2:] == row[:-2]
    width = int(codes.max()) + 1
    pair = pd.factorize(codes[:-1] * width + codes[1:])[0].astype(np.int64)
    three = pd.factorize(pair[:-1] * width + codes[2:])[0].astype(np.int64)
    window = pd.factorize(three * rows + row[:-2])[0]
    often = (np.bincount(window[whole], minlength=window.max() + 1)[window] > 1) & whole
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= often
    return np.bincount(row[covered], minlength=rows).astype(np.int64)


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text, lines with a word, and those of them that equal an earlier line."""
    flat, row = split_pieces(pc.split_pattern(texts, "\n"))
    coded = flat.dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0))[code]
    key = row[full] * max(1, len(coded.dictionary)) + code[full]
    lines = np.bincount(row[full], minlength=len(texts))
    distinct = np.bincount(pd.unique(key) // max(1, len(coded.dictionary)), minlength=len(texts))
    return lines.astype(np.int64), (lines - distinct).astype(np.int64)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text."""
    codes, distinct, starts = word_codes(texts)
    chars = np.asarray(pc.utf8_length(distinct)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(chars[codes])])
    lines, dup = line_counts(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    kinds = pd.unique(row * max(1, len(distinct)) + codes) // max(1, len(distinct))
    return {
        "n_words": np.diff(starts), "word_chars": np.diff(total[starts]), "n_symbols": byte_counts(texts, SYMBOLS), "n_dup_lines": dup,
        "n_repeat_words": repeated_words(codes, starts), "n_lines": lines, "n_upper": byte_counts(texts, string.ascii_uppercase.encode()),
        "n_digits": byte_counts(texts, string.digits.encode()), "n_marks": byte_counts(texts, b".,;:!?'\"()-"),
        "n_distinct": np.bincount(kinds.astype(np.int64), minlength=len(texts)),
    }


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row's whole text; null texts count as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                got = measure(text_of(part))
                ids = part.column(part.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(got[c], pa.int64()) for c in COUNTS]], ["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(count, schema)


def features() -> dict[str, Column]:
    """What rules may set thresholds on: counts per word, line or character."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": c("n_words").cast("double"), "mean_word": c("word_chars") / words, "symbols": c("n_symbols") / words,
        "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), "repeats": c("n_repeat_words") / words,
        "upper": c("n_upper") / F.greatest(c("word_chars"), F.lit(1)), "digits": c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
        "marks": c("n_marks") / words, "distinct": c("n_distinct") / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.threshold if self.above else of[self.feature] <= self.threshold


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for cond in rule:
        hit &= cond.holds(x)
    return hit


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, cuts: int, without: frozenset[str] = frozenset()) -> Condition | None:
    """The condition with the largest information gain among the rows a rule covers so far."""
    p, n = bad[inside].sum(), (~bad[inside]).sum()
    if not p or not n:
        return None
    before, best, gain = np.log2(p / (p + n)), None, 1e-9
    for name in sorted(set(x) - without):
        v = x[name][inside]
        for cut in np.unique(np.quantile(v, np.linspace(0, 1, cuts))):
            for above in (True, False):
                hit = v >= cut if above else v <= cut
                q, m = bad[inside][hit].sum(), (~bad[inside][hit]).sum()
                got = q * (np.log2(q / (q + m)) - before) if q else 0.0
                if got > gain:
                    best, gain = Condition(name, above, float(cut)), got
    return best


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, rules: int = 16, length: int = 4, cuts: int = 65, least: int = 3) -> list[list[Condition]]:
    """Ordered rules for `bad` rows; every third row prunes, the others grow.  Needs both classes; else no rule.

    A rule that isn't precise on the pruning rows is given up, and its leading feature starts no later one."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    open_, found, failed = np.ones(n, bool), [], frozenset()
    while len(found) < rules:
        rule, inside = [], open_ & ~prune
        while len(rule) < length and (cond := best_condition(x, bad, inside, cuts, frozenset() if rule else failed)):
            rule.append(cond)
            inside &= cond.holds(x)

        def worth(r: list[Condition]) -> float:
            hit = covers(r, x, n) & open_ & prune
            return (2 * bad[hit].sum() - hit.sum()) / max(1, hit.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covers(rule, x, n) & open_
        checked = hit & prune
        if not rule:
            break
        if bad[hit].sum() < least or not checked.any() or bad[checked].mean() < MIN_PRECISION or bad[hit].mean() < MIN_PRECISION:
            failed |= {rule[0].feature}
            continue
        found.append(rule)
        open_ &= ~hit
    return found


def as_column(rules: list[list[Condition]]) -> Column:
    """True where no rule fires: ordered `when` branches, first hit decides."""
    of, out = features(), None
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column(of)
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(counts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules from about `sample` labelled rows at most, drawn by a hash of doc_id; quality 0 is bad, null is left out."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counts.join(known, "doc_id").select("doc_id", (F.col("quality") == 0).alias("bad"), *[v.alias(k) for k, v in features().items()])
    got = bounded_sample(rows, "doc_id", sample).toPandas()
    if got.empty:
        return []
    got = got.sort_values("doc_id", ignore_index=True)
    return learn_list({k: got[k].to_numpy(float) for k in features()}, got["bad"].to_numpy(bool))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row (repeated rows stay repeated; null texts are empty and fail).

    Without labels the list is empty and every document that passes the base stays."""
    counts = materialise(text_counts(docs))
    rules = learn(counts, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & as_column(rules)).alias("kept"))
