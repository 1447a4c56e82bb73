"""Language of code-switched text: a linear-chain conditional random field labels every word, forward-backward.

Emissions are sums of learned weights of a word's affixes, character n-grams and the word itself (its lexicon entry),
hashed into a table of fixed size; transitions between word labels are learned with them.  Training sequences are runs of
labelled documents' words strung together, so labels change inside them.  A document's language is the label with the
largest mean posterior over its words that have letters.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.llm.arrow_text import bounded, slices, text_of, word_codes
from placerank.llm.common import bounded_sample

#: Training sample: about so many labelled documents, of so many characters at most, and so many words.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WORDS = 2_000, 20_000, 400_000
#: Hash table of emission features, length of a training sequence.
BUCKETS, LENGTH = 1 << 17, 64
#: Distinct words a worker remembers the scores of, and text bytes it handles at once.
KNOWN, SLICE = 500_000, 8_000_000
UNKNOWN = "und"


def hashed(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, prefixes and suffixes up to 4, and all inner n-grams up to 3."""
    found = ["=" + word]
    for k in range(1, min(4, len(word)) + 1):
        found += ["^" + word[:k], "$" + word[-k:]]
    for k in (1, 2, 3):
        found += [word[i : i + k] for i in range(len(word) - k + 1)]
    return [hashed(f) for f in dict.fromkeys(found)]


#: Steps of crc32 by byte, its states after the marks of prefixes and suffixes and at the start of an n-gram.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)
#: The first letter of three bytes in UTF-8.
WIDE = "\u0800"
MARKS = {mark: np.uint32(zlib.crc32(mark) ^ 0xFFFFFFFF) for mark in (b"^", b"$", b"")}


def crc_buckets(mark: bytes, columns: list[np.ndarray]) -> np.ndarray:
    """Hash buckets of the mark and the letters in each row of the columns, which are one or two bytes in UTF-8."""
    state = np.full(len(columns[0]), MARKS[mark], np.uint32)
    for column in columns:
        wide = column >= 0x80
        first = np.where(wide, 0xC0 | column >> 6, column)
        state = CRC[(state ^ first) & 0xFF] ^ (state >> 8)
        state[wide] = CRC[(state[wide] ^ (0x80 | column[wide] & 0x3F)) & 0xFF] ^ (state[wide] >> 8)
    return (state ^ 0xFFFFFFFF) % (BUCKETS - 1) + 1


def short_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """`word_features` of words of letters below WIDE: the same ids in the same order, made of all words at once."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(n)
    start = ends - n
    affixes = np.minimum(n, 4)
    size = [1 + 2 * affixes, n, np.maximum(n - 1, 0), np.maximum(n - 2, 0)]
    many = sum(size)
    first = np.cumsum(many) - many
    out, keep = np.empty(int(many.sum()), np.int32), np.ones(int(many.sum()), bool)
    out[first] = np.fromiter((hashed("=" + w) for w in words), np.int32, len(words))
    for k in range(1, 5):
        long = np.flatnonzero(n >= k)
        out[first[long] + 2 * k - 1] = crc_buckets(b"^", [data[start[long] + i] for i in range(k)])
        out[first[long] + 2 * k] = crc_buckets(b"$", [data[ends[long] - k + i] for i in range(k)])
    word, at = np.repeat(np.arange(len(words)), n), first.copy()
    place = np.arange(len(data)) - np.repeat(start, n)
    for k in (1, 2, 3):
        at = at + size[k - 1]
        here = np.flatnonzero(place + k <= n[word])
        grams = [data[here + i] for i in range(k)]
        slot = at[word[here]] + place[here]
        out[slot] = crc_buckets(b"", grams)
        code = word[here] << 33
        for i, column in enumerate(grams):
            code |= column.astype(np.int64) << 11 * i
        order = np.argsort(code, kind="stable")
        again = order[1:][code[order[1:]] == code[order[:-1]]]  # an n-gram counts once in a word
        keep[slot[again]] = False
    counts = np.add.reduceat(keep.astype(np.int64), first) if len(words) else n
    return out[keep], counts


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words one after the other, and how many each word has (one at least)."""
    plain = np.fromiter((w.isascii() or max(w) < WIDE for w in words), bool, len(words))
    flat, few = short_features([w for w, p in zip(words, plain, strict=True) if p])
    got = [word_features(w) for w, p in zip(words, plain, strict=True) if not p]
    counts = np.empty(len(words), np.int64)
    counts[plain], counts[~plain] = few, np.fromiter(map(len, got), np.int64, len(got))
    out, owner = np.empty(int(counts.sum()), np.int32), np.repeat(plain, counts)
    out[owner], out[~owner] = flat, np.fromiter(itertools.chain.from_iterable(got), np.int32)
    return out, counts


def summed(weights: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of each word's features, added up."""
    return np.add.reduceat(weights[flat], np.cumsum(counts) - counts) if len(counts) else np.zeros((0, weights.shape[1]), weights.dtype)


def clean_words(distinct: pa.Array) -> list[str]:
    """Letters of each word, with their marks, in lower case; empty if it has no letter."""
    bare = pc.utf8_lower(pc.replace_substring_regex(distinct, r"[^\p{L}\p{M}]+", ""))
    return pc.if_else(pc.match_substring_regex(bare, r"\p{L}"), bare, pa.scalar("", bare.type)).to_pylist()


def posteriors(emit: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over ragged sequences: the label posterior of every word.

    `emit` holds potentials per word (positive), `trans` and `first` too.  All sequences advance together; longest first,
    so those still running are a prefix."""
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], starts[:-1][order]
    steps = int(n[0]) if len(n) else 0
    running = np.searchsorted(-n, -np.arange(steps), side="left")
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    a = None
    for t in range(steps):
        k = running[t]
        at = begin[:k] + t
        a = (first if t == 0 else a[:k] @ trans) * emit[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.empty((0, emit.shape[1]), emit.dtype)
    for t in range(steps - 1, -1, -1):
        k = running[t]
        at = begin[:k] + t
        if len(b) < k:  # sequences that end here
            b = np.concatenate([b, np.full((k - len(b), emit.shape[1]), 1.0, emit.dtype)])
        beta[at] = b
        b = (b * emit[at]) @ trans.T
        b /= b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    return post


@dataclass
class Crf:
    """Labels with emission weights (BUCKETS x labels), log transitions and log start scores."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: list[np.ndarray] = field(default_factory=list)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission potentials of distinct words, remembered per worker."""
        if len(self.known) > KNOWN:
            self.known, self.scores = {}, []
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            rows = summed(self.weights, *feature_rows(part))
            self.known.update({w: len(self.known) + i for i, w in enumerate(part)})
            self.scores.append(np.exp(rows - rows.max(1, keepdims=True)).astype(np.float32))
        table = self.scores = [np.concatenate(self.scores)] if len(self.scores) > 1 else self.scores
        return np.maximum(table[0][np.fromiter((self.known[w] for w in words), np.int64, len(words))], 1e-12) if words else np.zeros((0, len(self.labels)), np.float32)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean posterior per label of each text over its words with letters, the number of these, and the mean of their largest
        posteriors: how certain the words' labels are, whatever the mix of languages."""
        codes, distinct, starts = word_codes(texts)
        clean = clean_words(distinct)
        emit = self.emissions(clean)
        lettered = np.fromiter((bool(w) for w in clean), bool, len(clean))
        kept = lettered[codes] if len(codes) else np.zeros(0, bool)
        row = np.repeat(np.arange(len(texts)), np.diff(starts))[kept]
        count = np.bincount(row, minlength=len(texts))
        ends = np.concatenate([[0], np.cumsum(count)])
        trans, first = np.exp(self.trans).astype(np.float32), np.exp(self.first).astype(np.float32)
        post = posteriors(emit[codes[kept]], ends, trans, first)
        mean = np.stack([np.bincount(row, post[:, k], len(texts)) for k in range(len(self.labels))], 1) / np.maximum(count, 1)[:, None]
        sure = np.bincount(row, post.max(1) if len(post) else None, len(texts)) / np.maximum(count, 1)
        return mean, count, sure


def training_runs(words: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of LENGTH word codes with their labels, strung together from runs of 4 to 48 words of all documents."""
    runs = []
    for codes, label in zip(words, labels, strict=True):
        at = 0
        while at < len(codes):
            end = at + int(rng.integers(4, 49))
            runs.append((codes[at:end], label))
            at = end
    rng.shuffle(runs)
    if not runs:
        return np.zeros((0, LENGTH), np.int64), np.zeros((0, LENGTH), np.int64)
    x = np.concatenate([c for c, _ in runs])
    y = np.concatenate([np.full(len(c), k) for c, k in runs])
    x, y = np.resize(x, -(-len(x) // LENGTH) * LENGTH)[:SAMPLE_WORDS], np.resize(y, -(-len(y) // LENGTH) * LENGTH)[:SAMPLE_WORDS]
    n = len(x) // LENGTH * LENGTH
    return x[:n].reshape(-1, LENGTH), y[:n].reshape(-1, LENGTH)


def train(texts: list[str], langs: list[str], epochs: int = 4, batch: int = 128, rate: float = 0.2, decay: float = 1e-5) -> Crf:
    """Maximise the conditional likelihood by Adagrad on mini-batches; the same model for the same rows."""
    rng = np.random.default_rng(7)
    labels = sorted(set(langs))
    gold = {x: i for i, x in enumerate(labels)}
    size = len(labels)
    model = Crf(labels, np.zeros((BUCKETS, size), np.float32), np.zeros((size, size)), np.zeros(size))
    if size < 2:
        return model
    codes, distinct, starts = word_codes(pa.array(texts, pa.large_string()))
    clean = clean_words(distinct)
    feats, sizes = feature_rows(clean)
    begins = np.cumsum(sizes) - sizes
    lettered = np.fromiter((bool(w) for w in clean), bool, len(clean))
    docs = [c[lettered[c]] for c in (codes[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True))]
    x, y = training_runs(docs, np.array([gold[v] for v in langs]), rng)
    squares = [np.full_like(model.weights, 1e-6), np.full_like(model.trans, 1e-6), np.full_like(model.first, 1e-6)]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            if not len(rows):
                continue
            b = len(rows)
            words, labels_ = x[rows], y[rows]
            many = sizes[words.ravel()]
            flat = feats[np.repeat(begins[words.ravel()] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            score = summed(model.weights, flat, many).reshape(b, LENGTH, size)
            emit = np.exp(score - score.max(2, keepdims=True)) + 1e-12
            trans, first = np.exp(model.trans), np.exp(model.first)
            alpha, beta = np.empty_like(emit), np.ones_like(emit)
            for t in range(LENGTH):
                a = (first if t == 0 else alpha[:, t - 1] @ trans) * emit[:, t]
                alpha[:, t] = a / a.sum(1, keepdims=True)
            for t in range(LENGTH - 2, -1, -1):
                v = (beta[:, t + 1] * emit[:, t + 1]) @ trans.T
                beta[:, t] = v / v.sum(1, keepdims=True)
            post = alpha * beta
            post /= post.sum(2, keepdims=True)
            pair = alpha[:, :-1, :, None] * trans * (emit * beta)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            off = -post
            np.put_along_axis(off, labels_[:, :, None], np.take_along_axis(off, labels_[:, :, None], 2) + 1, 2)
            grad = np.stack([np.bincount(flat, np.repeat(off[:, :, k].ravel(), many), BUCKETS) for k in range(size)], 1)
            moves = np.bincount((labels_[:, :-1] * size + labels_[:, 1:]).ravel(), minlength=size * size).reshape(size, size)
            grads = [grad / b, (moves - pair.sum((0, 1))) / b, off[:, 0].sum(0) / b]
            for param, g, s in zip((model.weights, model.trans, model.first), grads, squares, strict=True):
                g -= decay * param
                s += g * g
                param += rate * g / np.sqrt(s)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Crf | None:
    """Learn from the documents that may teach: a lang, a text, and crc32(doc_id as text) mod 3 other than 1."""
    teach = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
        & (F.length("text") <= SAMPLE_CHARS)
    )
    got = bounded_sample(teach.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")), "doc_id", sample).toPandas()
    if got.empty:
        return None
    got = got.sort_values(["doc_id", "text", "lang"], ignore_index=True)
    return train(got["text"].tolist(), got["lang"].tolist())


def label_texts(docs: DataFrame, model: Crf | None, keep: list[str]) -> DataFrame:
    """`keep` (a struct column or plain ones), lang_pred, score and certainty of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "_text", SLICE):
                rows = [part.column(part.schema.get_field_index(c)) for c in keep]
                if model is None:
                    name, score, sure = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.zeros(part.num_rows)
                else:
                    mean, count, sure = model.score(text_of(part, "_text"))
                    best = mean.argmax(1)
                    name = np.where(count > 0, np.array(model.labels, object)[best], UNKNOWN)
                    score = np.where(count > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*rows, pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())], [*keep, "lang_pred", "score", "certainty"])

    from pyspark.sql import types as T

    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("certainty", T.DoubleType())])
    return bounded(docs.select(*keep, F.col("_text"))).mapInArrow(run, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; null texts and texts without letters are `und` with score 0.

    Without labelled rows every prediction is `und`; a null doc_id is neither held out nor learned from."""
    model = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return label_texts(rows, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_known_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The columns of `docs`, rows whose words have known languages with a mean certainty of at least `least`.

    A text that mixes languages stays if its words are told apart; null texts and texts without letters go.  Repeated rows
    stay as often as they occur; an empty table, or one without labels to learn from, gives an empty one."""
    model = fit(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].cast("string").alias("_text"))
    out = label_texts(rows, model, ["_row"]).where((F.col("lang_pred") != UNKNOWN) & (F.col("certainty") >= least))
    return out.select("_row.*")
