"""Fuzzy name scores as vectorised UDFs, meant for candidate pairs only.

Definitions: ``ratio = 200 * LCS / (len(a) + len(b))``; ``token_set_ratio`` compares the shared
words with each side's remainder; ``partial_ratio`` is the best ratio of the shorter string against
windows of the longer one.  Strings are short keys.  The token-set score computes the common
subsequences of a whole batch at once, one bit per character and one 64-bit word per pair; partial ratios
repeat in a batch, hence the memo.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with one big integer as the bit row (Hyyrö 2004)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hits = row & where.get(ch, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def lcs_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """``lcs_length`` of every pair; pairs whose shorter string has over 63 characters go one by one."""
    short = [a if len(a) <= len(b) else b for a, b in zip(left, right, strict=True)]
    long = [b if len(a) <= len(b) else a for a, b in zip(left, right, strict=True)]
    n, m = np.array([len(s) for s in short], np.int64), np.array([len(s) for s in long], np.int64)
    out = np.zeros(len(n), np.int64)
    quick = np.flatnonzero((n > 0) & (n <= 63))
    for i in np.flatnonzero(n > 63).tolist():
        out[i] = lcs_length(short[i], long[i])
    if not len(quick):
        return out
    quick = quick[np.argsort(m[quick], kind="stable")]
    n, m = n[quick], m[quick]

    def codes(texts: list[str], sizes: np.ndarray) -> np.ndarray:
        table = np.zeros((len(texts), int(sizes.max())), np.uint32)
        table[np.arange(table.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return table

    a, b = codes([short[i] for i in quick.tolist()], n), codes([long[i] for i in quick.tolist()], m)
    letters, coded = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    a, b = coded[: a.size].reshape(a.shape), coded[a.size :].reshape(b.shape)
    rows = np.arange(len(quick))
    where = np.zeros((len(quick), len(letters)), np.uint64)
    for i in range(a.shape[1]):
        on = rows[n > i]
        where[on, a[on, i]] |= np.uint64(1 << i)
    full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for j in range(b.shape[1]):
        at = slice(int(np.searchsorted(m, j, side="right")), None)  # pairs whose longer string reaches j
        hits = row[at] & where[rows[at], b[at, j]]
        with np.errstate(over="ignore"):
            row[at] = ((row[at] + hits) | (row[at] - hits)) & full[at]
    out[quick] = n - np.bitwise_count(row).astype(np.int64)
    return out


def token_set_ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """``token_set_ratio`` of every pair."""
    out, tails, at = np.zeros(len(left)), ([], []), []
    prefix, total, floor = [], [], []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        one, two = set(a.split()), set(b.split())
        if not one or not two:
            continue
        shared = one & two
        if shared and (len(shared) == len(one) or len(shared) == len(two)):
            out[i] = 100.0
            continue
        base = sum(map(len, shared)) + len(shared)  # with the blank after it
        tail = [" ".join(sorted(words - shared)) for words in (one, two)]
        for keep, text in zip(tails, tail, strict=True):
            keep.append(text)
        at.append(i)
        prefix.append(base)
        total.append(2 * base + len(tail[0]) + len(tail[1]))
        least = base - 1
        floor.append(200.0 * least / (least + base + min(map(len, tail))) if base else 0.0)
    if at:
        common = lcs_lengths(*tails)
        out[at] = np.maximum(200.0 * (np.array(prefix) + common) / np.array(total), np.array(floor))
    return out


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = sorted(left & right)
    only_left, only_right = sorted(left - right), sorted(right - left)
    if shared and not (only_left and only_right):
        return 100.0
    base = " ".join(shared)
    full_left = " ".join([base, *only_left]).strip()
    full_right = " ".join([base, *only_right]).strip()
    # the shared words are a common prefix, so only the remainders need an LCS
    tail_left, tail_right = " ".join(only_left), " ".join(only_right)
    prefix = len(base) + 1 if base else 0
    total = len(full_left) + len(full_right)
    best = 200.0 * (prefix + lcs_length(tail_left, tail_right)) / total
    if base:
        for full in (full_left, full_right):
            best = max(best, 200.0 * len(base) / (len(base) + len(full)))
    return best


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best window of the longer string; windows at the edges may be shorter than the needle.  A best under ``least`` may come
    back as 0: windows that cannot reach it are passed over."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_window(short, long, least)
    if len(a) == len(b) and best < 100.0:
        best = max(best, _best_window(long, short, least))
    return best


def _best_window(short: str, long: str, least: float) -> float:
    """Slide over ``long``, keeping the letter counts both share: no LCS is longer than that, so
    most windows are passed over without computing one."""
    if short in long:
        return 100.0
    n, best, floor = len(short), 0.0, least - 1e-6
    need: dict[str, int] = {}
    for ch in short:
        need[ch] = need.get(ch, 0) + 1
    have, common = dict.fromkeys(need, 0), 0
    for end in range(1, len(long) + n):
        if end <= len(long) and long[end - 1] in need:
            ch = long[end - 1]
            have[ch] += 1
            common += have[ch] <= need[ch]
        start = end - n
        if start > 0 and long[start - 1] in need:
            ch = long[start - 1]
            common -= have[ch] <= need[ch]
            have[ch] -= 1
        size = min(end, len(long)) - max(0, start)
        if size and 200.0 * common / (n + size) > max(best, floor):
            best = max(best, ratio(short, long[max(0, start) : max(0, start) + size]))
    return best


def _scorer(fn, **fixed):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in memo:
                memo[pair] = fn(*pair, **fixed)
            out.append(memo[pair])
        return pd.Series(out, dtype="float64")

    return score


ratio_udf = _scorer(ratio)


@F.pandas_udf(T.DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = token_set_ratios(a[known].tolist(), b[known].tolist())
    return pd.Series(out).where(known)




def partial_ratio_udf(a, b, least: float = 0.0):
    """Column of partial ratios; those under ``least`` may be 0."""
    return _scorer(partial_ratio, least=least)(a, b)


def letter_counts(texts: Sequence[str]) -> np.ndarray:
    """How often each of 64 classes of characters occurs in every text."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, text in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64)
    return out


def best_needles(needles: Sequence[str], haystack: str, counts: np.ndarray, least: float, n: int, whole: bool = False) -> list[tuple[str, float]]:
    """The needles whose partial ratio with the haystack (``whole``: ratio) is ``least`` or more and not under that of the n-th
    best.  A partial ratio needs a haystack that is no shorter.

    A common subsequence has at most the letters both share, and a window at least as many characters: that bounds a score.
    Needles are scored in order of their bounds, until the bound falls under the n-th best score (a threshold algorithm)."""
    common = np.minimum(counts, letter_counts([haystack])).sum(axis=1)
    bound = 200.0 * common / np.maximum(counts.sum(axis=1) + (len(haystack) if whole else common), 1)
    found: list[tuple[str, float]] = []
    top: list[float] = []
    for i in np.argsort(-bound, kind="stable").tolist():
        floor = top[0] if len(top) == n else least
        if bound[i] < floor - 1e-6:
            break
        if whole:
            score = ratio(needles[i], haystack)
        else:
            score = partial_ratio(needles[i], haystack, floor) if len(needles[i]) <= len(haystack) else 0.0
        if score >= floor:
            found.append((needles[i], score))
            heapq.heappush(top, score)
            if len(top) > n:
                heapq.heappop(top)
    return [f for f in found if f[1] >= (top[0] if len(top) == n else least)]
