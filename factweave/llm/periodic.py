"""Maximal periodic runs of words by seed and extend along diagonals.

A run of period q and length L >= max(12, 2q) agrees with itself, q words apart, over L - q >= max(12 - q, q) words. So lags 1 to 7 are
seeded by 6-grams, and lags k to 2k - 1, for k = 8, 16, 32 ..., by k-grams: the longest grams that such a run must hold. An index of a
document's grams gives the pairs of occurrences with a lag of the class. Extending a pair covers its diagonal up to where the words
differ; pairs inside what is covered are left out: those whose words before agree (a pair to the left covers them) are passed over as
blocks of the index, and those inside a run whose period divides their lag are found in the table of what is covered furthest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run, the gram of the first lag class and the first lag of the next.
LEAST, FIRST_GRAM, NEXT_LAG = 12, 6, 8
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x7F4A7C15F39CC060) + (left >> np.uint64(29)))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _pairs(words: np.ndarray, grams: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions (i, j) of equal grams with low <= j - i < high and different words before them; None if no gram occurs twice."""
    order = np.argsort(grams, kind="stable")
    sorted_grams = grams[order]
    twice = np.flatnonzero(sorted_grams[1:] == sorted_grams[:-1])
    if not len(twice):
        return None
    keep = np.zeros(len(order), dtype=bool)
    keep[twice] = keep[twice + 1] = True
    order, sorted_grams = order[keep], sorted_grams[keep]
    before = np.where(order > 0, words[order - 1], -1)
    group = np.cumsum(np.r_[False, sorted_grams[1:] != sorted_grams[:-1]])
    # a block: neighbours in the index with the same gram and the same word before
    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (before[1:] != before[:-1]), True])
    block_end = np.repeat(cut[1:], np.diff(cut))
    place = group * (len(words) + 1) + order  # ascends
    base = group * (len(words) + 1)
    at = np.searchsorted(place, place + low)
    end = np.searchsorted(place, np.minimum(place + high, base + len(words)))
    row = np.flatnonzero(at < end)
    at, end = at[row], end[row]
    lefts, rights = [row[:0]], [row[:0]]
    while len(row):
        stop = np.minimum(block_end[at], end)
        differ = before[at] != before[row]
        size = (stop - at)[differ]
        lefts.append(np.repeat(row[differ], size))
        rights.append(np.repeat(at[differ] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()))
        more = stop < end
        row, at, end = row[more], stop[more], end[more]
    return order[np.concatenate(lefts)], order[np.concatenate(rights)]


def _agreement(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on."""
    done, step = 0, 64
    while j + done < len(words):
        b = words[j + done : j + done + step]
        differ = words[i + done : i + done + len(b)] != b
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = done + len(b), step * 2
    return done


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of a sequence of word numbers, by start, then period."""
    n = len(words)
    found: list[tuple[int, int, int]] = []
    if n < LEAST:
        return found
    one = words.astype(np.uint64)
    two = _mixed(one[:-1], one[1:])
    four = _mixed(two[:-2], two[2:])
    k, low, high, grams = FIRST_GRAM, 1, NEXT_LAG, _mixed(four[:-2], two[4:])
    while True:
        pairs = _pairs(words, grams, low, high)
        if pairs is None:  # nor does a longer gram
            return sorted(found, key=lambda r: (r[0], r[2]))
        lefts, rights = pairs
        if len(lefts) and low >= NEXT_LAG:
            # of the runs found so far that could hold two grams of this class, at most one holds any place
            held = np.array(sorted(r for r in found if r[1] >= 2 * k), dtype=np.int64).reshape(-1, 3)
            if len(held):
                of = np.searchsorted(held[:, 0], lefts, side="right") - 1
                start, length, period = held[np.maximum(of, 0)].T
                inside = (of >= 0) & (rights + k <= start + length) & ((rights - lefts) % period == 0)
                lefts, rights = lefts[~inside], rights[~inside]
        covered: dict[int, int] = {}
        by_place = np.argsort(lefts, kind="stable")
        for i, j in zip(lefts[by_place].tolist(), rights[by_place].tolist(), strict=True):
            lag = j - i
            if i < covered.get(lag, 0):
                continue
            same = _agreement(words, i, j)
            covered[lag] = i + same
            if same >= max(lag, LEAST - lag):
                found.append((i, same + lag, lag))
        if low < NEXT_LAG:  # within the first class a period may divide another
            smallest = {}
            for start, length, period in found:
                smallest[start, length] = min(period, smallest.get((start, length), period))
            found = [r for r in found if smallest[r[0], r[1]] == r[2] or r[2] % smallest[r[0], r[1]]]
            k, low, high, grams = NEXT_LAG, NEXT_LAG, 2 * NEXT_LAG, _mixed(four[:-4], four[4:])
        else:
            grams = _mixed(grams[:-k], grams[k:])
            k, low, high = 2 * k, high, 2 * high
        if 2 * low > n:
            return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list[str], seed: int) -> list[str]:
    """Words from a place on repeat the first few from there; place and number follow from the seed."""
    n = len(words)
    begin = seed % n
    period = 1 + (n - begin) // (3 + seed % 8)
    return [*words[:begin], *(words[begin + i % period] for i in range(n - begin))]


def tail_seed(row_id) -> int | None:
    """A tenth of the ids, by crc32 of their decimal text (null: empty text), get a seed for ``repeated_tail``."""
    h = zlib.crc32(b"" if row_id is None else str(row_id).encode())
    return h // 10 if h % 10 == 0 else None


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.schema([("id", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])


def periodic_runs(documents: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", tail=None) -> DataFrame:
    """One row per input row: id, ``runs`` (array of start, length, period by start, then period), ``collapsed``.

    Words are runs of non-white-space, numbered from 0 and compared as they are. A run is a longest stretch with smallest period q and
    at least max(12, 2q) words; runs may overlap. ``collapsed`` joins by one space the words that no run holds after its first q words.
    Null, empty and blank texts have no runs and collapse to an empty text. Repeated rows and null ids are rows like any other; an
    empty table gives an empty result; further columns are not read. ``tail`` maps an id to a seed of ``repeated_tail`` or None.
    A document is one task's work, in memory a small multiple of its text.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = documents.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))

    def one(i, text: str | None) -> tuple[list[dict], str]:
        words = WORD.findall(text or "")
        seed = tail(i) if tail and words else None
        if seed is not None:
            words = repeated_tail(words, seed)
        numbers: dict[str, int] = {}
        runs = find_runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        if not runs:
            return [], " ".join(words)
        dropped = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        kept = np.cumsum(dropped)[:-1] == 0
        return [{"start": s, "length": n, "period": q} for s, n, q in runs], " ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                done = [one(i.as_py(), t.as_py()) for i, t in zip(part.column(0), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], _RUNS), pa.array([d[1] for d in done], pa.string())], schema=_OUT)

    found = rows.mapInArrow(run, "id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.select(F.col("id").alias(id_col if isinstance(id_col, str) else "id"), "runs", "collapsed")
