"""Runs of repeated word sequences by an online sparse dynamic program over lags."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has LEAST words at least and REPEATS times its period.
LEAST, REPEATS = 24, 3
#: So many words at least match the ones a period before them in any run: LEAST - p for short periods p, 2 * p for others.
WINDOW = 16
#: Places ahead at which a lag is tried before it is opened.
PROBES = 8
#: Places from which lags are tried all at once.
MANY = 48
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _window_codes(words: list[bytes]) -> np.ndarray:
    """A hash of the WINDOW words that end at each word, from word WINDOW - 1 on. Equal windows have equal hashes."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    width = 1
    while width < WINDOW:
        h = h[:-width] * _MIX + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run: a stretch with smallest period p, LEAST words and REPEATS * p at least, that
    no neighbouring word extends.

    Words are read in order. The earlier places of a word keep a diagonal of their lag going or open one, where the
    WINDOW words up to both agree, as all runs need; a diagonal that does not go on is a maximal stretch of that lag, and
    a run if long enough. Inside a stretch of lag q that goes on, places farther back than q within it open nothing: a
    run with such a lag would be this stretch again, or reaches beyond it and is opened at its end, its start found by
    walking back. Nor does a place whose lag is seen to break off, at one of a few words ahead, before a run is long
    enough. So a text that repeats one word stays linear, and one of many like stretches opens few diagonals.
    """
    n = len(words)
    if n < LEAST:
        return []
    codes = _window_codes(words)
    ordered = np.sort(codes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(codes, twice))
    plain, numbers = codes.tolist(), None
    places: dict[int, array] = defaultdict(lambda: array("q"))  # by hash of a window: where it ended
    active: dict[int, int] = {}  # lag to start of its stretch
    found: dict[tuple[int, int], int] = {}  # (start, end) to smallest period

    def close(lag: int, end: int) -> None:
        start = active.pop(lag)
        if end - start + 1 >= max(LEAST, REPEATS * lag):
            found[start, end] = min(lag, found.get((start, end), lag))

    last, passed = -2, (0, 0)  # places that the word before passed over, from and up to
    for i in (at + WINDOW - 1).tolist():
        for lag in [k for k in active if i != last + 1 or words[i] != words[i - k]]:
            close(lag, last)
        seen = places[plain[i - WINDOW + 1]]
        upper = inner = len(seen)  # places from ``inner`` up to ``upper`` lie inside the shortest stretch that goes on
        over = (0, 0)
        if active:
            q = min(active)
            over = (active[q] + WINDOW - 1, i - q)
            upper = bisect_left(seen, over[1])
            inner = min(upper, bisect_left(seen, over[0]))
        for low, high in ((upper, len(seen)), (0, inner)):
            if high - low > MANY:
                if numbers is None:
                    known: dict[bytes, int] = {}
                    numbers = np.array([known.setdefault(w, len(known)) for w in words])
                lags = _going_on(numbers, codes, i, i - np.array(seen[low:high]), *passed)
            else:
                lags = [i - j for j in seen[low:high] if i - j not in active and _goes_on(words, plain, i, i - j, *passed)]
            for lag in lags:
                if lag in active or words[i - WINDOW + 1 : i + 1] != words[i - lag - WINDOW + 1 : i - lag + 1]:
                    continue
                first = i - lag - WINDOW + 1
                while first and words[first - 1] == words[first - 1 + lag]:
                    first -= 1
                active[lag] = first
        seen.append(i)
        last, passed = i, over
    for lag in list(active):
        close(lag, last)
    return sorted((s, e - s + 1, p) for (s, e), p in found.items())


def _goes_on(words: list[bytes], codes: list[int], i: int, lag: int, low: int, high: int) -> bool:
    """Whether ``lag`` is to be opened at word i: one that begins here and whose windows have equal hashes at PROBES places
    that a run would still need, or one that began at places (``low`` up to ``high``) that were passed over."""
    before = i - WINDOW - lag
    if before >= 0 and words[before] == words[before + lag]:
        return low <= i - 1 - lag < high
    i -= WINDOW - 1
    ahead = max(LEAST - lag, (REPEATS - 1) * lag) - WINDOW
    return i + ahead < len(codes) and all(codes[x] == codes[x - lag] for x in (i + ahead * k // PROBES for k in range(PROBES, 0, -1)))


def _going_on(numbers: np.ndarray, codes: np.ndarray, i: int, lags: np.ndarray, low: int, high: int) -> list[int]:
    """Those of many ``lags`` for which ``_goes_on`` holds; ``numbers`` are the words'."""
    before = i - WINDOW - lags
    begun = (before >= 0) & (numbers[np.maximum(before, 0)] == numbers[i - WINDOW])
    late = lags[begun & (low <= i - 1 - lags) & (i - 1 - lags < high)]
    i -= WINDOW - 1
    ahead = np.maximum(LEAST - lags, (REPEATS - 1) * lags) - WINDOW
    fits = ~begun & (i + ahead < len(codes))
    lags, ahead = lags[fits], ahead[fits]
    for k in range(PROBES, 0, -1):
        x = i + ahead * k // PROBES
        same = codes[x] == codes[x - lags]
        lags, ahead = lags[same], ahead[same]
    return late.tolist() + lags.tolist()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep)])


def repeat_some(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The words of a tenth of the documents, by crc32 of their id, are made periodic from some word on; a null id never."""
    n = len(words)
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def find_runs(docs: DataFrame, rewrite: Callable[[list[bytes], str | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start and period) and collapsed text of every row of ``docs``.

    A word is a run of characters other than the six ASCII blanks; a null text has none. Runs are exact: windows are
    found by a hash and compared in full. Whole texts are read, each within its row: nothing is shuffled, a text of any
    length is one value of one task. Repeated rows count each for themselves; other columns are ignored. ``rewrite``
    changes the words of a text, given its id, before they are searched.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sizes, found, texts = [], [0], [], []
            names = b.column(2).to_pylist()
            for text, name in zip(b.column(1).to_pylist(), names, strict=True):
                words = (text or b"").split()  # bytes: splits at the six ASCII blanks and nothing else
                if rewrite:
                    words = rewrite(words, name)
                runs = runs_of(words)
                counts.append(len(words))
                found += runs
                sizes.append(len(found))
                texts.append(collapsed(words, runs))
            parts = np.array(found, np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], ["start", "length", "period"])
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    of = docs.selectExpr("doc_id", "cast(text as binary) as text", "cast(doc_id as string) as name")
    return of.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
