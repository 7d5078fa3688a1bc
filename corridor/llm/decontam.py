"""Benchmark decontamination: a random-walk embedding of edit distance, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corridor.llm.common import bytes_of, text_hash, without

#: An item counts as leaked where a passage of the text is within this share of its words in edits.
MAX_EDITS = 0.2
#: The share of passages at MAX_EDITS that the walks must meet, on simulated items; tests/llm measure it by length.
RECALL, TRIALS, MOST_WALKS = 0.985, 400, 24
#: Positions that a walk samples for one key.
SAMPLES, SEED = 4, 42
#: Bytes of items held by a worker at a time; a longer benchmark is taken in blocks of about so many.
BLOCK_BYTES = 4 << 20
#: Documents with more candidates than this are held against every item of the block instead.
MANY = 4096
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(_INVERSE, PIECE + 1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLDED = np.arange(1, 257, dtype=np.uint64)
_FOLDED[65:91] = _FOLDED[97:123]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def _bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in UTF-8 bytes.

    A word is a run of letters and digits. Beyond ASCII all counts as letters but blanks, punctuation and symbols (by
    Unicode block); Han characters and kana are words of one character each.
    """
    letter, cut = np.concatenate([[False], _LETTER[b], [False]]), np.zeros(len(b) + 2, bool)
    at = np.flatnonzero(b >= 0xC0)
    if len(at):
        ahead = np.concatenate([b, np.zeros(3, np.uint8)])
        x, y, z = (ahead[at + k] for k in range(3))
        two = (x == 0xC2) & ~np.isin(y, (0xAA, 0xB5, 0xBA)) | (x == 0xC3) & np.isin(y, (0x97, 0xB7))
        three = (x == 0xE2) & ((y == 0x80) | (y == 0x81) & (z < 0xB0) | (y >= 0x86) & (y < 0xB0)) | (x == 0xE3) & (y == 0x80) & ~np.isin(z, (0x85, 0x87))
        wide = (y == 0xBC) & ((z < 0x90) | (z >= 0x9A) & (z <= 0xA0) | (z >= 0xBB)) | (y == 0xBD) & ((z == 0x80) | (z >= 0x9B) & (z <= 0xA5))
        three |= (x == 0xEF) & (wide | (y == 0xBB) & (z == 0xBF))
        for some, size in ((two, 2), (three, 3), ((x == 0xF0) & (y == 0x9F), 4)):
            for k in range(size):
                letter[np.minimum(at[some] + k + 1, len(b))] = False
        for some, size in (((x >= 0xE4) & (x <= 0xE9) | (x == 0xE3) & ((y >= 0x81) & (y <= 0x83) | (y >= 0x90)), 3), ((x == 0xF0) & (y >= 0xA0) & (y <= 0xB3), 4)):
            cut[at[some] + 1] = cut[np.minimum(at[some] + size + 1, len(b) + 1)] = True
        letter[0] = letter[-1] = False
    starts = np.flatnonzero(letter[1:] & (~letter[:-1] | cut[1:]))
    ends = np.flatnonzero(letter[:-1] & (~letter[1:] | cut[1:]))
    return starts, ends


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, ASCII case folded (callers lower the rest)."""
    out, k = [], 0
    while k < len(data):
        end = min(k + PIECE, len(data))
        if end < len(data):  # cut between words; a longer word is cut where the piece ends, between characters
            back = np.flatnonzero(~_LETTER[np.frombuffer(data, np.uint8, end - k, k)])
            end = k + int(back[-1]) + 1 if len(back) else end
            while end > k + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
        b = np.frombuffer(data, np.uint8, end - k, k)
        starts, ends = _bounds(b)
        upto = np.concatenate([[np.uint64(0)], np.cumsum(_FOLDED[b] * _UP[: len(b)])])
        out.append(_mixed((upto[ends] - upto[starts]) * _DOWN[starts]))
        k = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


@dataclass(frozen=True)
class Shape:
    """Windows of ``width`` words, every ``step`` words of a document and at every offset of an item."""

    width: int
    step: int


def shape_of(n: int) -> Shape:
    """The windows for items of ``n`` words: short ones, many to an item, so that some hold few of the allowed edits.

    A window's chance to be met falls with the edits in it, which grow with its width: wider windows for longer items
    would lose edited passages. Any passage within the allowed edits holds a whole aligned window.
    """
    if n < 9:
        return Shape(n - int(n * MAX_EDITS), 1)
    if n < 12:
        return Shape(7, 1)
    return Shape(8, 2) if n < 32 else Shape(16, 4)


def _walk_keys(words: np.ndarray, starts: np.ndarray, last: np.ndarray, shape: Shape, walks: int) -> Iterator[np.ndarray]:
    """The key of each window in each of the walks.

    A walk reads a word at each step and moves on if the step's random bit of that word says so; after an edit, two
    walks over like windows soon meet again, so sampled reads agree with a probability that falls with the edits. None
    leaves its window, so equal windows have equal keys, whatever follows them, and a verbatim passage is always met.
    """
    last = np.minimum(last, starts + shape.width - 1)
    steps = shape.width + shape.width // 2
    for r in range(walks):
        rng = np.random.default_rng([SEED, shape.width, r])
        sampled = np.zeros(steps, bool)
        sampled[np.minimum((np.arange(SAMPLES) + rng.random(SAMPLES)) * steps / SAMPLES, steps - 1).astype(int)] = True
        turned = words * np.uint64(rng.integers(1 << 62) * 2 + 1)
        turned ^= turned >> np.uint64(29)
        at, key = starts.copy(), np.full(len(starts), np.uint64(r + 1))
        for j in range(int(np.flatnonzero(sampled)[-1]) + 1):
            x = turned[at]
            if sampled[j]:
                key = (key ^ x) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(32)
            at = np.minimum(at + (x >> np.uint64(j % 61) & np.uint64(1)).astype(np.int64), last)
        yield key


def edited(item: list, n: int, rng: np.random.Generator, new: Callable[[], object]) -> list:
    """``item`` after ``n`` random edits: words left out, replaced or put in."""
    out = list(item)
    for _ in range(n):
        at = int(rng.integers(len(out)))
        out[at : at + 1] = [[], [new()], [out[at], new()]][rng.integers(3)]
    return out


@cache
def walks_for(n: int) -> int:
    """Walks that items of ``n`` words need: so many that RECALL of simulated passages at MAX_EDITS share a key."""
    shape, edits, rng = shape_of(n), int(n * MAX_EDITS), np.random.default_rng([SEED, n])
    if not edits:
        return 1
    sides: list[list[np.ndarray]] = [[], []]
    for _ in range(TRIALS):
        words = iter(rng.integers(1 << 63, size=n + 2 * edits + 18, dtype=np.uint64))
        item = [next(words) for _ in range(n)]
        ahead = [next(words) for _ in range(rng.integers(9))]
        sides[0].append(np.array(item))
        sides[1].append(np.array([*ahead, *edited(item, edits, rng, lambda: next(words)), *[next(words) for _ in range(9)]]))
    keys, trial = [], []
    for texts, step in zip(sides, (1, shape.step), strict=True):
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = [np.arange(first[k], max(first[k] + 1, first[k + 1] - shape.width + 1), step) for k in range(TRIALS)]
        trial.append(np.repeat(np.arange(TRIALS), [len(x) for x in starts]))
        keys.append(_walk_keys(np.concatenate(texts), np.concatenate(starts), first[trial[-1] + 1] - 1, shape, MOST_WALKS))
    met = np.zeros(TRIALS, bool)
    for walks, (a, b) in enumerate(zip(*keys, strict=True), 1):
        mine, other = (k ^ _mixed(t.astype(np.uint64)) for k, t in zip((a, b), trial, strict=True))
        met[trial[1][np.isin(other, mine)]] = True
        if met.mean() >= RECALL:
            break
    return walks


def plan(n: int) -> tuple[Shape, int]:
    """Shape and walks for items of ``n`` words: the walks of the hardest ones of a shape, short and with a full share of edits."""
    return shape_of(n), walks_for(n if n < 12 else 15 if n < 32 else 35)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest word edits between the item and any passage of the text, and where the best passage ends (first such)."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Items of one block, by shape: sorted keys of all windows of each walk, with the item and the window's offset."""

    def __init__(self, items: list[tuple[object, str]], plans: dict[int, tuple[Shape, int]] | None = None):
        self.items = [(i, word_hashes(t.lower().encode())) for i, t in items if t]
        self.items = [(i, w) for i, w in self.items if len(w)]
        self.by: dict[tuple[Shape, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        parts: dict[tuple[Shape, int], list[tuple[int, np.ndarray]]] = {}
        for k, (_, w) in enumerate(self.items):
            n = min(len(w), 32)
            parts.setdefault(plans[n] if plans else plan(n), []).append((k, w))
        for (shape, walks), own in parts.items():
            keys: list[list[np.ndarray]] = [[] for _ in range(walks)]
            item, offset = [], []
            for k, w in own:
                starts = np.arange(max(1, len(w) - shape.width + 1))
                for r, key in enumerate(_walk_keys(w, starts, np.full(len(starts), len(w) - 1), shape, walks)):
                    keys[r].append(key)
                item.append(np.full(len(starts), k, np.int32))
                offset.append(starts.astype(np.int32))
            of, offsets = np.concatenate(item), np.concatenate(offset)
            self.by[shape, walks] = []
            for r in range(walks):
                key = np.concatenate(keys[r])
                order = np.argsort(key, kind="stable").astype(np.int32)
                seen = np.zeros(1 << 20, bool)
                seen[key >> np.uint64(44)] = True
                self.by[shape, walks].append((key[order], order, seen))
            self.by[shape, walks].append((of, offsets, np.empty(0)))
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.least = self.sizes - (self.sizes * MAX_EDITS).astype(np.int64)
        self.vocabulary, self.flat = np.unique(np.concatenate([w for _, w in self.items] or [np.empty(0, np.uint64)]), return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document's place, item, where the item would start) from the windows of documents laid end to end; and the
        documents that have more than MANY of these, which are not listed."""
        length, many = np.diff(bounds), np.zeros(len(bounds) - 1, np.int64)
        found: list[np.ndarray] = [np.empty((0, 3), np.int64)]
        for (shape, _), walks in self.by.items():
            n = np.where(length >= shape.width, (length - shape.width) // shape.step + 1, (length > 0).astype(int))
            starts = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]) * shape.step, n) + np.arange(n.sum()) * shape.step
            tail = (length > shape.width) & ((length - shape.width) % shape.step > 0)
            doc = np.concatenate([np.repeat(np.arange(len(n)), n), np.flatnonzero(tail)])
            starts = np.concatenate([starts, bounds[1:][tail] - shape.width])
            of, offsets, _ = walks[-1]
            for k in range(0, len(starts), 1 << 17):
                s, d = starts[k : k + (1 << 17)], doc[k : k + (1 << 17)]
                for key, (keys, order, seen) in zip(_walk_keys(words, s, bounds[d + 1] - 1, shape, len(walks) - 1), walks[:-1], strict=True):
                    hit = np.flatnonzero(seen[key >> np.uint64(44)])
                    lo, hi = np.searchsorted(keys, key[hit]), np.searchsorted(keys, key[hit], "right")
                    np.add.at(many, d[hit], hi - lo)
                    real = (hi > lo) & (many[d[hit]] <= MANY)
                    hit, lo, size = hit[real], lo[real], (hi - lo)[real]
                    at = order[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                    hit = np.repeat(hit, size)
                    found.append(np.stack([d[hit], of[at], s[hit] - offsets[at]], 1))
        rows = np.unique(np.concatenate(found), axis=0)
        rows = rows[many[rows[:, 0]] <= MANY]
        return rows[:, 0], rows[:, 1], rows[:, 2], np.flatnonzero(many > MANY)

    def worth(self, words: np.ndarray) -> np.ndarray:
        """Items that have enough of their words in the text; all others are too far from any passage of it."""
        there = np.isin(self.vocabulary, words)[self.flat]
        return np.flatnonzero(np.add.reduceat(there, self.first) >= self.least)

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(document's place, item, fewest edits, first word of the passage, about) of every verified candidate."""
        cut = [word_hashes(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
        words = np.concatenate([*cut, np.zeros(1, np.uint64)])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done: dict[tuple[int, int], list[int]] = {}

        def held_against(d: int, i: int, lo: int, hi: int) -> None:
            item, near = self.items[i][1], words[lo:hi]
            if np.isin(item, near).sum() < self.least[i]:
                return
            n, end = edit_distance(item, near)
            if n <= len(item) - self.least[i] and (n, lo - bounds[d]) < best.get((d, i), (n + 1, 0)):
                best[d, i] = (n, int(max(0, lo + end - len(item) - bounds[d])))

        docs, items, places, every = self.candidates(words, bounds)
        for d in every:
            for i in self.worth(cut[d]):
                held_against(int(d), int(i), bounds[d], bounds[d + 1])
        for d, i, start in zip(docs.tolist(), items.tolist(), places.tolist(), strict=True):
            if best.get((d, i), (1, 0))[0] == 0 or any(abs(start - p) <= 1 for p in done.get((d, i), ())[-2:]):
                continue
            size, edits = int(self.sizes[i]), int(self.sizes[i] - self.least[i])
            done.setdefault((d, i), []).append(start)
            held_against(d, i, max(bounds[d], start - 2 * edits - 1), min(bounds[d + 1], start + size + 2 * edits + 1))
        return [(d, i, n, at) for (d, i), (n, at) in sorted(best.items())]


#: The index that this worker built last, by the block it is of.
_BUILT: dict[str, Index] = {}


def _index(name: str, held: Broadcast, plans: dict[int, tuple[Shape, int]]) -> Index:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(held.value, plans)
    return _BUILT[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, item_words and at (the passage's first word, about): the items leaked into documents.

    A row for each document row and item of which some passage is within MAX_EDITS of the item's words, by exact word
    edit distance; fewest edits first found. Words are letters and digits in lower case, so punctuation and layout do
    not count. Null or wordless texts and items leak nothing; equal items are reported each; repeated rows too.
    The benchmark is the stated query set: blocks of BLOCK_BYTES of items are held by workers one after another, each
    against all documents; a block's index is built once in a worker.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select("item_id", F.lower("text").alias("text"))
    blocks = max(1, -(-int(items.agg(F.sum(bytes_of(items))).first()[0] or 0) // BLOCK_BYTES))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, edits int, item_words int, at long"
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    texts = docs.where("text is not null").select("doc_id", F.lower("text").cast("binary").alias("text"))
    plans = {n: plan(n) for n in range(1, 33)}
    out = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        held, name = spark.sparkContext.broadcast([tuple(r) for r in own.collect()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, held, plans)
            ids = pa.array([i for i, _ in index.items], id_type)
            for b in batches:
                sizes, rows = b.column(1).to_pylist(), []
                k = 0
                while k < len(sizes):
                    n, size = k, 0
                    while n < len(sizes) and (n == k or size + len(sizes[n]) <= 4 * PIECE):
                        size += len(sizes[n])
                        n += 1
                    rows += [(d + k, *rest) for d, *rest in index.leaks(sizes[k:n])]
                    k = n
                if rows:
                    d, i, n, at = (np.array(c) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(d)), ids.take(pa.array(i)), pa.array(n, pa.int32()), pa.array(index.sizes[i], pa.int32()), pa.array(at, pa.int64())],
                        ["doc_id", "item_id", "edits", "item_words", "at"],
                    )

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage, each by its own text."""
    rows = docs.select(F.struct("doc_id", text_hash(F.col("text")).alias("text_hash")).alias("doc_id"), "text")
    return without(docs, find_leaks(rows, benchmark).select("doc_id.*"))
