"""SimHash near-duplicates, found by an anchor-point covering of the fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import settled, small_side, text_hash, without
from corridor.llm.components import connected_components

#: Most differing bits of a link that the covering below is proven for (tests/llm enumerates all patterns).
MAX_BITS = 4
#: The 64 bits fall into six segments. However four differing bits fall, one of KEYS has at most one of them.
SEGMENTS = (11, 11, 11, 11, 10, 10)
#: Three segments to a key: every pair of segments is in a key.
KEYS = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
#: More anchored fingerprints than this at one anchor are split, so that a task holds no more of them.
HOMES = 4096
#: Fingerprints that one task puts at their anchors.
PRINTS_A_TASK = 20_000
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(data: bytes, n_words: int) -> int:
    """64-bit SimHash of the lower-cased word shingles of one text, as a signed long; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - n_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[min(n_words, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, n, SHINGLES_AT_ONCE):
        pieces = zip(starts[k : k + SHINGLES_AT_ONCE].tolist(), ends[k : k + SHINGLES_AT_ONCE].tolist(), strict=True)
        hashes = b"".join([digest(joined[a:b], 42) for a, b in pieces])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint_of(text: Column, n_words: int = 4) -> Column:
    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None else fingerprint(x, n_words) for x in data], dtype="int64")

    return run(text.cast("binary"))


def _codes() -> list[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """For each key: how its bits are cut out (shift, mask, place); parity masks; by syndrome, what leads to anchors.

    The anchors of a key are the words of the Hamming code on its first 31 bits, with its other bits free: covering
    radius 1. A fingerprint within one bit of another is then within two of the other's nearest anchor, so it is put at
    every anchor within two (radius plus threshold); -1 fills a row, and the first column leads to the nearest anchor.
    """
    offsets = np.concatenate([[0], np.cumsum(SEGMENTS)])
    found = []
    for key in KEYS:
        cuts, place = [], 0
        for s in key:
            cuts.append((int(offsets[s]), (1 << SEGMENTS[s]) - 1, place))
            place += SEGMENTS[s]
        parity = np.array([sum(1 << p for p in range(31) if (p + 1) >> i & 1) for i in range(5)], np.uint64)
        free = [1 << p for p in range(31, place)]
        ways = np.full((32, 16 + len(free)), -1, np.int64)
        for s in range(32):
            nearest = 1 << (s - 1) if s else 0
            two = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if 0 < i ^ s and i < i ^ s] if s else []
            row = [nearest, *two, *(nearest | f for f in free)]
            ways[s, : len(row)] = row
        found.append((cuts, parity, ways))
    return found


def anchored(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor keys, fingerprints and whether the anchor is the nearest, a row for each fingerprint and anchor."""
    x, out = prints.view(np.uint64), []
    for k, (cuts, parity, ways) in enumerate(_codes()):
        v = np.zeros(len(x), np.uint64)
        for shift, mask, place in cuts:
            v |= (x >> np.uint64(shift) & np.uint64(mask)) << np.uint64(place)
        syndrome = np.zeros(len(x), np.int64)
        for i, m in enumerate(parity):
            syndrome |= (np.bitwise_count(v & m).astype(np.int64) & 1) << i
        flips = ways[syndrome]
        at = (v.astype(np.int64)[:, None] ^ flips) | k << 40
        real = flips >= 0
        home = np.zeros(flips.shape, bool)
        home[:, 0] = True
        out.append((at[real], np.broadcast_to(prints[:, None], flips.shape)[real], home[real]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = b.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(prints), 4096):
            at, fp, home = anchored(prints[k : k + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(fp), pa.array(home)], ["at", "fp", "home"])


def spanning_links(homes: np.ndarray, prints: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the pairs of homes and prints within ``max_bits`` connect, fewer than both together."""
    joined, links = np.zeros((len(homes), len(homes)), bool), []
    for k in range(0, len(prints), 512):
        p = prints[k : k + 512]
        near = np.bitwise_count(p[:, None] ^ homes[None, :]) <= max_bits
        first, some = near.argmax(1), near.any(1)
        links.append((p[some], homes[first[some]]))
        for i in np.flatnonzero(near.sum(1) > 1):
            joined[first[i]] |= near[i]
    joined |= joined.T
    todo = np.ones(len(homes), bool)
    for root in range(len(homes)):
        if todo[root]:
            todo[root], stack = False, [root]
            while stack:
                i = stack.pop()
                new = np.flatnonzero(joined[i] & todo)
                todo[new] = False
                links.append((np.full(len(new), homes[i]), homes[new]))
                stack += new.tolist()
    return links


def _links_of_runs(at: np.ndarray, x: np.ndarray, home: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of rows sorted by anchor, homes first: short runs by shifted comparison, long ones as spanning links."""
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    length = np.diff(np.concatenate([edge, [len(at)]]))
    want = (length > 1) & home[edge]
    links = []
    short = np.repeat(want & (length <= 16), length)
    i = np.flatnonzero(short)
    for shift in range(1, 16):
        a = i[i + shift < len(at)]
        a = a[(at[a] == at[a + shift]) & home[a]]
        if not len(a):
            break
        a = a[np.bitwise_count(x[a] ^ x[a + shift]) <= max_bits]
        links.append((x[a], x[a + shift]))
    for s, n in zip(edge[want & (length > 16)], length[want & (length > 16)], strict=True):
        run, h = x[s : s + n], home[s : s + n]
        links += spanning_links(run[h], run, max_bits)
    return links


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and homes first; the last run of a batch is kept for the next one."""
        at, x, home = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)

        def made(links):
            a = np.concatenate([l[0] for l in links] or [np.empty(0, np.uint64)])
            b = np.concatenate([l[1] for l in links] or [np.empty(0, np.uint64)])
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for b in batches:
            at = np.concatenate([at, b.column(0).to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            home = np.concatenate([home, b.column(2).to_numpy(zero_copy_only=False)])
            if not len(at):
                continue
            cut = int(np.searchsorted(at, at[-1]))
            if cut:
                yield made(_links_of_runs(at[:cut], x[:cut], home[:cut], max_bits))
                at, x, home = at[cut:], x[cut:], home[cut:]
            if len(at) > 4 * HOMES:  # one long run: its homes come first and meet each further piece
                yield made(_links_of_runs(at, x, home, max_bits))
                at, x, home = at[home], x[home], home[home]
        if len(at):
            yield made(_links_of_runs(at, x, home, max_bits))

    return run


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect exactly those within ``max_bits`` bits of another.

    ``prints`` has a long column ``fp``, distinct. The links span the groups: not every pair of a group is listed,
    so a group of copies makes as many links as members, while any two fingerprints within the bound are connected.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    # a fingerprint becomes about a hundred rows: as many tasks as those need, however few files the prints came in
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // PRINTS_A_TASK))
    rows = prints.select("fp").repartition(tasks, "fp").mapInArrow(_replicate, "at long, fp long, home boolean")
    crowded = settled(rows.where("home").groupBy("at").count().where(F.col("count") > HOMES // 2))
    if crowded.isEmpty():
        dealt = rows.repartition("at").sortWithinPartitions("at", F.desc("home"))
    else:
        parts = rows.join(crowded, "at", "left").withColumn("n", F.coalesce(F.ceil(4 * F.col("count") / HOMES), F.lit(1)).cast("int"))
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("home", F.col("home") & (F.col("part") == own))
        dealt = parts.select(F.xxhash64("at", "part").alias("at"), "fp", "home").repartition("at").sortWithinPartitions("at", F.desc("home"))
    return dealt.mapInArrow(_compare(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text, any others).

    Null and blank texts have fingerprint zero and are linked like any other. component_id is the smallest doc_id that
    links reach; null doc_ids count for none, and a group of them alone has a null component. Repeated rows stay.
    """
    prints, roots = _classes(docs, n_words, max_bits)
    smallest = settled(roots.groupBy("root").agg(F.min("first.doc_id").alias("component_id")))  # apart, so that a large root can be split
    named = roots.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, n_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and fp of every row; and fp, root (of its component) and first (least id and text) of every print."""
    prints = settled(docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), fingerprint_of(F.col("text"), n_words).alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    classes = settled(prints.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    links = connected_components(near_links(classes, max_bits)).withColumnRenamed("node", "fp")
    return prints, classes.join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(docs: DataFrame, n_words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the least by doc_id (null last), then by a hash of the text.

    Where that very row is there more than once, with the same id and text, one of them stays.
    """
    prints, roots = _classes(docs, n_words, max_bits)
    stays = settled(roots.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    # only groups of two rows or more have anything to drop
    named = roots.join(stays.where("n > 1").select("root", F.col("first").alias("_stays")), "root").select("fp", "_stays")
    rows = settled(prints.join(named, "fp").select("doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("_stays.doc_id")) & (F.col("text_hash") == F.col("_stays.text_hash"))).alias("stays")))
    kept = without(docs, rows.where("not stays"))
    again = rows.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1")
    if again.isEmpty():
        return kept
    hidden = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = kept.select(F.col("doc_id").alias("_id"), text_hash(F.col("text")).alias("_hash"), hidden.alias("_row"))
    again = again.select(F.col("doc_id").alias("_again"), F.col("text_hash").alias("_text"), F.lit(True).alias("_many"))
    found = found.join(small_side(again), found["_id"].eqNullSafe(F.col("_again")) & (F.col("_hash") == F.col("_text")), "left")
    once = found.where("_many").groupBy("_id", "_hash").agg(F.first("_row").alias("_row")).select("_row.*")  # combined before the shuffle
    return found.where("_many is null").select("_row.*").unionAll(once)


def covers(pattern: tuple[int, ...]) -> bool:
    """Whether some key has at most one of the differing bits that fall on the segments as ``pattern`` says."""
    return any(sum(pattern[s] for s in key) <= 1 for key in KEYS)


def patterns(max_bits: int = MAX_BITS) -> Iterator[tuple[int, ...]]:
    for p in itertools.product(range(max_bits + 1), repeat=len(SEGMENTS)):
        if sum(p) <= max_bits:
            yield p
