"""The trie of conversation prefixes, found by truncation peeling from its deepest nodes up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import settled, small_side
from corridor.operators.ranking import global_rank

#: Turns at most that a conversation takes from the first one of its hundred.
SHARED = 6
#: Bytes of the key of a prefix: a chained hash of its turns.
KEY = 16
#: Ids that are joined into one text in one task; longer lists are hashed text by text.
IDS_AT_ONCE = 256
#: Children of a node from which it is joined as a hot one.
HOT = 1000
_TURNS = "array<struct<digest:binary,chars:long>>"


def rebuilt(conversations: DataFrame, shared: int = SHARED) -> DataFrame:
    """conv_id and turns (digest and code points of each, in order) of every rebuilt conversation.

    ``conversations``: conv_id, turn, role, text; rows go by turn, null first, then by role and the turn's digest. The
    first h turns come from conversation c - c % 100 (h: crc32 of the decimal id, modulo ``shared``), the rest are the
    conversation's own after its first h. A null role or text is empty; rows without conv_id belong to no conversation;
    repeated rows are turns each; other columns are not read. Texts become digests at the scan and are never shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("_t"))
    own = said.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("_t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("_own"))
    own = settled(own)
    first = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_of"), F.slice("_own", 1, shared).alias("_first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    both = own.join(first, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_of"), "left")
    begin = F.slice(F.coalesce("_first", F.array().cast(_TURNS)), F.lit(1), h)
    return both.select("conv_id", F.concat(begin, F.slice("_own", h + 1, F.size("_own"))).alias("turns"))


def _keys(of: DataFrame) -> DataFrame:
    """conv_id, depth, keys (of every prefix but the root, one after another) and upto (code points of the first 0..depth turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, depths, keys, upto = b.column(0), [], [], []
            for turns in b.column(1).to_pylist():
                at, found = b"", []
                for t in turns:
                    at = hashlib.blake2b(at + t["digest"], digest_size=KEY).digest()
                    found.append(at)
                depths.append(len(turns))
                keys.append(b"".join(found))
                upto.append(np.concatenate([[0], np.cumsum([t["chars"] for t in turns], dtype=np.int64)]).astype(np.int64))
            columns = [ids, pa.array(depths, pa.int32()), pa.array(keys, pa.binary()), pa.array(upto, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "keys", "upto"])

    return of.select("conv_id", "turns").mapInArrow(run, "conv_id long, depth int, keys binary, upto array<long>")


def _key(depth: Column) -> Column:
    """The key of the first ``depth`` turns; the root's is empty."""
    return F.when(depth > 0, F.substring(F.col("keys"), KEY * (depth - 1) + 1, F.lit(KEY))).otherwise(F.lit(b""))


def _chars(low: Column, high: Column) -> Column:
    """Code points in the turns after the first ``low``, up to the first ``high``."""
    return F.get("upto", high) - F.get("upto", low)


def id_hashes(of: DataFrame, sizes: DataFrame) -> DataFrame:
    """key and ends: SHA-256 of the conv_ids of each key, ascending and comma-joined. ``sizes``: key, n.

    Ids of a key with many are joined IDS_AT_ONCE at a time by their rank over ranges; the hash then runs over those
    texts in order, one at a time: no list of all ids is ever held.
    """

    def joined() -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")

    big = small_side(sizes.where(F.col("n") > IDS_AT_ONCE).select(F.col("key").alias("_big")))
    few = of.join(big, of["key"] == big["_big"], "left_anti").groupBy("key").agg(F.sha2(joined(), 256).alias("ends"))
    if big.isEmpty():
        return few
    many = of.join(big, of["key"] == big["_big"]).select("key", "conv_id")
    block = F.floor((F.col("_r") - 1) / IDS_AT_ONCE).alias("block")
    texts = global_rank(many, [F.asc("key"), F.asc("conv_id")], "_r").groupBy("key", block).agg(joined().alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends"])

        at, h = None, None
        for b in batches:
            done = []
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != at:
                    done += [(at, h.hexdigest())] if h else []
                    at, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield out(done)
        if h:
            yield out([(at, h.hexdigest())])

    texts = texts.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return few.unionByName(texts.mapInArrow(run, "key binary, ends string"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the ``turns`` of ``sequences`` (conv_id, turns), from the root (depth 0) on.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves and saved_tokens (of the
    node's subtree) and ends_sha256 (of the members that end there). conv_id is unique and not null. An empty table has
    no node; a sequence without turns ends at the root.

    Equal sequences are one before anything else. What no other sequence shares, a sequence's own tail, is a strand of
    nodes alike but for their depth. From the deepest place where sequences meet, nodes are peeled: strands that reach
    it and sequences that end there are regrouped by the prefix left to them and summed, which finds the node, and its
    strand goes on up to the next depth where any meet. So a turn that a third of all share costs one row a task and
    round, and rounds are as many as there are depths at which sequences meet or end.
    """
    full = _key(F.col("depth"))
    of = settled(_keys(sequences))
    same = of.groupBy(full.alias("key")).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("depth", "keys", "upto")])
    same = settled(same)
    ends = id_hashes(of.select(full.alias("key"), "conv_id"), same.select("key", "n"))

    # members, counted as distinct sequences, of every prefix; along a sequence they only fall
    passed = same.select("conv_id", "keys", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d"))
    met = passed.groupBy(_key(F.col("d")).alias("key"), "d").agg(F.count("*").alias("c"), F.min("conv_id").alias("_first"))
    stretches = settled(met.groupBy("_first", "c").agg(F.min("d").alias("_top"), F.max("d").alias("_bottom")))
    at = sorted({r["_bottom"] for r in stretches.where("c > 1").select("_bottom").distinct().collect()} | {0}, reverse=True)  # depths: at most those of the longest
    alone = stretches.where("c = 1").select("_first", "_top")
    same = same.join(ends.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k")).join(alone, F.col("conv_id") == F.col("_first"), "left")
    same = settled(same.select("conv_id", "n", "depth", "keys", "upto", "ends", F.col("_top").alias("top")))

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    last = F.when(F.col("depth") > 0, (F.col("n") - 1) * _chars(F.col("depth") - 1, F.col("depth"))).otherwise(none)
    tails = same.where("top is not null").select(
        "conv_id", F.col("n").alias("n_convs"), "top", F.col("depth").alias("bottom"), "keys", "upto", none.alias("n_children"), one.alias("n_leaves"), last.alias("saved"), "ends"
    )
    ended = same.where("top is null")
    strands, nodes = [tails], []
    for k, d in enumerate(at):
        above = F.col("saved") + (F.col("n_convs") - 1) * _chars(F.col("top") - 1, F.col("bottom") - 1)
        key = _key(F.lit(d)).alias("key")
        arrived = [s.where(F.col("top") == d + 1).select(key, "conv_id", "n_convs", one.alias("_child"), "n_leaves", above.alias("saved"), F.lit(None).cast("string").alias("ends"), "keys", "upto") for s in [tails, *strands[1:][-1:]]]
        arrived.append(ended.where(F.col("depth") == d).select(key, "conv_id", F.col("n").alias("n_convs"), none.alias("_child"), none.alias("n_leaves"), none.alias("saved"), "ends", "keys", "upto"))
        rows = arrived[0]
        for a in arrived[1:]:
            rows = rows.unionByName(a)
        node = rows.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("_child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
            F.max("ends").alias("ends"), F.first(F.struct("keys", "upto")).alias("_path"),
        )
        node = node.select("*", "_path.*").drop("_path")
        own = (F.col("n_convs") - 1) * _chars(F.lit(d - 1), F.lit(d)) if d else none
        top = F.lit(at[k + 1] + 1 if k + 1 < len(at) else 0)
        node = settled(node.withColumn("saved", F.col("saved") + own).withColumns({"top": top, "bottom": F.lit(d), "ends": F.coalesce("ends", F.sha2(F.lit(b""), 256))}))
        nodes.append(node.where("n_children > 0").select("key", "bottom", F.col("conv_id").alias("parent"), "n_children"))
        strands.append(node.drop("key"))

    every = strands[0]
    for s in strands[1:]:
        every = every.unionByName(s.select(every.columns))
    parents = nodes[0]
    for p in nodes[1:]:
        parents = parents.unionByName(p)
    placed = _with_parents(every, parents)
    d = F.col("d")
    at_bottom = d == F.col("bottom")
    placed = placed.select("*", F.explode(F.sequence("top", "bottom")).alias("d"))
    saved = F.when(at_bottom, F.col("saved")).otherwise(F.col("saved") + (F.col("n_convs") - 1) * _chars(F.greatest(d - 1, F.lit(0)), F.col("bottom") - 1))
    return placed.select(
        "conv_id",
        d.cast("long").alias("depth"),
        F.when(d == 0, F.lit(None)).when(d == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.when(at_bottom, F.col("n_children")).otherwise(one).alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.when(at_bottom, F.col("ends")).otherwise(F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def _with_parents(strands: DataFrame, parents: DataFrame) -> DataFrame:
    """``strands`` with parent: the smallest member of the node above their top. Nodes with many children are joined apart."""
    of = strands.select("*", _key(F.greatest(F.col("top") - 1, F.lit(0))).alias("_above"))
    hot = small_side(parents.where(F.col("n_children") > HOT).select(F.col("key").alias("_k"), F.col("bottom").alias("_b"), "parent"))
    cold = parents.where(F.col("n_children") <= HOT).select(F.col("key").alias("_k"), F.col("bottom").alias("_b"), "parent")

    def on(side: DataFrame) -> Column:
        return (of["_above"] == side["_k"]) & (of["top"] - 1 == side["_b"])

    rest = of.join(hot.drop("parent"), on(hot), "left_anti").join(cold, on(cold), "left")
    return of.join(hot, on(hot)).unionByName(rest).drop("_above", "_k", "_b")
