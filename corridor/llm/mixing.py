"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.llm.common import BLANKS, free_name, settled, small_side, word_count
from corridor.operators.ranking import global_rank

#: Bits of a document's permutation key; digits of it that one round of the search for a cut looks at.
KEY_BITS, ROUND_BITS = 63, 7
#: Words of a block, at least, and blocks of all sources, about: beyond that blocks grow with the input. A source's blocks
#: are so many that blocks of all sources have about as many words.
BLOCK_WORDS, MOST_BLOCKS = 4096, 1 << 20
#: Groups of sources whose block quotas the driver splits among shards, and shards, at most: what the driver holds.
GROUPS, MOST_SHARDS = 32, 1 << 17
#: Bytes of text that a task writes, about.
PIECE_BYTES = 64 << 20


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order, null last; share is of all words; cap is of a source's."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    shard_words: int = 250_000
    seed: int = 42


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """``sources`` (source, n) with sid (their place by code point, null last, from 0) and target.

    A source's share is by weight; what exceeds the cap is shared again by weight among the rest. Each round is one
    aggregate over the sources, however many: it finds the share of a weight of one, given those capped so far.
    """
    ranked = global_rank(sources.withColumn("_null", F.col("source").isNull()), [F.asc("_null"), F.asc("source")], "sid").withColumn("sid", F.col("sid") - 1)
    weight = F.get(F.array(*map(F.lit, mix.weights)), F.pmod("sid", F.lit(len(mix.weights))).cast("int"))
    ranked = settled(ranked.select("source", "n", "sid", weight.alias("_weight")))
    most = mix.cap * F.col("n")
    size, weights = ranked.agg(F.sum("n"), F.sum("_weight")).first()
    unit, capped = mix.share * (size or 0) / (weights or 1), -1
    while True:
        over = F.col("_weight") * unit > most
        n, fixed, free = ranked.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("_weight")))).first()
        if n == capped or not free:
            break
        capped, unit = n, (mix.share * size - (fixed or 0)) / free
    return ranked.withColumn("target", F.least(F.col("_weight") * unit if free else most, most).cast("double")).drop("_weight")


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each source in each shard, by halving: a node's left half gets a hypergeometric draw of its blocks.

    Rows are shards. Columns sum to the quotas exactly and rows differ in their sums by rounding only. A node draws
    with a generator of its own, so that the same tree comes out again.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        lo, hi, own = stack.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        mid = (lo + hi) // 2
        n = int(own.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, n, method="marginals")
        stack += [(lo, mid, left), (mid, hi, own - left)]
    return out


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with size (words), and _u: the place of a document in the permutation of its source.

    The text is part of it, so that rows without an id, or with one id, have places of their own.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), F.col("doc_id").cast("string"), F.col("source"), F.col("text")), 1)
    return docs.withColumns({"size": word_count(F.col("text")), "_u": key})


def _shifted(bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col("_u"), bits)


def _reached(cells: DataFrame, due: Column) -> DataFrame:
    """The cell of each source (_sid, _cell, n, ...) in which ``due`` words are reached, with _due: words still due there."""
    upto = F.sum("n").over(Window.partitionBy("_sid").orderBy("_cell"))  # 2^ROUND_BITS cells of a source, at most
    return cells.withColumn("_due", due - (upto - F.col("n"))).where((F.col("_due") >= 0) & (F.col("_due") < F.col("n")))


def _cuts(of: DataFrame, blocks: DataFrame) -> DataFrame:
    """_sid, _key, _due and _there for each source with a partial pass: the permutation key at which its words are reached,
    the words still due there, and the words that rows of that key have.

    Radix selection: sums by the next digits of the key, each time among the documents of one cell of each source, first
    of all of them.
    """
    whole = blocks.where("_rest > 0").groupBy("_sid", F.col("_rest").alias("_due")).agg(F.sum("n").alias("n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    at = settled(whole.withColumns({"_cell": F.lit(0).cast("long"), "_shift": F.lit(KEY_BITS)}))
    while not at.where("_lo < _hi").isEmpty():
        here = small_side(at.select(F.col("_sid").alias("_s"), F.col("_cell").alias("_at"), "_shift", F.col("_due").alias("_left")))
        inside = of.join(here, (of["_sid"] == here["_s"]) & (_shifted(F.col("_shift")) == F.col("_at")))
        inside = inside.withColumn("_shift", F.greatest(F.col("_shift") - ROUND_BITS, F.lit(0)))
        sums = inside.groupBy("_sid", "_shift", "_left", _shifted(F.col("_shift")).alias("_cell")).agg(F.sum("size").alias("n"), F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
        at = settled(_reached(sums, F.col("_left")))
    return at.select("_sid", F.col("_lo").alias("_key"), "_due", F.col("n").alias("_there"))


def _dealt(blocks: DataFrame, cuts: DataFrame, words: int, mix: Mix) -> DataFrame:
    """_sid, _block and _dealt, an array of (epoch, shard): the shards that each block's draws go to.

    A tree splits the exact numbers of draws of every group of sources among the shards; a group's draws, in random
    order, then fill its shares one after another, which among the sources of a group is the same draw once more.
    """
    partial = F.when(F.col("_cell") <= F.call_function("shiftrightunsigned", F.col("_key"), KEY_BITS - F.col("_bits")), 1).otherwise(0)
    draws = blocks.join(small_side(cuts.select("_sid", "_key")), "_sid", "left").withColumn("_draws", F.col("_passes") + partial)
    group = F.pmod("_sid", F.lit(GROUPS)).cast("int").alias("_group")
    draws = settled(draws.where("_draws > 0").select(group, "_sid", "_cell", F.explode(F.sequence(F.lit(0), (F.col("_draws") - 1).cast("int"))).alias("epoch")))
    counts = np.zeros(GROUPS, np.int64)
    for g, n in draws.groupBy("_group").count().collect():
        counts[g] = n
    shards = max(1, min(-(-words // mix.shard_words), int(counts.sum()) // 8, MOST_SHARDS))
    upto = draws.sparkSession.sparkContext.broadcast(np.cumsum(split(counts, shards, mix.seed), axis=0))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own, g = own.sort_values(["_sid", "_cell", "epoch"]), int(own["_group"].iloc[0])
        place = np.random.default_rng([mix.seed, g]).permutation(len(own))
        return own.assign(shard=np.searchsorted(upto.value[:, g], place, "right").astype(np.int32))[["_sid", "_cell", "epoch", "shard"]]

    dealt = draws.groupBy("_group").applyInPandas(run, "_sid long, _cell long, epoch int, shard int")
    return dealt.groupBy("_sid", F.col("_cell").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("_dealt"))


def _numbered(of: DataFrame, alike: DataFrame) -> DataFrame:
    """``of`` with _before: for rows at the cut of a source of ``alike`` (_a), the words of those before them, else 0.

    Sums run within each partition of the input and then over the partitions, so that rows alike, which are told apart by
    their place alone, are never brought together.
    """
    cut = (F.col("_u") == F.col("_key")) & (F.col("size") > 0)
    of = of.join(alike, F.col("_sid") == alike["_a"], "left").withColumn("_cut", F.coalesce(cut & F.col("_a").isNotNull(), F.lit(False))).drop("_a")
    some = settled(of.where("_cut").withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sums = some.groupBy("_sid", "_p").agg(F.sum("size").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_sid").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    sums = small_side(sums.select(F.col("_sid").alias("_s0"), F.col("_p").alias("_p0"), before.alias("_first")))
    inside = Window.partitionBy("_sid", "_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    some = some.join(sums, (F.col("_sid") == F.col("_s0")) & (F.col("_p") == F.col("_p0")))
    some = some.withColumn("_before", F.col("_first") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return of.where("not _cut").withColumn("_before", F.lit(0).cast("long")).unionByName(some.select(*of.columns, "_before")).drop("_cut")


def assigned(of: DataFrame, sizes_of: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``of`` (sized documents) with source_size, target, taken and draws: array of (epoch, shard, words).

    A source's documents are permuted by a hash and cut into blocks. Whole passes repeat every block; a partial pass
    takes blocks in order up to the quota, where one document is cut so that the source's words match its target to a
    word. The splitting tree deals the exact numbers of blocks to the shards, and each shard gets the next blocks of a
    random order. No document is drawn more often than the cap rounded up, nor above cap times its size. Rows alike in
    id, source and text are told apart by their place, and share what is due at the cut to a word. Documents without words are never drawn. Sources may be as many as
    the documents: all that is known of them stays in tables, broadcast only where their size was checked.
    ``sizes_of`` holds the same rows without their texts: the sums come from it.
    """
    known = targets(sizes_of.groupBy("source").agg(F.sum("size").alias("n")), mix)
    quota = F.rint("target").cast("long")
    passes = F.when(F.col("n") > 0, F.floor(quota / F.col("n"))).otherwise(0).cast("long")
    known = known.withColumns({"_quota": quota, "_passes": passes}).withColumn("_rest", F.col("_quota") - F.col("_passes") * F.col("n"))
    total, words = known.agg(F.sum("n"), F.sum("_quota")).first()
    block = max(BLOCK_WORDS, -(-(total or 0) // MOST_BLOCKS))
    bits = F.greatest(F.ceil(F.log2(F.col("n") / block)), F.lit(0)).cast("int")
    known = known.select(F.col("sid").alias("_sid"), F.col("source").alias("_source"), F.col("n").alias("source_size"), "target", "_passes", "_rest", F.coalesce(bits, F.lit(0)).alias("_bits"))
    known = small_side(known)

    def of_source(df: DataFrame) -> DataFrame:
        return df.join(known, df["source"].eqNullSafe(F.col("_source")), "left").drop("_source")

    of, sizes_of = of_source(of), of_source(sizes_of)
    cell = _shifted(KEY_BITS - F.col("_bits"))
    drawn = sizes_of.where("size > 0")
    blocks = settled(drawn.groupBy("_sid", "_bits", "_passes", "_rest", cell.alias("_cell")).agg(F.sum("size").alias("n"), F.min("_u").alias("_lo"), F.max("_u").alias("_hi")))
    cuts = settled(_cuts(drawn.select("_sid", "_u", "size"), blocks))
    at = small_side(_dealt(blocks, cuts, words or 0, mix).withColumnsRenamed({"_sid": "_s", "_block": "_b"}))
    ends = small_side(cuts.withColumnRenamed("_sid", "_c"))

    of = of.join(at, (of["_sid"] == at["_s"]) & (cell == at["_b"]), "left")
    of = of.join(ends, F.col("_sid") == ends["_c"], "left")
    at_cut = drawn.join(ends, F.col("_sid") == ends["_c"]).where(F.col("_u") == F.col("_key"))
    alike = at_cut.groupBy("_sid").count().where("count > 1").select(F.col("_sid").alias("_a"))
    zero = F.lit(0).cast("long")
    if alike.isEmpty():
        of = of.withColumn("_before", zero)
    else:
        of = _numbered(of, small_side(alike))
    upto = lambda x: F.call_function("div", F.col("_due").cast("decimal(19,0)") * x.cast("decimal(19,0)"), F.col("_there").cast("decimal(19,0)"))
    at_key = upto(F.col("_before") + F.col("size")) - upto(F.col("_before"))
    part = F.when(F.col("_u") < F.col("_key"), F.col("size")).when(F.col("_u") == F.col("_key"), at_key).otherwise(zero)
    draws = F.transform(
        F.coalesce(F.col("_dealt"), F.array().cast("array<struct<epoch:int,shard:int>>")),
        lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.when(d["epoch"] < F.col("_passes"), F.col("size")).otherwise(F.col("_part")).alias("words")),
    )
    of = of.withColumn("_part", part).withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return of.withColumn("taken", taken).drop("_u", "_sid", "_passes", "_rest", "_bits", "_s", "_b", "_dealt", "_c", "_key", "_due", "_there", "_before", "_part")


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, and the shards it is drawn to.

    Null texts have size 0; a null source is a source of its own; repeated rows count each for themselves.
    """
    sizes_of = settled(sized(docs.select("doc_id", "source", "text"), mix).drop("text"))
    out = assigned(sizes_of, sizes_of, mix)
    return out.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row for each draw, and shard (``_shard``, and so on, where taken); dealt by shard, shuffled within.

    A document cut at its source's quota keeps its first words, joined by single spaces (and n_chars follows, where
    there is one). Columns of ``docs`` keep their values; clashing names are not used. A shard of more than PIECE_BYTES
    is dealt in pieces, drawn by hash, each in an order of its own: no task holds a whole large shard.
    """
    names = docs.columns
    hidden = {c: f"_in_{i}" for i, c in enumerate(names) if c not in ("doc_id", "source", "text")}
    plain = docs.withColumnsRenamed(hidden)
    sizes_of = sized(docs.select("doc_id", "source", "text"), mix).withColumn("_bytes", F.octet_length("text"))
    sizes_of = settled(sizes_of.drop("text"))
    out = assigned(sized(plain, mix), sizes_of, mix).withColumn("_draw", F.explode("draws"))
    whole = F.col("_draw.words") == F.col("size")
    first = F.concat_ws(" ", F.slice(F.filter(F.split("text", BLANKS), lambda w: w != ""), F.lit(1), F.col("_draw.words").cast("int")))
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(first))
    if "n_chars" in hidden:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(hidden["n_chars"], F.when(whole, F.col(hidden["n_chars"])).otherwise(F.length("text")).cast(kind))
    words, total = sizes_of.agg(F.sum("size"), F.sum("_bytes")).first()
    goal = int(mix.share * (total or 0))
    shards = max(1, min(-(-int(mix.share * (words or 0)) // mix.shard_words), MOST_SHARDS))
    pieces = -(-goal // (PIECE_BYTES * shards)) or 1
    tasks = min(max(-(-goal // PIECE_BYTES), docs.sparkSession.sparkContext.defaultParallelism), shards * pieces)
    place = F.xxhash64(F.lit(mix.seed), F.col("doc_id").cast("string"), F.col("text"), F.col("_draw.epoch"))
    out = out.withColumn("_place", place).withColumn("_shard", F.col("_draw.shard")).withColumn("_piece", F.pmod("_place", F.lit(pieces)))
    out = out.repartition(tasks, "_shard", "_piece").sortWithinPartitions("_shard", "_place")
    return out.select(F.col("_shard").alias(free_name("shard", names)), *[F.col(hidden.get(c, c)).alias(c) for c in names])
