"""Toxicity: class-conditional Kneser-Ney models of characters that share their backoff counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.llm.common import fold, settled, small_side

#: Codes of an n-gram (five, six and eight were compared among the rows that teach), bits of a code, discount.
ORDER, BITS, DISCOUNT = 8, 7, 0.75
#: N-grams, and contexts, whose ratios a task holds: the most frequent. Words with others are scored by joins.
MAX_HELD = 1 << 22
#: A document is judged as a whole and by its words whose log ratio is over this much.
EXCESS = 3.0
#: Bytes of text that are scored at once.
PIECE = 1 << 20
#: Labelled rows for the calibration, at most; the counts take every other labelled row.
MAX_CALIBRATION, SEED, THRESHOLD = 50_000, 42, 0.5
FEATURES = ("whole", "first", "second", "excess")


def _code_table() -> np.ndarray:
    """Bytes to codes: 0 is a gap between words, letters and digits follow, then bytes beyond ASCII: the 64 that go on with
    a letter each have one of their own, those that begin one share the 27 left."""
    code = np.zeros(256, np.int64)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
        code[ord(c)] = code[ord(c.upper())] = k + 1
    code[128:192] = 37 + np.arange(64)
    code[192:] = 101 + np.arange(64) % 27
    return code


CODE = _code_table()


def grams(data: bytes) -> np.ndarray:
    """The n-gram that ends at each code of a text, as a number. None reaches over a gap: words stand for themselves.

    Runs of gaps are one gap, and one stands at each end.
    """
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    c = CODE[b[(b < 0xC0) | (b >= 0xE0)]]  # a letter of two bytes is its second
    return _of_codes(c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])])


def _of_codes(c: np.ndarray) -> np.ndarray:
    out, inside = c.copy(), np.ones(len(c), bool)
    for k in range(1, ORDER):
        before = np.concatenate([np.zeros(min(k, len(c)), np.int64), c[:-k]])
        inside &= before > 0
        out |= np.where(inside, before, 0) << BITS * k
    return out


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of PIECE bytes or less, cut between words; only a word longer than that is cut where a piece ends."""
    k = 0
    while len(data) - k > PIECE:
        gap = np.flatnonzero(CODE[np.frombuffer(data, np.uint8, PIECE, k)] == 0)
        end = k + int(gap[-1]) + 1 if len(gap) else k + PIECE
        yield data[k:end]
        k = end
    yield data[k:]


def count_grams(texts: DataFrame) -> DataFrame:
    """gram, toxic and ordinary: how often each n-gram occurs in the texts of either class (columns text, toxic)."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(n * (key & 1)), pa.array(n * (1 - (key & 1)))], ["gram", "toxic", "ordinary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for text, toxic in zip(b.column(0), b.column(1), strict=True):
                for piece in pieces(text.as_py() or b""):
                    parts.append((grams(piece) << 1) + toxic.as_py())
                    size += len(parts[-1])
                    if size > PIECE:
                        yield counted(parts)
                        parts, size = [], 0
            if parts:
                yield counted(parts)

    rows = texts.where("text != ''").select(F.col("text").cast("binary"), F.col("toxic").cast("int"))
    return rows.mapInArrow(run, "gram long, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _low(gram: str, order: int) -> Column:
    """The last ``order`` codes."""
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * order) - 1))


def continuation(counts: DataFrame) -> DataFrame:
    """(low, p) of the n-grams one code shorter: how likely the last code is after the others, whatever the class.

    An n-gram's weight is the number of longer ones, kept of either class, that end with it; each order gives what it
    discounts to the next lower one, down to single codes, which share theirs evenly.
    """
    kinds, orders = counts.select("gram"), []
    for k in range(ORDER - 1, 0, -1):
        kinds = settled(kinds.groupBy(_low("gram", k).alias("gram")).agg(F.count("*").alias("n")))
        orders.append((k, kinds))
    p = None
    for k, own in reversed(orders):
        after = Window.partitionBy("h")  # at most 2^BITS rows
        own = own.withColumn("h", F.shiftright("gram", BITS)).withColumns({"total": F.sum("n").over(after), "kinds": F.count("*").over(after)})
        lower = F.lit(1 / (1 << BITS)) if p is None else F.col("p")
        own = own if p is None else own.withColumn("low", _low("gram", k - 1)).join(p, "low")
        p = own.select(F.col("gram").alias("low"), ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * lower) / F.col("total")).alias("p"))
    return p


def ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios of n-grams seen, (gram, r, n), and of what follows a context otherwise, (context, r, n).

    In class c, P(x|h) = (max(n_c(h,x) - D, 0) + D t_c(h) P(x|h')) / n_c(h), with t_c(h) the n-grams of h that c has.
    P(x|h') is common to both classes (``continuation``): an n-gram that neither has, or whose context one lacks, tells
    little, however few the toxic texts are.
    """
    totals = {"nt": F.sum("toxic"), "no": F.sum("ordinary"), "tt": F.count_if(F.col("toxic") > 0), "to": F.count_if(F.col("ordinary") > 0)}
    after = Window.partitionBy("h")  # at most 2^BITS rows
    c = counts.withColumn("h", F.shiftright("gram", BITS)).withColumns({k: v.over(after) for k, v in totals.items()})
    both = c.withColumn("low", _low("gram", ORDER - 1)).join(continuation(counts), "low")

    def likelihood(n: str, total: str, kinds: str) -> Column:
        seen = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * F.col("p")) / F.col(total)
        return F.when(F.col(total) > 0, seen).otherwise(F.col("p"))

    r = F.log(likelihood("toxic", "nt", "tt") / likelihood("ordinary", "no", "to"))
    seen = both.select("gram", r.alias("r"), (F.col("toxic") + F.col("ordinary")).alias("n"))
    context = counts.groupBy(F.shiftright("gram", BITS).alias("context")).agg(*[v.alias(k) for k, v in totals.items()])
    one = F.lit(1.0)
    rest = [F.when(F.col(n) > 0, DISCOUNT * F.col(t) / F.col(n)).otherwise(one) for n, t in (("nt", "tt"), ("no", "to"))]
    return seen, context.select("context", F.log(rest[0] / rest[1]).alias("r"), (F.col("nt") + F.col("no")).alias("n"))


class Table:
    """A number for each of the n-grams given, by the n-gram itself: open addressing, at most half of the places taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.__setstate__((keys, values))

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys[self.keys >= 0], self.values[self.keys >= 0]

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        keys, values = state
        self.bits = max(1, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several, one stays
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], self._next(at[~put])

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return at + 1 & (1 << self.bits) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, NaN where there is none."""
        out, todo, at = np.full(len(keys), np.nan), np.arange(len(keys)), self._place(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            todo, at = todo[on], self._next(at[on])
        return out


def _held(df: DataFrame, key: str) -> tuple[Table, DataFrame]:
    """The most frequent MAX_HELD rows or fewer as a table, and the other rows."""
    least, rows = None, 0
    for r in sorted(df.groupBy("n").count().collect(), reverse=True):  # few: counts differ
        rows += r["count"]
        if rows > MAX_HELD:
            break
        least = r["n"]
    near = F.lit(False) if least is None else F.col("n") >= least
    return _gathered(df.where(near), key), df.where(~near).select(key, F.col("r").cast("float").alias("r"))


def _gathered(df: DataFrame, key: str) -> Table:
    rows = df.select(key, F.col("r").cast("float")).toArrow()
    return Table(rows.column(0).to_numpy(), rows.column(1).to_numpy())


@dataclass(frozen=True)
class Held:
    """The ratios that a task holds; ``whole`` if there are no others."""

    seen: Table
    rest: Table
    whole: bool

    def parts(self, data: bytes) -> tuple[float, int, float, float, float, Counter[bytes]]:
        """Log ratios of a text: sum, number of characters, two most toxic words and what exceeds EXCESS, of the words whose
        n-grams are all held (all words, if the tables are whole); and the codes of each other word, with how often it occurs."""
        total, n, excess, top, left = 0.0, 0, 0.0, np.array([-EXCESS, -EXCESS]), Counter()
        for piece in pieces(data):
            g = grams(piece)
            r = self.seen.find(g)
            miss = np.flatnonzero(np.isnan(r))
            starts = np.concatenate([[0], np.flatnonzero(g & (1 << BITS) - 1 == 0)[:-1] + 1])
            r[miss] = np.nan_to_num(self.rest.find(g[miss] >> BITS)) if self.whole else 0
            word = np.add.reduceat(r, starts)
            n += len(r)
            if len(miss) and not self.whole:
                unknown = np.unique(np.searchsorted(starts, miss, "right") - 1)
                code, ends = (g & (1 << BITS) - 1).astype(np.uint8), np.append(starts[1:], len(g))
                left.update(code[starts[w] : ends[w]].tobytes() for w in unknown)
                word = np.delete(word, unknown)
            total += float(word.sum())
            excess += float(np.maximum(word - EXCESS, 0).sum())
            top = np.sort(np.concatenate([top, word]))[-2:]
        return total, n, float(top[1]), float(top[0]), excess, left


@dataclass(frozen=True)
class Model:
    held: Held
    #: What is not held, of (gram, r) and (context, r).
    far: tuple[DataFrame, DataFrame] | None
    beta: np.ndarray


def _design(x: np.ndarray) -> np.ndarray:
    one, two = (1 / (1 + np.exp(2 * EXCESS - np.clip(x[:, k], -20, 20))) for k in (1, 2))
    return np.stack([np.ones(len(x)), np.clip(x[:, 0], -1, 1) * 5, one, two, np.log1p(x[:, 3]) / 4], 1)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients for rows that count ``n`` times each."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        step = np.linalg.solve(x.T * w @ x + ridge * np.eye(len(beta)), x.T @ (n * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _model(counts: DataFrame) -> Model:
    seen, rest = ratios(counts)
    if counts.count() <= MAX_HELD:
        return Model(Held(_gathered(seen, "gram"), _gathered(rest, "context"), True), None, np.zeros(5))
    (near, far), (near_rest, far_rest) = _held(settled(seen), "gram"), _held(settled(rest), "context")
    return Model(Held(near, near_rest, False), (far, far_rest), np.zeros(5))


def fit(labelled: DataFrame, n_ids: int) -> Model | None:
    """``labelled``: doc_id, text, toxic (0 or 1), of ``n_ids`` ids. None where one class has no n-grams.

    A quarter of the ids calibrates, MAX_CALIBRATION of them at most; all other rows are counted. Where those lack a
    class, the plain comparison of the two likelihoods decides.
    """
    share = min(0.25, MAX_CALIBRATION / max(n_ids, 1))
    part = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1_000_000)) < int(1_000_000 * share)
    counts = settled(count_grams(labelled.where(~part)))
    if not all(counts.agg(F.sum("toxic"), F.sum("ordinary")).first()):
        return None
    blank = _model(counts)
    held = featured(labelled.where(part).select("doc_id", "text", "toxic"), blank, ["doc_id", "toxic"])
    rows = held.groupBy("toxic", *FEATURES).count().toArrow()  # a row for each text: copies are one
    y, *x, n = (rows.column(k).to_numpy().astype(float) for k in range(6))
    if not len(y) or y.min() == y.max():
        return replace(blank, beta=np.array([0.0, 1.0, 0.0, 0.0, 0.0]))
    return replace(blank, beta=logistic(_design(np.stack(x, 1)), y, n))


def featured(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` of each row, and FEATURES and score from its text, each n-gram with its own ratio.

    Where a task can't hold all ratios, the words of other n-grams are joined with theirs, each distinct word once.
    """
    held, beta = docs.sparkSession.sparkContext.broadcast(model.held), model.beta
    texts = docs.select(F.col("text").cast("binary"), *keep)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    scored = f"{kinds}, " + ", ".join(f"{c} double" for c in (*FEATURES, "score"))

    def batch(own: list[pa.Array], parts: list[tuple]) -> pa.RecordBatch:
        x = np.array([(total / n, *rest) for total, n, *rest in parts]).reshape(-1, 4)
        score = 1 / (1 + np.exp(-np.clip(_design(x) @ beta, -30, 30)))
        return pa.RecordBatch.from_arrays([*own, *(pa.array(x[:, k]) for k in range(4)), pa.array(score)], [*keep, *FEATURES, "score"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(b.columns[1:], [held.value.parts(t.as_py() or b"")[:5] for t in b.column(0)])

    if model.far is None:
        return texts.mapInArrow(whole, scored)

    left = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
    names, part_kinds = ["total", "n", *FEATURES[1:], "left"], "total double, n long, first double, second double, excess double"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [held.value.parts(t.as_py() or b"") for t in b.column(0)]
            words = pa.array([[{"word": w, "times": k} for w, k in p[5].items()] for p in parts], left)
            kinds = [pa.float64(), pa.int64(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array([p[k] for p in parts], t) for k, t in enumerate(kinds)), words], [*keep, *names])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, parts = b.columns[: len(keep)], []
            for total, n, first, second, excess, words in zip(*(c.to_pylist() for c in b.columns[len(keep) :]), strict=True):
                top = sorted([first, second, *(w["score"] for w in words for _ in range(min(w["times"], 2)))])[-2:]
                total += sum(w["score"] * w["times"] for w in words)
                excess += sum(max(w["score"] - EXCESS, 0) * w["times"] for w in words)
                parts.append((total, n, top[1], top[0], excess))
            yield batch(own, parts)

    rows = settled(texts.mapInArrow(near, f"{kinds}, {part_kinds}, left array<struct<word:binary,times:bigint>>").withColumn("row", F.monotonically_increasing_id()))
    scores = small_side(_word_scores(rows.select(F.explode("left.word").alias("word")).distinct(), held, model.far))
    flat = rows.select("row", F.struct(*keep, *names[:-1]).alias("own"), F.posexplode_outer("left").alias("at", "w"))
    # a row's own columns go with its first word; rows without such words get keys of their own
    alone = F.concat(F.unhex(F.lit("FF")), F.col("row").cast("string").cast("binary"))
    flat = flat.select("row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")).alias("own"), F.coalesce("w.word", alone).alias("word"), "w.times")
    joined = flat.join(scores, "word", "left").groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"), F.collect_list(F.when(F.col("times").isNotNull(), F.struct("score", "times"))).alias("left")
    )
    return joined.select("own.*", "left").mapInArrow(both, scored)


def _word_scores(words: DataFrame, held: Broadcast[Held], far: tuple[DataFrame, DataFrame]) -> DataFrame:
    """word and score: the log ratios of all n-grams of a word, given as its codes up to the gap after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            if not own:
                continue
            g = _of_codes(np.frombuffer(b"\0" + b"".join(own), np.uint8).astype(np.int64))[1:]
            word = np.repeat(np.arange(len(own)), [len(w) for w in own])
            r = held.value.seen.find(g)
            miss = np.flatnonzero(np.isnan(r))
            known = np.bincount(word, np.nan_to_num(r), len(own))
            known = np.where(np.diff(word[miss], prepend=-1) > 0, known[word[miss]], 0)  # with the first n-gram that is not held
            other = held.value.rest.find(g[miss] >> BITS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(word[miss])), pa.array(known), pa.array(g[miss]), pa.array(g[miss] >> BITS), pa.array(other, from_pandas=True)], ["word", "known", "gram", "context", "other"]
            )

    missed = words.mapInArrow(run, "word binary, known double, gram long, context long, other double")
    seen, rest = far[0], far[1].withColumnRenamed("r", "backoff")
    missed = missed.join(seen, "gram", "left")
    ask = F.col("r").isNull() & F.col("other").isNull()
    missed = missed.withColumn("context", F.when(ask, F.col("context")).otherwise(-1 - F.col("gram"))).join(rest, "context", "left")
    return missed.groupBy("word").agg(F.sum(F.col("known") + F.coalesce("r", "other", "backoff", F.lit(0.0))).alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, from its whole text alone.

    Labels (doc_id, toxic) teach only where crc32(doc_id) mod 5 is not 0; an id labelled more than once counts as
    toxic where most say so. Null texts score as empty ones. Without texts of both classes every score is 0.
    Repeated rows score alike. The counts cover every labelled text that teaches, so they grow with the corpus.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    marks = settled(marks.where(fold(F.col("doc_id"), 5) != 0))
    # the side of labels is small or both are shuffled; either way the texts that teach are read twice, never kept
    model = fit(docs.select("doc_id", "text").join(small_side(marks), "doc_id"), marks.count())
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    out = featured(docs, model, ["doc_id"]) if model else docs.select("doc_id", F.lit(0.0).alias("score"))
    return out.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
