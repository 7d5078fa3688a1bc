"""What the operators of this subpackage share: the word pattern, tables, folds and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]++"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read back, so that a lost executor costs no recomputation.

    The folder is the session's spark.checkpoint.dir; one of our own is set only where that is unset, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or the first of _name, __name, ... that is not among ``taken``; letter case does not count."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k))


def bounded(df: DataFrame, rows: int, key: str) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``; all of them where there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * rows / n))


#: Rows, and bytes of their values, that a broadcast may hold; longer sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def bytes_of(df: DataFrame) -> Column:
    """About the bytes of a row's values: texts as long as they are, elements of arrays 16, others 8."""
    size = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: 16 * F.size(c)}
    parts = [F.coalesce(size[kind](c), F.lit(0)) if (kind := f.dataType.typeName()) in size else F.lit(8) for f in df.schema for c in [F.col(f"`{f.name}`")]]
    return sum(parts, F.lit(0)).cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, settled, with a broadcast hint if a count shows that it has at most ``rows`` rows and ``size`` bytes."""
    df = settled(df)
    n, total = df.agg(F.count("*"), F.sum(bytes_of(df))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` but for the rows that have the doc_id and the text of a row of ``bad`` (doc_id, text_hash).

    So each row goes by its own verdict where ids repeat, and a null id is an id like others.
    """
    bad = small_side(bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_text")).distinct())
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (text_hash(docs["text"]) == bad["_bad_text"])
    return docs.join(bad, same, "left_anti")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)
