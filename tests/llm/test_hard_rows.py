"""Rows alike at a mixing cut, any clashing names, very many languages."""

import pytest
from pyspark.sql import functions as F

from corridor.llm import langid, mixing, sharding
from corridor.llm.common import free_name


@pytest.mark.parametrize("text", ["w", "five words in a row", " ".join(["w"] * 7)])
def test_rows_alike_take_their_target_to_a_word(spark, text):
    n = len(text.split())
    docs = spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit("a").alias("source"), F.lit(text).alias("text")).repartition(7)
    got = mixing.mix_report(docs).collect()
    assert len(got) == 1000 and all(r["taken"] <= 2 * n for r in got)
    assert sum(r["taken"] for r in got) == 1500 * n and got[0]["target"] == 1500 * n
    assert sum(len(r["text"].split()) for r in mixing.mixed(docs).collect()) == 1500 * n


def test_alike_rows_of_one_source_leave_others_as_they_are(spark):
    plain = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"))
    alike = spark.range(3000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("x y z").alias("text"))
    for docs in (plain.unionByName(alike), plain.unionByName(alike).repartition(5)):
        got = mixing.mix_report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
        assert len(got) == 2 and all(r["taken"] == round(r["target"]) for r in got)


CLASH = ["shard", "_shard", "slot", "_slot", "_lookup", "_to", "mix_shard", "_shard_", "_draw", "_place", "_piece", "_u", "size", "draws", "_part", "_before", "_cut", "_p", "_at", "_a", "_sid", "SLOT_"]


def test_places_and_mixes_whatever_the_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "c", "en", "s", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    out = docs
    for k in range(3):
        out = sharding.place(out)
        assert len(set(map(str.lower, out.columns))) == len(out.columns) == len(docs.columns) + 2 * (k + 1)
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == 4 and all(r[c] == f"own {c}" for r in rows for c in CLASH)
    assert all(r[free] == r["___shard"] for r in rows for free in ("__shard",)) and {type(r["__slot"]) for r in rows} == {int}
    mixed = mixing.mixed(docs)
    assert len(set(mixed.columns)) == len(mixed.columns) == len(docs.columns) + 1
    assert all(r[c] == f"own {c}" for r in mixed.collect() for c in CLASH)
    assert free_name("Shard", ["sHard", "_shard"]) == "__Shard"


def test_five_thousand_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 1)
    monkeypatch.setattr(langid, "MAX_LANGS", 300)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.col("id") % 5000).alias("lang"))
    got = langid.identify(docs).collect()
    assert len(got) == 6000 and all(r["lang_pred"].startswith("l") and 0 <= r["score"] <= 1 for r in got)
    assert langid.identify(docs.limit(0)).count() == 0
