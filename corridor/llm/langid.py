"""Language identification with a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import fold, settled, small_side

#: Bytes of a window; filters of each width; widths. The network sees whole texts as windows side by side.
WINDOW, FILTERS, WIDTHS = 256, 16, (2, 3, 4)
#: Labelled rows to learn from, at most, of each language, and windows taken of each of them.
MAX_ROWS, MAX_WINDOWS = 1500, 2
#: Rows to learn from of all languages, about, at most; and languages at most: the most frequent ones, ties by code point.
MAX_TOTAL, MAX_LANGS = 12_000, 4096
EMBED, EPOCHS, BATCH, RATE, SEED = 8, 12, 64, 5e-3, 42
#: Windows run through the network at once.
AT_ONCE = 256


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    kernels: list[np.ndarray]  # of each width: (width, EMBED, FILTERS)
    bias: np.ndarray  # (filters of all widths)
    dense: np.ndarray
    out: np.ndarray
    langs: list[str]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, what pairs of bytes (or a last single one) add to its filters: the convolution as lookups."""
        found = []
        for k in self.kernels:
            single = [(self.embed @ k[j]).astype(np.float32) for j in range(len(k))]
            parts = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, len(k) - 1, 2)]
            found.append(parts + ([single[-1]] if len(k) % 2 else []))
        return found

    def pooled(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Max of every filter over each window (rows of bytes)."""
        pair = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        out = []
        for width, parts in zip(WIDTHS, tables, strict=True):
            n = windows.shape[1] - width + 1
            total = parts[0][pair[:, :n]]
            for j, part in enumerate(parts[1:], 1):
                total += part[pair[:, 2 * j : 2 * j + n]] if len(part) == 65536 else part[windows[:, 2 * j : 2 * j + n]]
            out.append(total.max(1))
        return np.maximum(np.concatenate(out, 1) + self.bias, 0)

    def log_probs(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        z = self.pooled(windows, tables) @ self.dense + self.out
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows_of(data: bytes) -> np.ndarray:
    """The text in rows of WINDOW bytes, the last one filled up with zeros; one row at least."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def train(windows: np.ndarray, y: np.ndarray, langs: list[str]) -> Network:
    """Cross-entropy by Adam. Gradients of the maxima go to the places where the maxima were."""
    rng = np.random.default_rng(SEED)
    n_filters = FILTERS * len(WIDTHS)
    p = {"embed": rng.normal(size=(256, EMBED)) * 0.5, "bias": np.zeros(n_filters), "dense": rng.normal(size=(n_filters, len(langs))) * 0.1, "out": np.zeros(len(langs))}
    p |= {f"k{w}": rng.normal(size=(w, EMBED, FILTERS)) / np.sqrt(w * EMBED) for w in WIDTHS}
    first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            x, target = windows[order[s : s + BATCH]], y[order[s : s + BATCH]]
            # some windows are shown in part, as texts can be short
            keep = np.where(rng.random(len(x)) < 0.5, WINDOW, rng.integers(8, WINDOW, len(x)))
            x = np.where(np.arange(WINDOW) < keep[:, None], x, 0)
            e = p["embed"][x]
            tops, places = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                conv = sum(e[:, j : j + n] @ p[f"k{w}"][j] for j in range(w))
                places.append(conv.argmax(1))
                tops.append(conv.max(1))
            h = np.concatenate(tops, 1) + p["bias"]
            a = np.maximum(h, 0)
            z = a @ p["dense"] + p["out"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            dz = (q - np.eye(len(langs))[target]) / len(x)
            dh = dz @ p["dense"].T * (h > 0)
            g = {k: np.zeros_like(v) for k, v in p.items()}
            g["dense"], g["out"], g["bias"] = a.T @ dz, dz.sum(0), dh.sum(0)
            for i, w in enumerate(WIDTHS):
                d, rows = dh[:, i * FILTERS : (i + 1) * FILTERS], np.arange(len(x))[:, None]
                for j in range(w):
                    byte = x[rows, places[i] + j]
                    g[f"k{w}"][j] = np.einsum("bfe,bf->ef", p["embed"][byte], d)
                    np.add.at(g["embed"], byte, d[:, :, None] * p[f"k{w}"][j].T[None])
            t += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Network(p["embed"], [p[f"k{w}"] for w in WIDTHS], p["bias"].astype(np.float32), p["dense"].astype(np.float32), p["out"].astype(np.float32), langs)


def fit(known: DataFrame) -> Network | None:
    """A network from ``known`` (doc_id, text, lang): about MAX_ROWS rows of a language at most, chosen by a hash, and fewer
    of each where there are many languages, so that those of all are about MAX_TOTAL. A language with few rows gives all.
    Of more than MAX_LANGS values of lang the rarest teach nothing: this sample of the labels is bounded by both."""
    known = known.where("text is not null and lang is not null and length(text) > 0")
    counts = settled(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS))
    n_langs = counts.count()
    if not n_langs:
        return None
    quota = min(MAX_ROWS, max(1, MAX_TOTAL // n_langs))
    share = small_side(counts.select(F.col("lang").alias("_lang"), F.when(F.col("n") <= quota, 1_000_000).otherwise(F.ceil(1_000_000 * quota / F.col("n"))).alias("_share")))
    chosen = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("lang"), F.col("text")), F.lit(1_000_000)) < F.col("_share")
    few = known.join(share, F.col("lang") == F.col("_lang")).where(chosen)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Some windows of each whole text; what the driver gathers is bounded by rows and windows."""
        for b in batches:
            own = [windows_of(x) for x in b.column(1).to_pylist()]
            own = [w[np.random.default_rng([SEED, len(w)]).permutation(len(w))[:MAX_WINDOWS]] for w in own]
            at = np.repeat(np.arange(len(own)), [len(w) for w in own])
            rows = pa.array([r.tobytes() for w in own for r in w], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), rows], ["lang", "window"])

    rows = few.select("lang", F.col("text").cast("binary")).mapInArrow(pick, "lang string, window binary")
    rows = sorted(tuple(r) for r in rows.distinct().collect())  # copies are one: no repeated row makes more of them
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    at = {lang: k for k, lang in enumerate(langs)}
    x = np.stack([np.frombuffer(w, np.uint8) for _, w in rows])
    return train(x, np.array([at[lang] for lang, _ in rows]), langs)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (mean probability of lang_pred) of every row of ``docs``.

    Learns from text and non-null lang where crc32(doc_id) mod 3 is not 1. A whole text is read in windows of WINDOW
    bytes; their log probabilities are added. ``und`` with score 0 where the text is null or has no letter, or where
    there was nothing to learn from. Ties go to the language first in code-point order; repeated rows come out alike. A
    text of any length is read whole, AT_ONCE windows at a time; an empty table gives no row. Columns but doc_id, text and
    lang are ignored.
    """
    f = fold(F.col("doc_id"), 3)
    network = fit(docs.where(f != 1).select("doc_id", "text", "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for b in batches:
            texts = b.column(1).to_pylist()
            some = [k for k, t in enumerate(texts) if t and network and any(map(str.isalpha, t))]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            parts: list[np.ndarray] = []
            for k in some:
                cut = windows_of(texts[k].encode())
                total, n = np.zeros(len(network.langs)), len(cut)
                parts.append((k, cut))
                if sum(len(c) for _, c in parts) >= AT_ONCE or k == some[-1]:
                    flat = np.concatenate([c for _, c in parts])
                    logs = np.concatenate([network.log_probs(flat[s : s + AT_ONCE], tables) for s in range(0, len(flat), AT_ONCE)])
                    at = 0
                    for i, c in parts:
                        total = logs[at : at + len(c)].sum(0)
                        at += len(c)
                        best = int(total.argmax())
                        mean = np.exp(total / len(c))
                        langs[i], scores[i] = network.langs[best], float(mean[best] / mean.sum())
                    parts = []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
