"""BPE encoding and decoding with a public vocabulary; long texts by tree concatenation."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import settled

#: Characters (or symbols of a word without end) of a part; longer texts are cut into parts that are encoded in parallel.
PART = 65_536
#: Tokens on either side of a join that are encoded anew at first; doubled until both sides agree.
WINDOW = 8
#: Longest word whose tokens a worker remembers, and how many of them at most.
WORD_BYTES, WORDS = 64, 1 << 18
_BLANK = re.compile(r"[\x20\x09-\x0D]")
#: How the file's own pattern parts words: what this says of printed ASCII holds for it alone (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters beyond ASCII that are tried, one by one, when a file is loaded: those that stay one letter by themselves.
_LETTERS = range(0xC0, 0x250)


class Vocabulary:
    """A tokenizer file with what the tree needs: single words, and words cut before their end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix") or spec.get("post_processor"):
            raise ValueError("a BPE tokenizer with word ends and no post-processor is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = spec["model"]["end_of_word_suffix"]
        self.path, self.whole = path, self.tokenizer.model
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.symbols = {k: t for t, k in (spec["model"]["vocab"] | special).items()}
        self.closed = {k for k, t in self.symbols.items() if t.endswith(self.end) or t in special}
        parts = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.plain = None
        if _PATTERN in parts and {"type": "Lowercase"} in (spec.get("normalizer") or {}).get("normalizers", []):
            self._learn_letters()
        self._known: dict[bytes, bytes] = {}

    @cached_property
    def open(self):
        """The model without word ends, for words that go on; loaded where a word is cut."""
        from tokenizers import models

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        return models.BPE(vocab=spec["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]])

    def _learn_letters(self) -> None:
        """Texts of printed ASCII and common letters are parted here, by the same pattern: plain, parted, letters."""
        tried = {}
        for c in map(chr, _LETTERS):
            low = self.tokenizer.normalizer.normalize_str(c)
            symbols = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{low}a")]
            if low == c.lower() and len(low) == 1 and len(symbols) == 1:
                tried[c] = (low, symbols[0][1:-1])
        self.letters = {ord(low): symbols for low, symbols in tried.values()}
        low = "a-z" + re.escape("".join(map(chr, self.letters)))
        self.plain = re.compile(f"[\x09-\x0D\x20-\x7E{re.escape(''.join(tried))}]*")
        self.parted = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{low}]+|[0-9]|[^\x09-\x0D\x200-9{low}]+")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. A word of it is encoded once and remembered."""
        if self.plain and self.plain.fullmatch(text) and not (self.special and self.special.search(text)):
            words = self.parted.findall(text.lower())  # all that the tokenizer would part and change is known
            fresh = self._plain_ids
        else:
            words = text.encode().split()  # blanks part words of any kind, and tokens never reach over them
            fresh = self._library_ids
        known = self._known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        known.update(zip(new, fresh(new), strict=True))
        ids = b"".join([known[w] for w in words])
        for w in new:
            if len(w) > WORD_BYTES:
                del known[w]
        return np.frombuffer(ids, np.int32)

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        tokenize, letters = self.whole.tokenize, self.letters
        return [array("i", [t.id for t in tokenize(w if w.isascii() else w.translate(letters))]).tobytes() for w in words]

    def _library_ids(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("i", e.ids).tobytes() for e in found]

    def words_of(self, text: str) -> list[str]:
        """The words of a stretch without blanks as the tokenizer parts them, in its byte symbols; special tokens as they are."""
        out = []
        for k, piece in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(piece)
            elif piece:
                out += [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))]
        return out

    def encode_symbols(self, words: list[str], last_open: bool) -> list[int]:
        """The ids of words in byte symbols; the last one may go on in the next part."""
        ids = []
        for k, w in enumerate(words):
            if self.special and self.special.fullmatch(w):
                ids.append(self.tokenizer.token_to_id(w))
            else:
                ids += [t.id for t in (self.open if last_open and k == len(words) - 1 else self.whole).tokenize(w)]
        return ids

    def seam(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Both sides of a word cut in two as one. Tokens around the cut are encoded anew, in windows that grow until
        the first token of the left side and the last one of the right side come out as they were.

        Byte pair merges are local: a row of tokens is the encoding of its text if every two neighbours are the encoding
        of theirs. Pairs inside a side and inside the window are; where the outer tokens agree, those between are too.
        """
        k = WINDOW
        while True:
            low, high = max(0, len(left) - k), min(len(right), k)
            starts = [i for i in range(low, len(left)) if int(left[i]) in self.closed]
            ends = [i for i in range(high) if int(right[i]) in self.closed]
            low, from_start = (starts[-1] + 1, True) if starts else (low, low == 0)  # the word begins after a closed token
            high, to_end = (ends[0] + 1, True) if ends else (high, high == len(right))
            row = [self.symbols[int(t)] for t in (*left[low:], *right[:high])]
            text = "".join(row)
            ended = text.endswith(self.end) and high and int(right[high - 1]) in self.closed
            model = self.whole if ended else self.open
            again = [t.id for t in model.tokenize(text[: -len(self.end)] if ended else text)]
            agree_left = from_start or again[0] == int(left[low])
            agree_right = to_end or again[-1] == int(right[high - 1])
            if agree_left and agree_right:
                return np.concatenate([left[:low], np.array(again, np.int32), right[high:]]).astype(np.int32)
            k *= 2

    def parts_of(self, text: str, size: int) -> list[tuple[str, bool, bool, bool]]:
        """(data, symbols, open to the left, open to the right) of parts of about ``size`` characters.

        A part ends at a blank where there is one. A stretch without blanks is parted into words first; a word longer than
        a part is cut, and its parts are open to each other.
        """
        out, at = [], 0
        while at < len(text):
            if len(text) - at <= size:
                out.append((text[at:], False, False, False))
                break
            cut = max((text.rfind(c, at, at + size) for c in " \t\n\v\f\r"), default=-1)
            if cut >= at:
                out.append((text[at : cut + 1], False, False, False))
                at = cut + 1
                continue
            blank = _BLANK.search(text, at + size)
            stop = blank.start() if blank else len(text)
            row, held = [], 0
            for w in self.words_of(text[at:stop]):
                if held + len(w) > size and row:
                    out.append((" ".join(row), True, False, False))
                    row, held = [], 0
                if len(w) > size and not (self.special and self.special.fullmatch(w)):
                    cuts = range(0, len(w), size)
                    out += [(w[c : c + size], True, c > 0, c + size < len(w)) for c in cuts]
                else:
                    row.append(w)
                    held += len(w)
            if row:
                out.append((" ".join(row), True, False, False))
            at = stop
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once a worker."""
    return Vocabulary(path)


@cache
def symbols_of(path: str) -> dict[int, str]:
    """The symbols of a file's ids, special tokens among them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder") is not None:
        raise ValueError("a tokenizer without a decoder is needed: its tokens are joined by spaces")
    return {k: t for t, k in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


#: Rows that a worker holds as Python values at once.
ROWS = 256


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, b.num_rows, ROWS):
            yield b.slice(low, ROWS)


def _ids(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _rows(ids: pa.Array) -> list[np.ndarray]:
    """An array of ids a row; none for null."""
    flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return [flat[a:b] if ok else np.zeros(0, np.int32) for a, b, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist(), strict=True)]


def encode(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text), as the tokenizer of ``path`` gives them.

    No special tokens are added; those written in a text count as such, as the library has it. A null text has no ids;
    repeated rows are rows each; other columns are ignored. ``path`` is a place that every executor has.

    A text of up to ``part`` characters is encoded in its row. A longer one is cut into parts, mid-word where it has no
    blank; all parts are encoded in parallel, and neighbours are joined in rounds, as a tree: where a word was cut, growing
    windows around the join are encoded anew until both sides agree. The result is the encoding of the whole text exactly.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    of = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > part

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in _few(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _ids([v.encode(t) for t in b.column(1).to_pylist()])], ["doc_id", "ids"])

    short = of.where(~long).select("doc_id", "text").mapInArrow(whole, f"doc_id {kind}, ids array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for k, text in enumerate(b.column(2).to_pylist()):
                parts = v.parts_of(text, part)
                one = pa.array([k] * len(parts))
                columns = [pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(one), b.column(1).take(one), pa.array(range(len(parts)), pa.int64()), pa.array([len(parts)] * len(parts), pa.int64()), *columns],
                    ["row", "doc_id", "at", "n", "data", "symbols", "opens", "goes_on"],
                )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            data, symbols, goes_on = (b.column(k).to_pylist() for k in (4, 5, 7))
            ids = [np.array(v.encode_symbols(d.split(" "), g), np.int32) if s else v.encode(d) for d, s, g in zip(data, symbols, goes_on, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 2, 3, 6)] + [_ids(ids)], ["row", "doc_id", "at", "n", "opens", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            opens = b.column(5).to_pylist()
            ids = [v.seam(x, y) if o and len(x) and len(y) else np.concatenate([x, y]) for x, y, o in zip(_rows(b.column(6)), _rows(b.column(7)), opens, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(5)] + [_ids(ids)], ["row", "doc_id", "at", "n", "opens", "ids"])

    head = f"row long, doc_id {kind}, at long, n long"
    numbered = of.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = settled(numbered.mapInArrow(cut, f"{head}, data string, symbols boolean, opens boolean, goes_on boolean"))
    most = parts.agg(F.max("n")).first()[0] or 0
    if not most:
        return short
    tasks = max(parts.sparkSession.sparkContext.defaultParallelism, parts.rdd.getNumPartitions())
    level = parts.repartition(tasks, "row", "at").mapInArrow(encoded, f"{head}, opens boolean, ids array<int>")
    for _ in range(int(most - 1).bit_length()):
        first, second = F.col("at") % 2 == 0, F.col("at") % 2 == 1
        pair = level.groupBy("row", F.floor(F.col("at") / 2).alias("at")).agg(
            F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max(F.when(first, F.col("opens"))).alias("opens"), F.max(F.when(second, F.col("opens"))).alias("between"),
            F.max(F.when(first, F.col("ids"))).alias("x"), F.max(F.when(second, F.col("ids"))).alias("y"),
        )
        level = pair.select("row", "doc_id", "at", "n", "opens", "between", "x", "y").mapInArrow(joined, f"{head}, opens boolean, ids array<int>")
    return short.unionByName(level.select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of every row of ``encoded`` (doc_id, ids), as the library decodes ids, special tokens kept.

    Ids beyond the vocabulary are left out, as the library does; null ids are none and give an empty text.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = symbols_of(path)
        for b in _few(batches):
            texts = [" ".join([t for t in map(symbols.get, r.tolist()) if t is not None]) for r in _rows(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
