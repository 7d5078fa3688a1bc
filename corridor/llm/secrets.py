"""Secret scans: keyword automaton, anchored expressions at the hits, checksums of the candidates."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "card", "iban", "key")
# Token prefixes, and names of private-key blocks.
GITHUB = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CARD_WORDS = ("card", "visa", "mastercard", "iban")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[a-z]+_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
DIGITS = frozenset("0123456789 -")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", re.A)
IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])")
KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: Characters around a keyword in which an expression without a keyword of its own is looked for, and more than the
#: longest of them has: what starts within reach is read to its end and one character on.
NEAR, LONGEST = 64, 64


def base62_crc(body: str) -> bool:
    """The last six characters are the crc32 of those before them, in base 62."""
    n, out = zlib.crc32(body[:-6].encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(6, "0") == body[-6:]


def luhn(number: str) -> bool:
    digits = [int(x) for x in number if x in "0123456789"]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keywords in {"assign": ASSIGN_WORDS, "access": ("akia",), "github": GITHUB, "npm": ("npm_",), "near": CARD_WORDS, "key": ("-----begin ",)}.items():
        for w in keywords:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """Lower case at the same positions."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every secret, sorted."""
    spans, ends = set(), dict.fromkeys(KINDS, 0)

    def at(kind: str, pattern: re.Pattern, start: int, good: Callable[[re.Match], bool]) -> None:
        if start >= ends[kind] and (m := pattern.match(text, start)):
            ends[kind] = m.end()
            if good(m):
                spans.add((m.start(), KINDS.index(kind), m.end()))

    reach: list[list[int]] = []  # neighbourhoods of keywords, those that meet made one
    for end, (kind, n) in sorted(words.iter(_lower(text)), key=lambda x: x[0] - x[1][1]):
        start = end - n + 1
        if kind == "assign":
            at(kind, ASSIGN, start, lambda m: len(m[2]) >= 6)
        elif kind == "access":
            at(kind, ACCESS, start, lambda m: len(m[0]) >= 20)
        elif kind in ("github", "npm"):
            at(kind, TOKEN, start, lambda m: base62_crc(m[1]))
        elif kind == "key":
            at(kind, KEY, start, lambda m: True)
        elif reach and start - NEAR <= reach[-1][1]:
            reach[-1][1] = max(reach[-1][1], end + NEAR)
        else:
            reach.append([max(0, start - NEAR), end + NEAR])
    for lo, hi in reach:
        for name, pattern, good in (("card", CARD, luhn), ("iban", IBAN, iban)):
            at_least = ends[name]
            back = lo  # a number that a neighbourhood cuts is read from where it begins
            while name == "card" and back > at_least and text[back - 1] in DIGITS:
                back -= 1
            for m in pattern.finditer(text, max(back, at_least), hi + LONGEST):
                if m.start() > hi:
                    break
                ends[name] = m.end()
                if m.end() > lo and good(m[0]):
                    spans.add((m.start(), KINDS.index(name), m.end()))
    spans.update((m.start(), 2, m.end()) for m in HEX.finditer(text))
    return sorted(spans)


def digest(text: str, words: ahocorasick.Automaton) -> tuple[int, int, int, str, str]:
    spans = scan(text, words)
    said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
    base = ",".join(s for s, (_, k, _) in zip(said, spans, strict=True) if k < 3)
    n = [sum(k == i for _, k, _ in spans) for i in range(3)]
    return *n, hashlib.sha256(base.encode()).hexdigest(), ",".join(said)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, code points, end exclusive) of each row.

    The keyword kinds are tried only where the automaton hits; runs of hex digits have no keyword and are searched for
    in the whole text. Tokens count with a right crc32, card numbers that touch a keyword's neighbourhood with a right
    Luhn digit, IBANs with remainder 1; numbers are never cut out of longer runs of digits. A null text is empty: no spans, and the hash of the empty string. Repeated rows are scanned each.
    """

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for b in batches:
            found = [digest(t.as_py() or "", words) for t in b.column(1)]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
