"""Secret scan: fixed patterns, and guess costs of the values that stand in a credential context.

The guess cost of a value is the least number of bits that a segmentation into dictionary words, dates, repeats,
keyboard walks and brute-force characters needs. Dynamic programming over the places of the value: the cheapest way to
end at a place is the cheapest of all segments that end there, each added to the cheapest way to its start. Repeats
and walks are followed from place to place as states, and words and dates have a greatest length, so a value costs time
in proportion to its length however long it is.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the contract: kinds in their order, pattern, group whose length counts, least length.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# "+" with a least length afterwards finds the same runs as a bounded repeat: both start at the first place of a run.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12

# A credential name, its separator, and the value up to a quote, blank or closing mark.
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"""
                      r"""["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*["']?([^\s"'`,;<>(){}\[\]]+)""", re.I | re.A)
_GATE = re.compile(r"pass|pwd|secret|token|key|credential|auth", re.I | re.A)

ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")  # a keyboard's rows; walks also follow 0-9 and a-z
COMMON = ("password", "passwd", "changeme", "letmein", "welcome", "admin", "root", "guest", "user", "default", "secret", "test", "example",
          "dummy", "sample", "your", "token", "here", "none", "null", "todo", "placeholder", "login", "master", "dragon", "monkey", "iloveyou")
LEET = str.maketrans("@4310$57", "aaeiosst")

WORD_LENGTH = (3, 24)  # of dictionary words
GUESS_BITS, GUESS_LENGTH = 40.0, 8  # a value is a span of kind guess from this cost and length on
SEGMENT_BITS = 1.0  # for each further segment
YEARS = (1900, 2050)
DATE_BITS = math.log2(366 * (YEARS[1] - YEARS[0]))
YEAR_BITS = math.log2(YEARS[1] - YEARS[0])

_DIGIT, _LOWER, _UPPER, _OTHER = (math.log2(x) for x in (10, 26, 26, 33))
_FULL_DATE = re.compile(r"(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2})|(19\d\d|20[0-4]\d)", re.A)


def brute_bits(c: str) -> float:
    """Bits of one character that no pattern explains."""
    if "0" <= c <= "9":
        return _DIGIT
    if "a" <= c <= "z":
        return _LOWER
    if "A" <= c <= "Z":
        return _UPPER
    return _OTHER if ord(c) < 128 else 16.0


def _walk_steps() -> set[tuple[str, str]]:
    """Ordered pairs of characters that stand next to each other: in a keyboard row, slanting down a column, 0-9, a-z."""
    lines = [*ROWS, "0123456789", "abcdefghijklmnopqrstuvwxyz", *("".join(x) for x in zip("1234567890", *(r[:10] for r in ("qwertyuiop", "asdfghjkl;", "zxcvbnm,./"))))]
    near = {(a, b) for line in lines for a, b in zip(line, line[1:])}
    return near | {(b, a) for a, b in near}


WALK = _walk_steps()
WALK_START, WALK_STEP = math.log2(47), math.log2(4)


def date_bits(text: str) -> float | None:
    """Bits of a whole date or year, or None where the text is neither."""
    m = _FULL_DATE.fullmatch(text)
    if m is None:
        return None
    if m[9]:
        return YEAR_BITS
    parts = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
    year, *rest = map(int, parts)
    low, high = sorted(rest)
    if len(parts[0]) == 4 and not YEARS[0] <= year < YEARS[1]:
        return None
    return DATE_BITS + (1.0 if m[2] or m[6] else 0.0) if 1 <= low <= 12 and high <= 31 else None


@dataclass(frozen=True)
class Words:
    """Bits of each dictionary word: of its rank, the commonest first."""

    bits: dict[str, float]

    def cost(self, part: str, low: str) -> float | None:
        """Bits of a part as a dictionary word, capitals and digit-for-letter swaps included; ``low`` is its lower case."""
        found = self.bits.get(low)
        extra = 0.0
        if found is None:
            plain = low.translate(LEET)
            found = self.bits.get(plain) if plain != low else None
            if found is None:
                return None
            extra = 2.0
        if part != low:
            extra += 1.0 if part[1:] == low[1:] or part.isupper() else float(sum(a != b for a, b in zip(part, low, strict=False)) + 1)
        return found + extra


@lru_cache(maxsize=2)
def dictionary(path: str | None) -> Words:
    """The common words, then the whole words of a tokenizers vocabulary in its order (a word's first rank counts)."""
    words = list(COMMON)
    if path is not None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        entries = sorted(model["vocab"].items(), key=lambda e: e[1])
        words += [w.removesuffix(end).lower() for w, _ in entries if w.endswith(end)]
    ranks: dict[str, int] = {}
    for w in words:
        if WORD_LENGTH[0] <= len(w) <= WORD_LENGTH[1] and w.isascii() and w.isalpha():
            ranks.setdefault(w, len(ranks) + 1)
    return Words({w: math.log2(r) + 1.0 for w, r in ranks.items()})


def guess_bits(value: str, words: Words) -> float:
    """The least bits of any segmentation of the value; the empty value costs nothing."""
    n = len(value)
    low = "".join([c.lower() if c.isascii() else c for c in value])
    best = [0.0] * (n + 1)  # best[i]: the cheapest way to cover the first i characters
    unit = [brute_bits(c) for c in value]
    brute = repeat = walk = math.inf  # the cheapest ways whose last segment, of that kind, ends here
    for i in range(n):
        start = best[i] + (SEGMENT_BITS if i else 0.0)
        brute = min(brute, start) + unit[i]
        cost = brute
        if i:
            before = best[i - 1] + (SEGMENT_BITS if i > 1 else 0.0)  # where a run of two or more can have begun
            repeat = min(repeat + 0.5, before + unit[i - 1] + 1.0) if value[i] == value[i - 1] else math.inf
            walk = min(walk + WALK_STEP, before + WALK_START + WALK_STEP) if (low[i - 1], low[i]) in WALK else math.inf
            cost = min(cost, repeat, walk)
        for size in range(WORD_LENGTH[0], min(WORD_LENGTH[1], i + 1) + 1):
            a = i + 1 - size
            word = words.cost(value[a:i + 1], low[a:i + 1])
            if word is not None:
                cost = min(cost, best[a] + (SEGMENT_BITS if a else 0.0) + word)
        if "0" <= value[i] <= "9":
            for size in range(4, min(10, i + 1) + 1):
                a = i + 1 - size
                date = date_bits(value[a:i + 1])
                if date is not None:
                    cost = min(cost, best[a] + (SEGMENT_BITS if a else 0.0) + date)
        best[i + 1] = cost
    return best[n]


Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, words: Words) -> list[tuple[int, int, float]]:
    """(start, end, bits) of the values in a credential context that are long enough and hard to guess."""
    if _GATE.search(text) is None:
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        if m.end(1) - m.start(1) >= GUESS_LENGTH:
            bits = guess_bits(m[1], words)
            if bits >= GUESS_BITS:
                out.append((m.start(1), m.end(1), bits))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[kind]}:{a}:{e}" for a, kind, e in spans])


def scan(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256 (digest of the base spans), spans (base ones and those
    of kind guess, as kind:start:end in code points, by start and then kind), n_guess, and max_bits, the highest guess
    cost among the guess spans (null: none).

    ``vocabulary`` is the path of a tokenizers file that each machine has; its whole words rank the dictionary. Null
    and empty texts have no spans. Repeated rows and rows without id each give their row; an empty table gives none;
    other columns are ignored. No row leaves its task, whole texts are searched, memory is that of a batch of texts.
    """
    fields = [("id", docs.schema[id_column].dataType), ("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()),
              ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_guess", T.LongType()), ("max_bits", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]

    def row(text: str, words: Words):
        base, guesses = base_spans(text), guess_spans(text, words)
        spans = sorted(base + [(a, 3, e) for a, e, _ in guesses])
        counts = [sum(s[1] == kind for s in base) for kind in range(3)]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(guesses),
                max((round(b, 6) for _, _, b in guesses), default=None))

    def run(batches):
        words = dictionary(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                got = [row(t, words) for t in b.column(1).to_pylist()]
                columns = [pa.array([g[k] for g in got], t) for k, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], schema.fieldNames())

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), text.alias("text")).mapInArrow(run, schema)
