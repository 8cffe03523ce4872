"""Phrase collocations by set-oriented mining over sorted occurrence relations.

The texts become one stored relation of word occurrences, sorted by piece and place and kept in chunks of whole
pieces. Each length extends it: the relation of surviving phrases meets itself at adjacent places of a piece, the
chunk's distinct extensions are counted, the counts of all chunks meet in one group per phrase, and the phrases that
reach the least count go back to their chunks, where only their occurrences are extended further (no phrase is
frequent unless both phrases inside it are). A phrase travels once per chunk however often it stands there, as numbers
of a frequent shorter phrase and a frequent word, so no word gathers its occurrences in one task.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.llm.common import utf8
from sourcegrain.session import stored

CHUNK_WORDS = 4_000_000  # bound of a task's memory; a longer piece is a chunk of its own
SENT_ROWS = 1_000_000  # likewise, of the surviving phrases that a task sends back to the chunks in one go

_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_BREAK = -1

_OCCURRENCES = "chunk long, lang string, size long, words array<string>, counts array<long>, entries long, ids binary"
_EXTENSIONS = "chunk long, prefix long, last long, n long"


class _Open:
    """The occurrences of one language that no chunk holds yet: word numbers in text order, breaks between pieces."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids = array("i")
        self.size = 0


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers from -1 on as ``width`` byte planes, compressed: small numbers leave the high planes empty."""
    return pa.compress((numbers + 1).astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, entries: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=width * entries, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(width, entries).T.copy().view(f"<i{width}").ravel() - 1


def _rows(held: dict[str, _Open], first: int) -> pa.RecordBatch:
    """One chunk per language, numbered from ``first``."""
    columns: list[list] = [[], [], [], [], [], [], []]
    for chunk, (lang, o) in enumerate(held.items(), first):
        ids = np.frombuffer(o.ids, np.int32)
        counts = np.bincount(ids[ids >= 0], minlength=len(o.known))
        order = np.argsort(-counts, kind="stable")
        number = np.full(len(order) + 1, _BREAK, dtype=np.int64)  # the last entry is that of a break
        number[order] = np.arange(len(order))
        words = list(o.known)
        row = (chunk, lang, o.size, [words[i] for i in order], counts[order], len(ids), _packed(number[ids], 4))
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                      ["chunk", "lang", "size", "words", "counts", "entries", "ids"])


def occurrences(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The occurrence relation, in chunks of one language: the distinct words, commonest first, with their counts, and the
    numbers of the words in order of piece and place, -1 between pieces (packed)."""
    def run(batches):
        held: dict[str, _Open] = {}
        number, words = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in text.lower().translate(_ENDS).split(b"\n"):
                    parts = piece.split()
                    if not parts:
                        continue
                    o = held.get(lang)
                    if o is None:
                        o = held[lang] = _Open()
                    known = o.known
                    o.ids.extend([known.setdefault(w, len(known)) for w in parts])
                    o.ids.append(_BREAK)
                    o.size += len(parts)
                    words += len(parts)
                    if words >= chunk_words:
                        yield _rows(held, number)
                        held, number, words = {}, number + len(held), 0
        if held:
            yield _rows(held, number)

    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), utf8(text_column).alias("text")).mapInArrow(run, _OCCURRENCES)


_FOUND = "chunk long, entries long, phrases binary, gid long, prefix long, last long, lang string, phrase string, count long"
_FOUND_ARROW = pa.schema([("chunk", pa.int64()), ("entries", pa.int64()), ("phrases", pa.binary()), ("gid", pa.int64()), ("prefix", pa.int64()),
                          ("last", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("count", pa.int64())])


def _counted(rows: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """The keys that count ``min_count`` or more in all chunks, each with a number of its own (``gid``): one row with its
    count per key, and messages that tell each chunk the numbers of its surviving keys (``entries`` is not null)."""
    dealt = rows.repartition(*keys).withColumn("_row", F.monotonically_increasing_id())
    key = Window.partitionBy(*keys)
    found = dealt.withColumn("total", F.sum("n").over(key)).withColumn("gid", F.min("_row").over(key)).where(F.col("total") >= min_count)
    first = F.col("_row") == F.col("gid")
    texts = [F.when(first, F.col(c)).alias(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "phrase")]
    found = found.select("chunk", F.col("prefix").cast("long").alias("prefix"), "last", "gid", *texts, F.when(first, F.col("total")).alias("count"))
    return stored(found.mapInArrow(_outcome, _FOUND))


def _outcome(batches):
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        once = pa.table(batch.filter(batch.column("count").is_valid()).columns, batch.schema.names)
        yield from _full({c: once[c] for c in ("gid", "prefix", "last", "lang", "phrase", "count")}, len(once)).to_batches()
        held.append(batch.select(["chunk", "prefix", "last", "gid"]))
        size += batch.num_rows
        if size >= SENT_ROWS:
            yield from _messages(held).to_batches()
            held, size = [], 0
    if held:
        yield from _messages(held).to_batches()


def _full(columns: dict, rows: int) -> pa.Table:
    """A table of all columns of an outcome, null where none is given."""
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in _FOUND_ARROW], schema=_FOUND_ARROW)


def _messages(held: list[pa.RecordBatch]) -> pa.Table:
    chunk, *columns = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
    order = np.argsort(chunk, kind="stable")
    names, starts = np.unique(chunk[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    blobs = []
    for a, e in zip(starts, ends, strict=True):
        packed = [_packed(c[order[a:e]], 8) for c in columns]
        blobs.append(struct.pack("<3q", *map(len, packed)) + b"".join(packed))
    return _full({"chunk": pa.array(names), "entries": pa.array(ends - starts, pa.int64()), "phrases": pa.array(blobs, pa.binary())}, len(names))


def _received(right: pa.Table, length: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The messages to one chunk by level: (prefix, last, gid) of the phrases shorter than ``length``."""
    out: dict[int, list[list[np.ndarray]]] = {k: [[np.zeros(0, np.int64)] * 3] for k in range(1, length)}
    for level, entries, blob in zip(*(right.column(c).to_pylist() for c in ("level", "entries", "phrases")), strict=True):
        at, columns = 24, []
        for size in struct.unpack_from("<3q", blob):
            columns.append(_unpacked(blob[at:at + size], entries, 8))
            at += size
        out[level].append(columns)
    return {k: tuple(np.concatenate(c) for c in zip(*parts, strict=True)) for k, parts in out.items()}


def _extension(ids: np.ndarray, found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, last, count) of the phrases of ``length`` words of a chunk whose two parts of one word less survived.

    At each level the places of the surviving phrases are merged with themselves one place on; a phrase is the rank of
    its first part times the number of surviving words, plus the rank of its last word. Breaks have no rank, so both
    parts lie in one piece.
    """
    code, _, gid = found[1]
    words = np.sort(gid)
    rank = np.full(int(ids.max(initial=0)) + 2, -1, dtype=np.int32)  # the last entry is that of a break
    rank[code] = np.searchsorted(words, gid)
    last = rank[ids]
    phrases, here, many = words, last, max(len(words), 1)
    for k in range(2, length + 1):
        n = max(len(last) - k + 1, 0)
        places = np.flatnonzero((here[:n] >= 0) & (here[1:n + 1] >= 0))
        codes = here[places].astype(np.int64) * many
        codes += last[k - 1:][places]
        if k == length:
            break
        prefix, end, gid = found[k]
        keys = np.searchsorted(phrases, prefix) * many + np.searchsorted(words, end)
        order = np.argsort(keys)
        phrases = np.sort(gid)
        here = np.full(len(last), -1, dtype=np.int32)
        if len(keys):
            keys, ranks = keys[order], np.searchsorted(phrases, gid)[order]
            at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            hit = keys[at] == codes
            here[places[hit]] = ranks[at[hit]]
    seen, counts = np.unique(codes, return_counts=True)
    first, word = np.divmod(seen, many)
    return phrases[first], words[word], counts


def _extended(relation: DataFrame, survivors: DataFrame, length: int) -> DataFrame:
    """Counts of the phrases of ``length`` words per chunk: the relation semi-joined with all shorter survivors."""
    def run(key, left, right):
        found = _received(right, length)
        out = [pa.table([pa.array([], pa.int64())] * 4, names)]
        for ids, entries in zip(left.column("ids").to_pylist(), left.column("entries").to_pylist(), strict=True):
            columns = _extension(_unpacked(ids, entries, 4), found, length)
            chunk = np.full(len(columns[0]), key[0].as_py(), dtype=np.int64)
            out.append(pa.table([pa.array(c, pa.int64()) for c in (chunk, *columns)], names))
        return pa.concat_tables(out)

    names = ["chunk", "prefix", "last", "n"]
    left = relation.select("chunk", "entries", "ids").groupBy("chunk")
    return left.cogroup(survivors.groupBy("chunk")).applyInArrow(run, _EXTENSIONS)


def frequent(docs: DataFrame, max_words: int = 3, min_count: int = 10, text_column: str = "text", lang_column: str = "lang",
             chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, n_words, count) of all phrases of 1 to ``max_words`` words that stand ``min_count``
    times or more, and (lang, n), the words of each language.

    Texts are lower-cased (A-Z only) and cut into pieces at ``.,;:!?`` and line breaks (x0A-x0D), pieces into words at
    spaces and tabs; phrases stay within a piece and are joined by one space. Null and empty texts have no words, a
    null language is ``und``, repeated rows count each, other columns are ignored, an empty table gives no rows.
    """
    relation = stored(occurrences(docs, text_column, lang_column, chunk_words))
    totals = relation.groupBy("lang").agg(F.sum("size").alias("n"))
    words = relation.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("prefix", "w"))
    words = words.select("chunk", "lang", "prefix", F.lit(0).cast("long").alias("last"), F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    found = _counted(words, ["phrase", "lang"], min_count)
    one = found.where("count is not null").select("gid", "lang", "phrase", "count")

    def messages(level: int) -> DataFrame:
        return found.where("entries is not null").select("chunk", F.lit(level).alias("level"), "entries", "phrases")

    survivors, phrases, shorter = messages(1), one.select("lang", "phrase", F.lit(1).alias("n_words"), "count"), one
    for k in range(2, max_words + 1):
        # The language needs no place in the key: a word's number belongs to one language.
        found = _counted(_extended(relation, survivors, k), ["last", "prefix"], min_count)
        head = shorter.select(F.col("gid").alias("prefix"), "lang", F.col("phrase").alias("head"))
        tail = one.select(F.col("gid").alias("last"), F.col("phrase").alias("tail"))
        shorter = stored(found.where("count is not null").select("gid", "prefix", "last", "count").join(head, "prefix").join(tail, "last")
                         .select("gid", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "count"))
        phrases = phrases.unionByName(shorter.select("lang", "phrase", F.lit(k).alias("n_words"), "count"))
        survivors = survivors.unionByName(messages(k))
    return phrases, totals


def _run_of(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, covered: int = 50, first: int | None = None, text_column: str = "text",
                 lang_column: str = "lang", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Phrases of 2 to ``max_words`` words whose words stand together more often than apart, by language.

    Columns: lang, rank (from 1), phrase, a (its occurrences), l and r (those of its two parts at the lowest-scoring
    cut, the first of equal ones), n (words of the language), score = floor(1000000 * a * a / (l * r)), exact in
    decimals. A phrase inside a longer frequent one with at least ``covered`` percent of its occurrences is dropped. Order: score
    and a descending, phrase ascending by UTF-8 bytes; ``first`` bounds the ranks of a language (None: all). Nulls,
    empty texts and tables: see ``frequent``.
    """
    phrases, totals = frequent(docs, max_words, min_count, text_column, lang_column, chunk_words)
    phrases = stored(phrases)
    long = phrases.where(F.col("n_words") >= 2).withColumn("words", F.split("phrase", " "))

    cut = long.select("lang", "phrase", F.col("count").alias("a"), "words", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _run_of("words", F.lit(1), F.col("k")).alias("left"),
                     _run_of("words", F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    part = phrases.where(F.col("n_words") < max_words)
    cut = cut.join(part.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l")), ["lang", "left"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r")), ["lang", "right"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    cut = cut.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * (a * a)).alias("top"), (l * r).alias("bottom"))
    cut = cut.withColumn("score", F.expr("top div bottom"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inside = long.where(F.col("n_words") >= 3).select("lang", "count", "words", "n_words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("length"))
    inside = inside.select("lang", "count", F.explode(F.transform(F.sequence(F.lit(1), F.col("n_words") - F.col("length") + 1),
                                                                  lambda s: _run_of("words", s, F.col("length")))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", F.col("best.score").alias("score"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
