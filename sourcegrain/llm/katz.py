"""Katz backoff scores from Good-Turing discounted bigram counts.

Every word of the training documents is a symbol of the model, named by its 64-bit hash; words that are frequent in a
sample have a small number as name instead, which changes the size of messages and nothing else. A task turns its
documents into messages, one for each bucket of words and of bigrams, in which a key stands once with the documents that hold it. A
bucket counts its keys, stores them and answers with partial sums per document. Nothing that grows with the vocabulary
reaches the driver or every executor: a bucket of bigrams asks the buckets of words for the counts of its words, sends
what it knows of each history to the history's bucket and gets the backoff weights back, each key once per bucket.

Every history keeps one event of mass for words it never had, besides what Good-Turing takes from the counts up to five:
p(w|h) = d(c) c / (c(h) + 1), else a(h) p(w), where p(w) is the smoothed share of w among all tokens. Probabilities over
all words, a word never seen and the end of the text sum to one after every history. The factor 1 / (c(h) + 1) stands in
both cases, so each document takes it from the counts of its own words.

With ``WORDS`` set to a number, the model has only so many of the most frequent words, and the other words are one class
in which a word has the share of its smoothed count. A history that had every symbol has nothing to back off to then; its
probabilities are divided by their sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcegrain.llm.common import grouped, mapped, utf8
from sourcegrain.session import small_batches, stored

WORDS: int | None = None  # words of the model at most, which are broadcast then; None: all words, nothing is broadcast
CHUNK = 500_000  # tokens that a task turns into one set of messages
BUCKET = 1_200_000  # tokens for each bucket of bigrams
DISCOUNTED = 5  # counts up to this are discounted
ADD = 0.1
SHIFT = np.uint64(20)
RANGES = 64
START, END = np.uint64(0), np.uint64(1)
SHORT = 60_000  # frequent words of a sample with short names, which only make messages smaller
SAMPLE = 50_000_000  # bytes of that sample

_MESSAGE = "bucket int, chunk long, trained int, docs binary, keys binary, sizes binary, places binary, counts binary, rare binary, rare_sizes binary, rare_places binary, rare_counts binary"
_NAMES = [f.split(" ")[0] for f in _MESSAGE.split(", ")]
_PART = "kind string, bucket int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
_PART_NAMES = [f.split(" ")[0] for f in _PART.split(", ")]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2**64, byte planes first."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _hashes(words: dict[bytes, int]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_64_digest(w) for w in words), ">u8").astype(np.uint64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, count) over the training rows of (id, train, text)."""
    def run(batches):
        counts: dict[bytes, int] = {}

        def out():
            h = _hashes(counts).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(counts.values()), pa.int64())], ["w", "c"])

        for b in batches:
            for text in b.column(2):
                for w in text.as_py().lower().split():
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > 50_000:
                    yield out()
                    counts.clear()
        yield out()
    return docs.where("train").mapInArrow(mapped(run), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Lexicon:
    """The model's words, sorted by hash, and the probabilities that need no history."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, kinds: int, trained: int):
        order = np.argsort(hashes)
        self.hashes, counts = hashes[order], counts[order]
        m = self.m = len(hashes)
        self.rare, self.end, self.start = m, m + 1, m + 2
        self.total, self.kinds = total + trained, kinds + (trained > 0)
        self.log_all = np.log10(self.total + ADD * (self.kinds + 1))
        rare_count, rare_kinds = total - int(counts.sum()), kinds - m
        self.log_rare = np.log10(rare_count + ADD * (rare_kinds + 1))
        self.after = np.concatenate([counts, [rare_count, 0, trained]]).astype(np.float64)  # how often a symbol is a history
        share = np.concatenate([counts + ADD, [rare_count + ADD * (rare_kinds + 1), trained + ADD * (trained > 0), 0]])
        self.p = share / (self.total + ADD * (self.kinds + 1))
        self.end_known = trained > 0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not self.m:
            return np.full(len(hashes), self.rare, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.m - 1)
        return np.where(self.hashes[at] == hashes, at, self.rare)


def lexicon(counts: DataFrame, trained: int) -> Lexicon:
    """The words whose count reaches the lowest step, of 64 to each doubling, that at most ``WORDS`` words reach."""
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2(F.col("c").cast("double")) * 64)
    steps = sorted(((r["s"], r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)  # 64 times the bits of a count
    least, sum_ = None, 0
    for s, n in steps:
        sum_ += n
        if sum_ > WORDS:
            break
        least = s
    rows = counts.where(step >= least).toArrow() if least is not None else pa.table({"w": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    return Lexicon(rows["w"].to_numpy().view(np.uint64), rows["c"].to_numpy(), total, kinds, trained)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each stands)."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[starts], np.diff(np.concatenate([starts, [len(sorted_)]]))


def _deltas(values: np.ndarray) -> bytes:
    return pack(np.concatenate([values[:1], np.diff(values)]))


def _sums(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _split(keys: np.ndarray, docs: np.ndarray, bucket: np.ndarray, buckets: int, packed=lambda kinds: [_deltas(kinds)]) -> dict[int, list[bytes]]:
    """Packed (distinct keys, documents per key, these documents, counts) of each bucket."""
    out: dict[int, list[bytes]] = {}
    order = np.lexsort((docs, keys, bucket))
    keys, docs, bucket = keys[order], docs[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        k, d = keys[edges[b]:edges[b + 1]], docs[edges[b]:edges[b + 1]]
        if len(k):
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
            counts = np.diff(np.concatenate([first, [len(k)]]))
            kinds, sizes = _runs(k[first])
            out[b] = [*packed(kinds), pack(sizes), pack(d[first]), pack(counts)]
    return out


def _mixed(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _in_chunks(flush):
    """Calls flush(chunk number, (id, train) rows, texts) for about ``CHUNK`` tokens at a time."""
    def run(batches):
        chunk, size, rows, texts = TaskContext.get().partitionId() << 24, 0, [], []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for i, train, text in zip(*[c.to_pylist() for c in b.slice(at, 256).columns], strict=True):
                    rows.append((i, train))
                    texts.append(text)
                    size += len(text) // 6 + 1
                    if size >= CHUNK or len(rows) >= 1 << 19:
                        yield from flush(chunk, rows, texts)
                        chunk, size, rows, texts = chunk + 1, 0, [], []
        if rows:
            yield from flush(chunk, rows, texts)
    return run


def _messages(shared, buckets: int):
    def flush(chunk: int, rows: list[tuple], texts: list[bytes]):
        lex: Lexicon = shared.value
        order = sorted(range(len(rows)), key=lambda i: not rows[i][1])  # training documents first
        trained = sum(r[1] for r in rows)
        known: dict[bytes, int] = {}
        numbers, lengths = [], []
        for i in order:
            words = texts[i].lower().split()
            lengths.append(len(words))
            numbers.extend([known.setdefault(w, len(known)) for w in words])
        hashes = _hashes(known)
        lengths, numbers = np.array(lengths, np.int64), np.array(numbers, np.int64)
        ids = lex.ids(hashes)
        doc = np.repeat(np.arange(len(order)), lengths)
        w = ids[numbers]
        base = np.bincount(doc, np.log10(lex.p[w] if len(w) else np.zeros(0)) * (w != lex.rare), len(order)) + np.log10(lex.p[lex.end])
        usual = np.bincount(doc, w != lex.rare, len(order)).astype(np.int64) + lex.end_known
        # symbols of all texts in a row, each with a start and an end
        at = np.arange(len(w)) + 2 * doc + 1
        symbols = np.full(len(w) + 2 * len(order), lex.start, np.int64)
        symbols[at] = w
        ends = np.cumsum(lengths + 2) - 1
        symbols[ends] = lex.end
        right = np.ones(len(symbols), bool)
        right[ends - lengths - 1] = False
        places = np.flatnonzero(right)
        keys = (symbols[places - 1].astype(np.uint64) << SHIFT) | symbols[places].astype(np.uint64)
        owner = np.repeat(np.arange(len(order)), lengths + 1)
        pairs = _split(keys, owner, _mixed(keys, buckets), buckets)
        seldom = w == lex.rare
        rare_hash = hashes[numbers[seldom]]
        rare = _split(rare_hash, doc[seldom], _mixed(rare_hash, buckets), buckets)
        nothing = pack(np.zeros(0, np.uint64))
        ids_blob = pa.BufferOutputStream()
        table = pa.table({"id": pa.array([rows[i][0] for i in order]), "train": pa.array([rows[i][1] for i in order], pa.bool_()), "n": lengths + 1,
                          "known": usual, "base": base, "rare": np.bincount(doc, seldom, len(order)).astype(np.int64)})
        with pa.ipc.new_stream(ids_blob, table.schema) as out:
            out.write_table(table)
        cells = [[b, chunk, trained, None, *pairs.get(b, [nothing] * 4), *rare.get(b, [nothing] * 4)] for b in sorted(pairs.keys() | rare.keys())]
        cells.append([chunk % buckets, chunk, trained, ids_blob.getvalue().to_pybytes(), *[nothing] * 8])
        types = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 9
        for s in range(0, len(cells), 64):
            columns = list(zip(*cells[s:s + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)

    return _in_chunks(flush)


def _counted(rows: list[dict], names: tuple[str, str, str, str], every: np.ndarray | None = None):
    """The distinct keys of all messages (in a row: ``every``), their training counts, and of each message (key numbers, sizes, places, counts)."""
    parts, totals = [], []
    for r in rows:
        keys = _sums(r[names[0]])
        sizes, places, counts = (unpack(r[n]).astype(np.int64) for n in names[1:])
        own = counts * (places < r["trained"])
        starts = np.cumsum(sizes) - sizes
        totals.append(np.add.reduceat(own, starts) if len(starts) else np.zeros(0, np.int64))
        parts.append((keys, sizes, places, counts))
    kinds, number = np.unique(np.concatenate([p[0] for p in parts]) if every is None else every, return_inverse=True)
    total = np.bincount(number, np.concatenate(totals), len(kinds)).astype(np.int64)
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return kinds, total, [(n, *p[1:]) for n, p in zip(np.split(number, cuts), parts, strict=True)]


def _bucket(shared):
    def work(table):
        lex: Lexicon = shared.value
        rows = table.to_pylist()
        bucket, out = rows[0]["bucket"], []
        kinds, total, messages = _counted(rows, ("keys", "sizes", "places", "counts"))
        _, rare_total, rare_messages = _counted(rows, ("rare", "rare_sizes", "rare_places", "rare_counts"))
        left, right = (kinds >> SHIFT).astype(np.int64), (kinds & np.uint64((1 << 20) - 1)).astype(np.int64)
        seen = total > 0
        out.append({"kind": "model", "bucket": bucket, "a": pack(np.concatenate([kinds[seen][:1], np.diff(kinds[seen])])), "b": pack(total[seen])})
        h, c = left[seen], np.minimum(total[seen], DISCOUNTED + 2)
        range_ = h * RANGES // (lex.m + 3)
        for r in np.unique(range_):
            own = range_ == r
            names, number = np.unique(h[own], return_inverse=True)
            by_count = [np.bincount(number, c[own] == k, len(names)) for k in range(1, DISCOUNTED + 3)]
            mass = np.bincount(number, lex.p[right[seen][own]], len(names))
            out.append({"kind": "history", "bucket": int(r), "a": pack(names), "b": pack(np.concatenate(by_count)), "c": mass.tobytes()})
        with np.errstate(divide="ignore"):
            log_seen = np.where(seen, np.log10(total) - np.log10(lex.after[left] + 1), 0.0)
            log_back = np.log10(lex.p[right])
        for r, (number, sizes, places, counts), (rare, rare_sizes, rare_places, rare_counts) in zip(rows, messages, rare_messages, strict=True):
            if r["docs"] is not None:
                out.append({"kind": "docs", "chunk": r["chunk"], "a": r["docs"]})
                continue
            key, rare_key = np.repeat(number, sizes), np.repeat(rare, rare_sizes)
            touched, place = np.unique(np.concatenate([places, rare_places]), return_inverse=True)
            one, two = place[:len(places)], place[len(places):]
            n = len(touched)
            new = ~seen[key]
            full = seen[key] & (lex.after[left[key]] >= lex.m + 2)  # histories that may have had every symbol
            sums = np.bincount(one, counts * np.where(new, log_back[key], log_seen[key]), n)
            low = [np.bincount(one, counts * (total[key] == k), n) for k in range(1, DISCOUNTED + 1)]
            rare_sum = np.bincount(two, rare_counts * np.log10(rare_total[rare_key] + ADD), n)
            rare_known = np.bincount(two, rare_counts * (rare_total[rare_key] > 0), n)
            out.append({"kind": "sums", "chunk": r["chunk"], "a": pack(touched), "b": sums.tobytes(), "c": pack(np.concatenate([*low, rare_known])),
                        "d": rare_sum.tobytes(), "e": pack(np.concatenate([places[new], places[full]])),
                        "f": pack(np.concatenate([left[key[new]], left[key[full]] + lex.m + 3])), "g": pack(np.concatenate([counts[new], counts[full]]))})
        return pa.Table.from_pylist(out, _PART_ARROW)
    return work


_PART_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("chunk", pa.int64())] + [(n, pa.binary()) for n in "abcdefg"])


def _histories(table):
    """Sums over all buckets of the statistics of one range of histories."""
    every = [(unpack(a).astype(np.int64), unpack(b).astype(np.int64), np.frombuffer(c)) for a, b, c in zip(
        *[table[n].to_pylist() for n in "abc"], strict=True)]
    names, number = np.unique(np.concatenate([e[0] for e in every]), return_inverse=True)
    width = DISCOUNTED + 2
    low = np.concatenate([e[1].reshape(width, -1) for e in every], axis=1)
    columns = [np.bincount(number, low[k], len(names)).astype(np.int64) for k in range(width)]
    mass = np.bincount(number, np.concatenate([e[2] for e in every]), len(names))
    return pa.table([pa.array(names), *[pa.array(c) for c in columns], pa.array(mass)], names=["h", *[f"t{k + 1}" for k in range(width)], "mass"])


def discounts(kinds: list[int]) -> np.ndarray:
    """Katz's d(1..5) from the numbers of bigrams seen once to six times; where these give none between 0 and 1, (r - 1/2) / r."""
    r = np.arange(1, DISCOUNTED + 1)
    plain = (r - 0.5) / r
    n = np.array(kinds, dtype=np.float64)
    if (n <= 0).any():
        return plain
    turing = (r + 1) * n[1:] / (n[:-1] * r)
    common = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (turing - common) / (1 - common)
    return np.where((d > 0) & (d <= 1) & (common < 1), d, plain)


def _limited_scores(rows: DataFrame) -> DataFrame:
    """Scores of (id, train, text) by a model of at most ``WORDS`` words and the class of the others."""
    spark = rows.sparkSession
    counts = stored(word_counts(rows))
    trained = rows.where("train").count()
    lex = lexicon(counts, trained)
    shared = spark.sparkContext.broadcast(lex)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lex.total // BUCKET + 1)
    messages = rows.mapInArrow(_messages(shared, buckets), _MESSAGE)
    parts = stored(messages.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_bucket(shared), _PART))
    fields = ", ".join(f"t{k} long" for k in range(1, DISCOUNTED + 3))
    stats = parts.where("kind = 'history'").select("bucket", "a", "b", "c").groupBy("bucket").applyInArrow(_histories, f"h long, {fields}, mass double").toArrow()
    low = np.stack([stats[f"t{k}"].to_numpy() for k in range(1, DISCOUNTED + 3)])
    d = discounts([int(x) for x in low[:-1].sum(axis=1)])
    back = np.zeros(2 * (lex.m + 3))  # the weight of each history, then what its seen words get if it had every symbol
    h = stats["h"].to_numpy()
    r = np.arange(1, DISCOUNTED + 1)
    kept = 1 + (low[:DISCOUNTED] * (r * (1 - d))[:, None]).sum(axis=0)
    back[h] = np.log10(kept / (lex.after[h] + 1)) - np.log10(np.maximum(1 - stats["mass"].to_numpy(), 1e-300))
    back[h + lex.m + 3] = np.where(low.sum(axis=0) == lex.m + 2, -np.log10(np.maximum(1 - kept / (lex.after[h] + 1), 1e-300)), 0.0)
    weights = spark.sparkContext.broadcast((back, np.log10(d), float(lex.log_all), float(lex.log_rare), lex.total))

    def finish(table):
        back, log_d, log_all, log_rare, total = weights.value
        docs_blob = next(a for k, a in zip(table["kind"].to_pylist(), table["a"].to_pylist(), strict=True) if k == "docs")
        own = pa.ipc.open_stream(docs_blob).read_all()
        n = own.num_rows
        score, rare_sum, known = np.zeros(n), np.zeros(n), own["known"].to_numpy().copy()
        for p in table.filter(pc.equal(table["kind"], "sums")).to_pylist():
            at, small = unpack(p["a"]).astype(np.int64), unpack(p["c"]).astype(np.int64).reshape(DISCOUNTED + 1, -1)
            score[at] += np.frombuffer(p["b"]) + log_d @ small[:DISCOUNTED]
            rare_sum[at] += np.frombuffer(p["d"])
            known[at] += small[DISCOUNTED]
            np.add.at(score, unpack(p["e"]).astype(np.int64), unpack(p["g"]).astype(np.int64) * back[unpack(p["f"]).astype(np.int64)])
        rare = own["rare"].to_numpy()
        return pa.table({"id": own["id"], "held_out": pc.invert(own["train"]), "n_tokens": own["n"], "n_known": pa.array(known),
                         "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(own["base"].to_numpy() + rare_sum - rare * log_all),
                         "score": pa.array(score + rare_sum - rare * log_rare)})

    chunks = parts.where("kind in ('docs', 'sums')").drop("bucket")
    return chunks.groupBy("chunk").applyInArrow(grouped(finish), _ddl(rows))


def _ddl(rows: DataFrame) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- the model of all words ----
_KEYED = "bucket int, chunk long, trained int, docs binary, lefts binary, rights binary, sizes binary, places binary, counts binary, words binary, word_sizes binary, word_places binary, word_counts binary"
_KEYED_NAMES = [f.split(" ")[0] for f in _KEYED.split(", ")]
_STEP = "kind string, bucket int, source int, chunk long, a binary, b binary, c binary, d binary, stats array<long>"
_STEP_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("source", pa.int32()), ("chunk", pa.int64())]
                        + [(n, pa.binary()) for n in "abcd"] + [("stats", pa.list_(pa.int64()))])


def _pair_bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    return _mixed(left * np.uint64(0xC2B2AE3D27D4EB4F) + right, buckets)


def short_names(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, names) of the words with short names; the more frequent, the smaller."""
    sample = rows.sample(min(1.0, SAMPLE / max(size, 1)), seed=7)
    top = word_counts(sample).orderBy(F.desc("c"), "w").limit(SHORT).toArrow()
    hashes = top["w"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (order + 2).astype(np.uint64)


def _named(hashes: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, names = short
    if not len(known):
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, names[at], hashes)


def _keyed(buckets: int, shared):
    """Messages of words and bigrams by their names."""
    def flush(chunk: int, rows: list[tuple], texts: list[bytes]):
        order = sorted(range(len(rows)), key=lambda i: not rows[i][1])  # training documents first
        trained = sum(r[1] for r in rows)
        known: dict[bytes, int] = {}
        numbers, lengths = [], []
        for i in order:
            words = texts[i].lower().split()
            lengths.append(len(words))
            numbers.extend([known.setdefault(w, len(known)) for w in words])
        names = np.concatenate([_named(_hashes(known), shared.value), np.array([END, START], np.uint64)])
        by_name, kinds = np.argsort(names), len(names)
        rank = np.empty(kinds, np.int64)  # within the chunk a symbol is its place among the sorted names
        rank[by_name] = np.arange(kinds)
        names = names[by_name]
        lengths, w = np.array(lengths, np.int64), rank[np.array(numbers, np.int64)]
        doc = np.repeat(np.arange(len(order)), lengths)
        # symbols of all texts in a row, each with a start and an end
        symbols = np.full(len(w) + 2 * len(order), rank[-1], np.int64)
        symbols[np.arange(len(w)) + 2 * doc + 1] = w
        ends = np.cumsum(lengths + 2) - 1
        symbols[ends] = rank[-2]
        right = np.ones(len(symbols), bool)
        right[ends - lengths - 1] = False
        places = np.flatnonzero(right)
        left, right = symbols[places - 1], symbols[places]
        owner = np.repeat(np.arange(len(order)), lengths + 1)
        pairs = _split(left * kinds + right, owner, _pair_bucket(names[left], names[right], buckets), buckets,
                       lambda keys: [_deltas(names[keys // kinds]), pack(names[keys % kinds])])
        del symbols, right, places, left, owner, numbers, known
        words = _split(w, doc, _mixed(names[w], buckets), buckets, lambda keys: [_deltas(names[keys])])
        del w, doc
        nothing = pack(np.zeros(0, np.uint64))
        blob = pa.BufferOutputStream()
        table = pa.table({"id": pa.array([rows[i][0] for i in order]), "train": pa.array([rows[i][1] for i in order], pa.bool_()), "n": lengths + 1})
        with pa.ipc.new_stream(blob, table.schema) as out:
            out.write_table(table)
        cells = [[b, chunk, trained, None, *pairs.get(b, [nothing] * 5), *words.get(b, [nothing] * 4)] for b in sorted(pairs.keys() | words.keys())]
        cells.append([chunk % buckets, chunk, trained, blob.getvalue().to_pybytes(), *[nothing] * 9])
        types = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 10
        for s in range(0, len(cells), 64):
            columns = list(zip(*cells[s:s + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _KEYED_NAMES)
    return _in_chunks(flush)


def _by_bucket(names: np.ndarray, number: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names ordered by bucket, ``number`` as places in that order, and where each bucket starts."""
    bucket = _mixed(names, buckets)
    order = np.lexsort((names, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return names[order], place[number], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _count_bucket(buckets: int):
    def work(table):
        rows = table.to_pylist()
        bucket, out = rows[0]["bucket"], []
        words, word_total, word_messages = _counted(rows, ("words", "word_sizes", "word_places", "word_counts"))
        histories, left = np.unique(np.concatenate([_sums(r["lefts"]) for r in rows]), return_inverse=True)
        rights, right = np.unique(np.concatenate([unpack(r["rights"]) for r in rows]), return_inverse=True)
        histories, left, _ = _by_bucket(histories, left, buckets)
        rights, right, edges = _by_bucket(rights, right, buckets)
        width = max(len(rights), 1)
        kinds, total, messages = _counted(rows, ("lefts", "sizes", "places", "counts"), left * width + right)
        left, right = kinds // width, kinds % width
        seen = total > 0
        out.append({"kind": "stats", "bucket": bucket, "stats": [*[int((total == k).sum()) for k in range(1, DISCOUNTED + 2)],
                                                                 int(word_total.sum()), int((word_total > 0).sum())]})
        out.append({"kind": "words", "bucket": bucket, "a": _deltas(words), "b": pack(word_total)})
        out.append({"kind": "model", "bucket": bucket, "a": _deltas(histories), "b": _deltas(left[seen]), "c": pack(right[seen]), "d": pack(total[seen])})
        for b in np.flatnonzero(np.diff(edges)):
            out.append({"kind": "ask", "bucket": int(b), "source": bucket, "a": _deltas(rights[edges[b]:edges[b + 1]])})
        with np.errstate(divide="ignore"):
            log_seen = np.where(seen, np.log10(total), 0.0)
        log_base, log_after = np.log10(word_total + ADD), np.log10(word_total + 1)
        for r, (number, sizes, places, counts), (word, word_sizes, word_places, word_counts) in zip(rows, messages, word_messages, strict=True):
            if r["docs"] is not None:
                out.append({"kind": "docs", "chunk": r["chunk"], "a": r["docs"]})
                continue
            key, word_key = np.repeat(number, sizes), np.repeat(word, word_sizes)
            touched, place = np.unique(np.concatenate([places, word_places]), return_inverse=True)
            one, two = place[:len(places)], place[len(places):]
            n = len(touched)
            base = np.bincount(two, word_counts * log_base[word_key], n)
            score = np.bincount(one, counts * log_seen[key], n) - np.bincount(two, word_counts * log_after[word_key], n)
            low = [np.bincount(one, counts * (total[key] == k), n) for k in range(1, DISCOUNTED + 1)]
            known = np.bincount(two, word_counts * (word_total[word_key] > 0), n)
            out.append({"kind": "sums", "chunk": r["chunk"], "a": pack(touched), "b": np.concatenate([base, score]).tobytes(), "c": pack(np.concatenate([*low, known]))})
            new = ~seen[key]
            if new.any():
                out.append({"kind": "new", "bucket": bucket, "chunk": r["chunk"], "a": pack(places[new]), "b": pack(left[key[new]]),
                            "c": pack(right[key[new]]), "d": pack(counts[new])})
        return pa.Table.from_pylist(out, _STEP_ARROW)
    return work


def _answer(trained: int):
    """The counts of the words that the buckets of bigrams ask for, in the order of the question."""
    def work(table):
        rows = table.to_pylist()
        own = [r for r in rows if r["kind"] == "words"]
        words, total = (_sums(own[0]["a"]), unpack(own[0]["b"])) if own else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        words, total = np.append(words, np.uint64(0)), np.append(total, np.uint64(0))  # the last one stands for none
        out = []
        for r in rows:
            if r["kind"] == "ask":
                asked = _sums(r["a"])
                at = np.searchsorted(words[:-1], asked)
                found = np.where(words[at] == asked, total[at], np.uint64(0))
                out.append({"kind": "count", "bucket": r["source"], "source": r["bucket"], "a": pack(np.where(asked == END, np.uint64(trained), found))})
        return pa.Table.from_pylist(out, _STEP_ARROW)
    return work


def _answers(rows: list[dict], kind: str, read) -> np.ndarray:
    parts = [read(r["a"]) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["source"])]
    return np.concatenate(parts) if parts else np.zeros(0)


def _history_parts(buckets: int, d: np.ndarray):
    """What a bucket of bigrams knows of each of its histories, also of those it has no training bigram of."""
    taken = np.concatenate([[0], np.arange(1, DISCOUNTED + 1) * (1 - d), [0]])

    def work(table):
        rows = table.to_pylist()
        model = next(r for r in rows if r["kind"] == "model")
        count = _answers(rows, "count", unpack).astype(np.int64)
        histories, left, right, total = _sums(model["a"]), _sums(model["b"]).astype(np.int64), unpack(model["c"]).astype(np.int64), unpack(model["d"]).astype(np.int64)
        n = len(histories)
        lost = np.bincount(left, taken[np.minimum(total, DISCOUNTED + 1)], n)
        mass = np.bincount(left, count[right], n).astype(np.int64)
        follow = np.bincount(left, minlength=n)
        edges = np.searchsorted(_mixed(histories, buckets), np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(edges)):
            own = slice(edges[b], edges[b + 1])
            out.append({"kind": "history", "bucket": int(b), "source": model["bucket"], "a": _deltas(histories[own]), "b": lost[own].tobytes(),
                        "c": pack(mass[own]), "d": pack(follow[own])})
        return pa.Table.from_pylist(out, _STEP_ARROW)
    return work


def _weights(total: int, kinds: int):
    """log10 of a(h) (c(h) + 1) for the histories that each bucket of bigrams named, in its order."""
    def work(table):
        rows = table.to_pylist()
        names = [_sums(r["a"]) for r in rows]
        every, number = np.unique(np.concatenate(names), return_inverse=True)
        lost = np.bincount(number, np.concatenate([np.frombuffer(r["b"]) for r in rows]), len(every))
        mass = np.bincount(number, np.concatenate([unpack(r["c"]) for r in rows]), len(every))
        follow = np.bincount(number, np.concatenate([unpack(r["d"]) for r in rows]), len(every))
        left = total - mass + ADD * (kinds + 1 - follow)  # a word never seen is always left
        weight = np.log10(1 + lost) + np.log10(total + ADD * (kinds + 1)) - np.log10(left)
        parts = np.split(weight[number], np.cumsum([len(x) for x in names])[:-1])
        return pa.Table.from_pylist([{"kind": "weight", "bucket": r["source"], "source": r["bucket"], "a": x.tobytes()} for r, x in zip(rows, parts, strict=True)], _STEP_ARROW)
    return work


def _backed_off(log_all: float):
    """Sums per document over the bigrams without training count."""
    def work(table):
        rows, out = table.to_pylist(), []
        count, weight = _answers(rows, "count", unpack), _answers(rows, "weight", np.frombuffer)
        share = np.log10(count + ADD) - log_all
        for r in rows:
            if r["kind"] == "new":
                places, left, right, counts = (unpack(r[n]).astype(np.int64) for n in "abcd")
                touched, place = np.unique(places, return_inverse=True)
                out.append({"kind": "back", "chunk": r["chunk"], "a": pack(touched), "b": np.bincount(place, counts * (weight[left] + share[right])).tobytes()})
        return pa.Table.from_pylist(out, _STEP_ARROW)
    return work


def scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Words are split at ASCII white space after lowering A-Z; each text ends in one end token; null and empty texts are
    that token alone. Rows whose id is null are trained on and scored like others; repeated rows count each time;
    without training rows every word is unknown; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), (~held_out(id_column)).alias("train"), utf8(text_column).alias("text"))
    if WORDS is not None:
        return _limited_scores(rows)
    size, trained = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // BUCKET + 1)

    def each(table: DataFrame, work) -> DataFrame:
        return table.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(grouped(work), _STEP)

    with small_batches(spark):
        shared = spark.sparkContext.broadcast(short_names(rows, size))
        parts = stored(each(rows.mapInArrow(mapped(_keyed(buckets, shared)), _KEYED), _count_bucket(buckets)))
    of = lambda *kinds: parts.where(F.col("kind").isin(*kinds))
    *low, total, kinds = of("stats").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(DISCOUNTED + 3)]).first()
    total, kinds = total + trained, kinds + (trained > 0)
    d = discounts(low)
    counts = stored(each(of("words", "ask"), _answer(trained)))
    weights = each(each(of("model").unionByName(counts), _history_parts(buckets, d)), _weights(total, kinds))
    log_d, log_all = np.log10(d), float(np.log10(total + ADD * (kinds + 1)))
    back = each(of("new").unionByName(counts).unionByName(weights), _backed_off(log_all))

    def finish(table):
        parts = table.to_pylist()
        own = pa.ipc.open_stream(next(p["a"] for p in parts if p["kind"] == "docs")).read_all()
        n = own["n"].to_numpy()
        base = np.log10(trained + ADD) - n * log_all
        score, known = np.full(len(n), -np.log10(trained + 1)), np.full(len(n), int(trained > 0))
        for p in parts:
            if p["kind"] == "docs":
                continue
            at, sums = unpack(p["a"]).astype(np.int64), np.frombuffer(p["b"])
            if p["kind"] == "back":
                score[at] += sums
                continue
            small = unpack(p["c"]).astype(np.int64).reshape(DISCOUNTED + 1, -1)
            base[at] += sums[:len(at)]
            score[at] += sums[len(at):] + log_d @ small[:DISCOUNTED]
            known[at] += small[DISCOUNTED]
        return pa.table({"id": own["id"], "held_out": pc.invert(own["train"]), "n_tokens": own["n"], "n_known": pa.array(known),
                         "train_tokens": pa.array(np.full(len(n), total, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    chunks = of("docs", "sums").unionByName(back).select("kind", "chunk", "a", "b", "c")
    return chunks.groupBy("chunk").applyInArrow(grouped(finish), _ddl(rows))

