"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves are the ranks of the pairs that start at each symbol, its root the lowest rank and, of equal ones,
the leftmost place. A merge changes three leaves and so three paths to the root. Trees of many words of similar length
are worked in step as one array; each distinct word of a task is merged once.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcegrain.llm.common import mapped, utf8

NONE = np.int64(1) << np.int64(62)
PLACE_BITS = 32
CACHED_WORDS = 400_000  # bound of a worker's memory for words; beyond it the memory starts anew


class Bpe:
    """A vocabulary of the tokenizers library whose words end in a suffix and whose texts pass a byte-level map."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre = whole.normalizer, whole.pre_tokenizer
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.text = {i: t.encode() for t, i in (vocab | special).items()}
        self.four = {i: i.to_bytes(4, "little") for i in self.text}
        stand_ins = self._byte_map()
        self.byte = {c: b for b, c in enumerate(stand_ins)}
        self.alone = np.array([vocab[c] for c in stand_ins], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in stand_ins], dtype=np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.plain = regex.compile(r"[\x21-\x7EÀ-įı-ſ]*")  # normal form C, one-to-one lower case
        self.words: dict[bytes, tuple[bytes, bytes]] = {}

    @staticmethod
    def _byte_map() -> list[str]:
        """The printable stand-in of each byte in byte-level vocabularies."""
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]

    def split(self, word: str) -> list[bytes | int]:
        """Pieces of a word without white space, as bytes, and the ids of special tokens in it."""
        if self.plain.fullmatch(word) and not (self.cut and "<" in word):
            return [p.encode() for p in self.pieces.findall(word.lower())]
        out: list[bytes | int] = []
        for part in self.cut.split(word) if self.cut and "<" in word else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif self.plain.fullmatch(part):
                out += [p.encode() for p in self.pieces.findall(part.lower())]
            elif part:
                out += [bytes([self.byte[c] for c in p]) for p, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for n, p in enumerate(pieces):
            by_width.setdefault(max(1, (len(p) - 1).bit_length()), []).append(n)
        for bits, members in by_width.items():
            step = max(1, (1 << 21) >> bits)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                for n, ids in zip(part, self._trees([pieces[m] for m in part], 1 << bits), strict=True):
                    out[n] = ids
        return out

    def _trees(self, pieces: list[bytes], width: int) -> list[list[int]]:
        count = len(pieces)
        symbol = np.full((count, width + 1), -1, dtype=np.int64)  # the last column stands for no symbol
        data, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces)))
        ends = np.cumsum(sizes)
        symbol[np.repeat(np.arange(count), sizes), np.arange(len(data)) - np.repeat(ends - sizes, sizes)] = self.alone[data]
        symbol[np.arange(count), sizes - 1] = self.last[data[ends - 1]]
        following = np.tile(np.arange(1, width + 2), (count, 1))
        before = np.tile(np.arange(-1, width), (count, 1))
        rows, places = np.arange(count), np.arange(width)
        tree = np.full((count, 2 * width), NONE, dtype=np.int64)
        ranks = self.rank(symbol[:, :-1], symbol[:, 1:])
        tree[:, width:] = np.where(ranks < NONE, ranks << PLACE_BITS | places, NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])

        def put(r: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            node = place + width
            tree[r, node] = value
            node = node >> 1
            while node[0] >= 1:
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                node = node >> 1

        def pair(r: np.ndarray, place: np.ndarray) -> np.ndarray:
            found = self.rank(symbol[r, place], symbol[r, following[r, place]])
            return np.where(found < NONE, found << PLACE_BITS | place, NONE)

        active = rows[tree[:, 1] < NONE]
        while len(active):
            root = tree[active, 1]
            at = root & ((1 << PLACE_BITS) - 1)
            gone = following[active, at]
            symbol[active, at] = self.made[root >> PLACE_BITS]
            symbol[active, gone] = -1
            nxt = np.minimum(following[active, gone], width)
            following[active, at] = nxt
            before[active, nxt] = at
            put(active, gone, np.full(len(active), NONE))
            put(active, at, pair(active, at))
            prev = before[active, at]
            has = prev >= 0
            if has.any():
                put(active[has], prev[has], pair(active[has], prev[has]))
            active = active[tree[active, 1] < NONE]
        left = symbol[:, :-1] >= 0
        ids, cuts = symbol[:, :-1][left].tolist(), np.concatenate([[0], np.cumsum(left.sum(axis=1))]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: set[bytes]) -> None:
        """Put the ids and the decoded form of new words into the memory."""
        if len(self.words) + len(words) > CACHED_WORDS:
            self.words.clear()
        splits = {w: self.split(w.decode()) for w in words}
        pieces = list({p for s in splits.values() for p in s if not isinstance(p, int)})
        ids = dict(zip(pieces, self.merge(pieces), strict=True))
        text, four = self.text, self.four
        for w, s in splits.items():
            numbers = ids[s[0]] if len(s) == 1 and s[0] in ids else [i for p in s for i in ((p,) if isinstance(p, int) else ids[p])]
            self.words[w] = b"".join([four[i] for i in numbers]), b" ".join([text[i] for i in numbers])

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, the decoded text)."""
        words = text.split()
        known = self.words
        try:
            got = [known[w] for w in words]
        except KeyError:
            missing = {w for w in words if w not in known}
            kept = {w: known[w] for w in set(words) - missing} if len(known) + len(missing) > CACHED_WORDS else None
            self.learn(missing)
            known.update(kept or {})
            got = [known[w] for w in words]
        return b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])

    def decode(self, ids: bytes) -> bytes:
        return b" ".join([self.text[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", output: str = "ids") -> DataFrame:
    """Token ids of every whole text: (id, n_tokens, and ``ids`` array<int> with ``decoded`` or, for ``output="digests"``,
    ids_sha256 and decoded_sha256).

    ``vocabulary`` is the path of a tokenizers file that each machine has. Null texts count as empty: no tokens, empty
    decoded text. Rows keep their order and number; no row leaves its task, and memory is that of a batch of texts plus
    a bounded memory of words.
    """
    digests = output == "digests"

    def run(batches):
        bpe = loaded(vocabulary)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    yield encoded(bpe, whole.slice(at, 256))
        finally:
            bpe.words.clear()  # the worker outlives the task and may serve other operators

    def encoded(bpe: Bpe, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        fresh = {w for t in texts for w in t.split()} - bpe.words.keys()
        if fresh and len(fresh) <= CACHED_WORDS // 2:
            bpe.learn(fresh)
        done = [bpe.encode(t) for t in texts]
        counts = pa.array([len(i) // 4 for i, _ in done], pa.int64())
        if digests:
            two = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in done], pa.string()) for k in (0, 1)]
        else:
            two = [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in done], pa.list_(pa.int32())),
                   pa.array([bpe.decode(i).decode() for i, _ in done], pa.string())]
        return pa.RecordBatch.from_arrays([b.column(0), counts, *two], schema.fieldNames())

    two = [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [
        ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()),
                           *[T.StructField(*x) for x in two]])
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(mapped(run), schema)
