"""Chat formatting in a prefix tree.

Conversations with the same first turns share the nodes of these turns. The forest is laid out once, depth first, as one
stream of code points: a sort by path, where a node's path is the chain of its ancestors' short hashes, is that order, and
one scan of each range partition with a stack of open nodes gives the places. A node keeps the position id of its first code point (what stands
before it in its own conversation) and the stream intervals of its ancestors, which are all that it may attend to.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcegrain.session import stored

# The turn marks.
START, END = "<|im_start|>", "<|im_end|>"
STEP = 12  # bytes of a path per turn
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """A text without any ``<|``; each run between ``<`` and ``|`` gets one backslash more."""
    return _MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the part under the loss mask)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    start = len(head)
    return f"{head}{body}{END}\n", start, start + (len(body) if role == "assistant" else 0)


def parse_turns(stream: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in stream.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest.removesuffix(f"{END}\n"))))
    return turns


_NODE = "path binary, depth int, position long, role string, formatted string, loss_start int, loss_end int, conv_id long, leaf boolean"
_ARROW = pa.schema([("path", pa.binary()), ("depth", pa.int32()), ("position", pa.int64()), ("role", pa.string()), ("formatted", pa.string()),
                    ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("conv_id", pa.int64()), ("leaf", pa.bool_())])


def turn_nodes(conversations: DataFrame) -> DataFrame:
    """One row per turn with its path; rows of a conversation in order of turn, role and text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))  # the turns of one conversation

    def run(batches):
        for b in batches:
            out = []
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path, link, position = b"", b"", 0
                items = turns.as_py()
                for n, t in enumerate(items):
                    formatted, start, end = format_turn(t["role"], t["text"])
                    link = xxhash.xxh3_128_digest(link + formatted.encode())
                    path += link[:STEP]
                    out.append({"path": path, "depth": n + 1, "position": position, "role": t["role"], "formatted": formatted, "loss_start": start,
                                "loss_end": end, "conv_id": conv, "leaf": n + 1 == len(items)})
                    position += len(formatted)
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, _ARROW)
                        out = []
            yield pa.RecordBatch.from_pylist(out, _ARROW)
    return whole.mapInArrow(run, _NODE)


class _Open:
    """The open nodes of a depth-first scan: path, interval and merged intervals up to and with the node."""

    def __init__(self):
        self.nodes: list[tuple[bytes, int, int, list[tuple[int, int]]]] = []

    def enter(self, path: bytes, start: int, end: int) -> tuple[int, list[tuple[int, int]], list[int]]:
        """(ancestors before the scan, merged intervals and starts of those in it)."""
        while self.nodes and not path.startswith(self.nodes[-1][0]):
            self.nodes.pop()
        outside = (len(self.nodes[0][0] if self.nodes else path) // STEP) - 1
        inside = self.nodes[-1][3] if self.nodes else []
        starts = [n[1] for n in self.nodes]
        self.nodes.append((path, start, end, merged([*inside, (start, end)])))
        return outside, inside, starts


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending intervals, neighbours joined."""
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<from:bigint,to:bigint>>"


def _scan(batches):
    """Of one range in order: places within the range, and on the last row the nodes that stay open."""
    open_, total, first, held = _Open(), 0, None, None
    spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def out(b, before, outside, inside, starts, last):
        n = b.num_rows
        stack = [None] * n
        if last:
            stack[-1] = [{"from": x[1], "to": x[2]} for x in open_.nodes]
        firsts = pa.array([first if last and i == n - 1 else None for i in range(n)], pa.binary())
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64()), pa.array(outside, pa.int32()), pa.array(inside, spans),
                                           pa.array(starts, pa.list_(pa.int64())), pa.array(stack, spans), firsts],
                                          [*b.schema.names, "before", "outside", "inside", "starts", "stack", "first"])

    for b in batches:
        if not b.num_rows:
            continue
        if held:
            yield out(*held, False)
        before, outside, inside, starts = [], [], [], []
        for path, length, leaf in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("leaf").to_pylist(), strict=True):
            first = first or path
            o, i, s = open_.enter(path, total, total + length)
            before.append(total)
            outside.append(o)
            inside.append([{"from": x, "to": y} for x, y in i])
            starts.append(s if leaf else None)
            total += length
        held = b, before, outside, inside, starts
    if held:
        yield out(*held, True)


def _carried(ends: list) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """Of each range (offset, intervals of the nodes that are open before it), from the last rows of all ranges."""
    carried, open_, offset = {}, [], 0
    for r in sorted(ends, key=lambda r: r["part"]):
        carried[r["part"]] = offset, open_[:len(r["first"]) // STEP - 1]
        kept = open_[:len(r["path"]) // STEP - len(r["stack"])]
        open_ = kept + [(x["from"] + offset, x["to"] + offset) for x in r["stack"]]
        offset += r["before"] + r["length"]
    return carried


def forest(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): the laid-out prefix forest and each conversation's last node.

    Nodes: node, start, length, position, depth, role, formatted, loss_start, loss_end, ancestors (intervals of the
    stream in order, neighbours joined) and, where a conversation ends, turn_starts (the starts of all its turns before).
    Null texts and roles count as empty; rows without conv_id form one conversation; repeated rows are turns of their
    own; equal conversations end in the same node; an empty table gives no rows.
    """
    spark = conversations.sparkSession
    rows = stored(turn_nodes(conversations))
    leaves = rows.where("leaf").select("conv_id", F.unhex(F.md5("path")).alias("node"))
    same = ("depth", "position", "role", "formatted", "loss_start", "loss_end")
    distinct = rows.groupBy("path").agg(*[F.first(c).alias(c) for c in same], F.max("leaf").alias("leaf"))
    distinct = distinct.withColumn("length", F.char_length("formatted").cast("long"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 200_000 + 1)
    ordered = distinct.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    schema = ordered.schema.simpleString()[7:-1].replace(":", " ")
    laid = stored(ordered.mapInArrow(_scan, f"{schema}, before bigint, outside int, inside {_SPANS}, starts array<bigint>, stack {_SPANS}, first binary"))
    # one row per range, each with at most a path of open nodes
    carried = _carried(laid.where("stack is not null").select("part", "path", "first", "stack", "before", "length").collect())
    shared = spark.sparkContext.broadcast(carried)

    def place(batches):
        for b in batches:
            start, ancestors, turn_starts = [], [], []
            for part, before, outside, inside, starts in zip(*[b.column(c).to_pylist() for c in ("part", "before", "outside", "inside", "starts")], strict=True):
                offset, open_ = shared.value[part]
                up = open_[:outside]
                start.append(before + offset)
                ancestors.append([{"from": x, "to": y} for x, y in merged([*up, *[(i["from"] + offset, i["to"] + offset) for i in inside]])])
                turn_starts.append(None if starts is None else [x for x, _ in up] + [s + offset for s in starts])
            spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield b.select(kept).append_column("start", pa.array(start, pa.int64())).append_column("ancestors", pa.array(ancestors, spans)).append_column(
                "turn_starts", pa.array(turn_starts, pa.list_(pa.int64())))

    kept = ["node", "length", *same]
    named = laid.withColumn("node", F.unhex(F.md5("path"))).drop("path", "stack", "first", "leaf")
    fields = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in kept)
    nodes = named.mapInArrow(place, f"{fields}, start bigint, ancestors {_SPANS}, turn_starts array<bigint>")
    return nodes, leaves


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each conversation parsed from the stream at its turns' starts: conv_id, turns array<struct<role, text>>,
    loss_text (all text under the mask, unescaped) and formatted_chars. Equal conversations are read once."""
    ends = nodes.where("turn_starts is not null").select("node", F.explode(F.concat("turn_starts", F.array("start"))).alias("start"))
    pieces = ends.join(nodes.select("start", "formatted", "loss_start", "loss_end"), "start")
    whole = pieces.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start", "formatted", "loss_start", "loss_end"))).alias("pieces"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                turns, loss, chars = [], [], []
                for value in part.column(1).to_pylist():
                    stream = "".join(p["formatted"] for p in value)
                    turns.append([{"role": r, "text": t} for r, t in parse_turns(stream)])
                    loss.append("".join(unescape(p["formatted"][p["loss_start"]:p["loss_end"]]) for p in value))
                    chars.append(len(stream))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                                                  pa.array(loss, pa.string()), pa.array(chars, pa.int64())], ["node", "turns", "loss_text", "formatted_chars"])
    read = whole.mapInArrow(run, "node binary, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")
    return leaves.join(read, "node").drop("node")


def digests(read: DataFrame) -> DataFrame:
    """The columns of ``read_back`` as counts and digests."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def turns_digest(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
