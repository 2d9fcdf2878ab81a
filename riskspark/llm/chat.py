"""Chat formatting with a prefix tree over conversations.

Conversations that start with the same turns share those turns' tokens. The
distinct turn prefixes are the nodes of a forest; the forest is emitted depth
first as one token stream in which every node appears once, with

* position ids that count from the start of the conversation, and
* attention intervals: the stream ranges of the node's ancestors.

A conversation is a row of an index: the stream starts of its nodes. Depth-first
order is the order of the *paths* (chained 128-bit turn hashes, one after the
other), so it comes from a range-partitioned sort; a path owns the nodes behind
the part it shares with its predecessor.

Template: ``### role: text</turn>\\n`` per turn. Inside roles and texts a
backslash is doubled, a ``#`` after a ``#`` and the slash of ``</turn>`` get a
backslash (roles also colons and line ends), so control strings never occur
inside a text and unescaping restores it exactly.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import stage

LOSS_ROLE = "assistant"
_KEY = 16                 # bytes of a node key
_BATCH = 8 << 20
_UNESCAPE = re.compile(r"\\(.)", re.S)
_END = "</turn>\n"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\")
    text = re.sub(r"(?<=#)#", r"\\#", text).replace("</turn>", "<\\/turn>")
    return text.replace(":", "\\:").replace("\n", "\\n").replace("\r", "\\r") if role else text


def unescape(text: str, role: bool = False) -> str:
    special = {"n": "\n", "r": "\r"} if role else {}
    return _UNESCAPE.sub(lambda m: special.get(m.group(1), m.group(1)), text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the character interval of its text."""
    head, body = f"### {escape(role, True)}: ", escape(text)
    return head + body + _END, len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn; raises if the template does not hold."""
    m = re.match(r"### ((?:[^:\\]|\\.)*): ", formatted, re.S)
    if not m or not formatted.endswith(_END):
        raise ValueError("not a formatted turn")
    return unescape(m.group(1), True), unescape(formatted[m.end():-len(_END)])


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most about ``_BATCH`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def turn_chains(conversations: DataFrame) -> DataFrame:
    """(conv, depth, role, text, key, path): turns in order with chained keys, then one path row (depth -1).

    Turns are ordered by turn, role, text; each conversation is streamed, so a
    long one never sits in memory (its path, 16 bytes a turn, does).
    """
    schema = pa.schema([("conv", pa.int64()), ("depth", pa.int32()), ("role", pa.string()), ("text", pa.string()),
                        ("key", pa.binary()), ("path", pa.binary())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, path, key = None, None, b""
        for this, role, text in _rows(batches):
            if path is None or this != conv:
                if path:
                    yield conv, -1, None, None, None, bytes(path)
                conv, path, key = this, bytearray(), b""
            r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
            key = hashlib.sha256(key + struct.pack("<qq", len(r), len(t)) + r + t).digest()[:_KEY]
            path += key
            yield conv, len(path) // _KEY - 1, role, text, key, None
        if path:
            yield conv, -1, None, None, None, bytes(path)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    return ordered.mapInArrow(lambda it: _batches(chain(it), schema, lambda r: 100 + len(r[3] or r[5] or "")),
                              "conv long, depth int, role string, text string, key binary, path binary")


def _shared(a: bytes, b: bytes) -> int:
    """Number of leading nodes that two paths share."""
    n = min(len(a), len(b)) // _KEY
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid * _KEY] == b[:mid * _KEY] else (lo, mid - 1)
    return lo


def _path_order(paths: DataFrame) -> DataFrame:
    """Distinct paths in depth-first order: (owner, path, part, at, shared).

    ``shared`` is the number of nodes the path shares with its predecessor. The
    first path of each range part gets it from the last path of the parts before.
    """
    schema = pa.schema([("owner", pa.int64()), ("path", pa.binary()), ("at", pa.int64()), ("shared", pa.int32())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for at, (owner, path) in enumerate(_rows(batches)):
            yield owner, path, at, -1 if last is None else _shared(last, path)
            last = path

    distinct = paths.groupBy("path").agg(F.min("conv").alias("owner"))
    # repartitionByRange with a stated number keeps the parts apart; their content is fixed once written
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.select("owner", "path").repartitionByRange(n, "path").sortWithinPartitions("path")
    marked = stage(ordered.mapInArrow(lambda it: _batches(mark(it), schema, lambda r: 64 + len(r[1])),
                                      "owner long, path binary, at long, shared int")
                   .withColumn("part", F.spark_partition_id()), "chat_paths")
    ends = marked.groupBy("part").agg(F.max("path").alias("last"), F.min("path").alias("first")).orderBy("part").collect()
    fixes, last = [], b""
    for r in ends:
        fixes.append((r["part"], _shared(last, bytes(r["first"]))))
        last = bytes(r["last"])
    fixed = marked.sparkSession.createDataFrame(fixes, "part int, first_shared int")
    return marked.join(F.broadcast(fixed), "part").withColumn(
        "shared", F.when(F.col("shared") < 0, F.col("first_shared")).otherwise(F.col("shared"))).drop("first_shared")


def prefix_tree(conversations: DataFrame, tokenizer_path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, index) of ``conversations(conv_id, turn, role, text)``.

    nodes: one row per distinct turn prefix: key, start and end (token range in
    the stream), position (position id of its first token), ancestors
    (array of [start, end) stream ranges it attends to besides itself), tokens
    (little-endian uint32), loss_start and loss_end (character interval of the
    text under the loss mask, equal where there is none), n_chars.
    index: one row per conversation turn: conv, depth, key, start.

    NULL texts and roles are empty; NULL conversation ids form one conversation;
    repeated turn rows are turns of their own; an empty table gives empty results.
    Very long texts are tokenised whole; other columns are not read, so their names
    cannot clash.
    """
    chains = stage(turn_chains(conversations), "chat_turns")
    turns = chains.where("depth >= 0").drop("path")
    order = stage(_path_order(chains.where("depth = -1").select("conv", "path")), "chat_order")

    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("depth", pa.int32()), ("key", pa.binary()), ("tokens", pa.binary()),
                        ("n_tokens", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("n_chars", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoding = _encoding(tokenizer_path, pattern)
        for part, at, depth, key, role, text in _rows(batches):
            formatted, a, b = format_turn(role, text)
            ids = encoding.encode_ordinary(formatted)
            loss = role == LOSS_ROLE
            yield part, at, depth, key, struct.pack(f"<{len(ids)}I", *ids), len(ids), a if loss else 0, b if loss else 0, len(formatted)

    own = turns.join(order.select(F.col("owner").alias("conv_"), "part", "at", "shared"),
                     F.col("conv").eqNullSafe(F.col("conv_"))).where("depth >= shared")
    encoded = stage(own.select("part", "at", "depth", "key", "role", "text").mapInArrow(
        lambda it: _batches(encode(it), schema, lambda r: 100 + len(r[4])),
        "part int, at long, depth int, key binary, tokens binary, n_tokens long, loss_start long, loss_end long, n_chars long"), "chat_nodes")

    # Stream positions: running sums inside a segment, a range part, and over the parts.
    segment = Window.partitionBy("part", "at").orderBy("depth")
    sums = encoded.groupBy("part", "at").agg(F.sum("n_tokens").alias("n"))
    in_part = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("part_start"))
    segments = (sums.withColumn("in_part", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(F.broadcast(parts), "part")
                .select("part", "at", (F.col("part_start") + F.col("in_part")).alias("segment_start")))
    placed = stage(encoded.join(segments, ["part", "at"])
                   .withColumn("start", F.col("segment_start") + F.sum("n_tokens").over(segment) - F.col("n_tokens"))
                   .withColumn("end", F.col("start") + F.col("n_tokens")), "chat_placed")

    where = placed.select("key", "start", "end")
    index = stage(turns.select("conv", "depth", "key").join(where, "key"), "chat_index")
    # A segment's ancestors: the nodes its path shares with the one before, as merged ranges.
    branch = (order.where("shared > 0").select(F.col("owner").alias("conv_"), "part", "at", "shared")
              .join(index, (F.col("conv").eqNullSafe(F.col("conv_"))) & (F.col("depth") < F.col("shared"))))
    by_depth = Window.partitionBy("part", "at").orderBy("depth")
    runs = (branch.withColumn("new", (F.col("start") != F.coalesce(F.lag("end").over(by_depth), F.lit(-1))).cast("int"))
            .withColumn("run", F.sum("new").over(by_depth))
            .groupBy("part", "at", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    above = runs.groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("above"))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    length = F.aggregate(F.coalesce("above", none), F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    own_range = F.when(F.col("start") > F.col("segment_start"),
                       F.array(F.struct(F.col("segment_start").alias("start"), F.col("start").alias("end")))).otherwise(none)
    nodes = placed.join(above, ["part", "at"], "left").select(
        "key", "start", "end", (length + F.col("start") - F.col("segment_start")).alias("position"),
        F.concat(F.coalesce("above", none), own_range).alias("ancestors"), "tokens", "loss_start", "loss_end", "n_chars")
    return stage(nodes, "chat_tree"), index.select("conv", "depth", "key", "start")


def read_back(nodes: DataFrame, index: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the stream alone.

    Each conversation's nodes are fetched by their stream start, put in position
    order, decoded and parsed; positions must join up without a gap.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoding, conv, n = _encoding(tokenizer_path, pattern), None, 0
        for this, position, tokens, loss_start, loss_end in _rows(batches):
            if n == 0 or this != conv:
                if n:
                    yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars
                conv, n, at, chars, formatted_chars, turns, loss = this, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            if position != at:
                raise ValueError(f"conversation {this}: position {position} follows {at}")
            ids = struct.unpack(f"<{len(tokens) // 4}I", tokens)
            formatted = encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")
            role, text = parse_turn(formatted)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(formatted[loss_start:loss_end])
            loss.update(masked.encode("utf-8", "surrogatepass"))
            n, at, chars, formatted_chars = n + 1, at + len(ids), chars + len(masked), formatted_chars + len(formatted)
        if n:
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars

    rows = (index.select("conv", "start").join(nodes.select("start", "position", "tokens", "loss_start", "loss_end"), "start").drop("start")
            .repartition("conv").sortWithinPartitions("conv", "position").select("conv", "position", "tokens", "loss_start", "loss_end"))
    return rows.mapInArrow(lambda it: _batches(read(it), schema, lambda r: 400),
                           "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
