"""Best-fit decreasing packing of token sequences.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Best-fit decreasing only looks at lengths, and pieces of equal length are
interchangeable, so the exact sequential algorithm runs on the *histogram* of
lengths: at most ``capacity`` rows, whatever the corpus. A segment tree over
the remaining capacities gives the tightest open bin in logarithmic time; one
step places a whole run of equal pieces into a whole run of equal bins. The
plan says where the k-th piece of each length goes; the tasks that tokenise number
their pieces of each length, so a table of counts per task and length turns that
into the k-th of all. The ids travel with their pieces, once, to their sequence,
and the sequences are written; what ``pack_documents`` returns is read back from them.

Ids are kept as little-endian unsigned integers of two bytes where the vocabulary
allows it, else of four (``id_width``).

Defined results
* NULL and empty texts are one piece with the end id alone.
* Repeated rows and NULL ids are packed row by row.
* Very long texts are tokenised whole and cut into pieces; the slices of a batch that
  are worked on together hold one text at least.
* Pieces of equal length (ties) take the places of that length in the order of the tasks.
* An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import stage
from riskspark.plans.joins import may_broadcast

CAPACITY = 2048
EOS_ID = 0
CACHE_WORDS = 250_000   # units whose ids a worker remembers, twice
RANK_BUCKETS = 64       # parts in which the pieces of one length are numbered, where their tasks did not
_SLICE = 8 << 20        # bytes of text worked on together
_ROWS_OUT = 5_000
#: Letters that the tokenizer's normaliser puts in lower case and its splitter leaves as one word,
#: and the same with a final mark that is a token of its own.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[{_LETTERS}]+").fullmatch
_PLAIN_MARKED = f"^[{_LETTERS}]+[.,]?$"


def _byte_symbols() -> dict[int, str]:
    """Byte -> symbol of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + n) for n, b in enumerate(rest)}


_BYTE_SYMBOLS = _byte_symbols()


class WordTokens:
    """Token ids of texts, word by word.

    The word-level BPE files drop white space before splitting, so the ids of a
    text are those of its words in order (tests compare with whole-text
    encoding). The distinct words of a slice are reduced to units: a word of plain
    letters is its lower case, with a final full stop or comma apart; any other
    word is a unit as it is. Only distinct units are looked up. New units of plain
    letters go straight to the tokenizer's model, the others through the whole
    tokenizer. Units are remembered in two generations of ``limit`` entries: when
    the young one is full it becomes the old one, and units still in use move
    back, so memory is bounded and frequent units stay.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.id_width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = [self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"]
        if any(len(m) != 1 for m in self.marks):
            raise ValueError("full stop and comma must be one token each")

    def _learn(self, units: list[str]) -> None:
        """Ids of units that are not in the young generation."""
        known = [*map(self.old.get, units)]
        self.young.update((u, ids) for u, ids in zip(units, known) if ids is not None)
        young, tokenize, odd = self.young, self.model.tokenize, []
        for u in [u for u, ids in zip(units, known) if ids is None]:
            if not _PLAIN(u):
                odd.append(u)
                continue
            symbols = u if u.isascii() else u.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
            young[u] = array("I", [t.id for t in tokenize(symbols)]).tobytes()
        if odd:
            found = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            young.update((u, array("I", e.ids).tobytes()) for u, e in zip(odd, found))

    def _units(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The unit of each distinct word, and its final mark (0: none, 1: full stop, 2: comma)."""
        plain = pc.match_substring_regex(words, _PLAIN_MARKED)
        lowered = pc.utf8_lower(words)
        stop, comma = (pc.and_(plain, pc.ends_with(words, m)) for m in ".,")
        units = pc.if_else(plain, pc.ascii_rtrim(lowered, ".,"), words).dictionary_encode()
        mark = stop.cast(pa.int8()).to_numpy(zero_copy_only=False) + 2 * comma.cast(pa.int8()).to_numpy(zero_copy_only=False)
        return units, mark

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array (NULL: none)."""
        texts = pc.fill_null(texts, "")
        for space in "\n\t\r":
            texts = pc.replace_substring(texts, space, " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        units, mark = self._units(words.dictionary)
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        distinct = units.dictionary.to_pylist()
        found = [*map(self.young.get, distinct)]
        if None in found:
            self._learn([u for u, ids in zip(distinct, found) if ids is None])
            found = [*map(self.young.__getitem__, distinct)]
        each = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(each) - each
        del found, distinct
        unit = units.indices.to_numpy(zero_copy_only=False)
        pool, first, each = _gather(pool, first, each, unit, (mark > 0).astype(np.int64))
        marked = np.flatnonzero(mark)
        pool[first[marked] + each[marked] - 1] = np.array([0, *(m[0] for m in self.marks)], "<u4")[mark[marked]]
        word = words.indices.to_numpy(zero_copy_only=False)
        ids, first, each = _gather(pool, first, each, word)
        cuts = np.append(first, len(ids))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _gather(pool: np.ndarray, first: np.ndarray, each: np.ndarray, pick: np.ndarray,
            room: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs ``pool[first[p]:first[p] + each[p]]`` of all picks back to back, with ``room`` more
    (unset) entries behind each; their new starts and lengths."""
    n = each[pick] + room
    ends = np.cumsum(n)
    starts = ends - n
    at = np.repeat(first[pick] - starts, n) + np.arange(ends[-1] if len(ends) else 0)
    if not np.isscalar(room):
        np.minimum(at, max(len(pool) - 1, 0), out=at)
    return (pool[at] if len(pool) else np.zeros(len(at), pool.dtype)), starts, n


def _slices(batch: pa.RecordBatch, size: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes."""
    step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


@functools.lru_cache(maxsize=2)
def _word_tokens(path: str) -> WordTokens:
    """One memory of words for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos_id: int = EOS_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, part, nth, ids), one row per piece.

    A document is the ids of its text followed by ``eos_id`` (NULL and empty
    texts: only ``eos_id``). Only documents longer than ``capacity`` are cut.
    ``part`` is the task's number and ``nth`` counts its pieces of one length from
    0; both hold for the table once it is written.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out, held, seen = _word_tokens(tokenizer_path), [[] for _ in schema], 0, Counter()
        kind, part = f"<u{words.id_width}", TaskContext.get().partitionId()
        for b in (few for batch in batches for few in _slices(batch)):
            for doc_id, ids in zip(b.column(0).to_pylist(), words.encode(b.column(1))):
                ids = np.append(ids, eos_id).astype(kind)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at:at + capacity]
                    for c, v in zip(out, (doc_id, k, at, len(piece), part, seen[len(piece)], piece.tobytes())):
                        c.append(v)
                    seen[len(piece)] += 1
                    held += 64 + piece.nbytes
                if len(out[0]) >= _ROWS_OUT or held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out, held = [[] for _ in schema], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, part int, nth long, ids binary"))


class _TightestBin:
    """Segment tree over remaining capacities 0..capacity: tightest non-empty one >= a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)

    def set(self, at: int, full: bool) -> None:
        at += self.size
        self.tree[at] = full
        while at > 1:
            at >>= 1
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def first_from(self, at: int) -> int | None:
        """Smallest marked capacity >= ``at``."""
        node = at + self.size
        if self.tree[node]:
            return at
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length -> count).

    Returns placements (length, first, count, bin, per_bin, offset): pieces
    first..first+count-1 of that length go to bins bin, bin+1, ..., ``per_bin``
    of them to a bin, the first at ``offset``. Same bins as the one-by-one
    algorithm with ties broken by the lowest bin number of a run.
    """
    runs: dict[int, deque] = defaultdict(deque)   # remaining capacity -> runs of bins (first bin, number)
    tree, plan, bins = _TightestBin(capacity), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not runs[room]:
                tree.set(room, True)
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"piece of {length} tokens does not fit {capacity}")
        left, done = histogram[length], 0
        while left:
            room = tree.first_from(length)
            if room is None:                       # open new bins for all the rest
                room, first, n, fresh = capacity, bins, -(-left // (capacity // length)), True
            else:
                (first, n), fresh = runs[room].popleft(), False
                if not runs[room]:
                    tree.set(room, False)
            each = room // length                  # a bin just used stays the tightest while it has room
            whole = min(n, left // each)
            if whole:
                plan.append((length, done, whole * each, first, each, capacity - room))
                put(room - each * length, first, whole)
                done, left = done + whole * each, left - whole * each
            used = whole
            if left and used < n:                  # the last bin takes what is left
                plan.append((length, done, left, first + used, left, capacity - room))
                put(room - left * length, first + used, 1)
                done, left, used = done + left, 0, used + 1
            if fresh:
                bins += used
            elif used < n:
                rest = (first + used, n - used)
                if not runs[room]:
                    tree.set(room, True)
                runs[room].appendleft(rest)
    return plan


def number_pieces(pieces: DataFrame, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds part and nth to pieces that their tasks did not number: ``RANK_BUCKETS`` hash parts, so a
    length held by a third of all rows is spread out."""
    cells = pieces.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)).cast("int"))
    inside = Window.partitionBy("length", "part").orderBy(*order)
    return cells.withColumn("nth", (F.row_number().over(inside) - 1).cast("long"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a written table with ``length``, ``part``, ``nth``).

    The histogram (at most ``capacity`` rows) is the only thing that reaches the
    driver; the plan that goes back is bounded by the lengths and capacities,
    not by the corpus. The counts per part and length are broadcast while they
    are under the broadcast limits, else joined by a shuffle.
    """
    if "nth" not in pieces.columns:
        return pack(number_pieces(pieces), capacity).drop("part", "nth")
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("_n")), "length_counts")
    rows = counts.groupBy("length").agg(F.sum("_n").alias("n"), F.count("*").alias("cells")).collect()
    histogram = {int(r["length"]): int(r["n"]) for r in rows}
    plan = np.array(best_fit_decreasing(histogram, capacity), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    if may_broadcast(base, sum(int(r["cells"]) for r in rows)):
        base = F.broadcast(base)
    by_length = {length: plan[plan[:, 0] == length] for length in set(plan[:, 0].tolist())}
    sent = pieces.sparkSession.sparkContext.broadcast(by_length)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, k: pd.Series) -> pd.DataFrame:
        n, kk = length.to_numpy(np.int64), k.to_numpy(np.int64)
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        cuts = np.flatnonzero(np.diff(n[order])) + 1
        for at in np.split(order, cuts) if len(order) else ():
            x = n[at[0]]
            rows, own = sent.value[int(x)], kk[at]
            p = rows[np.searchsorted(rows[:, 1], own, "right") - 1]
            j = own - p[:, 1]
            seq[at], off[at] = p[:, 3] + j // p[:, 4], p[:, 5] + (j % p[:, 4]) * x
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = pieces.join(base, ["length", "part"]).withColumn("_p", place("length", F.col("_base") + F.col("nth")))
    return ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], "_p.sequence_id", "_p.offset")


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces): one row per sequence, its ids back to back and its pieces
    (doc_id, piece, start, length) in order."""
    piece = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(pa.struct(piece)))])

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        """Sequences of a sorted batch that holds whole sequences: runs of its buffers."""
        seq = b.column(0).to_numpy()
        cuts = np.append(np.append(0, np.flatnonzero(np.diff(seq)) + 1), len(seq))
        ids = b.column(5)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
        joined = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts].tobytes()), ids.buffers()[2]])
        parts = pa.StructArray.from_arrays(b.columns[1:5], names=[n for n, _ in piece])
        return pa.RecordBatch.from_arrays([pa.array(seq[cuts[:-1]]), joined, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts)],
                                          schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None                       # the last sequence of a batch may go on in the next one
        for b in batches:
            if not b.num_rows:
                continue
            b = b if kept is None else pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
            seq = b.column(0).to_numpy()
            last = int(np.searchsorted(seq, seq[-1]))
            if last:
                yield rows(b.slice(0, last))
            kept = b.slice(last)
        if kept is not None:
            yield rows(kept)

    return (packed.select("sequence_id", "doc_id", "piece", "start", "length", "ids", "offset")
            .repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
            .select("sequence_id", "doc_id", "piece", "start", "length", "ids")
            .mapInArrow(run, "sequence_id long, ids binary, pieces array<struct<doc_id: long, piece: int, start: long, length: long>>"))


def read_sequences(sequences: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece in written sequences.

    The checksum is that of the piece's ids in the sequence, as little-endian
    unsigned 32-bit integers.
    """
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                parts = b.column(2).flatten()
                length = parts.field(3).to_numpy()
                counts = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
                ends = np.cumsum(length)
                firsts = np.cumsum(counts) - counts
                tokens = np.add.reduceat(length, firsts)
                width = {len(i) // int(t) for i, t in zip(b.column(1).to_pylist(), tokens)}
                ids = np.frombuffer(b"".join(b.column(1).to_pylist()), f"<u{width.pop()}").astype("<u4").tobytes()
                offset = ends - length - np.repeat((ends - length)[firsts], counts)
                crc = [zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(parts.field(k) for k in range(4)), pa.array(crc, pa.int64()),
                     pa.array(np.repeat(b.column(0).to_numpy(), counts)), pa.array(offset)], schema=out)

    return sequences.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The packed training sequences, written: (sequence_id, ids, pieces), see ``assemble``."""
    pieces = stage(token_pieces(docs, tokenizer_path, capacity, EOS_ID, id_col, text_col), "pieces", "zstd")
    return stage(assemble(pack(pieces, capacity)), "sequences", "zstd")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece, read back
    from the written sequences."""
    return read_sequences(packed_sequences(docs, tokenizer_path, capacity, id_col, text_col))
