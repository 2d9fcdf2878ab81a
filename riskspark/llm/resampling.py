"""Importance resampling towards a target distribution, with hashed n-gram features.

Features are all runs of one and of two consecutive words. Their CRC-32 comes from
a position table: for a fixed length the checksum of a byte string is the XOR of
one contribution per byte, which depends on the byte and its distance from the end
only, and of a constant of the length. A batch of texts is one byte array; the
contributions are looked up for all its word bytes at once and folded over the
feature spans by ``bitwise_xor.reduceat``. Features longer than the table are
folded block by block: what is left of a span moves on by whole blocks.

Spark does the rest: bucket counts of documents and target are summed per task and
merged (``n_buckets`` rows a task), the gains of the buckets (``n_buckets`` numbers,
whatever the corpus) go to the tasks that score, and the draw ranks by a histogram
of the integer scores, so no task sorts the corpus.

Defined results
* NULL, empty and word-less texts have no feature, weight 0 and are never drawn.
* Very long texts are read whole, in blocks of about ``BLOCK`` bytes cut at word ends.
* Rows are scored one by one; rows sharing an id share their random part. Ties go to
  the smaller id (NULL last), then to the larger weight.
* A NULL id is scored as the empty string.
* An empty table gives an empty table; an empty target counts nothing for any bucket.
* Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm.common import stage

N_BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 25               # per cent of the documents with enough words
SEED = 7
DEPTH = 512              # distances from the end in the position table
BLOCK = 1 << 20          # bytes worked on at a time

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def position_table(depth: int = DEPTH) -> np.ndarray:
    """``[distance from the end, byte]``: what a byte adds to the checksum register."""
    one = np.array([zlib.crc32(bytes((b,))) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.empty((depth, 256), np.uint32)
    out[0] = one
    for d in range(1, depth):
        out[d] = (out[d - 1] >> np.uint32(8)) ^ one[out[d - 1] & np.uint32(255)]
    return out


class SpanCrc:
    """CRC-32 of words and word pairs, vectorised over many spans."""

    def __init__(self, depth: int = DEPTH):
        if depth < 4:
            raise ValueError("the position table needs at least four distances")
        self.depth, self.table = depth, position_table(depth)
        self.flat = self.table.reshape(-1)
        self.constants = np.array([zlib.crc32(bytes(n)) for n in range(2 * depth + 2)], np.uint32)

    def _moved(self, register: np.ndarray, by: int) -> np.ndarray:
        """The register after ``by`` zero bytes, 4 <= by <= depth: its own four bytes are contributions."""
        out = np.zeros_like(register)
        for k in range(4):
            out ^= self.table[by - 1 - k][(register >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def _blockwise(self, span: bytes) -> int:
        """Checksum of one span longer than the table, folded in blocks of its depth."""
        data = np.frombuffer(span, np.uint8)
        head = len(data) % self.depth
        register = np.zeros(1, np.uint32)
        if head:
            register ^= np.bitwise_xor.reduce(self.flat[np.arange(head - 1, -1, -1) * 256 + data[:head]])
        blocks = data[head:].reshape(-1, self.depth)
        rows = np.arange(self.depth - 1, -1, -1) * 256
        for at in range(0, len(blocks), 4096):
            folded = np.bitwise_xor.reduce(self.flat[rows + blocks[at:at + 4096]], axis=1)
            for part in folded:
                register = self._moved(register, self.depth) ^ part
        return int(register[0]) ^ zlib.crc32(bytes(len(span)))

    def features(self, letters: np.ndarray, lengths: np.ndarray, paired: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Checksums of all words and, where ``paired``, of word, space, next word.

        ``letters`` holds the lower-cased bytes of the words back to back, ``lengths``
        their lengths. Returns one checksum per word and one per word (meaningless
        where not ``paired``).
        """
        starts = np.cumsum(lengths) - lengths
        following = np.append(lengths[1:], 0) * paired
        own = np.repeat((starts + lengths - 1).astype(np.int32), lengths) - np.arange(len(letters), dtype=np.int32)
        inside = self.depth - 1
        words = np.bitwise_xor.reduceat(self.flat[np.minimum(own, inside) * 256 + letters], starts)
        own += np.repeat((following + 1).astype(np.int32), lengths)
        lead = np.bitwise_xor.reduceat(self.flat[np.minimum(own, inside) * 256 + letters], starts)
        space = self.flat[np.minimum(following, inside) * 256 + 32]
        pairs = lead ^ space ^ np.append(words[1:], np.uint32(0))
        joint = lengths + 1 + following
        last = len(self.constants) - 1
        pairs ^= self.constants[np.minimum(joint, last)]
        words = words ^ self.constants[np.minimum(lengths, last)]
        for i in np.flatnonzero(lengths > self.depth):
            words[i] = self._blockwise(letters[starts[i]:starts[i] + lengths[i]].tobytes())
        for i in np.flatnonzero(paired & (joint > self.depth)):
            middle = starts[i] + lengths[i]
            pairs[i] = self._blockwise(letters[starts[i]:middle].tobytes() + b" "
                                       + letters[middle:middle + following[i]].tobytes())
        return words, pairs


def _word_end(data: np.ndarray, at: int, stop: int) -> int:
    """First position from ``at`` on that is not inside a word running over ``at``."""
    if at >= stop or not (_IN_WORD[data[at]] and _IN_WORD[data[at - 1]]):
        return min(at, stop)
    step = 1024
    while at < stop:
        outside = np.flatnonzero(~_IN_WORD[data[at:min(at + step, stop)]])
        if len(outside):
            return at + int(outside[0])
        at, step = min(at + step, stop), step * 2
    return stop


def _block_features(crc: SpanCrc, data: np.ndarray, bounds: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(checksum and row of every feature, last word) of the texts ``data[bounds[i]:bounds[i + 1]]``.

    ``carry`` is the last word of the first text before this block: it pairs up with
    the first word here and is not counted again.
    """
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    rows = np.searchsorted(bounds[:-1], starts, "right") - 1
    letters = _LOWERED[data[inside]]
    final = letters[len(letters) - lengths[-1]:] if len(lengths) else carry
    known = int(len(carry) > 0)
    if known:
        letters, lengths, rows = np.concatenate((carry, letters)), np.append(len(carry), lengths), np.append(0, rows)
    if not len(lengths):
        return np.empty(0, np.uint32), np.empty(0, np.int64), final
    paired = np.append(rows[1:] == rows[:-1], False)
    words, pairs = crc.features(letters, lengths, paired)
    return np.concatenate((words[known:], pairs[paired])), np.concatenate((rows[known:], rows[paired])), final


def text_features(crc: SpanCrc, texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(checksums, rows) of all features of a column of UTF-8 byte strings without NULLs, in blocks.

    Short texts are taken together; a longer one is cut at word ends.
    """
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    nothing, row = np.empty(0, np.uint8), 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1)
        at, stop = int(offsets[row]), int(offsets[end])
        if end > row + 1 or stop - at <= block:
            found, rows, _ = _block_features(crc, data[at:stop], offsets[row:end + 1] - at, nothing)
            yield found, rows + row
        else:
            carry = nothing
            while at < stop:
                cut = _word_end(data, min(at + block, stop), stop)
                found, rows, carry = _block_features(crc, data[at:cut], np.array([0, cut - at]), carry)
                yield found, rows + row
                at = cut
        row = end


def _utf8() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")


def bucket_counts(rows: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts: one partial count per task, then a sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, counts = SpanCrc(), np.zeros(n_buckets, np.int64)
        for b in batches:
            for found, _ in text_features(crc, b.column(0)):
                counts += np.bincount(found % np.uint32(n_buckets), minlength=n_buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], ["bucket", "n"])

    return rows.select(_utf8()).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed target to corpus ratio of each bucket.

    ``n_buckets`` numbers come to the driver, whatever the size of the tables.
    """
    s, t = bucket_counts(docs, n_buckets), bucket_counts(target, n_buckets)
    counts = (s.withColumnRenamed("n", "s").join(t.withColumnRenamed("n", "t"), "bucket", "full").na.fill(0)).collect()
    corpus, wanted = np.zeros(n_buckets), np.zeros(n_buckets)
    for r in counts:
        corpus[r.bucket], wanted[r.bucket] = r.s, r.t
    ratio = ((wanted + 1.0) * (corpus.sum() + n_buckets)) / ((corpus + 1.0) * (wanted.sum() + n_buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, version, n_features, weight) per row; ``version`` is a hash of the text."""
    n_buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = SpanCrc()
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for found, rows in text_features(crc, b.column(2)):
                low, high = (int(rows.min()), int(rows.max()) + 1) if len(rows) else (0, 0)
                gain = gains[found % np.uint32(n_buckets)]
                n[low:high] += np.bincount(rows - low, minlength=high - low)
                total[low:high] += np.bincount(rows - low, gain, high - low).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(weight)],
                                             ["doc_id", "version", "n_features", "weight"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version"), _utf8())
    return rows.mapInArrow(run, f"doc_id {id_type}, version long, n_features long, weight long")


def with_scores(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight plus a Gumbel draw of the id, in thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return weights.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long"))


def draw(scored: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``rank``: 1, 2, 3 ... for the drawn rows by falling score, else NULL.

    ``scored`` is read three times and should be a written table. Scores are whole
    numbers between about -50 000 and 70 000 (gains are logarithms of ratios of
    64-bit counts, draws of 32-bit hashes), so their histogram is bounded: its running
    total says where each score's ranks start, and only rows of one score are sorted.
    """
    enough = F.col("n_features") >= 2 * min_words - 1   # w words have w + (w - 1) features
    counts = scored.where(enough).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    places = (counts.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
              .withColumn("wanted", F.expr(f"sum(n) over () * {int(share)} div 100"))
              .where("before < wanted").select(F.col("score").alias("_score"), "before", "wanted"))
    placed = scored.join(F.broadcast(places), (F.col("score") == F.col("_score")) & enough, "left").drop("_score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), F.col("weight").desc())
    drawn = placed.where("before is not null").withColumn("rank", F.col("before") + F.row_number().over(order))
    rank = F.when(F.col("rank") <= F.col("wanted"), F.col("rank")).cast("long").alias("rank")
    return (drawn.select(*scored.columns, rank)
            .unionByName(placed.where("before is null").select(*scored.columns, F.lit(None).cast("long").alias("rank"))))


def importance_resample(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS, share: int = SHARE,
                        min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, version, n_features, weight, score, rank) per row of ``docs``; ``target`` has a column ``text``."""
    return draw(stage(with_scores(weigh(docs, bucket_gains(docs, target, n_buckets)), seed), "resampling-scores"), share, min_words)


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; equal rows come with the first of them."""
    held = ranked.where("rank is not null").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    version = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(held, docs["doc_id"].eqNullSafe(held["_id"]) & (version == held["_version"]), "left_semi")
