"""SimHash near-duplicates through pivot distance tables.

A fingerprint's *pivot coordinates* are its Hamming distances to
``N_PIVOTS`` reference fingerprints, taken on each of five bit blocks
(40 coordinates, precomputed once per distinct fingerprint). The distance to
a pivot is 1-Lipschitz, so for two fingerprints at most ``k`` bits apart

* the coordinates of one pivot differ by at most ``k`` summed over the blocks
  (a pair whose largest coordinate difference exceeds ``k`` is discarded), and
* with k <= 3 at least two of the five blocks hold no differing bit, so there
  all coordinates are equal: that equality is the join key.

Pairs that survive the pivot table are verified by XOR and popcount. Nothing
is approximate: no link between groups is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import free_name, stage
from riskspark.llm.components import connected_components
from riskspark.plans.joins import may_broadcast

SHINGLE_WORDS = 3
MAX_BITS = 3
N_PIVOTS = 8
KEY = ("pair", "k1", "k2")
BUCKET = 128            # fingerprints sharing a key up to which all pairs are joined
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit, width)
_CHUNK = 1 << 16  # shingles hashed at a time: bounds memory on very long texts


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text (unsigned).

    A-Z are lower-cased, words are runs outside ASCII white space, shingles
    are hashed by XXH64 with seed 42, repeats included. A bit is set when more
    than half of the hashes have it. NULL, empty and blank texts give 0.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle_words:
        starts, ends = [0], [len(joined)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle_words + 1].tolist()
        ends = ends[shingle_words - 1:].tolist()
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = np.fromiter((digest(joined[s:e], 42) for s, e in
                            zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])), np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit long, one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def _pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: the XXH64 of 0, 1, 2, ... (evenly spread bits)."""
    import xxhash

    return [int(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), 42)).view(np.int64)) for i in range(n)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds c0..c4: per block, the distances to all pivots, four bits each."""
    def block(first: int, width: int) -> Column:
        mask = int(np.uint64(((1 << width) - 1) << first).view(np.int64))
        packed = F.lit(0)
        for r, p in enumerate(_pivots()):
            d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(mask)))
            packed = packed.bitwiseOR(F.shiftleft(d, 4 * r))
        return packed

    return fps.select("*", *[block(*b).alias(f"c{i}") for i, b in enumerate(BLOCKS)])


def _max_pivot_difference() -> Column:
    """Largest over the pivots of the coordinate differences summed over the blocks."""
    def nibble(c: str, r: int) -> Column:
        return F.shiftrightunsigned(F.col(c), 4 * r).bitwiseAND(F.lit(15))

    per_pivot = []
    for r in range(N_PIVOTS):
        total = F.lit(0)
        for i in range(len(BLOCKS)):
            total = total + F.abs(nibble(f"a.c{i}", r) - nibble(f"b.c{i}", r))
        per_pivot.append(total)
    return F.greatest(*per_pivot)


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp_a, fp_b): pairs of distinct fingerprints at most ``max_bits`` apart, enough to connect all of them.

    Keys that at most ``BUCKET`` fingerprints share give every pair. A key that
    more share (a large group of near copies) is compared in blocks of that size,
    and each block gives a spanning forest of its pairs: the same groups, but
    never all pairs of a group.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the five-block pivot key finds pairs up to 3 bits apart")
    table = pivot_table(distinct_fps.select("fp"))
    keys = F.array(*[F.struct(F.lit(n).cast("byte").alias("pair"), F.col(f"c{i}").alias("k1"), F.col(f"c{j}").alias("k2"))
                     for n, (i, j) in enumerate(itertools.combinations(range(len(BLOCKS)), 2))])
    keyed = table.select("*", F.explode(keys).alias("k")).select("fp", "k.*", *[f"c{i}" for i in range(len(BLOCKS))])
    hot = stage(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET), "simhash_hot")
    n_hot = hot.count()
    if not n_hot:
        return _pairs(keyed, max_bits).distinct()
    shared = F.broadcast(hot) if may_broadcast(hot, n_hot) else hot
    blocks = _blocks(keyed.join(shared, list(KEY)), max_bits)
    return _pairs(keyed.join(shared.select(*KEY), list(KEY), "left_anti"), max_bits).unionByName(blocks).distinct()


def _pairs(keyed: DataFrame, max_bits: int) -> DataFrame:
    """All linked pairs that share a key."""
    a, b = keyed.alias("a"), keyed.alias("b")
    same_key = (F.col("a.pair") == F.col("b.pair")) & (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2"))
    near = ((F.col("a.fp") < F.col("b.fp")) & (_max_pivot_difference() <= max_bits)
            & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits))
    return a.join(b, same_key & near).select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"))


def _forest(a: np.ndarray, b: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs between two sets of fingerprints."""
    pivots = np.array(_pivots(), np.int64).view(np.uint64)
    da, db = (np.bitwise_count(x[:, None] ^ pivots).astype(np.int16) for x in (a, b))
    i, j = np.nonzero(np.abs(da[:, None] - db[None]).max(2) <= max_bits)      # survivors of the pivot table
    near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for x, y in zip(a[i[near]].tolist(), b[j[near]].tolist()):
        if x != y and (p := find(x)) != (q := find(y)):
            parent[p] = q
            out.append((x, y))
    return out


def _blocks(shared: DataFrame, max_bits: int) -> DataFrame:
    """Spanning forests of keys shared by many, one group per pair of chunks of about ``BUCKET`` fingerprints."""
    chunks = F.ceil(F.col("n") / BUCKET).cast("int")
    cut = (shared.select("fp", *KEY, chunks.alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
           .select(*KEY, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            fps, chunk = (np.array(x) for x in zip(*rows))
            fps = fps.astype(np.int64).view(np.uint64)
            out.extend(_forest(fps[chunk == key[3]], fps[chunk == key[4]], max_bits))

        def batch() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            pairs.sort(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["fp_a", "fp_b"])

        for b in batches:
            for *this, chunk, fp in zip(*(c.to_pylist() for c in b.columns)):
                if this != key:
                    if rows:
                        close()
                    key, rows = this, []
                rows.append((fp, chunk))
            if len(out) > 50_000:
                yield batch()
                out = []
        if rows:
            close()
        if out:
            yield batch()

    grouped = cut.repartition(*KEY, "i", "j").sortWithinPartitions(*KEY, "i", "j", "fp")
    return grouped.mapInArrow(run, "fp_a long, fp_b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``component_id`` is the smallest doc_id reachable over links (itself
    included). Equal fingerprints are one vertex of the graph, so copies are
    never expanded into pairs. Texts without words have fingerprint zero and
    link like any other. NULL ids: the row is kept; its component is the
    smallest non-NULL id reachable, or NULL when there is none. Very long texts
    are hashed in chunks, whole; an empty table gives an empty table; other columns
    are not read, so their names cannot clash.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    vertices = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "vertices")
    comps = connected_components(links(vertices, max_bits).select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v")))
    named = vertices.join(comps, vertices.fp == comps.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    vertex_out = stage(named.join(lowest, "component").select("fp", "component_id"), "vertex_component")
    return (fps.join(vertex_out, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without all but one row of each near-duplicate component.

    The row with the smallest id stays, all columns unchanged. Where an id
    repeats (or is NULL) rows are told apart by their fingerprint, and of rows
    that share id and component the one with the smallest content hash stays.
    Very long texts are fingerprinted whole, an empty table stays empty, and the
    columns of ``docs`` may have any names.
    """
    key = free_name(docs, "_id")
    comp = stage(simhash_components(docs, id_col, text_col, shingle_words, max_bits), "simhash_components")
    again = stage(comp.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
                  .select(F.col("doc_id").alias(key)), "simhash_repeated")
    drop = stage(comp.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "simhash_drop")
    if may_broadcast(drop, drop.count()):    # else a join that Spark may split
        drop = F.broadcast(drop)
    doc_id = F.col(f"`{id_col}`").cast("long")
    if again.isEmpty():
        return docs.join(drop, doc_id == F.col(key), "left_anti")
    out = docs.join(drop.unionByName(again).distinct(), doc_id.eqNullSafe(F.col(key)), "left_anti")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.join(again, doc_id.eqNullSafe(F.col(key)), "left_semi").select(
        F.struct(*cols).alias("row"), doc_id.alias("doc_id"),
        F.xxhash64(*[c.cast("string") for c in cols]).alias("h"),
        _fingerprint_hex(shingle_words)(F.col(f"`{text_col}`")).alias("fingerprint"))
    named = rows.join(comp.distinct().alias("c"), rows.doc_id.eqNullSafe(F.col("c.doc_id"))
                      & (rows.fingerprint == F.col("c.fingerprint")))
    one = (named.where("h is not null and c.doc_id <=> c.component_id").groupBy("component_id", F.when(
        F.col("component_id").isNull(), F.col("c.fingerprint")).alias("f"))
        .agg(F.min_by("row", "h").alias("row")))
    return out.unionByName(one.select("row.*"))


def _fingerprint_hex(shingle_words: int):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{fingerprint(t, shingle_words):016x}")

    return run
