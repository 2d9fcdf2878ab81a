"""Substring dedup by line hashing.

Units are lines and, inside lines of several sentences, their sentences. Every
unit of at least ``min_words`` words is normalised (lower case, single spaces)
and hashed to 128 bits; digests are grouped over the whole corpus. Scripts
written without spaces count each of their characters as a word. With
``min_words=1`` every line that is not blank is a unit; the default leaves lines of
up to three words, which ordinary texts share by chance, alone. The earliest
occurrence (smallest doc_id, then smallest offset) stays. Of the others,

* every line goes, and
* sentences go when consecutive ones make up at least ``run_words`` words: a
  passage pasted into other lines is caught, a short sentence that two texts
  happen to share is not.

Removed stretches are returned with their offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import stage

MIN_WORDS = 4
RUN_WORDS = 25
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"(?<=[.!?])(?=\s)|(?<=[\u3002\uff01\uff1f])")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
_LAST = (1 << 63) - 1       # rank of NULL ids
_BATCH_ROWS = 50_000


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, bool, bytes | None]]:
    """(start, end, words, is_line, digest) in text order; units too short to group have no digest."""
    from xxhash import xxh3_128_digest

    def unit(start: int, part: str, line: bool) -> tuple:
        words = part.lower().split()
        n = len(words) if part.isascii() else len(words) + sum(max(0, len(_UNSPACED.findall(w)) - 1) for w in words)
        digest = xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if n >= max(1, min_words) else None
        return start, start + len(part), n, line, digest

    for m in _LINE.finditer(text):
        line = m.group()
        yield unit(m.start(), line, True)
        parts = _SENTENCE.split(line)
        if len(parts) > 1:
            at = m.start()
            for part in parts:
                yield unit(at, part, False)
                at += len(part)


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, d1, d2) of every groupable unit of ``docs(doc_id, text_hash, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, digests = [], [], []
        for b in batches:
            for doc_id, text_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for *_, digest in units(text.as_py() or "", min_words):
                    if digest:
                        ids.append(doc_id)
                        hashes.append(text_hash)
                        digests.append(digest)
                if len(ids) > _BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(digests, pa.binary())], schema=schema)
                    ids, hashes, digests = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(digests, pa.binary())], schema=schema)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, digest binary")


def cut(text: str, own: set[bytes], foreign: set[bytes], min_words: int = MIN_WORDS,
        run_words: int = RUN_WORDS) -> tuple[str, list[tuple[int, int]]]:
    """(text without repeated units, removed stretches).

    ``foreign``: digests whose earliest occurrence is in another document.
    ``own``: repeated digests that this document has first; here only the first
    of them stays.
    """
    seen: set[bytes] = set()
    gone: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    run_size, gap = 0, 0

    def close() -> None:
        nonlocal run, run_size, gap
        if run_size >= run_words:
            gone.append((run[0][0], run[-1][1]))
        run, run_size, gap = [], 0, 0

    parsed = list(units(text, min_words))
    for k, (start, end, words, is_line, digest) in enumerate(parsed):
        repeated = digest is not None and (digest in foreign or digest in seen)
        if digest is not None and digest in own:
            seen.add(digest)
        if is_line and repeated:
            gone.append((start, end))
        if is_line and k + 1 < len(parsed) and not parsed[k + 1][3]:
            continue                        # its sentences follow
        if repeated:
            run.append((start, end))
            run_size += words + gap
            gap = 0
        elif digest is None:
            gap += words if run else 0      # too short to tell: a run may go on behind it
        else:
            close()
    close()
    merged: list[tuple[int, int]] = []
    for a, b in sorted(gone):
        if merged and not text[merged[-1][1]:a].strip():
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        elif not merged or a >= merged[-1][1]:
            merged.append((a, b))
        else:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
    merged = [(a, b + 1 if text[b:b + 1] == "\n" and (a == 0 or text[a - 1] == "\n") else b) for a, b in merged]
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept), merged


def _cut(text: pd.Series, own: pd.Series, foreign: pd.Series, min_words: int, run_words: int) -> pd.DataFrame:
    out, spans = [], []
    for t, o, f in zip(text, own, foreign):
        if t is None or (o is None and f is None):
            out.append(t)
            spans.append([])
        else:
            new, gone = cut(t, set(o) if o is not None else set(), set(f) if f is not None else set(), min_words, run_words)
            out.append(new)
            spans.append([{"start": a, "end": b} for a, b in gone])
    return pd.DataFrame({"text": out, "removed": spans})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, text, removed), one row per input row.

    ``removed`` lists the [start, end) character ranges of the original text that
    went. NULL texts stay NULL, empty texts empty; rows that share an id count as
    one document for the ranking; NULL ids rank last; an empty table stays empty.
    A digest shared by a third of all rows is counted with map-side combining and
    looked up through a join that Spark may split. Only digests that occur more
    than once are joined, and only documents that hold one are rewritten. Very long
    texts are read whole, unit by unit; other columns are not read, so their names
    cannot clash.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))
    found = stage(unit_table(rows, min_words), "line_units")
    rank = F.coalesce("doc_id", F.lit(_LAST))
    repeated = stage(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
                     "line_repeats")
    hits = (found.join(repeated, "digest").withColumn("is_own", rank == F.col("first"))
            .groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(F.col("is_own"), F.col("digest"))).alias("own"),
                                                F.collect_set(F.when(~F.col("is_own"), F.col("digest"))).alias("foreign")))
    hits = hits.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "own", "foreign")
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    @F.pandas_udf("text string, removed array<struct<start: long, end: long>>")
    def rewrite(text: pd.Series, own: pd.Series, foreign: pd.Series) -> pd.DataFrame:
        return _cut(text, own, foreign, min_words, run_words)

    return joined.withColumn("c", rewrite("text", "own", "foreign")).select("doc_id", "c.text", "c.removed")
