"""Line dedup by counting the documents of each normalised line.

Every text is split at line feeds; each line gets a key (ends stripped of ASCII
white space, A-Z lower-cased) and the key a 128-bit hash. Hashes are grouped over
the corpus with a map-side combine, so a line that a third of all documents hold
is one partial row a task. Lines whose key is in ``min_docs`` documents or more
go, except in the smallest document that holds it, and what is left of a text is
put together again by position. DataFrame functions only.

Only hashes, ids and positions travel for the line tables. Keys with more than a
thousandth of all repeated lines (at most a thousand keys) are joined by
broadcast, so no task receives such a key's lines; the others are joined by a
shuffle. Texts are split once and shuffled once, by document.

Defined results
* NULL and empty texts are one empty line; nothing of them is dropped.
* Rows sharing an id are one document: a line repeated only there stays, and where
  that id is the smallest holder, it stays in all of them. Each row is cut by its
  own positions, equal rows alike.
* Rows with a NULL id are together one document, after all others.
* Very long texts are cut in time proportional to their lines: the kept runs
  between dropped positions are sliced and joined.
* An empty table gives an empty table. Other columns of the input are ignored, so
  their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import stage

MIN_DOCS = 2
MIN_CHARS = 10
HOT_SHARE = 1000     # keys with more than 1/1000 of the repeated lines are joined by broadcast
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The normal form of a line: ends stripped of ASCII white space, A-Z lower-cased.

    ``lower`` does that to ASCII lines; others keep their non-ASCII letters as they are.
    """
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, pos, h1, h2): one row per line with a key of ``min_chars`` code points or more.

    ``version`` is a hash of the text; it tells rows apart that share an id.
    """
    line = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    return (_rows(docs, id_col, text_col).select("doc_id", "version", line)
            .select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
            .where(F.length("key") >= min_chars)
            .select("doc_id", "version", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")))


def repeated_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, first, n_lines): keys in at least ``min_docs`` documents and the smallest id holding them.

    For two documents the smallest and the largest id already tell; higher
    thresholds count distinct ids.
    """
    missing = F.max(F.col("doc_id").isNull().cast("int"))
    if min_docs <= 1:
        enough = F.lit(True)
    elif min_docs == 2:
        enough = (F.min("doc_id") < F.max("doc_id")) | (F.min("doc_id").isNotNull() & (missing == 1))
    else:
        enough = F.count_distinct("doc_id") + missing >= min_docs
    return (lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_lines"), enough.alias("enough"))
            .where("enough").drop("enough"))


def dropped_positions(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, version, dropped): per document the ascending positions of its lines that go.

    ``repeated`` is read three times and should be a written table.
    """
    total = repeated.agg(F.sum("n_lines")).first()[0] or 0
    hot = F.broadcast(repeated.where(F.col("n_lines") * HOT_SHARE > total).select("h1", "h2", "first"))
    rest = repeated.where(F.col("n_lines") * HOT_SHARE <= total).select("h1", "h2", "first")
    by = ["h1", "h2"]
    found = lines.join(hot, by).unionByName(lines.join(hot.select(*by), by, "left_anti").join(rest, by))
    return (found.where(~F.col("doc_id").eqNullSafe(F.col("first")))
            .groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped")))


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) per row of ``docs``, the text without its repeated lines."""
    lines = stage(line_table(docs, min_chars, id_col, text_col), "lines")
    repeated = stage(repeated_keys(lines, min_docs), "repeated-lines")
    drops = dropped_positions(lines, repeated).withColumnRenamed("doc_id", "_id").withColumnRenamed("version", "_version")
    rows = _rows(docs, id_col, text_col)
    both = rows.join(drops, rows["doc_id"].eqNullSafe(drops["_id"]) & (rows["version"] == drops["_version"]), "left")
    parts = both.select("doc_id", "text", "dropped", F.split("text", "\n").alias("lines"))
    marks = F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("dropped") + 1), lambda k: F.slice(
        F.col("lines"), F.element_at("marks", k) + 2, F.element_at("marks", k + 1) - F.element_at("marks", k) - 1)))
    return parts.withColumn("marks", marks).select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long").alias("n_dropped"))
