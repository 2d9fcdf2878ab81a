"""Filter interaction audit over failing-id relations.

One pass over the texts finds which filters each document fails. For each filter
the ids that fail it are written as a table of their own (its failing-id
relation). From then on only ids are joined: the survivors of a prefix of filters
are the ids left by left-anti joins with the relations of its letters, what the
next filter removes is the left-semi join of the survivors with its relation.

A prefix's survivors do not depend on the order of its letters, so the audit does
not repeat joins for every order: ``split_by_relations`` takes one filter after the
other and splits each class of ids by a left-semi (fails) and a left-anti join
(passes). Five filters give 32 classes; the survivors of any prefix are the classes
that fail none of its letters. All orders are then read from the counts of the
classes, whose number does not grow with the documents.

Defined results
* NULL texts are empty; an empty text has no words.
* Rows are counted one by one, repeated rows too; ``version`` (128 bits of the text)
  tells rows apart that share an id.
* A NULL id is a document; as no id is smaller than it, it never fails the copy filter.
* A document with several label rows counts as labelled 1 if any of them is 1; missing
  and NULL labels count as 0.
* Very long texts are read whole, as bytes, one at a time.
* An empty table gives no parts and so no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm.common import stage

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65        # per cent of the words
MAX_UPPER = 5            # per cent of the code points
HOT_SHARE = 1000         # texts with more than 1/1000 of all copies are joined by broadcast
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SPECIAL = b"#$%&*|"
_INSIDE = bytes(range(0x80, 0xC0))   # UTF-8 bytes that start no code point
KEY = ("doc_id", "v1", "v2")


def failing(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether one UTF-8 text fails the filters A to D. ``bytes.split`` cuts at ASCII white space."""
    words = text.split()
    points = len(text.translate(None, _INSIDE))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words), 100 * upper > MAX_UPPER * points,
            len(text.translate(None, _SPECIAL)) < len(text))


def flag_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, v1, v2, part, A, B, C, D) per row; the one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(F.lit(1), text).alias("v1"), F.xxhash64(F.lit(2), text).alias("v2"),
                       F.coalesce(F.col("source"), F.lit("")).alias("part"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = [failing(t.as_py()) for t in b.column(4)]
            columns = [pa.array([f[k] for f in flags], pa.bool_()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *columns], ["doc_id", "v1", "v2", "part", "A", "B", "C", "D"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, v1 long, v2 long, part string, A boolean, B boolean, C boolean, D boolean")


def later_copies(rows: DataFrame) -> DataFrame:
    """Keys of the rows whose text a smaller id holds as well.

    Texts with more than a thousandth of all copies (at most a thousand texts) are joined by broadcast.
    """
    first = stage(rows.groupBy("v1", "v2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max("doc_id").alias("last"))
                  .where("first < last").drop("last"), "copied-texts")
    total = first.agg(F.sum("n")).first()[0] or 0
    by = ["v1", "v2"]
    hot = F.broadcast(first.where(F.col("n") * HOT_SHARE > total).drop("n"))
    rest = first.where(F.col("n") * HOT_SHARE <= total).drop("n")
    found = rows.join(hot, by).unionByName(rows.join(hot.select(*by), by, "left_anti").join(rest, by))
    return found.where("doc_id > first").select(*KEY)


def failing_relations(rows: DataFrame) -> dict[str, DataFrame]:
    """One written table of failing keys for each filter."""
    out = {f: stage(rows.where(f).select(*KEY).distinct(), f"fails-{f}") for f in "ABCD"}
    return out | {"E": stage(later_copies(rows).distinct(), "fails-E")}


def _same(left: DataFrame, right: DataFrame) -> Column:
    on = left[KEY[0]].eqNullSafe(right[KEY[0]])
    for k in KEY[1:]:
        on = on & (left[k] == right[k])
    return on


def survivors(ids: DataFrame, relations: dict[str, DataFrame], prefix: str) -> DataFrame:
    """Rows of ``ids`` left after the filters of ``prefix``: one left-anti join a letter."""
    for f in prefix:
        ids = ids.join(relations[f], _same(ids, relations[f]), "left_anti")
    return ids


def removed(ids: DataFrame, relations: dict[str, DataFrame], prefix: str, step: str) -> DataFrame:
    """Rows that filter ``step`` removes after ``prefix``: survivors, left-semi its relation."""
    left = survivors(ids, relations, prefix)
    return left.join(relations[step], _same(left, relations[step]), "left_semi")


def split_by_relations(ids: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """``ids`` with ``fails``: bit k is set where the row is in the relation of filter k.

    Each step splits the rows by a left-semi and a left-anti join; the result is
    written, so a lost executor repeats one step at most.
    """
    out = ids.withColumn("fails", F.lit(0))
    for k, f in enumerate(FILTERS):
        hit = out.join(relations[f], _same(out, relations[f]), "left_semi")
        miss = out.join(relations[f], _same(out, relations[f]), "left_anti")
        out = stage(hit.withColumn("fails", F.col("fails") + (1 << k)).unionByName(miss), f"split-{f}")
    return out


def order_table(classes: DataFrame, orders: list[str]) -> DataFrame:
    """All steps of all orders per part from the class counts (part, fails, n, good, toxic)."""
    steps = (classes.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.length("filter_order"))))
             .withColumn("letter", F.expr("substr(filter_order, step, 1)"))
             .withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', letter) - 1)"))
             .withColumn("before", F.expr(f"aggregate(filter(split(substr(filter_order, 1, step - 1), ''), x -> x <> ''), 0, "
                                          f"(a, x) -> a + shiftleft(1, instr('{FILTERS}', x) - 1))")))
    fails, before, own = F.col("fails"), F.col("before"), F.col("bit")
    hit = fails.bitwiseAND(own) != 0
    alive = fails.bitwiseAND(before) == 0

    def total(condition: Column, what: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")

    out = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(alive & ~hit).alias("kept"), total(alive & hit).alias("removed"), total(~alive & hit).alias("redundant"),
        total(fails == own).alias("unique_fails"), total(alive & hit, "good").alias("good_lost"),
        total(alive & hit, "toxic").alias("toxic_lost"))
    return (out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")).cast("long"))
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; zeros included.

    ``shapley`` is the sum of what the step's filter removes over all orders.
    """
    rows = stage(flag_documents(docs), "filter-flags")
    relations = failing_relations(rows)
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                         F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    ids = rows.select(*KEY, "part").join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    classes = split_by_relations(stage(ids, "filter-ids"), relations).groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return order_table(classes, ["".join(p) for p in permutations(FILTERS)])
