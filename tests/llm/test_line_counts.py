import random

import pytest

from riskspark.llm.line_counts import drop_repeated_lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
HOT = "All rights reserved"


def _brute(rows, min_docs=2, min_chars=10):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(line.strip(BLANK).translate(LOWER), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(BLANK).translate(LOWER)
            ids = holders[key]
            first = min((x for x in ids if x is not None), default=None)
            if len(key) < min_chars or len(ids) < min_docs or i == first:
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = [f"Shared line number {k} of the pool" for k in range(12)] + ["short", "ÄÖÜ Straße ist hier", "äöü straße ist hier", "", "   "]
    rows = [(k, "\n".join([f"own line {k} {j}" if rng.random() < 0.5 else rng.choice(["", " ", "\t"]) + rng.choice(pool).replace("S", rng.choice("Ss"))
                           for j in range(rng.randrange(1, 12))] + ([f"  {HOT.upper()}\x0b"] if k % 3 == 0 else []))) for k in range(300)]
    return rows + [(400, None), (401, ""), (402, "\n\n"), (403, HOT), (403, HOT), (403, "other text\n" + HOT + " "), (None, HOT + "\nonly null"),
                   (None, "only null ids hold this line"), (None, "only null ids hold this line"), (404, "\n".join([HOT, "x"] * 3000)),
                   (405, "a line that repeats inside\na line that repeats inside"), (2, rows[2][1])]


@pytest.mark.parametrize("min_docs", [2, 4])
def test_equals_brute_force(spark, rows, min_docs):
    table = spark.createDataFrame([(i, t, "x", 1, 2, [3]) for i, t in rows],
                                  "doc_id long, text string, version string, pos int, n_lines int, dropped array<int>").repartition(5)
    got = sorted((tuple(r) for r in drop_repeated_lines(table, min_docs=min_docs).collect()), key=str)
    assert got == _brute(rows, min_docs)


def test_empty_table(spark, no_documents):
    assert drop_repeated_lines(no_documents).collect() == []


def test_no_python_on_the_main_path(spark, documents):
    plan = drop_repeated_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
