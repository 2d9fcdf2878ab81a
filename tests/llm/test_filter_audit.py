import random
import re
from itertools import permutations

import pytest

from riskspark.llm.filter_audit import FILTERS, audit_filters, failing_relations, flag_documents, removed, survivors

from .conftest import prose

WORD = re.compile("[^\x20\x09-\x0D]+")


def _fails(rows):
    out = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        out.append((i, part or "", {f for f in bad if bad[f]}))
    return out


def _brute(rows, labels):
    marked = {k: {i for i, *m in labels if m[k] == 1} for k in (0, 1)}
    docs, out = _fails(rows), []
    for part in {p for _, p, _ in docs}:
        mine = [d for d in docs if d[1] == part]
        steps = []
        for order in map("".join, permutations(FILTERS)):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                steps.append([part, order, k, len(left) - len(gone), len(gone), sum(f in d[2] for d in mine) - len(gone),
                              sum(d[2] == {f} for d in mine), sum(d[0] in marked[0] for d in gone), sum(d[0] in marked[1] for d in gone)])
                left = [d for d in left if f not in d[2]]
        for s in steps:
            out.append((*s, sum(x[4] for x in steps if x[1][x[2] - 1] == s[1][s[2] - 1])))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    texts = [prose(rng.randrange(20, 120), k) for k in range(60)]
    texts += [t.upper() if k % 3 == 0 else t + " $" if k % 3 == 1 else " ".join(t.split()[:9] * 12) for k, t in enumerate(texts[:30])]
    rows = [(k, t, rng.choice(["a", "b", None])) for k, t in enumerate(texts)]
    rows += [(200 + k, texts[k % 4], "hot") for k in range(40)] + [(300, None, "a"), (301, "", ""), (302, "\x85 é中 |", "b"), (303, " \t\n", "b"),
             (None, texts[0], "a"), (None, texts[0], "a"), (5, rows[5][1], rows[5][2]), (5, "another text", "b"), (304, prose(40_000, 9), "b")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 250, 2)] + [(300, None, 1), (None, 1, 1), (4, 1, 0), (999, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, True, 3) for i, t, p in rows], "doc_id long, text string, source string, A boolean, fails int")
    return rows, labels, docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_brute_force(tables):
    rows, labels, docs, marks = tables
    got = sorted(tuple(r) for r in audit_filters(docs, marks).collect())
    assert got == _brute(rows, [x for x in labels if x[0] is not None])


def test_prefixes_by_joins_alone(tables):
    rows, _, docs, _ = tables
    ids = flag_documents(docs)
    relations, facts = failing_relations(ids), _fails(rows)
    for prefix, step in (("", "E"), ("CA", "B"), ("EDB", "A")):
        left = [d for d in facts if not d[2] & set(prefix)]
        assert survivors(ids, relations, prefix).count() == len(left)
        assert removed(ids, relations, prefix, step).count() == sum(step in d[2] for d in left)


def test_empty_tables(spark, tables):
    _, _, docs, marks = tables
    assert audit_filters(docs.where("false"), marks).count() == 0
    assert audit_filters(docs, marks.where("false")).where("good_lost + toxic_lost > 0").count() == 0
