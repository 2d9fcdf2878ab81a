import random
import re

import pytest

from riskspark.llm.decontaminate import build, drop_contaminated, find_matches, scan

from .conftest import prose

ITEMS = [(k, prose(n, 100 + k)) for k, n in enumerate((12, 18, 25, 40, 58, 58, 5, 200))]
ITEMS += [(50, None), (51, ""), (52, "four words are few"), (None, prose(30, 777)), (0, ITEMS[0][1])]


def _distance(a, b):
    """Fewest edits between ``a`` and any span of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def _words(text):
    return re.findall(r"\w+", (text or "").lower())


def _brute(docs, items):
    return {(i, k) for i, t in docs for k, x in items
            if _words(x) and _distance(_words(x), _words(t)) <= int(0.2 * len(_words(x)))}


def _edited(text, edits, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"zz{rng.randrange(99)}"
        elif kind == 1:
            words.insert(at, f"yy{rng.randrange(99)}")
        else:
            del words[at]
    return " ".join(words)


@pytest.fixture(scope="module")
def leaks():
    rng, rows = random.Random(2), []
    for n in range(160):
        k, text = rng.choice([i for i in ITEMS if i[1] and len(i[1].split()) >= 5])
        edits = rng.randint(0, int(0.2 * len(text.split())))
        host = prose(rng.randint(0, 200), 1000 + n).split()
        at = rng.randint(0, len(host))
        rows.append((n, " ".join(host[:at]) + " " + _edited(text, edits, n) + " " + " ".join(host[at:])))
    clean = [(1000 + n, prose(rng.randint(0, 300), 5000 + n)) for n in range(40)]
    half = [(2000 + n, prose(20, n) + " " + " ".join(t.split()[: len(t.split()) // 2]) + " " + prose(20, n + 1))
            for n, (_, t) in enumerate(ITEMS) if t and len(t.split()) >= 25]
    return rows + clean + half


def test_search_equals_brute_force(leaks):
    bench = build(ITEMS)
    found = {(i, bench.ids[m[0]]) for (i, _), hits in zip(leaks, scan(bench, [t for _, t in leaks])) for m in hits}
    expected = _brute(leaks, ITEMS)
    assert not found - expected and len(found & expected) >= 0.98 * len(expected)
    assert not {i for i, _ in found} & set(range(1000, 3000))


def test_spans_and_distances_are_exact(spark, leaks):
    docs = spark.createDataFrame([(i, t.upper(), 1) for i, t in leaks], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = find_matches(docs, bench, items_per_block=3).collect()
    text, item = dict(leaks), {k: t for k, t in ITEMS}
    assert {(r.doc_id, r.item_id) for r in rows} >= set(list(_brute(leaks[:60], ITEMS))[:40]) - {None}
    for r in rows:
        span = text[r.doc_id][r.start_char:r.end_char]
        assert len(_words(span)) == r.n_words
        assert _distance(_words(item[r.item_id]), _words(span)) == r.edits <= 0.2 * r.item_words


def test_long_text_repeated_leaks_and_odd_rows(spark):
    item = ITEMS[3][1]
    long = prose(900, 9) + " " + " ".join(f"w{k}" for k in range(400_000)) + " " + item + " tail " + item
    docs = spark.createDataFrame([(1, long, "x"), (2, None, "x"), (3, "", "x"), (4, item, "x"), (4, item, "x"), (None, item, "x")],
                                 "doc_id long, text string, similarity string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = find_matches(docs, bench).collect()
    assert sorted([r.doc_id for r in rows if r.item_id == 3], key=str) == sorted([1, 1, 4, 4, None], key=str)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_empty_sides(spark, no_documents, documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_matches(no_documents, bench).count() == 0
    assert find_matches(documents, empty).count() == 0 and drop_contaminated(documents, empty).count() == documents.count()


@pytest.mark.parametrize("n", [3, 15, 40, 60, 100, 200, 400, 800])
def test_recall_with_all_edits_at_every_length(n):
    """Items of every length class, each present with its whole share of word edits."""
    items = [(k, prose(n, 9000 + 100 * n + k)) for k in range(40)]
    bench = build(items)
    assert all(len(w) <= 1024 for c in bench.classes for w in [c.walks])
    texts = [prose(30, k) + " " + _edited(t, int(0.2 * n), 77 * n + k) + " " + prose(30, k + 1) for k, t in items]
    found = sum(any(bench.ids[m[0]] == k for m in hits) for (k, _), hits in zip(items, scan(bench, texts)))
    assert found >= 39, found
    assert not any(scan(bench, [prose(400, 5), " ".join(items[0][1].split()[: n // 3])])) or n < 5


def test_a_block_is_as_large_as_its_items():
    import pickle
    items = [(k, prose(800, 40_000 + k)) for k in range(60)]
    assert len(pickle.dumps(build(items))) < 20e6


def test_short_items_match_verbatim_and_repeatedly():
    bench = build([(1, "Quartz lantern"), (2, "zebra"), (3, "!!")])
    hits = scan(bench, ["a quartz LANTERN, and a quartz lantern", "quartz and lantern", "Zebra zebra", ""])
    assert [sorted((bench.ids[m[0]], m[1]) for m in h) for h in hits] == [[(1, 1), (1, 5)], [], [(2, 0), (2, 1)], []]
