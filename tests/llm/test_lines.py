import pytest
from xxhash import xxh3_128_digest

from riskspark.llm.lines import cut, dedup_lines, units

from .conftest import prose

BANNER = "All rights reserved by the river company."
PASSAGE = " ".join(prose(12, 300 + k).capitalize() + "." for k in range(6))


def _brute(docs, min_words=4, run_words=25):
    """The rule spelt out: first occurrences by (doc_id, offset), then the cut."""
    def norm(part):
        return " ".join(part.lower().split())

    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        for a, b, words, _, _ in units(t or ""):
            if words >= min_words:
                first.setdefault(norm(t[a:b]), i)
    out = []
    for i, t in docs:
        own = {xxh3_128_digest(n.encode()) for n, f in first.items() if f == i}
        foreign = {xxh3_128_digest(n.encode()) for n, f in first.items() if f != i}
        out.append((i, *cut(t, own, foreign)) if t is not None else (i, None, []))
    return out


@pytest.fixture(scope="module")
def docs():
    rows = [(k, "\n".join([prose(10, 400 + k), BANNER.upper() if k % 2 else "  " + BANNER, prose(12, 500 + k)])) for k in range(30)]
    rows += [(100, prose(9, 1) + " " + PASSAGE + " " + prose(9, 2)), (101, prose(9, 3) + " " + PASSAGE + " " + prose(9, 4)),
             (102, PASSAGE), (103, "Yes it is. No. " + prose(30, 5)), (104, "Yes it is. No. " + prose(30, 6)),
             (105, None), (106, ""), (107, "\n\n"), (108, rows[0][1]), (None, rows[1][1]), (109, BANNER + "\n" + BANNER)]
    return rows


def test_equals_brute_force(spark, docs):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, digest string, n int")
    got = [(r.doc_id, r.text, [(s.start, s.end) for s in r.removed]) for r in dedup_lines(table).collect()]
    assert sorted(got, key=str) == sorted(_brute(docs), key=str)


def test_what_stays_and_what_goes(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in dedup_lines(table).collect()}
    assert sum(BANNER.lower() in (r.text or "").lower() for r in out.values()) == 1 and BANNER in out[0].text
    assert PASSAGE in out[100].text and PASSAGE[120:300] not in out[101].text and PASSAGE[120:300] not in out[102].text
    assert out[103].text == docs[33][1] and out[104].text == docs[34][1]
    assert out[108].text.strip() == "" and out[105].text is None and out[106].text == ""
    source = dict(docs)
    for i, r in out.items():
        if r.text is not None:
            kept, at = "", 0
            for s in r.removed:
                kept, at = kept + source[i][at:s.start], s.end
            assert kept + source[i][at:] == r.text


def test_repeated_rows_and_empty_table(spark, no_documents):
    twice = spark.createDataFrame([(1, BANNER), (1, BANNER), (2, BANNER)], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(twice).collect()) == ["", BANNER, BANNER]
    assert dedup_lines(no_documents).count() == 0


def _plain_line_dedup(docs):
    """Independent of the module: every non-blank line but the first of its normal form goes."""
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        kept = []
        for line in t.split("\n"):
            norm = " ".join(line.lower().split())
            if norm and norm in seen:
                continue
            seen.setdefault(norm, i)
            kept.append(line)
        out[i] = kept
    return out


def test_every_line_against_a_plain_count(spark):
    """min_words=1: short lines and lines without spaces count too."""
    import random
    rng = random.Random(7)
    pool = ["Yes", "No!", "  yes", "Chapter 1", "\u8fd9\u662f\u4e00\u4e2a\u6ca1\u6709\u7a7a\u683c\u7684\u53e5\u5b50" * 8, "", " ", "a b c d e", "A  B c D e", "once more with feeling"]
    docs = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.6 else prose(6, 100 * k + j) for j in range(8))) for k in range(40)]
    got = {r.doc_id: [x for x in r.text.split("\n") if x.strip()]
           for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=1).collect()}
    assert got == {i: [x for x in lines if x.strip()] for i, lines in _plain_line_dedup(docs).items()}


def test_long_lines_without_spaces_are_units_by_default(spark):
    line = "\u8fd9\u662f\u4e00\u4e2a\u6ca1\u6709\u7a7a\u683c\u7684\u53e5\u5b50" * 20
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame([(1, line), (2, "own words of the text\n" + line)], "doc_id long, text string")).collect()}
    assert out == {1: line, 2: "own words of the text\n"} or out == {1: line, 2: "own words of the text"}
