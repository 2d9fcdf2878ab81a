import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from riskspark.llm.resampling import SpanCrc, bucket_gains, drawn_documents, importance_resample, position_table, text_features

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(f.encode()) for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)


def _brute(rows, target, n_buckets=10_000, share=25):
    s, t = (Counter(c % n_buckets for x in texts for c in _features(x)[0]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        found, words = _features(text)
        gains = [math.floor(1000 * math.log((t[c % n_buckets] + 1) * (S + n_buckets) / ((s[c % n_buckets] + 1) * (T + n_buckets)))) for c in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2]))
    for k, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    letters = "abcABC019 éß中.-_\n\t"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(600))) for _ in range(120)]
    return made + ["", " .-", "x" * 5000, "一" * 900 + " y " + "二" * 700, "a b " * 3000, "One TWO"] + made[:10]


@pytest.mark.parametrize("depth,block", [(4, 16), (16, 64), (512, 1000), (512, 1 << 20)])
def test_checksums_of_spans(texts, depth, block):
    got = [[] for _ in texts]
    for found, rows in text_features(SpanCrc(depth), pa.array([b"skipped", *(t.encode() for t in texts)]).slice(1), block):
        for c, r in zip(found.tolist(), rows.tolist()):
            got[r].append(c)
    assert [sorted(g) for g in got] == [sorted(_features(t)[0]) for t in texts]


def test_position_table_is_the_checksum():
    table = position_table(9)
    for text in (b"a", b"word", b"two words"):
        register = 0
        for k, b in enumerate(text):
            register ^= int(table[len(text) - 1 - k, b])
        assert register ^ zlib.crc32(bytes(len(text))) == zlib.crc32(text)


def _rows(texts):
    return list(enumerate(texts)) + [(900, None), (None, texts[0]), (None, texts[1]), (3, texts[3]), (3, texts[4])]


def test_equals_brute_force(spark, texts):
    rows, target = _rows(texts), [texts[5] + " a b c", "a b", None, ""]
    docs = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in rows], "doc_id long, text string, rank int, score double, version string").repartition(7)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    ranked = importance_resample(docs, wanted)
    got = sorted((tuple(r) for r in ranked.drop("version").collect()), key=str)
    assert got == _brute(rows, target)
    drawn = drawn_documents(docs, ranked)
    assert drawn.columns == docs.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in got if r[4] is not None}


def test_share_and_empty_tables(spark, texts, no_documents):
    docs = spark.createDataFrame(_rows(texts), "doc_id long, text string")
    nothing = docs.where("false").select("text")
    assert importance_resample(no_documents, docs).collect() == []
    assert sorted((tuple(r) for r in importance_resample(docs, nothing, share=100).drop("version").collect()), key=str) == \
        _brute(_rows(texts), [], share=100)
    assert importance_resample(docs, nothing, share=0).where("rank is not null").count() == 0
    assert not bucket_gains(nothing, nothing).any()
