import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from riskspark.llm.catalog import ORACLES, QUERIES, word_tokenizer
from riskspark.llm.packing import WordTokens

from .conftest import prose
from .test_toxicity import _text

LEAK = prose(40, 12345)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng, texts = random.Random(1), {i: _text(i % 6 == 0, i) for i in range(900)}
    for i in range(1000, 1040):                                   # near copies of clean documents
        words = texts[(i - 1000) * 12 + 1].split()
        texts[i] = " ".join(words) if i % 2 else " ".join(words).upper()
    for i in range(1100, 1110):                                   # a benchmark item inside clean prose
        texts[i] = f"{prose(50, i)} {LEAK} {prose(50, i + 1)}"
    texts[1200] = f"{prose(60, 9)} write to jane.roe@mail.example.com or +1 (988) 555-2485"
    texts |= {1300: None, 1301: "", 1302: prose(5000, 77)}
    rows = [(i, t, "en", "src", len(t or "")) for i, t in texts.items()]
    rng.shuffle(rows)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, before = {}, {r.doc_id: r.text for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(kept[name]) and set(kept[name]) <= set(before)
        before = {i: r.text for i, r in kept[name].items()}
    clean = kept["zstd_toxicity"]
    assert sum(i in clean for i in range(0, 900, 6)) <= 8 and sum(i in clean for i in range(900) if i % 6) >= 740
    assert {1200, 1300, 1301, 1302, *range(1100, 1110)} <= set(clean)
    single = kept["simhash_near_dedup"]
    assert not any(i in single for i in range(1000, 1040) if (i - 1000) * 12 + 1 in clean) and set(range(1100, 1110)) <= set(single)
    assert (1300 in single) and (1301 not in single)              # both have fingerprint zero
    left = kept["cgk_decontamination"]
    assert set(single) - set(left) == set(range(1100, 1110))
    final = kept["pii_surrogates"]
    assert set(final) == set(left) and "jane.roe" not in final[1200].text and "555-2485" not in final[1200].text
    assert all(final[i].text == left[i].text and final[i].n_chars == left[i].n_chars for i in final if i != 1200)
    assert final[1200].n_chars == len(final[1200].text)

    tokens, rows = WordTokens(word_tokenizer()), corpus_pipeline.run(spark, sf_dir).collect()
    expected = set()
    for i, r in final.items():
        ids = np.append(tokens.encode(pa.array([r.text], pa.string()))[0], 0).astype("<u4")
        expected |= {(i, k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)


def test_registered_queries():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(QUERIES) < set(queries) and queries["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(queries)


def test_empty_documents(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
