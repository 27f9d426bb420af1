"""The pipeline's stages on odd rows and on empty tables."""

import corpus_pipeline
import pytest

from knowloom.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, comp string, hits int, __h long, __row string, __said string, score double, lang_pred string, row string, key long, maybe int, gone string, uid string, n int, label string, h string, piece string, nth int, taken string, size int"
EXTRA = ("x", 1, 2, "r", "s", 0.5, "lp", "rr", 3, 4, "g", "u", 5, "l", "hh", "p", 6, "t", 7)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    words = ["thing", "ander", "verbund", "schein", "hausen", "other", "stone", "river", "green", "winter", "summer", "broken"]
    say = lambda i, n=40: " ".join(words[(i * 7 + j * (1 + i % 5) + j * j * i) % 12] + str(chr(97 + (i + j) % 26)) for j in range(n))
    rows = [(i, say(i), "en", "ab"[i % 2], 3, *EXTRA) for i in range(1, 30)]
    rows += [(50, say(3), "en", "a", 1, *EXTRA), (51, None, "en", "a", 1, *EXTRA), (52, "", "en", None, 0, *EXTRA), (53, "12 !!", "en", "a", 0, *EXTRA)]
    rows += [(54, "intro words here " + say(99, 30) + " tail", "en", "a", 0, *EXTRA), (55, say(60) + " mail bob@mail.example.com", "en", "b", 0, *EXTRA), (5, say(5), "en", "b", 3, *EXTRA), (None, say(70), "en", "a", 0, *EXTRA)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, say(99, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), {}
    scratch = common.Scratch(spark, "test")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, tables), name)
        if k < 4:
            assert docs.columns == columns
            assert all(tuple(r)[5:] == EXTRA for r in docs.collect())
            kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
            texts = {r.doc_id: r for r in docs.collect()}
    ids = {k: {i for none, i in v if not none} for k, v in kept.items()}
    assert not {51, 52, 53} & ids["language"] and {1, 5, 50, 54, 55} <= ids["language"]
    assert 50 not in ids["near_duplicates"] and 3 in ids["near_duplicates"] and kept["near_duplicates"].count((False, 5)) == 1
    assert 54 not in ids["decontamination"] and ids["near_duplicates"] - {54} == ids["decontamination"]
    assert ids["personal_data"] == ids["decontamination"] and (True, 0) in kept["personal_data"]
    assert texts[55].text.endswith("mail <EMAIL>") and texts[55].n_chars == len(texts[55].text)
    assert {r.doc_id for r in docs.collect()} - {None} <= ids["personal_data"] and docs.count() > 5
    assert corpus_pipeline.run(spark, tables).count() == docs.count()


def test_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
