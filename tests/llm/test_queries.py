"""Every training-data query on the smallest tables: columns and types, and its SQL in DuckDB where there is one."""

import os
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

from knowloom.llm import pii
from knowloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
#: The columns that each query must return; more may follow.
COLUMNS = {
    "op1": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3": "doc_id bigint, span_start bigint, span_end bigint",
    "op4": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9": "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint",
    "op10": "query_id bigint, rank int, vec_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = [c.rpartition(" ")[::2] for c in COLUMNS[name.split("_")[0]].split(", ")]
    assert {c: t for c, t in df.dtypes if c in dict(want)} == dict(want)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
        order = [rel.columns.index(c) for c in df.columns]
        assert Counter(map(tuple, rows)) == Counter(tuple(r[i] for i in order) for r in rel.fetchall())


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """On the smallest table: texts of the last stages against the fields' own functions, sizes against the words of what was kept."""
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    field = pii.train()
    assert len(out) == len({r.doc_id for r in out}) and {"doc_id", "size", "source_size", "target", "taken"} <= set(out[0].asDict())
    for r in out:
        (_, spans), = pii.all_spans([texts[r.doc_id]], field)
        assert r.size == len(pii.masked(texts[r.doc_id], spans).split()) or any(c in texts[r.doc_id] for c in "\x1c\x1d\x1e\x1f\x85\xa0 　")
        assert 0 < r.taken <= 3 * r.size
