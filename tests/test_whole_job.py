"""The registered queries do the whole job: no ids, words or lengths are left out."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from knowloom.functions import text as T
from knowloom.operators import nearest, records, route
from knowloom.plans import registry, samples
from knowloom.scratch import Scratch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_validate_refs_reads_all_documents(spark, monkeypatch):
    seen = []
    whole = records.issues
    monkeypatch.setattr(records, "issues", lambda c: (seen.append(c), whole(c))[1])
    found = registry.validate_refs(spark, SF)
    ids = {r.id for r in samples.documents(spark, SF).join(samples.cku(spark, SF).select("doc_id", "id"), "doc_id").select("id").collect()}
    assert {r.id for r in seen[0].select("id").collect()} == ids
    even = {r.id for r in samples.cku(spark, SF).where("doc_id % 2 = 0").select("id").collect()}
    assert {r.id for r in found.collect()} == even


def test_questions_are_whole_turns(spark):
    turns = {r.conv_id * 1000 + r.turn: r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect()}
    assert any(len(t.split(" ")) > 4 for t in turns.values())
    assert {r.qid: r.question for r in samples.questions(spark, SF).collect()} == turns
    got = {}
    for r in registry.QUERIES["keywords"](spark, SF).collect():
        got.setdefault(r.qid, []).append((r.pos, r.kw))
    stop = set(T.STOPWORDS)
    want = {q: list(enumerate(w for w in re.findall(r"\w+", t.lower()) if len(w) > 2 and w not in stop)) for q, t in turns.items()}
    assert {q: sorted(ks) for q, ks in got.items()} == {q: ks for q, ks in want.items() if ks}


def test_best_is_the_top_of_all_scores(spark, monkeypatch):
    entity = spark.createDataFrame([(f"doc-{d}", f"Na{'abcd'[d % 4]}me{'xyz'[i % 3]}{'kl'[(d + i) % 2]}") for d in range(60) for i in range(d % 5)], "cku_id string, name string")
    topic = spark.createDataFrame([(f"doc-{d}", f"src{d % 7}") for d in range(60)], "cku_id string, topic string")
    fact = spark.createDataFrame([(f"doc-{d}", i, f"the name {'abc'[d % 3]}long fact{i} goes here") for d in range(0, 60, 2) for i in range(d % 3)], "cku_id string, seq int, claim string")
    asked = ["name here goes", "nam mex src1 src src", "goes", "n_mex naame nothing", "src1 src2 src3 fact1", "____ name", "name here goes", "the", "blong fact0", "nothing", "nacmez nacmez alo"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    want = sorted(map(tuple, route.top(route.scores(q, entity, topic, fact)).collect()))
    assert {w[0] for w in want} == {0, 1, 2, 3, 4, 5, 6, 8, 10} and any(w[3] == 1.0 for w in want)
    for lead, size in ((nearest.LEAD, route.ROUND_BYTES), (6, 200)):
        monkeypatch.setattr(nearest, "LEAD", lead)
        monkeypatch.setattr(route, "ROUND_BYTES", size)
        assert sorted(map(tuple, route.best(q, entity, topic, fact).collect())) == want


@pytest.mark.parametrize("name", ["route_batch_topk", "access_filter", "prompt_context", "sources_distinct"])
def test_batches_of_questions_list_no_pairs(spark, monkeypatch, name):
    """Pairs of questions and documents grow with the square of the input: they filled the disk."""

    def listed(*_):
        raise AssertionError("all pairs were listed")

    monkeypatch.setattr(route, "scores", listed)
    assert registry.QUERIES[name](spark, SF).count() > 0


ODD = [
    (1, "# One\nword\n## Two\n#three"), (2, ""), (3, None), (4, "a\nT b\n \nT c "), (5, "## x\n# y\nT z \x0b"), (6, "a\n## \n## \nT b"), (7, " \n\t"), (8, "\nT a\n\n"), (9, "plain\n##\tx\n### y\n"), (10, "## \nT a\r\nT b"), (11, "\n" * 30 + "T a\n## b" + "\n#" * 25),
]


@pytest.mark.parametrize("name", ["heading_sections", "greedy_pack"])
def test_sections_of_odd_texts_are_those_of_the_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(i, t, "en", "src1") for i, t in ODD], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["prompt_context", "sources_distinct"])
def test_texts_are_not_gathered_by_question(spark, monkeypatch, name):
    """A long document answers many questions: its lines, copied to each, filled the disk."""

    def gathered(*_):
        raise AssertionError("texts were gathered by question")

    monkeypatch.setattr(route, "assemble", gathered)
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_prompts_from_written_lines_are_those_of_assemble(spark):
    c = samples.cku(spark, SF)
    ids = [r.id for r in c.orderBy("doc_id").limit(9).collect()]
    found = spark.createDataFrame([(q, n + 1, ids[(q * n + n) % 9]) for q in range(20) for n in range(1 + q % 5)], "qid long, rank int, cku_id string")
    want = route.assemble(found, c)
    assert sorted(map(tuple, route.context_prompts(found, c).collect())) == sorted(map(tuple, want.select("qid", "prompt").collect()))
    assert sorted(map(tuple, route.sources(found, c).collect())) == sorted(map(tuple, want.select("qid", "sources").collect()))


def test_routing_drops_what_it_has_used_up(spark, monkeypatch):
    """Texts as records and as tokens, and the rows of each round of questions, stood on the disk together."""
    whole, roots, columns, shards = Scratch.keep, set(), {}, []

    def keep(self, df, name, *args, **more):
        roots.add(self.root.removeprefix("file://"))
        columns[name] = df.columns
        if name.startswith("found-"):
            shards.append("RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString())
        return whole(self, df, name, *args, **more)

    monkeypatch.setattr(Scratch, "keep", keep)
    monkeypatch.setattr(route, "ROUND_BYTES", 1000)
    found = registry.access_filter(spark, SF)
    left = {x for r in roots for x in os.listdir(r)}
    assert "facts" not in columns["ckus"] and "tokens" in columns and not left & {"tokens", "rows", "shards"}
    assert len(shards) > 1 and not any(shards)  # rows are dealt out once, not in each round
    monkeypatch.undo()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, registry.access_filter(spark, SF).collect())) != []


def test_written_tables_leave_no_shuffle_files(spark):
    there = lambda: set(re.findall(r"shuffle_\d+_", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before, setting = there(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = Scratch(spark, "free").keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts", free=True)
    until = time.time() + 20
    while there() - before and time.time() < until:
        time.sleep(0.1)
    assert not there() - before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
