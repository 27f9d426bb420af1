"""Files to records to answers, incremental refresh, roles, audit, YAML, watching."""

import json

import pytest

from knowloom.operators import records
from knowloom.plans.engine import Asker, Compiler, benchmark
from knowloom.sources.files import Config
from knowloom.streaming.watch import watch


@pytest.fixture
def docs(tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/git.md").write_text("# Branches\nUse Git branches for each Feature always.\n\n# Merge\nThe Merge needs two Reviews to pass.")
    (tmp_path / "docs/py.md").write_text("# Python\nPython lists hold many values in order.")
    (tmp_path / "docs/bad.md").write_bytes(b"\xff\xfe\xff")
    return tmp_path


def statuses(df):
    return {r.source.rpartition("/")[2]: r.status for r in df.collect()}


def test_compile_is_incremental_and_keeps_roles(spark, docs):
    c = Compiler(spark, Config(store_dir=str(docs / "store"), max_section_lines=2))
    assert statuses(c.compile(str(docs / "docs"), roles=["hr"])) == {"git.md": "compiled", "py.md": "compiled", "bad.md": "failed"}
    (docs / "docs/py.md").write_text("# Python\nPython dicts map keys to values.")
    assert statuses(c.compile(str(docs / "docs"))) == {"git.md": "skipped", "py.md": "compiled", "bad.md": "failed"}
    assert {tuple(r[0]) for r in c.store.ckus().select("meta.access.roles").collect()} == {("hr",)}
    c.compile(str(docs / "docs"), roles=[])
    assert {tuple(r[0]) for r in c.store.ckus().select("meta.access.roles").collect()} == {()}
    assert records.count_events(c.store.events(), "compile").first()[0] == 3
    a = Asker(spark, Config(store_dir=str(docs / "store")))
    got = a.query("Which reviews does a merge need?")
    assert "git.md" in got["sources"][0] and "two Reviews" in got["answer"]
    assert a.query("zzzz")["answer"].startswith("No relevant")
    text = c.store.export_yaml()
    assert sorted(r.id for r in c.store.import_yaml(text).collect()) == sorted(r.id for r in c.store.ids().collect())
    with pytest.raises(FileNotFoundError):
        c.store.load("none")


def test_benchmark(spark, docs):
    (docs / "docs/bad.md").unlink()
    (docs / "questions.json").write_text(json.dumps([{"id": "1", "question": "python lists", "expected_keywords": ["values", "nope"]}]))
    report, results = benchmark(spark, Config(store_dir=str(docs / "s")), str(docs))
    assert report["total_questions"] == 1 and report["questions"][0]["matched_keywords"] == ["values"] and report["questions"][0]["latency_ms"] > 0
    assert report["avg_keyword_score"] == 0.5 and report["compile_doc_count"] == 2 and report["category_scores"] == {"answer_quality": 0.5}


def test_watch_reports_changed_files_again(spark, docs):
    seen = []

    def turn():
        q = watch(spark, str(docs / "docs"), seen.extend, str(docs / "cp"), debounce_ms=100)
        q.processAllAvailable()
        q.stop()
        out = sorted(p.rpartition("/")[2] for p in seen)
        seen.clear()
        return out

    assert turn() == ["bad.md", "git.md", "py.md"]
    assert turn() == []
    (docs / "docs/py.md").write_text("other text")
    (docs / "docs/git.md").unlink()
    assert turn() == ["py.md"]


def test_only_touched_buckets_are_written_again(spark, docs):
    c = Compiler(spark, Config(store_dir=str(docs / "store")))
    for i in range(12):
        (docs / f"docs/n{i}.md").write_text(f"# N{i}\nText number {i} stands here.")
    c.compile(str(docs / "docs"))
    before = c.store.manifest()[1]["folders"]
    (docs / "docs/py.md").write_text("# Python\nOther text stands here now.")
    c.compile([str(docs / "docs/py.md"), str(docs / "docs/git.md")])
    after = c.store.manifest()[1]["folders"]
    assert sum(before[b] != after[b] for b in before) <= 1 and set(before) == set(after)
    assert c.store.ckus().count() == 14 and c.store.load_by_source(str(docs / "docs/py.md")).first().facts[0].claim == "Other text stands here now."
    names = {p.name for p in (docs / "store/ckus").iterdir()}
    assert names == {*before.values(), *after.values()}
    logged = [r.id for r in c.store.events().orderBy("id").collect()]
    assert len(logged) == 2 and logged[0] < logged[1]


def test_imported_records_are_checked(spark, docs):
    from knowloom.sources.store import from_yaml

    good = "meta: {source: a, compiled: 2024-01-01T00:00:00, hash: h, type: markdown}\nsummaries: {document: d}\nfacts: [{id: f, claim: c, source: {page: 1}}]\n"
    assert from_yaml(good)["facts"][0]["confidence"] == 1.0 and from_yaml(good)["meta"]["language"] == "en"
    for bad in ("[]", good.replace("hash: h", "hash: 1"), good.replace("{page: 1}", "{page: x}"), good.replace("2024-01-01T00:00:00", "soon"), good.replace("id: f, ", ""), good + "entities: [{id: e, name: E, type: t, relations: [{target: x}]}]\n"):
        with pytest.raises(ValueError):
            from_yaml(bad)
