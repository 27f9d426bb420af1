"""Functions and operators by hand-written cases."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from knowloom.functions import ids, text
from knowloom.operators import coerce, kmap, providers, records, route, split
from knowloom.plans import engine
from knowloom.schema import CKU_DDL, PAGE_DDL
from knowloom.sources import files


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column).first()[0]


@pytest.mark.parametrize("source, stem", [("a.tar.gz", "a.tar"), (".md", ".md"), ("x/Übung 1.md", "Übung 1"), ("dir/", "dir"), ("a.", "a.")])
def test_stem(spark, source, stem):
    assert value(spark, ids.stem(F.col("s")), s=source) == stem


def test_source_to_id(spark):
    import hashlib

    got = value(spark, ids.source_to_id(F.col("s")), s="/d/-Mein Übung!.md")
    assert got == "mein-übung-" + hashlib.sha256("/d/-Mein Übung!.md".encode()).hexdigest()[:8]


def test_keywords_keep_order_and_repeats(spark):
    assert value(spark, text.keywords(F.col("q")), q="What is the Übung läuft on snake_case, Übung?") == ["übung", "läuft", "snake_case", "übung"]


def test_fts_tokens_fold_accents_not_sharp_s(spark):
    assert value(spark, text.fts_tokens(F.col("q")), q="Café Übung Straße snake_case") == ["cafe", "ubung", "straße", "snake", "case"]


def test_keyword_score(spark):
    e = F.array(F.lit("Paris"), F.lit("x9"), F.lit("zz"))
    assert value(spark, text.keyword_score(F.col("a"), e), a="in paris") == pytest.approx(1 / 3)
    assert value(spark, text.keyword_score(F.col("a"), F.array().cast("array<string>")), a="") == 1.0


@pytest.mark.parametrize("doc, n", [("# a\nx\n# b\ny", 2), ("pre\n# a\nx", 2), ("# a\n### b\n### c", 1), ("plain", 1), ("", 1)])
def test_heading_sections(spark, doc, n):
    assert len(value(spark, split.heading_sections(F.col("t")), t=doc)) == n


def chunked(spark, pages, max_lines):
    """Chunks of pages (number, text, visuals), as lists of pages."""
    rows = [(n, t, [("image", n, None, d, at) for d, at in v]) for n, t, *v in pages]
    return spark.createDataFrame([(rows,)], f"p ARRAY<{PAGE_DDL}>").select(split.chunks(F.col("p"), max_lines)).first()[0]


def test_pack_keeps_oversized_sections_alone(spark):
    doc = "# a\n" + "\n".join("x" * 299) + "\n# b\ny\n# c\n" + "\n".join("z" * 49) + "\n# d\n" + "\n".join("w" * 49)
    got = chunked(spark, [(0, doc)], 60)
    assert [c[0].text.count("\n") + 1 for c in got] == [300, 53, 50] and [c[0].number for c in got] == [0, 1, 2]


def test_line_blocks_and_limits(spark):
    doc = "\n".join(str(i) for i in range(250))
    got = [c[0].text for c in chunked(spark, [(0, doc)], 100)]
    assert [g.count("\n") + 1 for g in got] == [100, 100, 50] and "\n".join(got) == doc
    with pytest.raises(ValueError):
        split.line_blocks(F.col("t"), 0)
    assert [len(chunked(spark, [(0, "\n".join("x" * n))], 200)) for n in (200, 201)] == [1, 2]


def test_pages_are_packed_whole(spark):
    got = chunked(spark, [(i, "\n".join("x" * 30)) for i in range(20)], 100)
    assert [p.number for c in got for p in c] == list(range(20)) and max(map(len, got)) == 3
    assert [len(c) for c in chunked(spark, [(0, "x"), (1, "\n".join("y" * 500)), (2, "z")], 100)] == [1, 1, 1]
    assert sum(c[0].text.count("\n") + 1 for c in chunked(spark, [(0, "\n".join("y" * 500))], 100)) == 500


def test_images_go_with_their_section(spark):
    doc = "intro ![a](1)\n# A\nx\n# B\n![b](2)\ny"
    at = [("one", doc.index("![a]")), ("two", doc.index("![b]"))]
    rows = [(0, doc, [("image", 0, None, d, i) for d, i in at])]
    got = spark.createDataFrame([(rows,)], f"p ARRAY<{PAGE_DDL}>").select(split.chunks(F.col("p"), 2)).first()[0]
    assert [[v.data for v in c[0].visuals] for c in got] == [["one"], [], ["two"]]


@pytest.mark.parametrize("page, want", [("4", 4), ("4.0", 4), (4.0, 4), (True, 1), (None, None)])
def test_pages_read_leniently(page, want):
    assert coerce.fact({"id": "f", "claim": "c", "source": {"page": page}})["source"]["page"] == want


@pytest.mark.parametrize("source", [{"page": 4.5}, {"page": "x"}, {"page": [1]}, {"page": 2**40}, {"page": "1e300"}, {"section": 1}])
def test_facts_with_bad_sources_go(source):
    assert coerce.fact({"id": "f", "claim": "c", "source": source}) == {"ok": False}


def merged(spark, *raws):
    """What the engine makes of one document's raw chunks."""
    import json

    rows = [("s", i, len(raws), json.dumps(coerce.chunk(r)), None) for i, r in enumerate(raws)]
    return engine.compiled(spark.createDataFrame(rows, engine.FOUND_DDL)).first().asDict(recursive=True)


def test_coercion_defaults(spark):
    got = merged(spark, {"summaries": 3, "entities": [{"id": 1, "relations": [{"target": "a"}, {"target": "a", "type": "t"}]}, 7, {"id": 1}], "facts": "no", "visuals": [{"structured_data": [1]}, {"context": 3}], "dependencies": ["a", None, 2, "a"]})
    assert got["entities"] == [{"id": "1", "name": "", "type": "concept", "relations": [{"target": "a", "type": "t"}]}, {"id": "1", "name": "", "type": "concept", "relations": []}]
    assert got["dependencies"] == ["a", "2", "a"] and got["visuals"][0]["structured_data"] is None and len(got["visuals"]) == 1
    assert got["summaries"] == {"document": "", "sections": []} and got["language"] == "en" and got["error"] is None
    assert merged(spark, {"language": None})["error"] == "ValueError: language must be text"
    assert merged(spark, {"facts": [{"id": "f", "claim": "c", "confidence": "x", "entities": [1]}]})["facts"][0] == {"id": "f", "claim": "c", "source": {"page": None, "section": None}, "confidence": 1.0, "entities": ["1"]}


def test_merge_rules(spark):
    section = lambda title: {"id": "s", "title": title, "summary": ""}
    a = {"summaries": {"document": "A", "sections": [section("1")]}, "entities": [{"id": "e", "name": "E", "relations": [{"target": "x", "type": "t"}] * 2}, {"id": ""}], "facts": [{"id": "f", "claim": "1", "source": {"page": "bad"}}, {"id": "g", "claim": "2"}, {"id": ""}], "dependencies": ["a.md", "b.md"], "language": "de"}
    b = {"summaries": {"document": "B", "sections": [section("2")]}, "entities": [{"id": "e", "name": "Z", "relations": [{"target": "x", "type": "t"}, {"target": "y", "type": "t"}, {"target": "y", "type": "t"}]}], "facts": [{"id": "f", "claim": "3"}, {"id": "g", "claim": "4"}, {"id": ""}], "visuals": [{"id": "v"}], "dependencies": ["b.md", "c.md", None], "language": "en"}
    got = merged(spark, a, b, {"language": "de", "entities": 3, "facts": {"id": 1}, "summaries": {"document": ""}})
    assert got["summaries"] == {"document": "A B", "sections": [section("1")]} and got["language"] == "de"
    assert [(e["name"], [r["target"] for r in e["relations"]]) for e in got["entities"]] == [("E", ["x", "x", "y"])]
    assert [f["claim"] for f in got["facts"]] == ["2", "", ""] and got["dependencies"] == ["a.md", "b.md", "c.md"] and len(got["visuals"]) == 1
    assert merged(spark, {"language": 3}, {"language": None})["language"] == "en"
    assert merged(spark, {"language": "fr"}, {"language": "de"}, {})["language"] == "fr"


def test_odd_ids_and_relations_are_no_errors(spark):
    got = merged(spark, {"entities": [{"id": [1], "relations": 5}, {"id": {"a": 1}}]}, {"entities": [{"id": [1], "name": "later"}], "dependencies": {"a": 1}})
    assert [(e["id"], e["relations"]) for e in got["entities"]] == [("[1]", []), ("{'a': 1}", [])] and got["dependencies"] == []


def test_provider_surface():
    assert providers.parse_response('```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ("[1]", "nope"):
        with pytest.raises(ValueError):
            providers.parse_response(bad)
    with pytest.raises(ValueError):
        providers.get_provider("none")
    assert providers.get_provider("local", model="m", api_key="x").get_name() == "local/m"


def test_files_and_parsers(spark, tmp_path):
    for name in ("b.md", ".hidden/c.md", "_x/d.MD", "e.txt", "a.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("# T\n![alt](i.png)\r\nx")
    found = files.collect_files(str(tmp_path))
    assert [f.removeprefix(str(tmp_path)) for f in found] == ["/_x/d.MD", "/a.pdf", "/b.md"]
    assert {r[0] for r in files.files(spark, found).select("source").collect()} == set(found)
    kind, (page,) = files.parse(found[0], b"![alt](i.png)\r\nx")
    assert kind == "markdown"
    assert page["text"] == "![alt](i.png)\nx" and page["visuals"][0]["data"] == "alt=alt, src=i.png"
    with pytest.raises(ValueError):
        files.parser_of("x.txt")
    with pytest.raises(FileNotFoundError):
        files.collect_files(str(tmp_path / "none"))


def test_pdf_spans():
    line = lambda t, s: {"spans": [{"text": t, "size": s}]}
    assert files.spans_to_markdown({"blocks": [{"type": 0, "lines": [line("Big", 20), line("a", 10), line("b", 10)]}, {"type": 1}, {"type": 0, "lines": [line("Mid", 14), line("c", 10)]}]}) == "# Big\n\na b\n\n## Mid\n\nc"


class Notes:
    kind = "notes"

    def can_parse(self, path):
        return path.endswith(".notes")

    def parse(self, content):
        return [{"number": 0, "text": content.decode(), "visuals": []}]


def test_parsers_can_be_added(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PARSERS", list(files.PARSERS))
    (tmp_path / "x.notes").write_text("hi")
    assert files.collect_files(str(tmp_path)) == []
    files.register(Notes())
    (found,) = files.collect_files(str(tmp_path))
    assert files.parse(found, b"hi") == ("notes", [{"number": 0, "text": "hi", "visuals": []}])


class Page:
    """A page as the PDF library gives it, with parts that may fail."""

    def __init__(self, number, **parts):
        self.number, self.parts = number, parts

    def _part(self, name, default):
        v = self.parts.get(name, default)
        if isinstance(v, Exception):
            raise v
        return v

    def get_text(self, kind):
        return {"blocks": [{"type": 0, "lines": [{"spans": [{"text": f"page {self.number}", "size": 20}]}]}]}

    def get_image_info(self, xrefs):
        return self._part("images", [])

    def find_tables(self):
        return types.SimpleNamespace(tables=self._part("tables", []))

    def get_drawings(self):
        return self._part("drawings", [])


class Table:
    bbox = (1, 2, 3, 4)

    def __init__(self, said):
        self.said = said

    def to_markdown(self):
        if self.said is None:
            raise RuntimeError
        return self.said


def test_pdf_visuals_are_best_effort(monkeypatch):
    box = lambda *b: {"rect": b}
    pages = [
        Page(0, images=[{"bbox": (0, 0, 1, 1)}, {}], tables=[Table("| a |"), Table(None)], drawings=[box(0, 0, 1, 2), box(5, 5, 9, 8)] * 3),
        Page(1, images=ValueError("bad"), tables=[Table("t")], drawings=[box(1, 1, 1, 5)] * 9),
        Page(2, tables=ValueError("bad"), drawings=[box(0, 0, 1, 1)] * 5),
    ]

    class Document(list):
        closed = False

        def close(self):
            Document.closed = True

    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: Document(pages)))
    kind, got = files.parse("x.PDF", b"%PDF")
    assert kind == "pdf" and Document.closed and [p["text"] for p in got] == ["# page 0", "# page 1", "# page 2"]
    said = [[(v["type"], v["bbox"], v["data"]) for v in p["visuals"]] for p in got]
    assert said[0] == [("image", [0, 0, 1, 1], None), ("image", None, None), ("table", [1, 2, 3, 4], "| a |"), ("table", [1, 2, 3, 4], None), ("diagram", [0, 0, 9, 8], None)]
    assert said[1] == [("table", [1, 2, 3, 4], "t")] and said[2] == []
    monkeypatch.setitem(sys.modules, "fitz", None)
    with pytest.raises(ImportError, match="PyMuPDF"):
        files.parse("x.pdf", b"")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("provider: local\nmax_section_lines: 7\n")
    c = files.load_config("here", str(tmp_path / "c.yaml"), {"KNOWLOOM_TOP_K": "9", "KNOWLOOM_MAX_SECTION_LINES": "x"})
    assert (c.store_dir, c.provider, c.top_k, c.max_section_lines) == ("here", "local", 9, 200)
    (tmp_path / "config.yaml").write_text("provider: cloud\nurl: http://file\nother: 1\n")
    c = files.load_config(environ={"KNOWLOOM_STORE_DIR": str(tmp_path), "OLLAMA_HOST": "http://alias", "OPENAI_API_KEY": "k"})
    assert (c.store_dir, c.provider, c.url, c.api_key) == (str(tmp_path), "cloud", "http://file", "k")
    assert files.load_config(environ={"OPENAI_API_KEY": "k", "KNOWLOOM_API_KEY": "own"}).api_key == "own"
    with pytest.raises(ValueError):
        files.Config(max_section_lines=0)


def test_names_with_wildcards_are_found_by_pieces(spark):
    names = spark.createDataFrame([(n,) for n in ("abXcd", "a1b2c", "ab", "Überblick", "x")], "name string")
    kws = spark.createDataFrame([(k,) for k in ("ab_cd", "a_b_c", "___", "blick", "_ab", "zzz")], "kw string")
    got = {(r.name, r.kw) for r in route.containing(names, kws).collect()}
    assert got == {("abXcd", "ab_cd"), ("a1b2c", "a_b_c"), ("abXcd", "___"), ("a1b2c", "___"), ("Überblick", "___"), ("Überblick", "blick")}


def test_facts_are_found_alike_by_broadcast_and_by_postings(spark, cku, monkeypatch):
    kws = route.question_keywords(spark.createDataFrame([(1, "cafe opens"), (2, "snake_case used"), (3, "cafe used")], "qid long, question string"))
    want = {(1, "c1", 1), (2, "c1", 1)}
    for size in (route.BROADCAST_BYTES, 0):
        monkeypatch.setattr(route, "BROADCAST_BYTES", size)
        assert {tuple(r) for r in route.fact_hits(kmap.facts_all(cku), kws).collect()} == want


RECORD = {
    "id": "c1", "meta": {"source": "a.md", "compiled": "t", "hash": "h", "type": "markdown", "language": "en", "access": {"roles": ["hr"]}}, "summaries": {"document": "d", "sections": [{"id": "s", "title": "Alpha", "summary": "x"}]},
    "entities": [{"id": "e", "name": "Old", "type": "x", "relations": [{"target": "q", "type": "r"}]}, {"id": "e", "name": "Über_uns", "type": "Process", "relations": [{"target": "z", "type": "r"}]}],
    "facts": [{"id": "f", "claim": "the Café opens", "source": {"page": None, "section": None}, "confidence": 1.0, "entities": ["e"]}, {"id": "f", "claim": "snake_case is used", "source": {"page": 2, "section": None}, "confidence": 1.0, "entities": ["u"]}],
    "visuals": [], "dependencies": [],
}


@pytest.fixture(scope="module")
def cku(spark):
    return spark.createDataFrame([RECORD], CKU_DDL)


def test_map_tables(cku):
    assert [(r.name, r.id) for r in kmap.entities(cku).collect()] == [("Über_uns", "e")]
    assert [r.target for r in kmap.entity_relations(cku).collect()] == ["z"]
    assert {r.topic for r in kmap.topics(cku).collect()} == {"x", "process", "alpha"}
    assert kmap.facts(cku).count() == 1 and kmap.facts_all(cku).count() == 2
    assert kmap.find_by_entity(kmap.entities(cku), "BER_u").count() == 1 and kmap.find_by_entity(kmap.entities(cku), "über").count() == 0


def test_fts(cku):
    f = kmap.facts_all(cku)
    assert kmap.find_by_keywords(f, ["cafe", "opens"]).count() == 1 and kmap.find_by_keywords(f, ["snake_case"]).count() == 1
    assert kmap.find_by_keywords(f, ["cafe", "used"]).count() == 0 and kmap.find_by_keywords(f, []).count() == 0
    assert kmap.find_by_keywords(f, ["cafe", "none"], any_of=True).count() == 1


def test_route_access_context(spark, cku):
    q = spark.createDataFrame([(1, "the ber_uns opens", "hr"), (2, "process", None), (3, "nothing here", "hr")], "qid long, question string, role string")
    scored = route.scores(q, kmap.entities(cku), kmap.topics(cku), kmap.facts_all(cku))
    assert {(r.qid, r.score) for r in scored.collect()} == {(1, 3.0), (2, 2.0)}
    top = route.top(scored).join(q, "qid")
    access = cku.select(F.col("id").alias("cku_id"), F.col("meta.access.roles").alias("roles"))
    seen = route.allowed(top, access)
    assert [r.qid for r in seen.collect()] == [1]
    said = {r.qid: r.answer for r in route.answer(q, route.assemble(seen, cku)).collect()}
    assert said[3].startswith("No relevant") and said[1].startswith("## Relevant Summaries\n- d [Source: a.md]\n\n## Relevant Facts\n- the Café opens (p.None) [Source: a.md]")


def test_issues(cku):
    assert {r.issue for r in records.issues(cku).collect()} == {"duplicate entity ids", "duplicate fact ids", "entity e: unknown entity q", "entity e: unknown entity z", "fact f: unknown entity u"}
