"""Splitting texts into bounded chunks, without a shuffle: per-row expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import line_count, strip
from ..schema import PAGE_DDL, VISUAL_DDL

HEADING = r"(?md)(?=^#{1,2}\s+)"
SPAN = "STRUCT<lo: INT, hi: INT>"
PART = "STRUCT<text: STRING, n: INT, lo: INT, hi: INT>"
CHUNK = f"STRUCT<text: STRING, n: INT, spans: ARRAY<{SPAN}>>"
PACK = f"STRUCT<done: ARRAY<{CHUNK}>, text: STRING, n: INT, spans: ARRAY<{SPAN}>>"


def needs_splitting(text: Column, max_lines: int) -> Column:
    _positive(max_lines)
    return line_count(text) > max_lines


def _positive(max_lines: int) -> None:
    if max_lines <= 0:
        raise ValueError("max_lines must be positive")


def sections(text: Column, heading: str = HEADING, clean: Callable[[Column, Column], Column] | None = None) -> Column:
    """array<PART>: the parts of a text that start at headings (of level 1 and 2) and are not blank, each with where it stands; without a heading none.

    heading matches the empty string before a heading; clean(part, whether it is the first) takes the place of strip(part).
    """
    start = F.expr(f"CAST(named_struct('parts', array(), 'at', 0) AS STRUCT<parts: ARRAY<{PART}>, at: INT>)")

    def step(acc: Column, part: Column) -> Column:
        text, end = clean(part, acc["at"] == 0) if clean else strip(part), acc["at"] + F.length(part)
        new = F.struct(text.alias("text"), line_count(text).alias("n"), acc["at"].alias("lo"), end.alias("hi")).cast(PART)
        return F.struct(F.when(text == "", acc["parts"]).otherwise(F.array_append(acc["parts"], new)).alias("parts"), end.alias("at")).cast(f"STRUCT<parts: ARRAY<{PART}>, at: INT>")

    found = F.aggregate(F.split(text, heading), start, step, lambda acc: acc["parts"])
    return F.when(F.regexp_like(text, F.lit(heading)), found).otherwise(F.array().cast(f"array<{PART}>"))


def heading_sections(text: Column, heading: str = HEADING, clean: Callable[[Column, Column], Column] | None = None) -> Column:
    """Texts of the sections; without a heading the text as it is."""
    found = F.transform(sections(text, heading, clean), lambda x: x["text"])
    return F.when(F.regexp_like(text, F.lit(heading)), found).otherwise(F.array(text))


def pack(parts: Column, max_lines: int, joiner: str = "\n\n") -> Column:
    """Greedy packing of array<PART>: a part that would exceed max_lines starts a new chunk; array<CHUNK>."""
    _positive(max_lines)
    start = F.expr(f"CAST(named_struct('done', array(), 'text', CAST(NULL AS STRING), 'n', 0, 'spans', array()) AS {PACK})")

    def closed(acc: Column) -> Column:
        return F.array_append(acc["done"], F.struct(acc["text"].alias("text"), acc["n"].alias("n"), acc["spans"].alias("spans")).cast(CHUNK))

    def step(acc: Column, part: Column) -> Column:
        full = acc["text"].isNotNull() & (acc["n"] + part["n"] > max_lines)
        fresh, span = full | acc["text"].isNull(), F.struct(part["lo"].alias("lo"), part["hi"].alias("hi"))
        return F.struct(
            F.when(full, closed(acc)).otherwise(acc["done"]).alias("done"), F.when(fresh, part["text"]).otherwise(F.concat(acc["text"], F.lit(joiner), part["text"])).alias("text"),
            F.when(fresh, part["n"]).otherwise(acc["n"] + part["n"]).alias("n"), F.when(fresh, F.array(span)).otherwise(F.array_append(acc["spans"], span)).alias("spans"),
        ).cast(PACK)

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["text"].isNull(), acc["done"]).otherwise(closed(acc)))


def line_blocks(text: Column, max_lines: int) -> Column:
    _positive(max_lines)
    lines = F.split(text, "\n", -1)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / max_lines).cast("int")), lambda i: F.array_join(F.slice(lines, i * max_lines + 1, F.lit(max_lines)), "\n"))


def page_packs(pages: Column, max_lines: int) -> Column:
    """Pages of a document packed in order, whole: array<array<page>>."""
    _positive(max_lines)
    kind = f"STRUCT<done: ARRAY<ARRAY<{PAGE_DDL}>>, now: ARRAY<{PAGE_DDL}>, n: INT>"
    start = F.expr(f"CAST(named_struct('done', array(), 'now', array(), 'n', 0) AS {kind})")

    def step(acc: Column, page: Column) -> Column:
        n = line_count(page["text"])
        full = (F.size(acc["now"]) > 0) & (acc["n"] + n > max_lines)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(full, F.array(page)).otherwise(F.array_append(acc["now"], page)).alias("now"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        ).cast(kind)

    return F.aggregate(pages, start, step, lambda acc: F.when(F.size(acc["now"]) == 0, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def chunks(pages: Column, max_lines: int) -> Column:
    """array<array<page>>: a document whole, by headings, by lines, or by pages. An image goes with the section that it stands in; line blocks have none."""
    _positive(max_lines)
    total = F.aggregate(pages, F.lit(0), lambda n, p: n + line_count(p["text"]))
    text, visuals, none = pages[0]["text"], pages[0]["visuals"], F.array().cast(f"ARRAY<{VISUAL_DDL}>")

    def one(text: Column, number: Column, visuals: Column) -> Column:
        return F.array(F.struct(number.cast("int").alias("number"), text.alias("text"), visuals.alias("visuals")).cast(PAGE_DDL))

    def inside(spans: Column) -> Column:
        return F.filter(visuals, lambda v: F.exists(spans, lambda s: (v["at"] >= s["lo"]) & (v["at"] < s["hi"])))

    parts = sections(text)
    by_heading = F.transform(pack(parts, max_lines), lambda c, i: one(c["text"], i, inside(c["spans"])))
    by_lines = F.transform(line_blocks(text, max_lines), lambda t, i: one(t, i, none))
    by_page = F.when(F.size(pages) > 1, page_packs(pages, max_lines)).when(F.size(parts) > 1, by_heading).otherwise(by_lines)
    return F.when(total <= max_lines, F.array(pages)).otherwise(by_page)


def markdown_images(text: Column) -> Column:
    """array<struct<alt, src, data>> of image links."""
    link = r"!\[([^\]]*)\]\(([^)]+)\)"
    alts, srcs = (F.regexp_extract_all(text, F.lit(link), F.lit(g)) for g in (1, 2))
    return F.zip_with(alts, srcs, lambda a, s: F.struct(a.alias("alt"), s.alias("src"), F.concat(F.lit("alt="), a, F.lit(", src="), s).alias("data")))
