"""Identity of sources and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(source: Column) -> Column:
    """The last path part without its last suffix; a leading or trailing dot starts no suffix."""
    name = F.regexp_extract(F.regexp_replace(source, r"/+$", ""), r"([^/]*)$", 1)
    cut = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(cut == "", name).otherwise(cut)


def source_to_id(source: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem(source)), r"[^\p{L}\p{N}-]", "-"), r"^-+|-+$", "")
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(source, 256), 1, 8))


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)
