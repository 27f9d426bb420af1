"""Tolerant reading of extracted JSON: what does not fit is defaulted or marked, item by item. One chunk in, one typed row out."""

from __future__ import annotations

import json
from typing import Any

INT32 = 1 << 31


def _dicts(x: Any) -> list[dict]:
    return [i for i in x if isinstance(i, dict)] if isinstance(x, list) else []


def lax_int(x: Any) -> int | None:
    """A 32-bit int, or what plainly is one: whole floats, booleans, and text of either. ValueError otherwise."""
    if x is None:
        return None
    if isinstance(x, str):
        try:
            y: Any = int(x.strip())
        except ValueError:
            y = float(x)
    else:
        y = x
    if isinstance(y, (bool, int)) or isinstance(y, float) and y.is_integer():
        if -INT32 <= int(y) < INT32:
            return int(y)
    raise ValueError(f"not an integer: {x!r}")


def source_ref(x: Any) -> dict:
    if not isinstance(x, dict):
        return {"page": None, "section": None}
    section = x.get("section")
    if section is not None and not isinstance(section, str):
        raise ValueError("section must be text")
    return {"page": lax_int(x.get("page")), "section": section}


def key(item: dict) -> str | None:
    """An item's id for merging, of any JSON type; null where there is none."""
    return json.dumps(item["id"], sort_keys=True) if item.get("id") else None


def section(s: dict) -> dict:
    said = {k: s.get(k) for k in ("id", "title", "summary")}
    return {"ok": all(isinstance(v, str) for v in said.values()), **{k: v if isinstance(v, str) else None for k, v in said.items()}}


def entity(e: dict) -> dict:
    relations = [{"target": r["target"], "type": r["type"]} for r in _dicts(e.get("relations")) if isinstance(r.get("target"), str) and isinstance(r.get("type"), str)]
    return {"ok": True, "id": str(e.get("id", "")), "name": str(e.get("name", "")), "type": str(e.get("type", "concept")), "relations": relations}


def fact(f: dict) -> dict:
    try:
        source = source_ref(f.get("source"))
    except (ValueError, OverflowError):
        return {"ok": False}
    try:
        confidence = float(f.get("confidence", 1.0))
    except (TypeError, ValueError, OverflowError):
        confidence = 1.0
    named = f.get("entities")
    return {"ok": True, "id": str(f.get("id", "")), "claim": str(f.get("claim", "")), "source": source, "confidence": confidence, "entities": [str(e) for e in named] if isinstance(named, list) else []}


def visual(v: dict) -> dict:
    context, data = v.get("context"), v.get("structured_data")
    try:
        source = source_ref(v.get("source"))
    except (ValueError, OverflowError):
        return {"ok": False}
    if context is not None and not isinstance(context, str):
        return {"ok": False}
    return {"ok": True, "id": str(v.get("id", "")), "type": str(v.get("type", "image")), "source": source, "description": str(v.get("description", "")), "structured_data": json.dumps(data, ensure_ascii=False) if isinstance(data, dict) else None, "context": context}


def chunk(raw: dict) -> dict:
    """A chunk's typed row (schema CHUNK_DDL). document is its summary, said the same where there is one; a language that is no text is null."""
    head = raw["summaries"] if isinstance(raw.get("summaries"), dict) else {}
    named, language = raw.get("dependencies"), raw.get("language", "en")
    read = lambda f, xs: [{"key": key(x), **f(x)} for x in _dicts(xs)]
    return {
        "document": str(head.get("document", "")), "said": str(head["document"]) if head.get("document") else None, "language": language if isinstance(language, str) else None,
        "dependencies": [str(d) for d in named if d is not None] if isinstance(named, list) else [],
        "sections": read(section, head.get("sections")), "entities": read(entity, raw.get("entities")), "facts": read(fact, raw.get("facts")), "visuals": read(visual, raw.get("visuals")),
    }
