"""Benchmark reports: a table for the console, a JSON file."""

from __future__ import annotations

import json
from pathlib import Path

#: From which share of expected keywords a score is good, and from which fair.
GOOD, FAIR = 0.7, 0.4


def grade(score: float) -> str:
    return "good" if score >= GOOD else "fair" if score >= FAIR else "poor"


def table(head: tuple[str, ...], rows: list[tuple]) -> list[str]:
    cells = [head, *[tuple(str(x) for x in r) for r in rows]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(head))]
    return ["  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in cells]


def text(report: dict) -> str:
    """Summary, scores by category in order of name, and one row per question."""
    mean, questions = report["avg_keyword_score"], report["questions"]
    counts = {c: sum(q["category"] == c for q in questions) for c in report["category_scores"]}
    lines = [
        f"Data set {report['dataset']}: {report['compile_doc_count']} documents, {report['total_questions']} questions, compiled in {report['compile_time_s']:.1f} s",
        f"Mean keyword score {mean:.1%} ({grade(mean)}), latency {report['avg_latency_ms']:.0f} ms, tokens {report['avg_tokens']:.0f}", "",
        *table(("category", "score", "grade", "questions"), [(c, f"{s:.1%}", grade(s), counts[c]) for c, s in sorted(report["category_scores"].items())]), "",
        *table(("id", "category", "score", "grade", "latency", "tokens", "keywords"), [(q["id"], q["category"], f"{q['keyword_score']:.0%}", grade(q["keyword_score"]), f"{q['latency_ms']:.0f} ms", q["token_estimate"], f"{len(q['matched_keywords'])}/{len(q['expected_keywords'])}") for q in questions]),
    ]
    return "\n".join(lines)


def save(report: dict, path: str) -> None:
    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    where.write_text(json.dumps(report, indent=2, ensure_ascii=False), "utf-8")
