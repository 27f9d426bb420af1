"""Command line: compile, query, watch, serve, audit, bench, info, validate."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__, report
from .operators import kmap, records
from .plans.engine import Asker, Compiler, benchmark
from .schema import CKU_DDL
from .sources.files import load_config
from .sources.store import from_yaml
from .streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("knowloom")
    p.add_argument("--version", "-V", action="version", version=f"knowloom {__version__}")
    p.add_argument("--config", help="configuration file; config.yaml in the store if not given")
    sub = p.add_subparsers(dest="do", required=True)

    def command(name: str, *where: str, provider: bool = False, **kw) -> argparse.ArgumentParser:
        q = sub.add_parser(name, **kw)
        for w in where:
            q.add_argument(w.rstrip("?"), nargs="?" if w.endswith("?") else None)
        q.add_argument("--store", "-s", help="the store's folder")
        if provider:
            q.add_argument("--provider", "-p")
            q.add_argument("--model", "-m")
        return q

    q = command("compile", "path", provider=True)
    q.add_argument("--force", "-f", action="store_true")
    q.add_argument("--roles", "-r", help="names, by commas")
    q.add_argument("--verbose", "-v", action="store_true")
    q = command("query", "question", provider=True)
    q.add_argument("--top-k", "-k", type=int)
    q.add_argument("--role")
    q.add_argument("--sources", action=argparse.BooleanOptionalAction, default=True)
    q.add_argument("--stats", action="store_true")
    q = command("watch", "path", provider=True)
    q.add_argument("--debounce", type=int, default=1000, help="milliseconds")
    q = command("serve", provider=True)
    q.add_argument("--host", default="127.0.0.1")
    q.add_argument("--port", type=int, default=8484)
    q = command("audit")
    q.add_argument("--event", "-e")
    q.add_argument("--limit", "-n", type=int, default=20)
    q.add_argument("--offset", type=int, default=0)
    q = command("bench", "path", provider=True)
    q.add_argument("--force", action=argparse.BooleanOptionalAction, default=True)
    q.add_argument("--output", "-o", help="a JSON file")
    command("info")
    command("validate", "target?", help="a YAML file, a folder of them, or the store")
    return p


def compile_(spark: SparkSession, config, a) -> int:
    roles = None if a.roles is None else [r.strip() for r in a.roles.split(",") if r.strip()]
    out = Compiler(spark, config).compile(a.path, a.force, roles)
    counts = {r[0]: r[1] for r in out.groupBy("status").count().collect()}
    for r in out.where("status = 'failed'" if not a.verbose else "true").orderBy("status", "source").toLocalIterator():
        print(f"  {r.status}: {r.source}" + (f": {r.error}" if r.error else ""))
    print(f"{sum(counts.values())} documents: " + ", ".join(f"{counts.get(s, 0)} {s}" for s in ("compiled", "skipped", "failed")))
    return int("failed" in counts)


def query(spark: SparkSession, config, a) -> int:
    got = Asker(spark, config).query(a.question, a.role, a.top_k)
    print(got["answer"])
    if a.sources and got["sources"]:
        print("\nSources:", *(f"  {s}" for s in got["sources"]), sep="\n")
    if a.stats:
        print(f"\n{len(got['ckus'])} records, about {got['tokens'] or 0} tokens, provider {config.provider}/{config.model or '-'}")
    return 0


def validate(spark: SparkSession, config, a) -> int:
    """Records of YAML files, or of the store, by type and by meaning."""
    bad = 0
    if a.target:
        target = Path(a.target)
        if not target.exists():
            raise FileNotFoundError(a.target)
        named = [target] if target.is_file() else sorted(target.glob("*.yaml"))
        rows = []
        for f in named:
            try:
                rows.append({**from_yaml(f.read_text("utf-8")), "id": f.name})
            except Exception as e:  # noqa: BLE001 - one file's error is its own
                bad += 1
                print(f"  {f.name}: {e}")
        checked, n = spark.createDataFrame(rows, CKU_DDL), len(named)
    else:
        checked = Compiler(spark, config).store.ckus()
        n = checked.count()
    found = records.issues(checked).groupBy("id").agg(F.array_sort(F.collect_list("issue")).alias("issues")).orderBy("id")
    for r in found.toLocalIterator():
        bad += 1
        print(*(f"  {r.id}: {x}" for x in r.issues), sep="\n")
    print(f"{n} records: {n - bad} valid, {bad} invalid")
    return int(bad > 0)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = load_config(a.store, a.config)
    config = replace(config, **{k: v for k in ("provider", "model") if (v := getattr(a, k, None))})
    spark = SparkSession.builder.appName("knowloom").getOrCreate()
    if a.do == "compile":
        return compile_(spark, config, a)
    if a.do == "query":
        return query(spark, config, a)
    if a.do == "validate":
        return validate(spark, config, a)
    store = Compiler(spark, config).store
    if a.do == "watch":
        watch(spark, a.path, lambda paths: Compiler(spark, config).compile(paths), f"{config.store_dir}/watch", a.debounce).awaitTermination()
    elif a.do == "serve":
        from .server import create_server

        server = create_server(spark, config, a.host, a.port)
        print(f"http://{a.host}:{server.server_port}")
        server.serve_forever()
    elif a.do == "audit":
        events = store.events()
        for r in records.list_events(events, a.event, a.limit, a.offset).collect():
            print(r.id, r.timestamp, r.event, r.user or "-", r.details)
        print(f"{records.count_events(events, a.event).first()[0]} events")
    elif a.do == "bench":
        out, _ = benchmark(spark, config, a.path, a.force)
        print(report.text(out))
        if a.output:
            report.save(out, a.output)
    elif a.do == "info":
        said = {"version": __version__, "store": config.store_dir, "provider": config.provider, "model": config.model, "max_section_lines": config.max_section_lines, **kmap.stats(store.ckus()).first().asDict(), "events": records.count_events(store.events()).first()[0]}
        print(json.dumps(said, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
