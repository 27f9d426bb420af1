"""Records as Parquet in buckets by id, with YAML for exchange, and the audit log."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import upsert
from ..schema import CKU_DDL, EVENT_DDL

BUCKETS = 64


class Store:
    """A manifest says which folder holds each bucket; a write makes new folders of the buckets that it touches, then a new manifest.

    The manifest with the highest number counts; it is written whole under another name first. One writer at a time.
    Folders that neither the present nor the last manifest names are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets, self._last = spark, root.rstrip("/"), buckets, 0

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(n for s in fs.listStatus(where) if not (n := s.getPath().getName()).startswith((".", "_"))) if fs.exists(where) else []

    def manifest(self, back: int = 0) -> tuple[int, dict]:
        """Number and content of the present manifest, or of one before it: {buckets, folders: {bucket: folder}}."""
        names = self._names(f"{self.root}/manifests")
        if len(names) <= back:
            return 0, {"buckets": self.buckets, "folders": {}}
        name = names[-1 - back]
        return int(name.removesuffix(".json")), json.loads(self.spark.read.text(f"{self.root}/manifests/{name}", wholetext=True).first()[0])

    def _read(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/ckus/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(CKU_DDL).parquet(*paths) if paths else self.spark.createDataFrame([], CKU_DDL)

    def ckus(self) -> DataFrame:
        return self._read(self.manifest()[1]["folders"])

    def save(self, new: DataFrame) -> None:
        """Insert or replace by id. Only the buckets of the new ids are read and written."""
        number, m = self.manifest()
        bucket = F.pmod(F.xxhash64("id"), F.lit(m["buckets"]))
        folder = uuid.uuid4().hex
        columns = self._read({}).columns
        staged = f"{self.root}/incoming/{folder}"
        new.select(*columns).write.parquet(staged)
        new = self.spark.read.schema(CKU_DDL).parquet(staged)
        touched = [str(r[0]) for r in new.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
        old = self._read({b: f for b, f in m["folders"].items() if b in touched})
        if touched:
            upsert(old, new).withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/ckus/{folder}")
            text = json.dumps({"buckets": m["buckets"], "folders": {**m["folders"], **dict.fromkeys(touched, folder)}})
            self._publish(f"{self.root}/manifests/{number + 1:012d}.json", text)
            kept = {f for back in (0, 1) for f in self.manifest(back)[1]["folders"].values()}
            for name in self._names(f"{self.root}/ckus"):
                if name not in kept:
                    self._delete(f"{self.root}/ckus/{name}")
        self._delete(staged)

    def _publish(self, path: str, text: str) -> None:
        fs, where = self._fs(path)
        _, draft = self._fs(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text, "utf-8"))
        out.close()
        fs.mkdirs(where.getParent())
        if fs.exists(where) or not fs.rename(draft, where):
            raise RuntimeError(f"{path} was written by another")

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def load(self, cku_id: str) -> DataFrame:
        found = self.ckus().where(F.col("id") == cku_id)
        if found.isEmpty():
            raise FileNotFoundError(cku_id)
        return found

    def load_by_source(self, source: str) -> DataFrame:
        return self.ckus().where(F.col("meta.source") == source)

    def ids(self) -> DataFrame:
        return self.ckus().select("id")

    # --- audit ---

    def events(self) -> DataFrame:
        fs, where = self._fs(f"{self.root}/audit")
        return self.spark.read.schema(EVENT_DDL).parquet(f"{self.root}/audit") if fs.exists(where) else self.spark.createDataFrame([], EVENT_DDL)

    def log(self, event: str, details: dict, user: str | None = None) -> int:
        """Append one event. Its id is the time in microseconds, and above this writer's last one, so no event is read for it (single writer)."""
        self._last = max(self._last + 1, time.time_ns() // 1000)
        row = (self._last, datetime.now(timezone.utc).isoformat(), event, user, json.dumps(details, ensure_ascii=False))
        self.spark.createDataFrame([row], EVENT_DDL).coalesce(1).write.mode("append").parquet(f"{self.root}/audit")
        return self._last

    # --- YAML ---

    def export_yaml(self) -> DataFrame:
        """id, yaml"""
        from ..cluster import ship

        ship(self.spark)

        def run(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "yaml": [to_yaml(json.loads(x)) for x in pdf["j"]]})

        return self.ckus().select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).mapInPandas(run, "id string, yaml string")

    def import_yaml(self, texts: DataFrame) -> DataFrame:
        """texts (yaml): records."""
        from ..cluster import ship

        ship(self.spark)

        def run(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame({"j": [json.dumps(from_yaml(x), ensure_ascii=False) for x in pdf["yaml"]]})

        return texts.select("yaml").mapInPandas(run, "j string").select(F.from_json("j", CKU_DDL).alias("c")).select("c.*")


def to_yaml(record: dict) -> str:
    import yaml

    record = {**record, "visuals": [{**v, "structured_data": json.loads(v["structured_data"]) if v.get("structured_data") else None} for v in record.get("visuals") or []]}
    return yaml.dump(record, allow_unicode=True, sort_keys=False, default_flow_style=False)


def from_yaml(text: str) -> dict:
    """A record, its parts checked by type; ValueError says what is wrong."""
    import yaml

    record = yaml.safe_load(text)
    if not isinstance(record, dict):
        raise ValueError("a record must be a mapping")

    def want(where: str, x: object, kind: type | tuple[type, ...], optional: bool = False):
        if x is None and optional:
            return x
        if not isinstance(x, kind) or isinstance(x, bool):
            raise ValueError(f"{where}: {'missing' if x is None else 'wrong type ' + type(x).__name__}")
        return x

    def items(name: str) -> list[dict]:
        return [want(f"{name}[{i}]", x, dict) for i, x in enumerate(want(name, record.get(name, []), list))]

    def texts(where: str, xs: object) -> list[str]:
        return [want(f"{where}[{i}]", x, str) for i, x in enumerate(want(where, xs, list))]

    def source(where: str, x: object) -> dict:
        x = want(where, x, dict)
        return {"page": want(f"{where}.page", x.get("page"), int, True), "section": want(f"{where}.section", x.get("section"), str, True)}

    meta = {"language": "en", "access": {}, **want("meta", record.get("meta"), dict)}
    for name in ("source", "hash", "type", "language"):
        want(f"meta.{name}", meta.get(name), str)
    try:
        stamp = want("meta.compiled", meta.get("compiled"), (str, datetime))
        stamp = stamp if isinstance(stamp, datetime) else datetime.fromisoformat(stamp)
    except ValueError as e:
        raise ValueError(f"meta.compiled: {e}") from e
    meta = {**{k: meta[k] for k in ("source", "hash", "type", "language")}, "compiled": str(meta["compiled"]), "access": {"roles": texts("meta.access.roles", want("meta.access", meta["access"], dict).get("roles", []))}}
    head = want("summaries", record.get("summaries"), dict)
    sections = [{k: want(f"summaries.sections[{i}].{k}", want(f"summaries.sections[{i}]", s, dict).get(k), str) for k in ("id", "title", "summary")} for i, s in enumerate(want("summaries.sections", head.get("sections", []), list))]
    out = {"id": record.get("id"), "meta": meta, "summaries": {"document": want("summaries.document", head.get("document"), str), "sections": sections}, "entities": [], "facts": [], "visuals": [], "dependencies": texts("dependencies", record.get("dependencies", []))}
    for i, e in enumerate(items("entities")):
        relations = [{k: want(f"entities[{i}].relations.{k}", want("relation", r, dict).get(k), str) for k in ("target", "type")} for r in want(f"entities[{i}].relations", e.get("relations", []), list)]
        out["entities"].append({**{k: want(f"entities[{i}].{k}", e.get(k), str) for k in ("id", "name", "type")}, "relations": relations})
    for i, f in enumerate(items("facts")):
        out["facts"].append({**{k: want(f"facts[{i}].{k}", f.get(k), str) for k in ("id", "claim")}, "source": source(f"facts[{i}].source", f.get("source")), "confidence": float(want(f"facts[{i}].confidence", f.get("confidence", 1.0), (int, float))), "entities": texts(f"facts[{i}].entities", f.get("entities", []))})
    for i, v in enumerate(items("visuals")):
        data = want(f"visuals[{i}].structured_data", v.get("structured_data"), dict, True)
        out["visuals"].append({**{k: want(f"visuals[{i}].{k}", v.get(k), str) for k in ("id", "type", "description")}, "source": source(f"visuals[{i}].source", v.get("source")), "structured_data": None if data is None else json.dumps(data, ensure_ascii=False), "context": want(f"visuals[{i}].context", v.get("context"), str, True)})
    return out
