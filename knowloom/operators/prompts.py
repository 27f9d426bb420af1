"""Prompts of many questions from few documents: each document's lines are written once, and prompts are put together from there.

A long document answers many questions, so the prompts together hold its text many times. No prompt and no copy of a
text is shuffled: tasks hold lists of documents and read the documents' lines by range.
"""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs

#: Bytes of documents' lines that a task keeps, and bytes of prompts that it gives on at a time.
KEPT_BYTES, OUT_BYTES = 64 << 20, 8 << 20
PLACES = pa.schema([("cku_id", pa.string()), ("source", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("sizes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
PLACE = "cku_id string, source string, path string, at long, sizes array<long>, counts array<long>"
PROMPTS = pa.schema([("qid", pa.int64()), ("prompt", pa.string())])
TITLES = ("## Relevant Summaries", "\n## Relevant Facts", "\n## Visual Knowledge")


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI or local path, and the path in it."""
    root = "file://" + root.removeprefix("file:") if root.startswith("file:/") and not root.startswith("file://") else root
    return pafs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (pafs.LocalFileSystem(), root)


def write(root: str):
    """Rows (cku_id, source, parts: lines of each part or null, counts) to files under root; a row of PLACES for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{root}/{uuid.uuid4().hex}"
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    cku_id, source, parts, counts = (c[i].as_py() for c in batch.columns)
                    if out is None:
                        fs, path = opened(root)
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(opened(name)[1])
                    packed = [b"" if p is None else zlib.compress(p.encode("utf-8", "surrogatepass"), 1) for p in parts]
                    rows.append({"cku_id": cku_id, "source": source, "path": name, "at": at, "sizes": [len(p) for p in packed], "counts": counts})
                    at += sum(map(len, packed))
                    out.write(b"".join(packed))
                yield pa.RecordBatch.from_pylist(rows, schema=PLACES)
        finally:
            if out is not None:
                out.close()

    return run, PLACE


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (qid, ds: list of rank, path, at, sizes, counts by rank) to (qid, prompt)."""
    kept: OrderedDict[tuple[str, int], list[str | None]] = OrderedDict()
    sizes: dict[tuple[str, int], int] = {}
    files: dict[str, pa.NativeFile] = {}
    held = 0

    def lines(d: dict) -> list[str | None]:
        nonlocal held
        key = d["path"], d["at"]
        if key in kept:
            kept.move_to_end(key)
            return kept[key]
        if d["path"] not in files:
            fs, path = opened(d["path"])
            files[d["path"]] = fs.open_input_file(path)
        f = files[d["path"]]
        f.seek(d["at"])
        raw, parts = f.read(sum(d["sizes"])), []
        for n in d["sizes"]:
            parts.append(zlib.decompress(raw[:n]).decode("utf-8", "surrogatepass") if n else None)
            raw = raw[n:]
        kept[key], sizes[key] = parts, sum(4 * len(p) for p in parts if p)
        held += sizes[key]
        while held > KEPT_BYTES and len(kept) > 1:
            held -= sizes.pop(kept.popitem(last=False)[0])
        return parts

    try:
        for batch in batches:
            qids, prompts, size = [], [], 0
            for i in range(batch.num_rows):
                ds = batch.column(1)[i].as_py()
                texts = [lines(d) for d in ds]
                said = []
                for part, title in enumerate(TITLES):
                    if any(d["counts"][part] for d in ds):
                        said += [title, *(t[part] for t in texts if t[part] is not None)]
                qids.append(batch.column(0)[i].as_py())
                prompts.append("\n".join(said))
                size += len(prompts[-1])
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(prompts, pa.string())], schema=PROMPTS)
                    qids, prompts, size = [], [], 0
            if qids:
                yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(prompts, pa.string())], schema=PROMPTS)
    finally:
        for f in files.values():
            f.close()
