"""The HTTP service, the HTTP providers against a mock server, the command line and the benchmark report."""

import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from knowloom import __main__ as cli
from knowloom import report
from knowloom.operators import providers
from knowloom.server import create_server
from knowloom.sources.files import Config


def running(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}"


def call(url, body=None, kind="application/json"):
    """Status and JSON of a request."""
    data = json.dumps(body).encode() if isinstance(body, (dict, list)) else body
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": kind} if data is not None else {})) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def send(url, name, content, field="file"):
    body = b"--B\r\nContent-Disposition: form-data; name=\"" + field.encode() + b"\"; filename=\"" + name.encode() + b"\"\r\nContent-Type: text/markdown\r\n\r\n" + content + b"\r\n--B--\r\n"
    return call(url, body, "multipart/form-data; boundary=B")


def test_service(spark, tmp_path):
    server = create_server(spark, Config(store_dir=str(tmp_path / "s")), port=0)
    url = running(server)
    assert call(f"{url}/health")[1]["status"] == "ok" and call(f"{url}/none")[0] == 404
    assert call(f"{url}/knowledge")[1] == {"total_ckus": 0, "stats": {"ckus": 0, "entities": 0, "facts": 0, "relations": 0, "topics": 0}, "ckus": []}
    text = b"# Branches\nUse Git branches for each Feature always."
    assert send(f"{url}/compile?roles=hr,%20admin&user=ann", "git.md", text)[1]["status"] == "compiled"
    assert send(f"{url}/compile", "git.md", text)[1]["status"] == "skipped"
    assert send(f"{url}/compile", "../up/git.md", text + b"\nMore Text stands here now.")[1] == {"status": "compiled", "filename": "git.md", "message": "git.md was compiled"}
    assert send(f"{url}/compile", "bad.md", b"\xff\xfe")[1]["status"] == "failed"
    assert send(f"{url}/compile", "x.txt", b"x")[0] == 400 and call(f"{url}/compile", b"nothing", "text/plain")[0] == 422
    known = call(f"{url}/knowledge")[1]
    assert known["total_ckus"] == 1 and known["ckus"][0]["source"] == "git.md" and known["ckus"][0]["roles"] == ["hr", "admin"] and known["ckus"][0]["fact_count"] == 2
    status, got = call(f"{url}/query", {"question": "Which branches does git use?", "user_role": "hr"})
    assert status == 200 and got["sources"] == ["git.md"] and got["routed_ckus"] == [known["ckus"][0]["id"]] and got["token_estimate"] > 5
    assert call(f"{url}/query", {"question": "git branches"})[1]["sources"] == []
    for body in ({"question": "x", "top_k": 0}, {"question": "x", "top_k": 51}, {"top_k": 3}, [1]):
        assert call(f"{url}/query", body)[0] == 422
    events = call(f"{url}/audit?event_type=query&limit=1")[1]
    assert events["total"] == 2 and len(events["events"]) == 1 and events["events"][0]["details"]["question"] == "git branches"
    assert call(f"{url}/audit?event_type=compile")[1]["events"][-1]["user"] == "ann" and call(f"{url}/audit?limit=501")[0] == 422
    server.shutdown()


class Model(BaseHTTPRequestHandler):
    """Answers as the two kinds of model services do; remembers what was asked."""

    seen: list = []
    status = 200

    def log_message(self, *_):
        pass

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Model.seen.append((self.path, body, self.headers.get("Authorization")))
        said = '```json\n{"language": "fr"}\n```'
        out = {"response": said} if self.path == "/api/generate" else {"choices": [{"message": {"content": said}}]}
        self.send_response(Model.status)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())


def test_http_providers():
    url = running(HTTPServer(("127.0.0.1", 0), Model))
    doc = {"pages": [{"number": 3, "text": " hello ", "visuals": [{"type": "image", "data": "alt=a"}, {"type": "table", "data": None}]}]}
    local, cloud = providers.get_provider("local", model="m", url=url), providers.get_provider("cloud", model="big", url=url, api_key="k")
    assert local.compile_document(doc) == cloud.compile_document(doc) == {"language": "fr"}
    (path, body, _), (other, chat, key) = Model.seen
    assert path == "/api/generate" and body["stream"] is False and body["options"] == {"temperature": 0.1, "num_predict": 8192} and body["model"] == "m"
    assert body["prompt"].endswith("[page 3]\nhello\n\nVisuals:\n* image: alt=a\n* table")
    assert other == "/v1/chat/completions" and key == "Bearer k" and chat["max_tokens"] == 8192
    assert "fr" in cloud.answer_query("why", "because") and Model.seen[-1][1]["max_tokens"] == 2048
    Model.status = 500
    with pytest.raises(RuntimeError, match="answered 500"):
        local.answer_query("q", "c")
    with pytest.raises(RuntimeError, match="cannot reach"):
        providers.get_provider("local", url="http://127.0.0.1:1").answer_query("q", "c")
    with pytest.raises(ValueError, match="key"):
        providers.CloudProvider("m", url)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d/docs").mkdir(parents=True)
    (tmp_path / "d/docs/a.md").write_text("# Git\nUse Git branches for each Feature always.")
    (tmp_path / "d/docs/b.md").write_bytes(b"\xff")
    store = ["-s", str(tmp_path / "s")]
    run = lambda *args: (cli.main([args[0], *store, *args[1:]]), capsys.readouterr().out)
    code, out = run("compile", str(tmp_path / "d/docs"), "-r", "hr")
    assert code == 1 and "2 documents: 1 compiled, 0 skipped, 1 failed" in out and "b.md: UnicodeDecodeError" in out
    (tmp_path / "d/docs/b.md").unlink()
    code, out = run("compile", str(tmp_path / "d/docs"), "-v")
    assert code == 0 and "skipped: " in out
    code, out = run("query", "git branches", "--role", "hr", "--stats")
    assert "Git branches" in out and "Sources:" in out and "1 records" in out
    assert "Sources:" not in run("query", "git branches", "--role", "hr", "--no-sources")[1]
    assert json.loads(run("info")[1])["facts"] == 1 and "4 events" in run("audit", "-n", "1")[1]
    assert run("validate") [0] == 0
    good = "meta: {source: a, compiled: 2024-01-01T00:00:00, hash: h, type: markdown}\nsummaries: {document: d}\n"
    (tmp_path / "a.yaml").write_text(good)
    (tmp_path / "b.yaml").write_text(good.replace("hash: h", "hash: ''"))
    (tmp_path / "c.yaml").write_text("meta: 3\n")
    code, out = run("validate", str(tmp_path))
    assert code == 1 and "b.yaml: meta.hash is empty" in out and "c.yaml: meta" in out and "3 records: 1 valid, 2 invalid" in out
    assert run("validate", str(tmp_path / "a.yaml"))[0] == 0
    (tmp_path / "d/questions.json").write_text(json.dumps([{"id": "q1", "question": "git branches", "expected_keywords": ["Feature", "nope"]}]))
    out = run("bench", str(tmp_path / "d"), "-o", str(tmp_path / "x/y.json"))[1]
    assert "q1" in out and json.loads((tmp_path / "x/y.json").read_text())["questions"][0]["id"] == "q1"
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_report_text():
    q = {"id": "1", "question": "?", "category": "b", "keyword_score": 0.5, "latency_ms": 12.4, "token_estimate": 7, "matched_keywords": ["x"], "expected_keywords": ["x", "y"]}
    out = report.text({"dataset": "d", "total_questions": 2, "compile_time_s": 1.0, "compile_doc_count": 3, "avg_keyword_score": 0.75, "avg_latency_ms": 10.0, "avg_tokens": 5.0, "category_scores": {"b": 0.5, "a": 1.0}, "questions": [q, {**q, "id": "2", "category": "a", "keyword_score": 1.0}]})
    lines = out.split("\n")
    assert "75.0% (good)" in lines[1] and lines[4].split() == ["a", "100.0%", "good", "1"] and lines[5].split() == ["b", "50.0%", "fair", "1"]
    assert lines[8].split() == ["1", "b", "50%", "fair", "12", "ms", "7", "1/2"]
    assert [report.grade(x) for x in (0.7, 0.69, 0.4, 0.39)] == ["good", "fair", "fair", "poor"]
