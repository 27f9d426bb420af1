"""Extraction providers: an interface, HTTP clients, and a rule-based provider that needs no network."""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.request
from typing import Any, Protocol

FENCE = re.compile(r"^```(?:json)?\s*\n?(.*?)\n?\s*```$", re.S)
COMPILE_PROMPT = """Read the document below and return one JSON object, and nothing else, with the keys
summaries {document, sections [{id, title, summary}]}, entities [{id, name, type, relations [{target, type}]}],
facts [{id, claim, source {page, section}, confidence, entities [id]}], visuals [{id, type, source, description,
structured_data, context}], dependencies [name] and language (ISO code).

"""
ANSWER_PROMPT = "Answer the question from the knowledge below only, and name the sources.\n\n{context}\n\nQuestion: {question}\n"


class Provider(Protocol):
    def compile_document(self, doc: dict) -> dict: ...
    def answer_query(self, question: str, context: str) -> str: ...
    def get_name(self) -> str: ...


def render(doc: dict) -> str:
    """A document's pages as text for a prompt, each page followed by a list of its visuals. doc: {pages: [{number, text, visuals: [{type, data}]}]}."""

    def listed(visuals: list[dict]) -> str:
        rows = (f"* {v['type']}: {v['data']}" if v.get("data") else f"* {v['type']}" for v in visuals)
        return "\n\nVisuals:\n" + "\n".join(rows) if visuals else ""

    return "\n\n".join(f"[page {p['number']}]\n{p['text'].strip()}{listed(p.get('visuals') or [])}" for p in doc["pages"])


def unfenced(text: str) -> str:
    m = FENCE.match(text.strip())
    return m[1].strip() if m else text.strip()


def parse_response(raw: str, context: str = "response") -> dict:
    try:
        out = json.loads(unfenced(raw))
    except ValueError as e:
        raise ValueError(f"{context}: invalid JSON: {raw[:500]}") from e
    if not isinstance(out, dict):
        raise ValueError(f"{context}: expected a JSON object, got {type(out).__name__}")
    return out


class HttpProvider:
    """Posts prompts as JSON; subclasses say what to send and where the text is in the reply."""

    def __init__(self, url: str, model: str, timeout: float = 300.0):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def _post(self, path: str, body: dict, headers: dict[str, str] | None = None) -> dict:
        request = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
                return json.load(reply)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{self.get_name()} answered {e.code}") from e
        except TimeoutError as e:
            raise RuntimeError(f"{self.get_name()} timed out after {self.timeout} s") from e
        except urllib.error.URLError as e:
            raise RuntimeError(f"cannot reach {self.url}: {e.reason}") from e

    def _generate(self, prompt: str, limit: int) -> str:
        raise NotImplementedError

    def get_name(self) -> str:
        raise NotImplementedError

    def compile_document(self, doc: dict) -> dict:
        return parse_response(self._generate(COMPILE_PROMPT + render(doc), 8192), self.get_name())

    def answer_query(self, question: str, context: str) -> str:
        return self._generate(ANSWER_PROMPT.format(context=context, question=question), 2048)


class LocalProvider(HttpProvider):
    def __init__(self, model: str = "llama3.1", url: str = "http://localhost:11434", timeout: float = 300.0):
        super().__init__(url, model, timeout)

    def get_name(self) -> str:
        return f"local/{self.model}"

    def _generate(self, prompt: str, limit: int) -> str:
        return self._post("/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0.1, "num_predict": 8192}}).get("response", "")


class CloudProvider(HttpProvider):
    """A chat-completions service; its key is needed when it is built."""

    def __init__(self, model: str, url: str, api_key: str | None = None, timeout: float = 300.0):
        super().__init__(url, model, timeout)
        self.key = api_key or os.environ.get("KNOWLOOM_API_KEY")
        if not self.key:
            raise ValueError("an API key is needed (KNOWLOOM_API_KEY)")

    def get_name(self) -> str:
        return f"cloud/{self.model}"

    def _generate(self, prompt: str, limit: int) -> str:
        reply = self._post("/v1/chat/completions", {"model": self.model, "max_tokens": limit, "messages": [{"role": "user", "content": prompt}]}, {"Authorization": f"Bearer {self.key}"})
        return reply["choices"][0]["message"]["content"]


class RuleProvider:
    """Ours, for tests and runs without a network: headings are sections, sentences of three words or more facts, their capitalised words entities."""

    def get_name(self) -> str:
        return "rules"

    def compile_document(self, doc: dict) -> dict[str, Any]:
        out: dict[str, Any] = {"summaries": {"document": "", "sections": []}, "entities": [], "facts": [], "visuals": [], "dependencies": [], "language": doc.get("language", "en")}
        names: dict[str, None] = {}
        for page in doc["pages"]:
            for block in re.split(r"(?m:^(?=#))", page["text"]):
                if m := re.match(r"#+[ \t]+(\S.*)", block):
                    slug = re.sub(r"\W+", "-", m[1].lower()).strip("-")
                    out["summaries"]["sections"].append({"id": slug, "title": m[1].strip(), "summary": block[m.end() :].strip()[:200]})
                    block = block[m.end() :]
                for s in re.split(r"(?<=[.!?])\s+|\n", block):
                    if len(s.split()) >= 3:
                        found = list(dict.fromkeys(w for w in re.findall(r"\w+", s) if len(w) >= 3 and w[0].isupper()))
                        names.update(dict.fromkeys(found))
                        out["facts"].append({"id": f"{page['number']}-{len(out['facts']) + 1}", "claim": s.strip(), "source": {"page": page["number"]}, "entities": [n.lower() for n in found]})
            for v in page.get("visuals") or []:
                out["visuals"].append({"id": f"v{page['number']}-{len(out['visuals']) + 1}", "type": v["type"], "source": {"page": page["number"]}, "description": v.get("data") or v["type"]})
        out["entities"] = [{"id": n.lower(), "name": n, "type": "concept", "relations": []} for n in names]
        out["summaries"]["document"] = out["facts"][0]["claim"] if out["facts"] else ""
        return out

    def answer_query(self, question: str, context: str) -> str:
        return context


PROVIDERS = {"rules": RuleProvider, "local": LocalProvider, "cloud": CloudProvider}


def get_provider(name: str, **options: Any) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    kind = PROVIDERS[name]
    known = kind.__init__.__code__.co_varnames[1 : kind.__init__.__code__.co_argcount] if "__init__" in kind.__dict__ else ()
    return kind(**{k: v for k, v in options.items() if k in known and v is not None})
