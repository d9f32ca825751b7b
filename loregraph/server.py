"""The application over HTTP: ``route`` answers a request as plain values, ``serve`` puts it behind a socket.

GET /node/PATH, /context?files=A,B, /impact/PATH?exports=X,Y, /consumers/FILE/FUNCTION, /overview; POST /query
{"question": ...}, /refresh {"path": ...}. ``repo`` is a parameter of each, or the server's default. Answers are
JSON; context is markdown unless format=json, impact the other way round. Errors are JSON with 400, 404 or 500.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from loregraph.api import Engine, NotFound
from loregraph.errors import LoreError

JSON, MARKDOWN = "application/json", "text/markdown"


def _error(status: int, message: str, **more) -> tuple[int, str, str]:
    return status, JSON, json.dumps({"error": message, **more})


def route(engine: Engine, method: str, url: str, body: str = "", repo: str | None = None) -> tuple[int, str, str]:
    """(status, type, body) of a request."""
    parts = urlsplit(url)
    asked = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    path = unquote(parts.path)
    kind, _, rest = path.lstrip("/").partition("/")
    given: dict = {}
    if method == "POST":
        try:
            given = json.loads(body or "{}")
        except ValueError:
            return _error(400, "the body isn't JSON")
        if not isinstance(given, dict):
            return _error(400, "the body isn't an object")
    repo = given.get("repo") or asked.get("repo") or repo
    many = lambda v: [x.strip() for x in (v or "").split(",") if x.strip()]
    answer = lambda v: (200, JSON, json.dumps(v, default=str))
    try:
        if (method, kind) == ("POST", "query") and not rest:
            question = given.get("question") or given.get("query")
            if not isinstance(question, str) or not question.strip():
                return _error(400, "no question")
            found = engine.query(question, repo)
            return answer({"mode": "candidates", "candidates": found} if isinstance(found, list) else found)
        if not isinstance(repo, str) or not repo:
            return _error(400, "no repository")
        if (method, kind) == ("POST", "refresh") and not rest:
            if not isinstance(given.get("path"), str) or not given["path"]:
                return _error(400, "no path")
            return answer({"path": engine.node(repo, given["path"])["path"], "note": "files are read anew by the extraction step"})
        if method != "GET":
            return _error(404, f"nothing at {method} {path}")
        if kind == "node" and rest:
            return answer(engine.node(repo, rest))
        if kind == "context" and not rest:
            files = many(asked.get("files"))
            if not files:
                return _error(400, "no files asked for")
            form = "json" if asked.get("format") == "json" else "markdown"
            found = engine.context(repo, files, form)
            return answer(found) if form == "json" else (200, MARKDOWN, found)
        if kind == "impact" and rest:
            form = "markdown" if asked.get("format") == "markdown" else "json"
            found = engine.impact(repo, rest, form, many(asked.get("exports")) or None)
            return answer(found) if form == "json" else (200, MARKDOWN, found)
        if kind == "consumers" and "/" in rest:
            file, _, name = rest.rpartition("/")
            return answer(engine.consumers(repo, f"{file}:{name}"))
        if kind == "overview" and not rest:
            return answer(engine.overview(repo))
    except NotFound as e:
        return _error(404, str(e), **({"suggestions": e.suggestions} if e.suggestions else {}))
    except (ValueError, LoreError) as e:
        return _error(400 if isinstance(e, ValueError) else 500, str(e))
    except Exception as e:  # noqa: BLE001 - a request must not end the server
        return _error(500, str(e).split("\n")[0])
    return _error(404, f"nothing at {method} {path}")


def serve(engine: Engine, port: int = 8080, repo: str | None = None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound, but not yet running: ``serve_forever`` runs it. Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, kind, text = route(engine, self.command, self.path, body, repo)
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
