"""The HTTP text model against a server of our own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loregraph.prose import model
from loregraph.prose.http import HttpModel, ModelError, proxy_for


@pytest.fixture
def server():
    asked, replies = [], []

    class H(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = replies.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1", asked, replies
    s.shutdown()
    s.server_close()


def test_calls_and_errors(server, monkeypatch):
    url, asked, replies = server
    good = json.dumps({"choices": [{"message": {"content": '{"summary": "a", "purpose": "b"}'}}]})
    monkeypatch.setenv("LAMP_KEY", "k1")
    m = HttpModel(url, "small", "LAMP_KEY")
    replies += [(429, "slow down"), (503, ""), (200, good)]
    waits = []
    assert model.generate(m, "p", waits.append)["summary"] == "a" and waits == [1.0, 2.0]
    assert asked[0][0]["Authorization"] == "Bearer k1" and asked[0][1]["messages"] == [{"role": "user", "content": "p"}]
    replies += [(400, "bad")]
    with pytest.raises(ModelError, match="400"):
        model.call(m, "p", waits.append)
    for body in ("{}", '{"choices": []}', '{"choices": [{"message": {"content": ""}}]}'):
        replies.append((200, body))
        with pytest.raises(ModelError):
            m("p")
    with pytest.raises(ModelError, match="network"):
        HttpModel("http://127.0.0.1:9", "small", timeout=1)("p")


def test_proxies():
    env = {"HTTP_PROXY": "http://b", "https_proxy": "http://a"}
    assert proxy_for("https://model.example/v1", env) == "http://a" and proxy_for("http://localhost:1/v1", env) is None and proxy_for("http://127.0.0.1/", env) is None and proxy_for("https://m.example", {}) is None
