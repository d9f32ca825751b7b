"""A text model behind a chat-completions endpoint."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from urllib.parse import urlsplit

#: Seconds that a call may take.
TIMEOUT = 30.0
LOCAL = ("localhost", "127.0.0.1", "::1")


class ModelError(Exception):
    """A reply with an error status, or none at all; ``status`` is what a retry depends on."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


def proxy_for(url: str, env: dict[str, str] | None = None) -> str | None:
    """The proxy of an address: none for this machine, else what the environment names first."""
    env = dict(os.environ) if env is None else env
    if urlsplit(url).hostname in LOCAL:
        return None
    names = ("HTTPS_PROXY", "https_proxy", "HTTP_PROXY", "http_proxy")
    return next((env[n] for n in names if env.get(n)), None)


class HttpModel:
    """Calls ``url`` with a prompt. ``key`` names an environment variable of each machine, so that no secret is sent with a plan."""

    def __init__(self, url: str, model: str, key: str | None = None, max_tokens: int = 4096, temperature: float = 0.3, timeout: float = TIMEOUT) -> None:
        self.url, self.model, self.key, self.max_tokens, self.temperature, self.timeout = url, model, key, max_tokens, temperature, timeout

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": self.temperature, "response_format": {"type": "json_object"}}
        head = {"Content-Type": "application/json"}
        if self.key and os.environ.get(self.key):
            head["Authorization"] = f"Bearer {os.environ[self.key]}"
        proxy = proxy_for(self.url)
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({"http": proxy, "https": proxy} if proxy else {}))
        try:
            with opener.open(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as r:
                raw = json.loads(r.read())
        except urllib.error.HTTPError as e:
            raise ModelError(f"the model answered {e.code}: {e.read()[:200].decode('utf-8', 'replace')}", e.code) from e
        except (urllib.error.URLError, OSError) as e:
            raise ModelError(f"network: {getattr(e, 'reason', e)}") from e
        try:
            text = raw["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ModelError("the model's reply has no text") from e
        if not isinstance(text, str) or not text:
            raise ModelError("the model's reply is empty")
        return text
