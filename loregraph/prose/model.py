"""Text about nodes: prompts, a pluggable model, replies, retries, and what is stale."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

ATTEMPTS, PARSE_ATTEMPTS = 3, 3


class TextModel(Protocol):
    def __call__(self, prompt: str) -> str: ...


def offline(prompt: str) -> str:
    """The default model: a reply that depends on the prompt alone and calls nothing."""
    path = re.search(r"^Path: (.*)$", prompt, re.M)
    names = re.search(r"^Exports: (.*)$", prompt, re.M)
    what = path[1] if path else "This node"
    return json.dumps({"summary": f"{what} provides {names[1] if names and names[1] else 'internal code'}.", "purpose": f"Keeps {what} in one place.", "gotchas": []})


def file_prompt(path: str, lines: int, exports: list[str], statements: list[str]) -> str:
    facts = "\n".join(f"- {s}" for s in statements)
    return f"Describe a source file.\nPath: {path}\nLines: {lines}\nExports: {', '.join(exports)}\nKey statements:\n{facts}\nReply with JSON: summary, purpose, gotchas."


def module_prompt(path: str, children: dict[str, str]) -> str:
    facts = "\n".join(f"- {k}: {v}" for k, v in sorted(children.items()))
    return f"Describe a directory of source files.\nPath: {path}\nExports: \nFiles:\n{facts}\nReply with JSON: summary, purpose, gotchas."


def parse_reply(text: str) -> dict:
    """The object of a reply, bare or fenced. ``summary`` and ``purpose`` are needed; other fields of a wrong type are dropped."""
    m = re.search(r"```(?:json)?\s*([\s\S]*?)```", text)
    raw = json.loads((m[1] if m else text).strip())
    if not isinstance(raw, dict) or not all(isinstance(raw.get(k), str) and raw[k] for k in ("summary", "purpose")):
        raise ValueError("the JSON reply lacks a summary or a purpose")
    out = {"summary": raw["summary"], "purpose": raw["purpose"]}
    for k in ("gotchas", "keyExports", "patterns", "similarFiles"):
        if isinstance(raw.get(k), list) and all(isinstance(x, str) for x in raw[k]):
            out[k] = raw[k]
    out.setdefault("gotchas", [])
    return out


def retryable(error: Exception) -> bool:
    status = getattr(error, "status", None)
    return status == 429 or (status or 0) >= 500 or bool(re.search(r"timeout|timed out|network|ECONNRESET|abort", str(error), re.I))


def is_parse_error(error: Exception) -> bool:
    return isinstance(error, ValueError) or bool(re.search(r"json|parse|unexpected token|unterminated string", str(error), re.I))


def call(model: TextModel, prompt: str, sleep: Callable[[float], None] = time.sleep) -> str:
    for k in range(ATTEMPTS):
        try:
            return model(prompt)
        except Exception as e:
            if k == ATTEMPTS - 1 or not retryable(e):
                raise
            sleep(2.0**k)
    raise AssertionError


def generate(model: TextModel, prompt: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A parsed reply; one that can't be parsed is asked for again."""
    for k in range(PARSE_ATTEMPTS):
        try:
            return parse_reply(call(model, prompt, sleep))
        except Exception as e:
            if k == PARSE_ATTEMPTS - 1 or not is_parse_error(e):
                raise
            sleep(2.0**k)
    raise AssertionError


def write_prose(prompts: DataFrame, model: TextModel = offline, concurrency: int | None = None) -> DataFrame:
    """(repo, id, summary, purpose, gotchas, error) for (repo, id, prompt); a row that fails has an ``error`` and ends nothing.

    ``concurrency`` bounds the tasks that call the model at once. A task that is run again calls it again, so
    speculation should be off where calls cost.
    """
    rows = prompts.select("repo", "id", "prompt")
    if concurrency:
        rows = rows.repartition(min(max(concurrency, 1), 20))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, i, p in zip(pdf["repo"], pdf["id"], pdf["prompt"], strict=True):
                try:
                    r = generate(model, p)
                    out.append((repo, i, r["summary"], r["purpose"], r["gotchas"], None))
                except Exception as e:  # noqa: BLE001
                    out.append((repo, i, None, None, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["repo", "id", "summary", "purpose", "gotchas", "error"])

    return rows.mapInPandas(run, "repo string, id string, summary string, purpose string, gotchas array<string>, error string")
