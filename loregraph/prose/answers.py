"""Prompts for finding and answering, and what is read from the replies."""

from __future__ import annotations

import json
import re

#: Characters of a README that a prompt shows.
README_SHOWN = 500
TARGETS = (
    '{"type": "file", "path": "..."}', '{"type": "function", "name": "...", "in": "file"}', '{"type": "grep", "pattern": "...", "scope": "optional path prefix"}',
    '{"type": "importers", "of": "symbol"}', '{"type": "callers", "of": "file:function"}',
)


def overview_text(overview: dict) -> str:
    """The parts of an overview (readme, tree, modules, entry_points, connections, configs) that aren't empty, each under a title."""
    readme = (overview.get("readme") or "").strip()
    out = []
    if readme:
        out.append("README\n" + (readme if len(readme) <= README_SHOWN else readme[:README_SHOWN] + "..."))
    lines = {
        "Files": [f"{x['directory']}: {', '.join(x['names'])}" for x in overview.get("tree", [])],
        "Modules": [f"{x['path']}: {x.get('summary') or '-'}" + (f" (exports {', '.join(x['exports'])})" if x.get("exports") else "") for x in overview.get("modules", [])],
        "Entry points": [f"{x['path']}: {x['description']}" for x in overview.get("entry_points", [])],
        "Connections": [f"{x['path']} -> {', '.join(x['names'])}" if x.get("consumers") is None else f"{x['path']} ({x['consumers']} dependents) gives {', '.join(x['names'])}" for x in overview.get("connections", [])],
        "Configuration": list(overview.get("configs", [])),
    }
    out += [title + "\n" + "\n".join(f"- {x}" for x in rows) for title, rows in lines.items() if rows]
    return "\n\n".join(out)


def navigator_prompt(question: str, overview: dict) -> str:
    kinds = "\n".join(f"- {t}" for t in TARGETS)
    return f"Where in this project is the answer to a question?\n\n{overview_text(overview)}\n\nQuestion: {question}\n\nName the places to look at, as JSON: {{\"reasoning\": \"...\", \"targets\": [...]}}. Kinds of targets:\n{kinds}"


def synthesis_prompt(question: str, found: list[dict], errors: list[str] = ()) -> str:
    """``found``: rows of resolved targets (type, path, detail), in order."""
    rows = "\n".join(f"- [{x['type']}] {x['path']}: {x['detail']}" for x in found)
    lost = "\n\nNot found:\n" + "\n".join(f"- {e}" for e in errors) if errors else ""
    return f"Answer a question about a project from what was found in it, and from nothing else.\n\nQuestion: {question}\n\nFound:\n{rows}{lost}\n\nReply with JSON: {{\"answer\": \"...\"}}."


def reasoning_of(reply: str) -> str | None:
    try:
        raw = json.loads(unfenced(reply))
    except ValueError:
        return None
    return raw["reasoning"] if isinstance(raw, dict) and isinstance(raw.get("reasoning"), str) else None


def unfenced(reply: str) -> str:
    """A reply without the code fence around it."""
    m = re.fullmatch(r"\s*```[\w-]*[ \t]*\n?([\s\S]*?)\n?```\s*", reply)
    return (m[1] if m else reply).strip()


def parse_answer(reply: str) -> dict:
    """{"answer": ...} of a reply in JSON or plain text, or {"error": ...} where it is empty."""
    text = unfenced(reply or "")
    if not text:
        return {"error": "the model gave no answer"}
    try:
        raw = json.loads(text)
    except ValueError:
        return {"answer": text}
    if isinstance(raw, dict) and isinstance(raw.get("answer"), str) and raw["answer"].strip():
        return {"answer": raw["answer"]}
    return {"answer": text}
