"""Markdown of small results that were collected on purpose."""

from __future__ import annotations

from collections import defaultdict


# Where an error of a status comes from, as a rule.
CAUSES = {400: "wrong or missing input", 401: "no valid sign-in", 403: "signed in, but not allowed", 404: "what is asked for is not there", 429: "too many calls in a time", 500: "an error that nothing caught", 503: "a service that is needed is out of reach"}


def call_reference(ref: str, outgoing: bool = True) -> str:
    """A line for a call: ``file:function`` as the file and the function, an arrow between that tells who calls."""
    path, colon, name = ref.rpartition(":")
    return f"- `{path}` {'→' if outgoing else '←'} `{name}()`" if colon and name else f"- `{ref}`"


def test_links(tests: list[str], commands: dict[str, str | None]) -> list[str]:
    """A line per test file: how to run it if that is known, else where it is."""
    return [f"- Run: `{commands[t]}`" if commands.get(t) else f"- See: `{t}`" for t in tests]


def checklist(n: dict, high: int) -> list[str]:
    """What to think of before a file is changed."""
    out = []
    if n.get("fan_in", 0) > high:
        out.append(f"{n['fan_in']} files depend on this one: see them first")
    if n.get("tests"):
        out.append("run its tests: " + ", ".join(n["tests"]))
    elif n.get("type", "file") == "file":
        out.append("it has no tests")
    if n.get("patterns"):
        out.append("keep its patterns: " + ", ".join(sorted({p["pattern"] for p in n["patterns"]})))
    if n.get("errors"):
        out.append(f"keep its {len(n['errors'])} error paths")
    return out


def function(f: dict) -> str:
    """A function: whole with its key statements if it is ``expanded``, else its signature."""
    head = f"- `{f['signature'] or f['func_name']}` (line {f['start_line']})"
    if not f.get("expanded"):
        return head
    keys = "".join(f"\n  - line {k['line']} {k['category']}: `{k['text']}`" for k in f.get("key_statements") or [])
    return head + keys + (f"\n\n```ts\n{f['code_snippet']}\n```" if f.get("code_snippet") else "")


def context(nodes: list[dict], high: int = 5) -> str:
    """A page on some nodes, modules first: a header each, a warning where many depend on it, and what is known.

    Keys of a node that may be missing: summary, patterns, functions, errors, calls, called_by, exports,
    imports, dependents, tests, test_commands, commits, readme.
    """
    out = []
    for n in sorted(nodes, key=lambda x: (x.get("type") != "module", x["path"])):
        out.append(f"## {n['path']}")
        if n.get("fan_in", 0) > high:
            out.append(f"**{n['fan_in']} files depend on this one: change it with care.**")
        if n.get("detail"):
            out.append("### Before a change\n" + "\n".join(f"- [ ] {x}" for x in checklist(n, high)))
        if n.get("summary"):
            out.append(n["summary"])
        if n.get("patterns"):
            out.append("### Patterns\n" + "\n".join(f"- {p['pattern']} at `{p['location']}`" for p in n["patterns"]))
        if n.get("functions"):
            out.append("### Functions\n" + "\n".join(function(f) for f in n["functions"]))
        if n.get("errors"):
            out.append("### Errors\n" + errors(n["errors"], 4).strip())
        if n.get("calls") or n.get("called_by"):
            out.append("### Calls\n" + "\n".join([call_reference(c) for c in n.get("calls", [])] + [call_reference(c, False) for c in n.get("called_by", [])]))
        for title, key in (("Exports", "exports"), ("Imports", "imports"), ("Dependents", "dependents"), ("Recent commits", "commits")):
            if n.get(key):
                shown = list(n[key])[:10]
                out.append(f"### {title}\n" + "\n".join(f"- {x}" for x in shown) + (f"\n- and {len(n[key]) - 10} more" if len(n[key]) > 10 else ""))
        if n.get("tests"):
            out.append("### Tests\n" + "\n".join(test_links(n["tests"], n.get("test_commands", {}))))
        if n.get("readme"):
            out.append("### README\n" + n["readme"])
    return "\n\n".join(out) + "\n"


def impact(source: str, rows: list[dict], tests: list[str], commands: dict[str, str | None] | None = None) -> str:
    """Who is affected by a change, by depth, with the symbols and functions concerned, and the tests to run."""
    by = defaultdict(list)
    for r in rows:
        by[r["depth"]].append(r)
    out = [f"# Impact of {source}", f"{len(rows)} dependents"]
    for d in sorted(by):
        lines = []
        for r in sorted(by[d], key=lambda r: r["node"]):
            lines.append(f"- {r['node']}" + (f" (uses {', '.join(r['symbols'])})" if r.get("symbols") else ""))
            lines += [f"  - {f}()" for f in r.get("functions") or []]
        out.append(("## Direct" if d == 1 else f"## Depth {d}") + "\n" + "\n".join(lines))
    if tests:
        out.append("## Tests\n" + ("\n".join(f"- {t}" for t in sorted(tests)) if commands is None else "\n".join(test_links(sorted(tests), commands))))
    return "\n\n".join(out) + "\n"


def errors(rows: list[dict], level: int = 2) -> str:
    """Error paths by status, with the usual cause; those without one last."""
    by = defaultdict(list)
    for r in rows:
        by[r.get("status")].append(r)
    out = []
    for s in sorted(by, key=lambda x: (x is None, x)):
        title = f"{'#' * level} {s} {by[s][0].get('description') or ''}".rstrip() if s else f"{'#' * level} Other errors"
        cause = f"\n{CAUSES[s]}" if s in CAUSES else ""
        out.append(title + cause + "\n" + "\n".join(f"- line {r['line']}: {r.get('condition') or 'unconditional'}" for r in by[s]))
    return "\n\n".join(out) + "\n"
