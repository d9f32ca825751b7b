"""Navigation targets: a small plan of files, functions, patterns, importers and callers, resolved to rows."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.operators import search


@dataclass(frozen=True)
class Target:
    type: str
    path: str | None = None
    name: str | None = None
    of: str | None = None
    pattern: str | None = None
    scope: str | None = None
    within: str | None = None


_NEEDED = {"file": ("path",), "function": ("name", "in"), "grep": ("pattern",), "importers": ("of",), "callers": ("of",)}


def parse_targets(reply: str) -> list[Target]:
    """Targets of a JSON reply, bare or fenced; one that is invalid fails the whole reply."""
    m = re.search(r"```(?:json)?\s*([\s\S]*?)```", reply)
    raw = json.loads((m[1] if m else reply).strip())
    if not isinstance(raw, dict) or not isinstance(raw.get("targets"), list):
        raise ValueError("no list of targets")
    out = []
    for t in raw["targets"]:
        need = _NEEDED.get(t.get("type")) if isinstance(t, dict) else None
        if need is None or not all(isinstance(t.get(k), str) and t[k] for k in need):
            raise ValueError(f"invalid target: {t!r}")
        if t["type"] == "callers" and ":" not in t["of"]:
            raise ValueError(f"callers of {t['of']!r}: file:function expected")
        out.append(Target(**{k: t.get(k) for k in ("type", "path", "name", "of", "pattern", "scope")}, within=t.get("in")))
    return out


def resolve(targets: list[Target], functions: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(ord, type, repo, path, detail) of all targets in their order, as one union.

    Callers from test files are left to the reader by their path; they add no node. An unknown name gives no row.
    """
    out = None
    for n, t in enumerate(targets):
        if t.type == "file":
            one = functions.where(F.col("path") == t.path).select("repo", "path", F.lit(t.path).alias("detail")).distinct()
        elif t.type == "function":
            own = functions.where((F.col("path") == t.within) & (F.col("func_name") == t.name))
            one = own.select("repo", "path", F.col("signature").alias("detail")).distinct()
        elif t.type == "grep":
            one = search.grep(functions, t.pattern, t.scope).select("repo", "path", F.concat_ws(": ", "kind", "text").alias("detail"))
        elif t.type == "importers":
            one = symbols.where(F.col("symbol_name") == t.of).select("repo", "path", F.col("source_file").alias("detail")).distinct()
        else:
            one = calls.where(F.col("dst") == t.of).select("repo", F.substring_index("src", ":", 1).alias("path"), F.col("src").alias("detail")).distinct()
        one = one.select(F.lit(n).alias("ord"), F.lit(t.type).alias("type"), "repo", "path", "detail")
        out = one if out is None else out.unionByName(one)
    return out
