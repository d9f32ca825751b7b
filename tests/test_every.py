"""Path searches, impact and bundles over the prescribed set of requests, against brute force on small tables."""

import os
from collections import defaultdict
from datetime import datetime, timezone

import pytest

from loregraph.api import Engine
from loregraph.operators import search
from loregraph.plans import catalog

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
DIRS = ["src", "src/cache", "src/cahce", "src/mail", "packages/api/src", "packages/app/src/mail", "lib/Mail", ""]
NAMES = ["badge.ts", "bagde.ts", "types.ts", "account-index.ts", "index.ts", "Index.ts"]


def files():
    """(file_id, repo, path): two repositories, some ids divisible by 50 in both, one path in both."""
    paths = [f"{d}/{n}".lstrip("/") for d in DIRS for n in NAMES]
    return [(25 * (i + 1), "ash" if i % 3 else "birch", p) for i, p in enumerate(paths)] + [(5000, "birch", paths[2]), (5000, "birch", paths[2])]


def imports():
    """(repo, src, dst): chains, a cycle, a self-import and one edge twice."""
    out = []
    for repo in ("ash", "birch"):
        own = sorted({p for _, r, p in files() if r == repo})
        out += [(repo, a, b) for a, b in zip(own, own[1:])] + [(repo, own[4], own[0]), (repo, own[2], own[2]), (repo, own[5], own[3]), (repo, own[5], own[3])]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("every"))
    spark.createDataFrame([(*f, T0) for f in files()], "file_id long, repo string, path string, extracted_at timestamp").write.parquet(f"{d}/file_nodes.parquet")
    e = [(r, a, "imports", b) for r, a, b in imports()] + [(r, p, "testFile", p.replace(".ts", ".test.ts")) for _, r, p in files()[::4]]
    spark.createDataFrame([(i, *x, T0) for i, x in enumerate(e)], "edge_id long, repo string, src_id string, edge_type string, edge_target string, recorded_at timestamp").write.parquet(f"{d}/edges.parquet")
    return d


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def similarity(a, b):
    q, c = a.lower().split("/"), b.lower().split("/")
    s = 50 if q[-1] == c[-1] else max(0, 20 - 2 * edits(q[-1], c[-1]))
    for x, y in zip(q[:-1], c[:-1]):
        s += 10 if x == y else 5 - abs(len(x) - len(y)) if x.startswith(y) or y.startswith(x) else -edits(x, y)
    s -= 5 * abs(len(q) - len(c))
    if len(q) > 2 and len(c) > 2 and q[1] != c[1] and q[-1] == c[-1]:
        n = edits(q[1], c[1])
        s -= 0 if q[1].startswith(c[1]) or c[1].startswith(q[1]) or (n <= 2 and n <= min(len(q[1]), len(c[1])) / 3) else 30
    return s


def shared(a, b):
    q, c = a.split("/"), b.split("/")
    return 3 * (q[-1] == c[-1]) + sum(2 * (x in c[:-1]) + sum(y.startswith(x) and y != x for y in c[:-1]) for x in q[:-1])


def best(score, k):
    asked, every = {p for i, _, p in files() if i % 50 == 0}, {p for _, _, p in files()}
    out = []
    for q in asked:
        top = sorted((-score(q, p), p) for p in every if score(q, p) > 0)[:k]
        out += [(q, p, -s, n) for n, (s, p) in enumerate(top, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [(500, 1000), (7, 5)])
def test_path_searches(spark, folder, monkeypatch, block):
    monkeypatch.setattr(search, "PATHS", block[0])
    monkeypatch.setattr(search, "QUERIES", block[1])
    got = sorted((r.query, r.path, r.score, r.rank) for r in catalog.fuzzy_paths_every(spark, folder).collect())
    assert got == best(similarity, 3)
    assert len({g[0] for g in got}) == 25
    got = sorted((r.query, r.path, r.score, r.rank) for r in catalog.similar_paths_every(spark, folder).collect())
    assert got == best(shared, 3)
    want = defaultdict(list)
    for q, p, s, _ in sorted(best(similarity, 5), key=lambda r: (r[0], r[3])):
        want[q].append((p, int(min(max(s / 70, 0), 1) * 100 + 0.5) / 100))
    want = sorted((q, t[0][0] if t[0][1] >= 0.4 else None, "|".join(p for p, _ in (t[1:4] if t[0][1] >= 0.7 else t[:3]))) for q, t in want.items())
    assert sorted((r.query, r.matched, r.alternatives) for r in catalog.fuzzy_match_every(spark, folder).collect()) == want


def test_impact_and_bundles_of_every_seed(spark, folder):
    seeds = {(r, p) for i, r, p in files() if i % 50 == 0}
    assert {r for r, _ in seeds} == {"ash", "birch"}
    test = {(r, p, p.replace(".ts", ".test.ts")) for _, r, p in files()[::4]}
    known = {(r, p) for _, r, p in files()}
    want, tests, near = set(), set(), {}
    for r, s in seeds:
        depth, level = {s: 0}, [s]
        for n in range(1, 11):
            level = [a for a in {a for q, a, b in imports() if q == r and b in level} if a not in depth]
            depth |= dict.fromkeys(level, n)
        want |= {(r, s, x, n) for x, n in depth.items() if n}
        tests |= {(r, s, t) for q, p, t in test if q == r and p in depth}
        near |= {(r, s, b): 1 for q, a, b in imports() if q == r and a == s}
        near |= {(r, s, t): 1 for q, p, t in test if (q, p) == (r, s) and (r, t) in known}
    near |= {(r, s, s): 0 for r, s in seeds}
    assert {tuple(r) for r in catalog.impact_bfs_every(spark, folder).select("repo", "seed", "node", "depth").collect()} == want
    assert sum(r.nodes for r in catalog.impact_by_depth_every(spark, folder).collect()) == len(want)
    assert {tuple(r) for r in catalog.tests_for_impact_every(spark, folder).select("repo", "seed", "test").collect()} == tests
    files_only = {(r.repo, r.seed, r.node): r.hop for r in catalog.context_bundle_every(spark, folder).collect() if (r.repo, r.node) in known}
    assert files_only == near


def test_bundles_hold_modules(spark, folder):
    has = defaultdict(set)
    for _, r, p in files():
        has[r, p.rpartition("/")[0] or "."].add(p)
    modules = {k for k, v in has.items() if len(v) >= 3 or any(p.endswith("/index.ts") or p == "index.ts" for p in v)}
    want = {(r, p, p.rpartition("/")[0] or ".") for i, r, p in files() if i % 50 == 0 and (r, p.rpartition("/")[0] or ".") in modules}
    assert len(want) > 5
    got = catalog.context_bundle_every(spark, folder).collect()
    assert {(r.repo, r.seed, r.node) for r in got if (r.repo, r.node) in modules and r.hop == 1} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_context_has_module(spark):
    """On the given tables: a file in a directory that is a module comes with it."""
    d = "/root/testdata/sf0.001"
    e = catalog.parent_edges(spark, d).orderBy("repo", "src").first()
    rows = Engine(spark, d).context(e.repo, [e.src], form="rows")
    assert {r["path"]: (r["hop"], r["type"]) for r in rows}[e.dst] == (1, "module")
