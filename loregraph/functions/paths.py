"""Column functions on paths: directories, normalisation, similarity scores, suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(p: Column) -> Column:
    """Everything before the last slash; ``.`` for a root file."""
    return F.when(p.contains("/"), F.regexp_extract(p, "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def is_test_file(p: Column) -> Column:
    return p.endswith(".test.ts") | p.endswith(".spec.ts") | p.contains("__tests__/")


def normalize(p: Column) -> Column:
    """A path without ``.`` and with ``..`` taken back; what leads above the root keeps its ``..``."""
    step = lambda done, part: (
        F.when((part == ".") | (part == ""), done)
        .when((part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")


def usage_path(importer: Column, spec: Column) -> Column:
    """The path that a usage's ``./`` or ``../`` specifier means beside its file, whether it exists or not; others stand as they are."""
    own = F.split(importer, "/")
    up = F.size(F.filter(F.split(F.regexp_extract(spec, r"^((?:\.\./)*)", 1), "/"), lambda x: x == ".."))
    at = F.slice(own, 1, F.greatest(F.size(own) - 1 - up, F.lit(0)))
    rest = F.regexp_replace(spec, r"^(?:\.\./)+|^\./", "")
    return F.when(spec.startswith("./") | spec.startswith("../"), F.array_join(F.concat(at, F.array(rest)), "/")).otherwise(spec)


def suffixes(p: Column) -> Column:
    """A path and every tail of it that starts after a slash."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def without_extension(p: Column) -> Column:
    """A module path as imports write it: no leading ``./`` and no source extension."""
    return F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"\.(?:ts|js|tsx|jsx)$", "")


def lower_parts(p: Column) -> Column:
    return F.split(F.lower(p), "/")


def full_parts(p: Column) -> Column:
    """The parts of a path that aren't empty."""
    return F.filter(F.split(p, "/"), lambda s: s != "")


def similarity(query: Column, candidate: Column) -> Column:
    """``parts_similarity`` of two paths."""
    return parts_similarity(lower_parts(query), lower_parts(candidate))


def parts_similarity(q: Column, c: Column) -> Column:
    """How well a candidate path answers a misspelt one; both as ``lower_parts``.

    The same file name earns 50, another one 20 less twice the edits (0 at least). Each pair of directories at
    the same depth earns 10 if equal, 5 less the difference in length if one starts the other, else loses the
    edits. Each level of difference in depth costs 5. Files of the same name under clearly different second
    directories lose 30.
    """
    nq, nc = F.size(q) - 1, F.size(c) - 1
    qf, cf = F.element_at(q, -1), F.element_at(c, -1)
    name = F.when(qf == cf, 50).otherwise(F.greatest(F.lit(0), 20 - 2 * F.levenshtein(qf, cf)))
    n = F.least(nq, nc)
    pair = lambda a, b: F.when(a == b, 10).when(a.startswith(b) | b.startswith(a), 5 - F.abs(F.length(a) - F.length(b))).otherwise(-F.levenshtein(a, b))
    dirs = F.aggregate(F.zip_with(F.slice(q, 1, n), F.slice(c, 1, n), pair), F.lit(0), lambda s, x: s + x)
    qd, cd = F.get(q, F.lit(1)), F.get(c, F.lit(1))
    lev = F.levenshtein(qd, cd)
    alike = qd.startswith(cd) | cd.startswith(qd) | ((lev <= 2) & (lev <= F.least(F.length(qd), F.length(cd)) / 3))
    other = F.when((nq >= 2) & (nc >= 2) & (qd != cd) & (qf == cf) & ~alike, -30).otherwise(0)
    return name + dirs - 5 * F.abs(nq - nc) + other


def confidence(score: Column) -> Column:
    """A similarity score as a share of 70 between 0 and 1, to two places, halves up."""
    return F.floor(F.least(F.greatest(score / F.lit(70.0), F.lit(0.0)), F.lit(1.0)) * 100 + 0.5) / 100


def segment_score(t: Column, p: Column) -> Column:
    """Shared segments: 3 for the file name, 2 for each directory of the target that the path has, 1 for each that extends one; both as ``full_parts``."""
    td, pd_ = F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
    same = F.when(F.element_at(F.concat(F.array(F.lit("")), t), -1) == F.element_at(F.concat(F.array(F.lit("/")), p), -1), 3).otherwise(0)
    per = lambda d: F.when(F.array_contains(pd_, d), 2).otherwise(0) + F.size(F.filter(pd_, lambda x: x.startswith(d) & (x != d)))
    return same + F.aggregate(td, F.lit(0), lambda s, d: s + per(d))
