"""Queries of problem 2: variant spellings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import names
from loregraph.sources.tables import table


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, author, entity, route): each spelling with the entity it denotes in its repository, and what joins it to that."""
    return names.entities(names.spellings(table(spark, folder, "commits"), table(spark, folder, "file_nodes")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, author_a, author_b): all pairs of different spellings of one entity."""
    return names.same(p2_entities(spark, folder))


def p2_letters(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, pairs): of the pairs found, those that differ in case and blanks only."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return p2_found(spark, folder).where(plain("author_a") == plain("author_b")).groupBy("repo").agg(F.count(F.lit(1)).alias("pairs"))


def p2_routes(spark: SparkSession, folder: str) -> DataFrame:
    """(route, spellings): how many spellings each route joins to their entity."""
    return p2_entities(spark, folder).groupBy("route").agg(F.count(F.lit(1)).alias("spellings"))


def p2_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct spellings per repository, from all three fields."""
    s = names.spellings(table(spark, folder, "commits"), table(spark, folder, "file_nodes"))
    return s.groupBy("repo").agg(F.count(F.lit(1)).alias("spellings"))


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities, "p2_letters": p2_letters, "p2_routes": p2_routes, "p2_spellings": p2_spellings}
_NOBODY = ", ".join("'" + w + "'" for w in sorted(names.NOBODY))
_ALL = "SELECT DISTINCT repo, a FROM (SELECT repo, author AS a FROM commits UNION ALL SELECT repo, unnest(authors) FROM file_nodes UNION ALL SELECT repo, primary_author FROM file_nodes) s WHERE repo IS NOT NULL AND trim(a) <> ''"
_WORDLESS = r"^\W*((no|not|unknown|anonymous)[ _-]?(author|name|user|one|known|available|set)?)?\W*$"
ORACLES = {
    "p2_letters": f"""WITH p AS (SELECT repo, a, regexp_replace(lower(trim(a)), '\\s+', ' ', 'g') AS k FROM ({_ALL}) x)
        SELECT x.repo, count(*) AS pairs FROM p x JOIN p y ON x.repo = y.repo AND x.k = y.k AND x.a < y.a
        WHERE regexp_replace(x.k, '^[^a-z]+|[^a-z]+$', '', 'g') NOT IN ({_NOBODY}) AND NOT regexp_matches(x.k, '{_WORDLESS}') GROUP BY x.repo""",
    "p2_spellings": """SELECT repo, count(DISTINCT a) AS spellings FROM (SELECT repo, author AS a FROM commits UNION ALL SELECT repo, unnest(authors) FROM file_nodes
        UNION ALL SELECT repo, primary_author FROM file_nodes) s WHERE repo IS NOT NULL AND trim(a) <> '' GROUP BY repo"""
}
