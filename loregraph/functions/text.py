"""Column functions on text: tokens, keywords, identifiers, HTTP statuses. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query or summary is rid of.
STOPWORDS = """a an and are as at be by for from has have in is it its of on or that the this to was were will with which can all also but been into only
some such than then them they their there these when where while who why would each more most other should through very about after any before being between both
could does during either every had here how just like made make many may must our over own same so still take too under up used using way well what you your provides""".split()

# Words that are never identifiers in a claim.
COMMON_WORDS = """the is at which on a an as are was were be been being have has had do does did will would should could may might must can to of in for with this that
from by or and but not it if then else function requires calls returns uses needs when where what why how who all some any each every other another var env exist intensive
return null their about after also before between both during into over through under against along among around because behind below beneath beside besides beyond down
inside outside since than toward upon within without""".split()

# HTTP statuses by number.
HTTP_STATUS = {400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 413: "Payload Too Large",
               415: "Unsupported Media Type", 422: "Unprocessable Entity", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}


def one_of(word: Column, words: list[str]) -> Column:
    """Whether a word is in a fixed list, as one pattern: a literal that is compiled once."""
    return word.rlike("^(?:" + "|".join(words) + ")$")


def camel_parts(word: Column) -> Column:
    """A name's parts: an all-capitals word whole, else cut at lower-Upper and before the last capital of a run."""
    parts = F.split(word, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.when(word == F.upper(word), F.array(word)).otherwise(parts)


def query_tokens(text: Column) -> Column:
    """Search tokens in order of first appearance: numbers whole, names by their parts, more than two letters, no stopwords."""
    words = F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), F.lit(0))
    each = F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.array(w)).otherwise(F.transform(camel_parts(w), F.lower))))
    keep = F.filter(each, lambda w: w.rlike("^[0-9]+$") | ((F.length(w) > 2) & ~one_of(w, STOPWORDS)))
    return F.array_distinct(keep)


def summary_words(text: Column) -> Column:
    """Lower-case words of more than two letters that aren't stopwords; repetitions stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~one_of(w, STOPWORDS))


def statement_keywords(text: Column) -> Column:
    """The assigned name, and every word's parts (cut before each capital) of more than two letters, in lower case."""
    name = F.regexp_extract(text, r"^(\w+)\s*=", 1)
    words = F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(words, lambda w: F.split(w, "(?=[A-Z])"))), lambda p: F.length(p) > 2)
    return F.concat(F.when(name != "", F.array(F.lower(name))).otherwise(F.array().cast("array<string>")), F.transform(parts, F.lower))


def identifiers(text: Column) -> Column:
    """Words that look like names of code: mixed case, snake case, or at least four lower-case letters."""
    every = F.regexp_extract_all(text, F.lit("(?<![a-zA-Z0-9_])[a-zA-Z_][a-zA-Z0-9_]*(?![a-zA-Z0-9_])"), F.lit(0))
    named = lambda w: F.when(w.rlike("[a-z].*[A-Z]|[A-Z].*[a-z]"), True).when(w == F.upper(w), False).otherwise(w.contains("_") | (F.length(w) >= 4))
    return F.filter(every, lambda w: (F.length(w) > 2) & ~one_of(F.lower(w), COMMON_WORDS) & named(w))


def http_status(condition: Column, action: Column) -> Column:
    """The status that an error path stands for: the first 4xx or 5xx number if it is a standard one, else by wording, else null."""
    text = F.concat_ws(" ", F.coalesce(condition, F.lit("")), F.coalesce(action, F.lit("")))
    code = F.regexp_extract(text, r"\b(4\d{2}|5\d{2})\b", 1).try_cast("int")
    return (
        F.when(code.between(400, 451) | code.between(500, 511), code)
        .when(text.rlike(r"(?i)not\s*found"), 404)
        .when(text.rlike("(?i)unauthorized"), 401)
        .when(text.rlike("(?i)forbidden"), 403)
        .when(text.rlike(r"(?i)bad\s*request|invalidrequest|validationerror"), 400)
        .when(text.rlike(r"(?i)too\s*many\s*requests|rate\s*limit"), 429)
    )


def condition_chain(chain: Column, condition: Column) -> Column:
    """Conditions joined by ``&&``; the single one; or ``unconditional``."""
    return F.coalesce(F.nullif(F.array_join(chain, " && "), F.lit("")), F.nullif(condition, F.lit("")), F.lit("unconditional"))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.sha2(text.cast("binary"), 256))


def days_between(since: Column, now: Column) -> Column:
    """Whole periods of 24 hours, not calendar days."""
    return F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(since.cast("timestamp"))) / F.lit(86_400_000)).cast("long")
