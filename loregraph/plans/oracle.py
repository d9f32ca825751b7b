"""SQL, in DuckDB's dialect, that gives the same rows as the queries of ``catalog``.

Written apart from the plans: no look-around, other functions, recursive CTEs in place of loops.
"""

from __future__ import annotations

from loregraph.functions.text import COMMON_WORDS, HTTP_STATUS, STOPWORDS
from loregraph.operators.search import CONFIG_FILES


def _list(words) -> str:
    return "[" + ", ".join("'" + str(w) + "'" for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join("'" + str(w) + "'" for w in words) + ")"


FN = "fn AS (SELECT * FROM function_data QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY extracted_at DESC) = 1)"
FL = "fl AS (SELECT * FROM file_nodes QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY extracted_at DESC) = 1)"
CM = "cm AS (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at DESC) = 1)"
ED = r"ed AS (SELECT repo, src_id AS src, edge_type, regexp_replace(edge_target, '^\./', '') AS dst FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY recorded_at DESC) = 1) e WHERE edge_target IS NOT NULL)"
IM = f"{ED}, im AS (SELECT * FROM ed WHERE edge_type = 'imports')"
DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END"
MO = f"{FL}, mo AS (SELECT repo, {DIR} AS module, count(DISTINCT path) AS files FROM fl GROUP BY ALL HAVING count(DISTINCT path) >= 3 OR bool_or(path = 'index.ts' OR path LIKE '%/index.ts'))"
FAN = f"{IM}, fan AS (SELECT f.repo, f.path, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM (SELECT DISTINCT repo, path FROM fl) f LEFT JOIN (SELECT repo, dst AS path, count(*) AS n FROM im GROUP BY ALL) i USING (repo, path) LEFT JOIN (SELECT repo, src AS path, count(*) AS n FROM im GROUP BY ALL) o USING (repo, path))"
CALLS = r"ca AS (SELECT repo, caller AS src, regexp_replace(callee, '^\./', '') AS dst, imported_as FROM (SELECT * FROM cross_file_calls QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY recorded_at DESC) = 1) c WHERE callee IS NOT NULL AND caller IS NOT NULL)"
SYM = r"sy AS (SELECT repo, path, local_name, symbol_name, regexp_replace(source_file, '^\./', '') AS source_file FROM (SELECT * FROM resolved_symbols QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY recorded_at DESC) = 1) y WHERE source_file IS NOT NULL)"
SEED = "seed AS (SELECT repo, dst AS node FROM im WHERE repo = 'meridian-hub' GROUP BY ALL ORDER BY count(*) DESC, node LIMIT 1)"
BFS = f"{SEED}, adj AS (SELECT DISTINCT repo, dst AS node, src AS nxt FROM im WHERE src <> dst), walk AS (SELECT repo, node, 0 AS depth FROM seed UNION SELECT a.repo, a.nxt, w.depth + 1 FROM walk w JOIN adj a ON a.repo = w.repo AND a.node = w.node WHERE w.depth < 10), bfs AS (SELECT repo, node, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0)"
TEST = "(p LIKE '%.test.ts' OR p LIKE '%.spec.ts' OR contains(p, '__tests__/'))"


def _test(p: str) -> str:
    return f"({p} LIKE '%.test.ts' OR {p} LIKE '%.spec.ts' OR contains({p}, '__tests__/'))"


def camel(w: str) -> str:
    return f"CASE WHEN {w} = upper({w}) THEN [{w}] ELSE string_split(regexp_replace(regexp_replace({w}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ') END"


def tokens(t: str) -> str:
    each = f"flatten(list_transform(regexp_extract_all({t}, '[a-zA-Z0-9]+'), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN [w] ELSE list_transform({camel('w')}, lambda p: lower(p)) END))"
    return f"list_filter({each}, lambda w: regexp_full_match(w, '[0-9]+') OR (length(w) > 2 AND NOT list_contains({_list(STOPWORDS)}, w)))"


def keywords(t: str) -> str:
    parts = f"flatten(list_transform(regexp_extract_all({t}, '[a-zA-Z]+'), lambda w: string_split(ltrim(regexp_replace(w, '([A-Z])', ' \\1', 'g')), ' ')))"
    name = f"regexp_extract({t}, '^(\\w+)\\s*=', 1)"
    return f"list_concat(CASE WHEN {name} <> '' THEN [lower({name})] ELSE []::VARCHAR[] END, list_transform(list_filter({parts}, lambda p: length(p) > 2), lambda p: lower(p)))"


def summary(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({_list(STOPWORDS)}, w))"


STATUS = r"""CASE WHEN try_cast(regexp_extract(t, '\b(4\d{2}|5\d{2})\b', 1) AS INT) BETWEEN 400 AND 451 OR try_cast(regexp_extract(t, '\b(4\d{2}|5\d{2})\b', 1) AS INT) BETWEEN 500 AND 511 THEN try_cast(regexp_extract(t, '\b(4\d{2}|5\d{2})\b', 1) AS INT)
  WHEN regexp_matches(t, '(?i)not\s*found') THEN 404 WHEN regexp_matches(t, '(?i)unauthorized') THEN 401 WHEN regexp_matches(t, '(?i)forbidden') THEN 403
  WHEN regexp_matches(t, '(?i)bad\s*request|invalidrequest|validationerror') THEN 400 WHEN regexp_matches(t, '(?i)too\s*many\s*requests|rate\s*limit') THEN 429 END"""
ERR = f"st AS (SELECT repo, path, func_name, unnest(key_statements) AS s FROM fn), er AS (SELECT repo, path, func_name, s.line AS line, {STATUS} AS status FROM (SELECT *, s.text AS t FROM st WHERE s.category IN ('error', 'condition')) x)"
PAT = r"""pt AS (
  SELECT DISTINCT repo, path, 'retry' AS pattern, path || ':' || func_name AS location FROM (SELECT *, coalesce(key_statements, []) AS ks, coalesce(code_snippet, '') AS code FROM fn) f
  WHERE (regexp_matches(code, '\b(for|while)\s*\(') OR len(list_filter(ks, lambda x: x.category = 'config' AND regexp_matches(x.text, 'retry|attempt'))) > 0) AND len(list_filter(ks, lambda x: x.category = 'error')) > 0
    AND (len(list_filter(ks, lambda x: x.category = 'math' AND regexp_matches(x.text, 'Math\.pow|\*\*'))) > 0 OR len(list_filter(ks, lambda x: x.category = 'config' AND regexp_matches(x.text, 'retry|attempt'))) > 0)
  UNION ALL SELECT repo, path, 'cache', path FROM fn WHERE (contains(lower(func_name), 'cache') AND regexp_matches(lower(func_name), 'load|save|get|set|has|clear|invalidate')) OR contains(lower(coalesce(code_snippet, '')), 'cache')
    GROUP BY repo, path HAVING count(DISTINCT func_name) >= 2
  UNION ALL SELECT DISTINCT repo, path, 'singleton', path FROM fn WHERE (contains(lower(coalesce(code_snippet, '')), 'instance') AND regexp_matches(lower(coalesce(code_snippet, '')), 'null|undefined') AND regexp_matches(lower(coalesce(code_snippet, '')), '\bnew\b|create'))
    OR (contains(lower(func_name), 'get') AND contains(lower(func_name), 'instance')))"""
PROSE = "js AS (SELECT repo, path, unnest(map_entries(jsdoc)) AS e FROM fl), pr AS (SELECT repo, path, min_by(e.value.description, e.key) AS summary FROM js WHERE trim(e.value.description, ' ') <> '' GROUP BY ALL)"
INDEX = f"""{FN}, {MO}, {ERR}, {PAT}, {PROSE}, ix AS (SELECT DISTINCT kind, lower(token) AS token, repo, path FROM (
  SELECT 'export' AS kind, repo, path, unnest(list_concat([func_name], list_filter({camel('func_name')}, lambda p: length(p) > 2))) AS token FROM fn WHERE is_exported
  UNION ALL SELECT 'keyStatement', repo, path, unnest({keywords('s.text')}) FROM st
  UNION ALL SELECT 'error', repo, path, CAST(status AS VARCHAR) FROM er WHERE status IS NOT NULL
  UNION ALL SELECT 'module', repo, module, regexp_extract(module, '([^/]*)$', 1) FROM mo
  UNION ALL SELECT 'pattern', repo, path, pattern FROM pt
  UNION ALL SELECT 'summary', repo, path, unnest({summary('summary')}) FROM pr) u)"""
QUESTION = "How does retryLoad keep the session token in cache when 404 errors happen?"
PARENT = f"pa AS (SELECT DISTINCT f.repo, f.path AS src, m.module AS dst FROM (SELECT repo, path, {DIR} AS module FROM fl) f JOIN mo m USING (repo, module))"
TOP = f"""{INDEX}, {FAN}, {PARENT}, tk AS (SELECT DISTINCT unnest({tokens("'" + QUESTION + "'")}) AS token),
 w(kind, weight) AS (VALUES ('export', 10), ('pattern', 8), ('error', 7), ('keyStatement', 5), ('summary', 3), ('module', 2)),
 fo AS (SELECT repo, path, CAST(sum(weight) AS BIGINT) AS score, list_sort(list(DISTINCT kind || ': ' || token)) AS reasons, bool_or(kind = 'module') AS is_module FROM ix JOIN tk USING (token) JOIN w USING (kind) GROUP BY repo, path),
 ab AS (SELECT DISTINCT pa.repo, pa.dst AS path FROM fo JOIN pa ON pa.repo = fo.repo AND pa.src = fo.path WHERE NOT fo.is_module AND NOT EXISTS (SELECT 1 FROM fo g WHERE g.repo = pa.repo AND g.path = pa.dst)),
 al AS (SELECT * FROM fo UNION ALL SELECT repo, path, 1, ['parent of matched file'], true FROM ab),
 hi AS (SELECT repo, path FROM fan WHERE fan_in >= 5 ORDER BY fan_in DESC, repo, path LIMIT 5),
 ev AS (SELECT al.repo, al.path, al.score + CASE WHEN hi.path IS NULL THEN 0 ELSE 1 END AS score, al.reasons, al.is_module FROM al LEFT JOIN hi USING (repo, path)
   UNION ALL SELECT repo, path, 1, ['high fanIn'], false FROM hi WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.repo = hi.repo AND al.path = hi.path)),
 tp AS (SELECT repo, path, CAST(score AS BIGINT) AS score, reasons, is_module FROM ev ORDER BY score DESC, repo, path LIMIT 25)"""
ASKED = "(VALUES ('src/cahce/badge.ts'), ('src/mail/types.ts'), ('src/search/acount-index.ts')) q(query)"
EVERY = "(SELECT DISTINCT path AS query FROM file_nodes WHERE file_id % 50 = 0) q"


def fuzzy(asked: str) -> str:
    return f"""{FL}, pr AS (SELECT query, path, string_split(lower(query), '/') AS q, string_split(lower(path), '/') AS c FROM (SELECT DISTINCT path FROM fl) f, {asked}),
 sc AS (SELECT query, path,
   CASE WHEN q[-1] = c[-1] THEN 50 ELSE greatest(0, 20 - 2 * levenshtein(q[-1], c[-1])) END
   + coalesce(list_sum(list_transform(range(1, least(len(q), len(c))), lambda i: CASE WHEN q[i] = c[i] THEN 10 WHEN starts_with(q[i], c[i]) OR starts_with(c[i], q[i]) THEN 5 - abs(length(q[i]) - length(c[i])) ELSE -levenshtein(q[i], c[i]) END)), 0)
   - 5 * abs(len(q) - len(c))
   - CASE WHEN len(q) >= 3 AND len(c) >= 3 AND q[2] <> c[2] AND q[-1] = c[-1] AND NOT (starts_with(q[2], c[2]) OR starts_with(c[2], q[2]) OR (levenshtein(q[2], c[2]) <= 2 AND levenshtein(q[2], c[2]) <= least(length(q[2]), length(c[2])) / 3)) THEN 30 ELSE 0 END AS score FROM pr),
 fz AS (SELECT query, path, CAST(score AS BIGINT) AS score, floor(least(greatest(score / 70.0, 0.0), 1.0) * 100 + 0.5) / 100 AS confidence, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM sc WHERE score > 0)"""


NOTE = r"(?i)(?://|/\*).*?\b(TODO|FIXME|HACK|XXX):?\s*(.*)$"
CATEGORY = r"""CASE WHEN regexp_matches(line, '(?:const|let|var)\s+\w+\s*(?::[^=]+)?=\s*-?\d+(?:\.\d+)?\s*;?\s*$|(?:\?\?|\|\|)\s*\d+') THEN 'config' WHEN regexp_matches(line, '[''"`](?:https?|wss?)://') THEN 'url' WHEN regexp_matches(line, 'Math\.pow|\*\*') THEN 'math'
 WHEN regexp_matches(line, '\bif\s*\(.*status.*\b\d{3}\b') THEN 'condition' WHEN regexp_matches(line, '\bcatch\s*\(') THEN 'error' WHEN regexp_matches(line, '\b(?:for|while)\s*\(') THEN 'loop' WHEN regexp_matches(line, 'Promise\.(?:all|allSettled|race|any)\s*\(') THEN 'async-pattern' END"""
LINES = "ln AS (SELECT func_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT func_id, string_split(code_snippet, chr(10)) AS l FROM fn) x)"
IDS = f"list_filter(regexp_extract_all(t, '\\b[a-zA-Z_][a-zA-Z0-9_]*\\b'), lambda w: length(w) > 2 AND NOT list_contains({_list(COMMON_WORDS)}, lower(w)) AND CASE WHEN regexp_matches(w, '[a-z].*[A-Z]|[A-Z].*[a-z]') THEN true WHEN w = upper(w) THEN false ELSE contains(w, '_') OR length(w) >= 4 END)"
WORDS = "ws AS (SELECT repo, path AS src, func_name, unnest(list_distinct(regexp_extract_all(coalesce(code_snippet, ''), '\\w+'))) AS word FROM fn)"
NAMES = r"nm AS (SELECT repo, path, list_sort(list(DISTINCT coalesce(nullif(symbol_name, ''), regexp_replace(regexp_extract(source_file, '([^/]*)$', 1), '\.(ts|js|tsx|jsx)$', ''))))[1:5] AS names FROM sy GROUP BY repo, path)"
ENTRY = "ex AS (SELECT repo, path, count(DISTINCT func_name) AS n FROM fn WHERE is_exported GROUP BY repo, path), en AS (SELECT fan.repo, fan.path FROM fan LEFT JOIN ex USING (repo, path) WHERE fan_in = 0 AND coalesce(n, 0) <= 1)"
GREP = r"(?i)promise\.all|session"

def similar(asked: str) -> str:
    return f"WITH {FL}, pr AS (SELECT query, path, list_filter(string_split(query, '/'), lambda x: x <> '') AS q, list_filter(string_split(path, '/'), lambda x: x <> '') AS c FROM (SELECT DISTINCT path FROM fl) f, {asked}), sc AS (SELECT query, path, CASE WHEN q[-1] = c[-1] THEN 3 ELSE 0 END + coalesce(list_sum(list_transform(q[:-2], lambda d: CASE WHEN list_contains(c[:-2], d) THEN 2 ELSE 0 END + len(list_filter(c[:-2], lambda x: starts_with(x, d) AND x <> d)))), 0) AS score FROM pr) SELECT query, path, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 3"


SEEDS = "seed AS (SELECT DISTINCT repo, path AS seed, path AS node FROM file_nodes WHERE file_id % 50 = 0)"
BFS_EVERY = f"{SEEDS}, adj AS (SELECT DISTINCT repo, dst AS node, src AS nxt FROM im WHERE src <> dst), walk AS (SELECT repo, seed, node, 0 AS depth FROM seed UNION SELECT a.repo, w.seed, a.nxt, w.depth + 1 FROM walk w JOIN adj a ON a.repo = w.repo AND a.node = w.node WHERE w.depth < 10), bfs AS (SELECT repo, seed, node, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0)"

ORACLES = {
    "keyword_index": f"WITH {INDEX} SELECT * FROM ix",
    "prefilter_topk": f"WITH {TOP} SELECT * FROM tp",
    "candidate_lines": f"WITH {TOP}, us AS (SELECT im.repo, im.src AS path, string_agg(DISTINCT im.dst, ', ' ORDER BY im.dst) AS uses FROM im JOIN tp ON tp.repo = im.repo AND tp.path = im.dst GROUP BY im.repo, im.src) SELECT tp.repo, tp.path, tp.path || ': ' || coalesce(pr.summary, '(no summary)') || coalesce(' [Uses: ' || us.uses || ']', '') || CASE WHEN len(reasons) > 0 THEN ' [Matched: ' || replace(array_to_string(reasons, ', '), ': ', ':') || ']' ELSE '' END AS line FROM tp LEFT JOIN pr USING (repo, path) LEFT JOIN us USING (repo, path)",
    "tokenize_docs": f"WITH t AS (SELECT doc_id, {tokens('text')} AS w FROM documents), u AS (SELECT doc_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]) AS w FROM t) SELECT doc_id, CASE WHEN w IS NULL THEN NULL ELSE CAST(len(w) AS BIGINT) END AS tokens, array_to_string(w, ' ') AS all_tokens FROM u",
    "summary_words_top": f"SELECT word, count(*) AS n FROM (SELECT unnest({summary('text')}) AS word FROM documents WHERE lower(lang) IN ('en', 'eng')) x GROUP BY word ORDER BY n DESC, word LIMIT 50",
    "statement_keywords": f"WITH {FN}, st AS (SELECT unnest(key_statements) AS s FROM fn) SELECT keyword, count(*) AS n FROM (SELECT unnest({keywords('s.text')}) AS keyword FROM st) x GROUP BY keyword",
    "fan_in_out": f"WITH {FL}, {FAN} SELECT * FROM fan",
    "age_recency": f"WITH {FL} SELECT repo, path, CAST(floor((1751328000000 - epoch_ms(created_at)) / 86400000.0) AS BIGINT) AS age_days, CAST(floor((1751328000000 - epoch_ms(last_modified)) / 86400000.0) AS BIGINT) AS recency_days FROM fl",
    "commit_rollup": f"WITH {CM}, a AS (SELECT repo, path, author, max(commit_date) AS seen, max(commit_id) AS cid FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, author ORDER BY commit_date DESC, commit_id DESC) AS r FROM cm WHERE author IS NOT NULL) x WHERE r = 1 GROUP BY ALL), g AS (SELECT repo, path, count(*) AS commit_count, min(commit_date) AS created_at, max(commit_date) AS last_modified FROM cm GROUP BY ALL) SELECT g.*, coalesce((SELECT string_agg(author, '|' ORDER BY seen DESC, cid DESC, author) FROM a WHERE a.repo = g.repo AND a.path = g.path), '') AS authors FROM g",
    "primary_author": f"WITH {CM}, a AS (SELECT repo, path, author, count(*) AS n, max({{'d': commit_date, 'i': commit_id}}) AS seen FROM cm WHERE author IS NOT NULL GROUP BY ALL) SELECT repo, path, author, n FROM a QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, seen DESC) = 1",
    "recent_commits": f"WITH {CM} SELECT repo, path, commit_id, row_number() OVER (PARTITION BY repo, path ORDER BY commit_date DESC, commit_id DESC) AS rank FROM cm QUALIFY rank <= 5",
    "module_nodes": f"WITH {MO} SELECT * FROM mo",
    "contains_edges": f"WITH {FN}, {MO}, {PARENT} SELECT repo, dst AS src, src AS dst FROM pa UNION ALL SELECT DISTINCT repo, path, node_id FROM fn WHERE is_exported AND EXISTS (SELECT 1 FROM fl WHERE fl.repo = fn.repo AND fl.path = fn.path)",
    "parent_edges": f"WITH {MO}, {PARENT} SELECT * FROM pa",
    "imports_resolved": f"WITH {FL}, {IM} SELECT DISTINCT im.repo, src AS path, CASE WHEN contains(src, '/') THEN repeat('../', len(string_split(src, '/')) - 1) ELSE './' END || regexp_replace(dst, '\\.ts$', '') AS spec, CASE WHEN contains(src, '/') AND EXISTS (SELECT 1 FROM fl WHERE fl.repo = im.repo AND fl.path = im.dst) THEN dst END AS target FROM im",
    "import_counts": f"WITH {FL}, {IM} SELECT repo, src, dst, count(*) AS statements FROM im WHERE EXISTS (SELECT 1 FROM fl WHERE fl.repo = im.repo AND fl.path = im.dst) GROUP BY ALL",
    "imported_by": f"WITH {IM} SELECT DISTINCT repo, dst AS src, src AS dst FROM im WHERE src <> dst",
    "test_files": f"WITH {FL}, s AS (SELECT DISTINCT repo, path AS src, regexp_replace(path, '\\.ts$', '') AS stem, {DIR} AS dir FROM fl WHERE path LIKE '%.ts' AND NOT {_test('path')}), c AS (SELECT repo, src, unnest([stem || '.test.ts', stem || '.spec.ts', dir || '/__tests__/' || regexp_extract(stem, '([^/]*)$', 1) || '.test.ts', dir || '/__tests__/' || regexp_extract(stem, '([^/]*)$', 1) || '.spec.ts']) AS dst, unnest([1, 2, 3, 4]) AS p FROM s) SELECT c.repo, src, arg_min(dst, p) AS dst FROM c WHERE EXISTS (SELECT 1 FROM fl WHERE fl.repo = c.repo AND fl.path = c.dst) GROUP BY c.repo, src",
    "impact_bfs": f"WITH RECURSIVE {IM}, {BFS} SELECT * FROM bfs",
    "impact_by_depth": f"WITH RECURSIVE {IM}, {BFS} SELECT repo, depth, count(*) AS nodes FROM bfs GROUP BY ALL",
    "tests_for_impact": f"WITH RECURSIVE {IM}, {BFS} SELECT DISTINCT e.repo, e.dst AS test FROM ed e JOIN (SELECT repo, node FROM bfs UNION SELECT repo, node FROM seed) n ON n.repo = e.repo AND n.node = e.src WHERE e.edge_type = 'testFile'",
    "context_bundle": f"WITH {FL}, {IM}, {SEED}, b AS (SELECT repo, node, 0 AS hop FROM seed UNION ALL SELECT e.repo, e.dst, 1 FROM ed e JOIN seed s ON s.repo = e.repo AND s.node = e.src WHERE e.edge_type IN ('imports', 'parent', 'testFile')) SELECT repo, node, min(hop) AS hop FROM b WHERE EXISTS (SELECT 1 FROM fl WHERE fl.repo = b.repo AND fl.path = b.node) GROUP BY repo, node",
    "function_consumers": f"WITH {FN}, {CALLS}, c AS (SELECT repo, dst, {_test('string_split(src, chr(58))[1]')} AS t FROM ca) SELECT f.repo, f.node_id, count(c.dst) FILTER (WHERE NOT c.t) AS production, count(c.dst) FILTER (WHERE c.t) AS tests FROM (SELECT DISTINCT repo, node_id FROM fn WHERE is_exported) f LEFT JOIN c ON c.repo = f.repo AND c.dst = f.node_id GROUP BY f.repo, f.node_id",
    "cross_calls": f"WITH {CALLS} SELECT repo, src AS caller, array_to_string(list_sort(list(DISTINCT dst)), '|') AS callees, count(imported_as) AS renamed FROM ca GROUP BY repo, src",
    "called_by": f"WITH {FN}, c AS (SELECT DISTINCT repo, path, func_name AS caller, unnest(calls) AS func_name FROM fn) SELECT c.repo, c.path, c.func_name, string_agg(c.caller, '|' ORDER BY c.caller) AS callers FROM c WHERE EXISTS (SELECT 1 FROM fn WHERE fn.repo = c.repo AND fn.path = c.path AND fn.func_name = c.func_name) GROUP BY ALL",
    "importers": f"WITH {SYM} SELECT repo, source_file, symbol_name, count(*) FILTER (WHERE NOT {_test('path')}) AS production, count(*) FILTER (WHERE {_test('path')}) AS tests FROM sy GROUP BY repo, source_file, symbol_name",
    "reexport_chain": f"WITH RECURSIVE {SYM}, o AS (SELECT repo, path, symbol_name, min(source_file) AS nxt FROM sy GROUP BY ALL), w AS (SELECT repo, path, symbol_name, nxt AS origin, 1 AS hops FROM o UNION ALL SELECT w.repo, w.path, w.symbol_name, o.nxt, w.hops + 1 FROM w JOIN o ON o.repo = w.repo AND o.path = w.origin AND o.symbol_name = w.symbol_name WHERE w.hops < 5) SELECT repo, path, symbol_name, arg_max(origin, hops) AS origin, max(hops) AS hops FROM w GROUP BY repo, path, symbol_name",
    "suffix_join": f"WITH {FL}, {SYM}, r AS (SELECT DISTINCT repo, regexp_replace(source_file, '^(?:src|packages/[^/]+/src)/', '') AS ref FROM sy), x AS (SELECT repo, ref, regexp_replace(regexp_replace(ref, '^\\./', ''), '\\.(ts|js|tsx|jsx)$', '') AS a FROM r), y AS (SELECT DISTINCT repo, path, regexp_replace(regexp_replace(path, '^\\./', ''), '\\.(ts|js|tsx|jsx)$', '') AS b FROM fl) SELECT x.repo, ref, count(DISTINCT path) AS files FROM x JOIN y ON x.repo = y.repo AND (a = b OR ends_with(b, '/' || a) OR ends_with(a, '/' || b)) GROUP BY x.repo, ref",
    "affected_functions": f"WITH {FN}, {IM}, {WORDS}, e AS (SELECT DISTINCT repo, path AS dst, func_name AS word FROM fn WHERE is_exported) SELECT DISTINCT im.repo, im.src, ws.func_name, e.word AS uses FROM im JOIN e ON e.repo = im.repo AND e.dst = im.dst JOIN ws ON ws.repo = im.repo AND ws.src = im.src AND ws.word = e.word",
    "entry_points": f"WITH {FN}, {FL}, {FAN}, e AS (SELECT repo, path, count(DISTINCT func_name) AS n FROM fn WHERE is_exported GROUP BY repo, path) SELECT fan.repo, fan.path, coalesce(n, 0) AS exports FROM fan LEFT JOIN e USING (repo, path) WHERE fan_in = 0 AND coalesce(n, 0) <= 1",
    "overview_tree": f"WITH {FL} SELECT repo, {DIR} AS directory, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT DISTINCT repo, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM fl) f GROUP BY ALL",
    "relationships": f"WITH {FN}, {FL}, {FAN}, e AS (SELECT repo, path, string_agg(DISTINCT func_name, '|' ORDER BY func_name) AS x FROM fn WHERE is_exported GROUP BY repo, path) SELECT fan.repo, fan.path, fan_in AS consumers, coalesce(x, '') AS exports FROM fan LEFT JOIN e USING (repo, path) WHERE fan_in >= 5",
    "config_files": f"SELECT DISTINCT repo, path FROM (SELECT repo, path FROM file_nodes UNION ALL SELECT repo, path FROM package_json) x WHERE regexp_extract(path, '([^/]*)$', 1) IN {_in(CONFIG_FILES)}",
    "fuzzy_paths": f"WITH {fuzzy(ASKED)} SELECT query, path, score, confidence, rank FROM fz WHERE rank <= 3",
    "fuzzy_match": f"WITH {fuzzy(ASKED)}, b AS (SELECT query, list(path ORDER BY rank) AS p, list(confidence ORDER BY rank) AS c FROM fz WHERE rank <= 5 GROUP BY query) SELECT query, CASE WHEN c[1] >= 0.4 THEN p[1] END AS matched, array_to_string(CASE WHEN c[1] >= 0.7 THEN p[2:4] ELSE p[1:3] END, '|') AS alternatives FROM b",
    "similar_paths": similar(ASKED),
    "grep_union": f"WITH {FN}, g AS (SELECT * FROM fn), m AS (SELECT repo, path, 'function' AS kind FROM g WHERE regexp_matches(func_name, '{GREP}') UNION ALL SELECT repo, path, 'signature' FROM g WHERE regexp_matches(signature, '{GREP}') UNION ALL SELECT repo, path, 'code' FROM g WHERE regexp_matches(code_snippet, '{GREP}') UNION ALL SELECT repo, path, 'export' FROM g WHERE is_exported AND regexp_matches(func_name, '{GREP}') UNION ALL SELECT repo, path, 'keyStatement' FROM (SELECT repo, path, unnest(key_statements) AS s FROM g) x WHERE regexp_matches(s.text, '{GREP}')) SELECT repo, path, kind, count(*) AS matches FROM m GROUP BY ALL",
    "grep_scoped": f"WITH {FN}, g AS (SELECT * FROM fn WHERE starts_with(path, 'src/')), m AS (SELECT repo, path, 'function' AS kind FROM g WHERE regexp_matches(func_name, '{GREP}') UNION ALL SELECT repo, path, 'signature' FROM g WHERE regexp_matches(signature, '{GREP}') UNION ALL SELECT repo, path, 'code' FROM g WHERE regexp_matches(code_snippet, '{GREP}') UNION ALL SELECT repo, path, 'export' FROM g WHERE is_exported AND regexp_matches(func_name, '{GREP}') UNION ALL SELECT repo, path, 'keyStatement' FROM (SELECT repo, path, unnest(key_statements) AS s FROM g) x WHERE regexp_matches(s.text, '{GREP}')) SELECT repo, path, kind, count(*) AS matches FROM m GROUP BY ALL",
    "http_status": f"WITH {FN}, {ERR} SELECT * FROM er",
    "errors_by_status": f"WITH {FN}, {ERR}, h(status, name) AS (VALUES {', '.join(f'({k}, {v!r})' for k, v in HTTP_STATUS.items())}) SELECT er.status, coalesce(h.name, 'HTTP ' || er.status) AS description, count(*) AS paths FROM er LEFT JOIN h USING (status) WHERE er.status IS NOT NULL GROUP BY ALL",
    "inline_comments": f"WITH {FN}, {LINES} SELECT func_id, n, regexp_extract(line, '(?:^|[^:])//\\s*(.+)', 1) AS comment FROM ln WHERE regexp_extract(line, '(?:^|[^:])//\\s*(.+)', 1) <> ''",
    "markers": f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT DISTINCT comment_id, '// ' || text FROM doc_comments WHERE text IS NOT NULL), ln AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d) x) SELECT doc_id, n, upper(regexp_extract(line, '{NOTE}', 1)) AS marker, trim(regexp_replace(regexp_extract(line, '{NOTE}', 2), '\\*/\\s*$', ''), ' ') AS note FROM ln WHERE regexp_matches(line, '{NOTE}')",
    "key_statement_lines": f"WITH {FN}, {LINES}, c AS (SELECT func_id, {CATEGORY} AS category FROM ln) SELECT category, count(*) AS n, count(DISTINCT func_id) AS functions FROM c WHERE category IS NOT NULL GROUP BY category",
    "comment_functions": f"WITH {FN}, c AS (SELECT DISTINCT comment_id, repo, path, line FROM doc_comments) SELECT c.comment_id, (SELECT min_by(func_name, {{'a': start_line, 'b': func_name}}) FROM fn WHERE fn.repo = c.repo AND fn.path = c.path AND c.line BETWEEN fn.start_line AND fn.end_line) AS enclosing FROM c",
    "pattern_files": f"WITH {FN}, {PAT} SELECT * FROM pt",
    "content_hash": "SELECT CASE WHEN text IS NULL THEN NULL ELSE 'sha256-' || sha256(text) END AS content_hash, count(*) AS documents FROM documents GROUP BY ALL",
    "changed_files": "WITH o AS (SELECT doc_id, 'sha256-' || sha256(text) AS h FROM documents WHERE ingested_at AT TIME ZONE 'UTC' < TIMESTAMP '2024-06-01 00:00:00') SELECT d.doc_id, 'sha256-' || sha256(d.text) AS content_hash FROM documents d LEFT JOIN o USING (doc_id) WHERE ('sha256-' || sha256(d.text)) IS DISTINCT FROM o.h",
    "upsert_merge": "WITH f AS (SELECT file_id, line_count, commit_count, primary_author, extracted_at FROM file_nodes), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY extracted_at) = 1), n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY extracted_at DESC) = 1) SELECT file_id, o.line_count, coalesce(n.commit_count, o.commit_count) AS commit_count, coalesce(n.primary_author, o.primary_author) AS primary_author FROM o JOIN n USING (file_id)",
    "stale_nodes": f"WITH {FL} SELECT file_id FROM fl WHERE last_modified > extracted_at",
    "claim_confidence": f"WITH {FN}, {FL}, js AS (SELECT repo, path, unnest(map_entries(jsdoc)) AS e FROM fl), c AS (SELECT repo, path, e.key AS name, e.value.description AS t FROM js WHERE e.value.description IS NOT NULL), i AS (SELECT repo, path, name, unnest(CASE WHEN len({IDS}) = 0 THEN [NULL] ELSE {IDS} END) AS id FROM c), k AS (SELECT repo, path, name, id, EXISTS (SELECT 1 FROM fn WHERE fn.repo = i.repo AND fn.path = i.path AND fn.func_name = i.id) AS ok FROM i), g AS (SELECT repo, path, name, count(id) FILTER (WHERE ok) AS found, count(id) AS asked FROM k GROUP BY ALL) SELECT *, CASE WHEN asked > 0 AND found = asked THEN 'high' WHEN found > 0 THEN 'medium' ELSE 'low' END AS confidence FROM g",
    "token_cost": "SELECT count(*) AS rows, CAST(sum(ceil((coalesce(length(text), 0) + 500) / 4.0)) AS BIGINT) AS input_tokens, count(*) * 500 AS output_tokens, round(CAST(sum(ceil((coalesce(length(text), 0) + 500) / 4.0)) AS BIGINT) / 1000.0 * 0.003 + count(*) * 500 / 1000.0 * 0.015, 4) AS cost FROM documents",
    "target_counts": f"WITH {ED} SELECT edge_type, count(*) AS n FROM ed GROUP BY edge_type",
    "deprecations": f"WITH {FL}, js AS (SELECT repo, path, unnest(map_entries(jsdoc)) AS e FROM fl) SELECT repo, path, e.key AS name, e.value.deprecated AS note FROM js WHERE e.value.deprecated IS NOT NULL",
    "manifest_dependencies": "SELECT name, count(*) AS packages FROM (SELECT DISTINCT package_id, e.key AS name, e.value AS version FROM (SELECT package_id, unnest(map_entries(dependencies)) AS e FROM package_json) x) y GROUP BY name",
    "part_index": "SELECT DISTINCT * FROM (SELECT 'export' AS kind, unnest(string_split(lower(p_name), ' ')) AS token, p_partkey FROM part UNION ALL SELECT 'pattern', lower(p_type), p_partkey FROM part) x",
    "used_symbols": f"WITH {SYM} SELECT repo, source_file, path, coalesce(string_agg(DISTINCT symbol_name, '|' ORDER BY symbol_name), '') AS symbols FROM sy GROUP BY repo, source_file, path",
    "uses_exports": f"WITH {FN}, {IM}, {WORDS}, e AS (SELECT DISTINCT repo, path AS dst, func_name AS word FROM fn WHERE is_exported) SELECT DISTINCT im.repo, im.src, im.dst FROM im JOIN e ON e.repo = im.repo AND e.dst = im.dst JOIN ws ON ws.repo = im.repo AND ws.src = im.src AND ws.word = e.word",
    "metadata": f"WITH {FL}, {FAN}, a AS (SELECT repo, path, max(CAST(floor((1751328000000 - epoch_ms(created_at)) / 86400000.0) AS BIGINT)) AS age_days, min(CAST(floor((1751328000000 - epoch_ms(last_modified)) / 86400000.0) AS BIGINT)) AS recency_days FROM fl GROUP BY repo, path) SELECT * FROM fan JOIN a USING (repo, path)",
    "imported_names": f"WITH {SYM}, {NAMES} SELECT repo, path, array_to_string(names, '|') AS names FROM nm",
    "entry_descriptions": f"WITH {FN}, {FL}, {FAN}, {PROSE}, {SYM}, {NAMES}, {ENTRY} SELECT en.repo, en.path, coalesce(pr.summary, 'uses: ' || array_to_string(nm.names, ', '), 'entry point') AS description FROM en LEFT JOIN pr USING (repo, path) LEFT JOIN nm USING (repo, path)",
    "connections": f"WITH {FN}, {FL}, {FAN}, {SYM}, {NAMES}, {ENTRY}, f AS (SELECT en.repo, en.path, nm.names FROM en JOIN nm USING (repo, path)), x AS (SELECT repo, path, string_agg(DISTINCT func_name, '|' ORDER BY func_name) AS x FROM fn WHERE is_exported GROUP BY repo, path) SELECT repo, path, array_to_string(names, '|') AS names, CAST(NULL AS BIGINT) AS consumers FROM f UNION ALL SELECT fan.repo, fan.path, coalesce(x.x, ''), fan.fan_in FROM fan LEFT JOIN x USING (repo, path) WHERE fan_in >= 5 AND NOT EXISTS (SELECT 1 FROM f WHERE f.repo = fan.repo AND f.path = fan.path)",
    "module_exports": f"WITH {FN}, {MO}, {PARENT} SELECT pa.repo, pa.dst AS module, string_agg(DISTINCT fn.func_name, '|' ORDER BY fn.func_name) AS exports FROM pa JOIN fn ON fn.repo = pa.repo AND fn.path = pa.src WHERE fn.is_exported GROUP BY pa.repo, pa.dst",
    "expanded_functions": f"WITH {FN}, {FL}, {FAN}, {PAT}, n AS (SELECT repo, path, count(*) AS n FROM fn GROUP BY repo, path), h AS (SELECT DISTINCT repo, path, regexp_extract(location, '([^:]*)$', 1) AS func_name FROM pt WHERE contains(location, ':')) SELECT fn.repo, fn.path, fn.func_name, n.n < 5 OR coalesce(fan.fan_in, 0) > 5 OR h.func_name IS NOT NULL OR coalesce(len(list_filter(key_statements, lambda x: x.category = 'error')), 0) > 0 AS expanded FROM fn JOIN n USING (repo, path) LEFT JOIN fan USING (repo, path) LEFT JOIN h ON h.repo = fn.repo AND h.path = fn.path AND h.func_name = fn.func_name",
    "throws": f"WITH {FN}, {LINES}, t AS (SELECT func_id, CAST(n AS INT) AS line, regexp_extract(line, '\\bif \\((.*)\\) \\{{ throw ', 1) AS c, regexp_extract(line, '\\b(throw .*);', 1) AS act FROM ln WHERE regexp_matches(line, '\\bthrow ')) SELECT func_id, line, CASE WHEN c <> '' THEN c END AS condition, http_status FROM (SELECT *, c || ' ' || act AS t FROM t) x, LATERAL (SELECT {STATUS} AS http_status) y",
    "early_returns": f"WITH {FN}, {LINES}, last AS (SELECT func_id, max(n) AS m FROM ln WHERE regexp_matches(line, '^  [^ /}}]') GROUP BY func_id) SELECT ln.func_id, CAST(n AS INT) AS line, regexp_extract(line, '\\bif \\((.*)\\) \\{{ (return\\b[^;]*);', 1) AS condition, regexp_extract(line, '\\bif \\((.*)\\) \\{{ (return\\b[^;]*);', 2) AS action FROM ln JOIN last ON last.func_id = ln.func_id AND n < m WHERE regexp_matches(line, '\\bif \\(.*\\) \\{{ return\\b')",
    "fuzzy_paths_every": f"WITH {fuzzy(EVERY)} SELECT query, path, score, confidence, rank FROM fz WHERE rank <= 3",
    "fuzzy_match_every": f"WITH {fuzzy(EVERY)}, b AS (SELECT query, list(path ORDER BY rank) AS p, list(confidence ORDER BY rank) AS c FROM fz WHERE rank <= 5 GROUP BY query) SELECT query, CASE WHEN c[1] >= 0.4 THEN p[1] END AS matched, array_to_string(CASE WHEN c[1] >= 0.7 THEN p[2:4] ELSE p[1:3] END, '|') AS alternatives FROM b",
    "similar_paths_every": similar(EVERY),
    "impact_bfs_every": f"WITH RECURSIVE {IM}, {BFS_EVERY} SELECT * FROM bfs",
    "impact_by_depth_every": f"WITH RECURSIVE {IM}, {BFS_EVERY} SELECT repo, seed, depth, count(*) AS nodes FROM bfs GROUP BY ALL",
    "tests_for_impact_every": f"WITH RECURSIVE {IM}, {BFS_EVERY} SELECT DISTINCT e.repo, n.seed, e.dst AS test FROM ed e JOIN (SELECT repo, seed, node FROM bfs UNION SELECT repo, seed, node FROM seed) n ON n.repo = e.repo AND n.node = e.src WHERE e.edge_type = 'testFile'",
    "context_bundle_every": f"WITH {MO}, {PARENT}, {IM}, {SEEDS}, x AS (SELECT repo, src, dst FROM ed WHERE edge_type IN ('imports', 'parent', 'testFile') UNION ALL SELECT repo, src, dst FROM pa), k AS (SELECT repo, path AS node FROM fl UNION SELECT repo, module FROM mo), b AS (SELECT repo, seed, node, 0 AS hop FROM seed UNION ALL SELECT x.repo, s.seed, x.dst, 1 FROM x JOIN seed s ON s.repo = x.repo AND s.node = x.src) SELECT b.repo, b.seed, b.node, min(hop) AS hop FROM b WHERE EXISTS (SELECT 1 FROM k WHERE k.repo = b.repo AND k.node = b.node) GROUP BY b.repo, b.seed, b.node",
}
