"""Queries of the registry engine, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import align, evaluate, registry, rules, textsearch
from cairn.plans import search_sql
from cairn.sources.tables import lines, table

TERM = "tion"
TEMPLATES = ["<word>_of_<word>", "the_<word>", "<word>_that_<word>_<word>"]

# Shared parts of the SQL.
_LINES = """lines AS (SELECT doc_id, lang, source, CAST(generate_subscripts(a, 1) AS BIGINT) AS line, unnest(a) AS txt
 FROM (SELECT doc_id, lang, source, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents))"""
_NAMES = _LINES + """, line_names AS (SELECT doc_id, line, array_to_string(w[1:4], '_') AS name FROM (
 SELECT doc_id, line, list_filter(regexp_extract_all(txt, '[a-z]+'), lambda x: length(x) >= 2) AS w FROM lines) WHERE len(w) >= 3),
reg AS (SELECT DISTINCT name FROM line_names)"""
_POSTINGS = _NAMES + ", post AS (SELECT DISTINCT name, unnest(string_split(name, '_')) AS token FROM reg)"
_STATS = _POSTINGS + """, stats AS (SELECT token, count(*) AS df,
 round(1 + least(1.0, ln(((SELECT count(*) FROM reg) + 1) / (count(*) + 1)) / 8), 6) AS weight,
 round(greatest(0.0, ln((SELECT count(*) FROM reg) / count(*))), 6) AS info FROM post GROUP BY token)"""
_CASES = _STATS + """, base AS (SELECT doc_id AS query_id, arg_min(name, line) AS expected, (doc_id // 20) % 6 AS choice FROM line_names WHERE doc_id % 20 = 0 GROUP BY doc_id),
cut AS (SELECT *, string_split(expected, '_') AS t FROM base),
cases AS (SELECT query_id, ['missing','extra','typo','transposition','truncation','separator'][choice + 1] AS mutation, CASE choice
 WHEN 0 THEN array_to_string(list_concat(t[1:1], t[3:]), '_')
 WHEN 1 THEN array_to_string(list_concat(t[1:1], ['extra'], t[2:]), '_')
 WHEN 2 THEN array_to_string(list_concat([CASE WHEN length(t[1]) >= 4 THEN substr(t[1], 1, 1) || substr(t[1], 3) ELSE t[1] END], t[2:]), '_')
 WHEN 3 THEN array_to_string(list_concat([CASE WHEN length(t[1]) >= 4 THEN substr(t[1], 1, 1) || substr(t[1], 3, 1) || substr(t[1], 2, 1) || substr(t[1], 4) ELSE t[1] END], t[2:]), '_')
 WHEN 4 THEN array_to_string(list_concat(t[1:len(t) - 1], [CASE WHEN length(t[-1]) >= 5 THEN substr(t[-1], 1, length(t[-1]) - 2) ELSE t[-1] END]), '_')
 ELSE array_to_string(list_concat([t[1] || t[2]], t[3:]), '_') END AS query, expected FROM cut),
qtok AS (SELECT query_id, unnest(string_split(query, '_')) AS qtoken FROM cases)"""
_GRAMS = """grams AS (SELECT DISTINCT token, substr('^' || token || '$', CAST(i AS BIGINT), 2) AS gram FROM (SELECT token, unnest(range(1, length(token) + 2)) AS i FROM stats)),
qgrams AS (SELECT DISTINCT qtoken, substr('^' || qtoken || '$', CAST(i AS BIGINT), 2) AS gram FROM (SELECT qtoken, unnest(range(1, length(qtoken) + 2)) AS i FROM (SELECT DISTINCT qtoken FROM qtok) WHERE length(qtoken) >= 3)),
typos AS (SELECT qtoken, token, distance FROM (SELECT qtoken, token, CAST(levenshtein(qtoken, token) AS BIGINT) AS distance FROM (
 SELECT DISTINCT qtoken, token FROM grams JOIN qgrams USING (gram) WHERE token <> qtoken AND length(token) >= 3
 AND abs(length(qtoken) - length(token)) <= CASE WHEN least(length(qtoken), length(token)) >= 7 THEN 2 ELSE 1 END))
 WHERE distance <= 0.34 * greatest(length(qtoken), length(token)))"""
_PREFIXES = "prefixes AS (SELECT DISTINCT q.qtoken, s.token FROM (SELECT DISTINCT qtoken FROM qtok) q JOIN stats s ON length(q.qtoken) >= 3 AND length(s.token) > length(q.qtoken) AND starts_with(s.token, q.qtoken))"
_SHORT = _CASES + ", ask AS (SELECT query_id, query, query AS needle FROM cases), " + search_sql.shortlist("ask")
_BEST = _CASES + ", " + search_sql.matches()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return registry.identifier_registry(_docs(spark, d))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, names and token statistics, each worked out once: the search reads them many times."""
    reg = _registry(spark, d).persist()
    return evaluate.mutation_cases(_docs(spark, d)).persist(), reg, registry.token_stats(reg).persist()


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mutation_cases(_docs(spark, d))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return registry.token_stats(_registry(spark, d))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


@query(f"WITH {_LINES} SELECT doc_id, line, txt FROM lines")
def lines_scan(spark, d):
    return lines(_docs(spark, d))


@query(f"WITH {_NAMES} SELECT name FROM reg")
def identifier_registry(spark, d):
    return _registry(spark, d)


@query(f"WITH {_STATS} SELECT token, df, weight, info FROM stats")
def token_stats(spark, d):
    return _stats(spark, d)


@query(f"WITH {_POSTINGS} SELECT token, name, rank FROM (SELECT token, name, row_number() OVER (PARTITION BY token ORDER BY name) AS rank FROM post) WHERE rank <= 150")
def postings_top(spark, d):
    return registry.postings_top(_registry(spark, d))


@query(f"WITH {_STATS} SELECT DISTINCT substr('^' || token || '$', CAST(i AS BIGINT), 2) AS gram, token FROM (SELECT token, unnest(range(1, length(token) + 2)) AS i FROM stats)")
def bigram_index(spark, d):
    return registry.bigram_index(_stats(spark, d))


@query(f"WITH {_CASES} SELECT query_id, upper(expected) AS query, name FROM cases JOIN reg ON lower(upper(expected)) = lower(name)")
def exact_lookup(spark, d):
    return registry.exact_lookup(_cases(spark, d).select("query_id", F.upper("expected").alias("query")), _registry(spark, d))


@query(f"WITH {_CASES} SELECT query_id, mutation, query, expected FROM cases")
def mutation_cases(spark, d):
    return _cases(spark, d)


@query(f"WITH {_NAMES} SELECT name, array_to_string(list_reverse(t), '_') AS reverse, array_to_string(list_concat(t[2:], t[1:1]), '_') AS rotate FROM (SELECT name, string_split(name, '_') AS t FROM reg) WHERE len(t) >= 3")
def name_permutations(spark, d):
    return evaluate.permuted(_registry(spark, d))


@query(f"WITH {_CASES}, {_GRAMS} SELECT qtoken, token, distance FROM typos")
def typo_candidates(spark, d):
    return registry.typo_candidates(_cases(spark, d), _stats(spark, d))


@query(f"WITH {_CASES}, {search_sql.osa_typos('qtok')} SELECT qtoken, token, distance FROM osa_typo")
def osa_typos(spark, d):
    return registry.osa_typos(_cases(spark, d), _stats(spark, d))


@query(f"WITH {_CASES}, {_PREFIXES} SELECT qtoken, token FROM prefixes")
def prefix_readings(spark, d):
    return registry.prefix_readings(_cases(spark, d), _stats(spark, d))


@query(f"""WITH {_CASES} SELECT query_id, query, CAST(i AS BIGINT) AS at, token FROM (SELECT query_id, query, i, t[CAST(i AS BIGINT) + 1] || t[CAST(i AS BIGINT) + 2] AS token FROM (
 SELECT query_id, query, string_split(query, '_') AS t, unnest(range(0, len(string_split(query, '_')) - 1)) AS i FROM cases)) m WHERE length(token) >= 6 AND token IN (SELECT token FROM stats)""")
def merge_segments(spark, d):
    return registry.merge_segments(_cases(spark, d), _stats(spark, d))


@query(f"WITH {_SHORT} SELECT query_id, name, support, priority, rank FROM short")
def shortlist_topk(spark, d):
    cases, reg, stats = _index(spark, d)
    return registry.shortlist_topk(cases, reg, stats)


@query(f"""WITH {_BEST}, {search_sql.TOP} SELECT query_id, query, name, rank, 'SUGGESTION' AS status, 'token_edit' AS match_kind, match_score, query_support, candidate_coverage, array_to_string(matched, ',') AS matched,
 array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, '[' || array_to_string(changes, ',') || ']' AS substitutions, '[]' AS bindings FROM top""")
def fuzzy_search(spark, d):
    cases, reg, stats = _index(spark, d)
    return align.fuzzy_search(cases.select("query_id", "query"), reg, stats)


@query(f"WITH {_BEST}, {search_sql.TIERS} SELECT query_id, tier, rank, name, match_score, query_support, candidate_coverage, total FROM placed WHERE rank <= CASE WHEN tier = 'result' THEN 20 ELSE 40 END")
def search_tiers(spark, d):
    cases, reg, stats = _index(spark, d)
    matches = align.fuzzy_matches(cases.select("query_id", "query"), reg, stats, least=align.RELATED_SCORE)
    return align.tiers(matches).select("query_id", "tier", "rank", "name", "match_score", "query_support", "candidate_coverage", "total")


@query(f"""WITH {_BEST}, {search_sql.TOP}, hit AS (SELECT query_id, mutation, expected, min(CASE WHEN name = expected THEN rank END) AS place, count(name) AS n FROM cases LEFT JOIN top USING (query_id) GROUP BY ALL)
SELECT coalesce(mutation, 'all') AS mutation, count(*) AS queries, count(CASE WHEN place <= 1 THEN 1 END) AS hit_1, count(CASE WHEN place <= 5 THEN 1 END) AS hit_5, count(CASE WHEN n > 0 THEN 1 END) AS returned
FROM hit GROUP BY GROUPING SETS ((mutation), ())""")
def fuzzy_metrics(spark, d):
    return evaluate.metrics(_cases(spark, d), fuzzy_search(spark, d).select("query_id", "name", "rank"))


@query(f"""WITH {_CASES}, perm AS (SELECT *, string_split(expected, '_') AS t FROM cases), every AS (SELECT query_id, mutation, query, expected FROM cases
 UNION ALL SELECT query_id + {1 << 40}, 'reverse', array_to_string(list_reverse(t), '_'), expected FROM perm WHERE len(t) >= 3 UNION ALL SELECT query_id + {2 << 40}, 'rotate', array_to_string(list_concat(t[2:], t[1:1]), '_'), expected FROM perm WHERE len(t) >= 3
 UNION ALL SELECT query_id + {3 << 40}, 'unrelated', 'zzq' || query_id || '_xxk_vvw', expected FROM cases),
found AS (WITH cases AS (SELECT query_id, query FROM every), {search_sql.matches()}, {search_sql.TOP} SELECT query_id, name, rank, match_score FROM top),
hit AS (SELECT query_id, mutation, CASE WHEN substr(md5(expected), 1, 1) < '8' THEN 'calibration' ELSE 'holdout' END AS split, min(CASE WHEN name = expected THEN rank END) AS place, max(match_score) AS best FROM every LEFT JOIN found USING (query_id) GROUP BY query_id, mutation, expected)
SELECT split, mutation, count(*) AS queries, count(CASE WHEN place <= 1 THEN 1 END) AS hit_1, count(CASE WHEN place <= 5 THEN 1 END) AS hit_5, count(best) AS returned, quantile_disc(best, 0.5) AS median_score, quantile_disc(best, 0.95) AS p95_score FROM hit GROUP BY split, mutation""")
def evaluation(spark, d):
    """The search on mutated, reversed, rotated and unrelated names, by split."""
    cases, reg, stats = _index(spark, d)
    every = evaluate.evaluation_cases(cases).persist()
    found = align.fuzzy_search(every.select("query_id", "query"), reg, stats)
    return evaluate.evaluated(every, found.select("query_id", "name", "rank", "match_score"))


@query(f"""WITH {_SHORT}, best AS (SELECT query_id, mutation, expected, min(CASE WHEN name = expected THEN rank END) AS place, count(name) AS n FROM cases LEFT JOIN short USING (query_id) GROUP BY ALL)
SELECT coalesce(mutation, 'all') AS mutation, count(*) AS queries, count(CASE WHEN place <= 1 THEN 1 END) AS hit_1, count(CASE WHEN place <= 5 THEN 1 END) AS hit_5, count(CASE WHEN n > 0 THEN 1 END) AS returned
FROM best GROUP BY GROUPING SETS ((mutation), ())""")
def eval_metrics(spark, d):
    return evaluate.metrics(_cases(spark, d), shortlist_topk(spark, d).select("query_id", "name", "rank"))


_TEMPLATE_SQL = " UNION ALL ".join(
    f"SELECT query_id, query, '{name}' AS template, array_to_string([{', '.join(f'''regexp_extract(query, '{pattern}', {i + 1})''' for i in range(len(holes)))}], ',') AS captures FROM names WHERE regexp_matches(query, '{pattern}')"
    for name, pattern, holes, _, _ in rules.template_rows(TEMPLATES)
)


@query(f"WITH {_NAMES}, names AS (SELECT name AS query_id, name AS query FROM reg) {_TEMPLATE_SQL}")
def template_match(spark, d):
    names = _registry(spark, d).select(F.col("name").alias("query_id"), F.col("name").alias("query"))
    return rules.template_match(names, TEMPLATES).select("query_id", "query", "template", F.array_join("captures", ",").alias("captures"))


@query("""WITH defs AS (SELECT 'nation' AS type, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region),
cap AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'nation' WHEN p_size % 3 = 1 THEN 'region' ELSE 'planet' END AS type, CASE WHEN p_size % 2 = 0 THEN 'FRANCE' ELSE p_brand END AS value FROM part)
SELECT type, value, CASE WHEN EXISTS (SELECT 1 FROM defs d WHERE d.type = cap.type AND lower(d.name) = lower(cap.value)) THEN 'CONFIRMED' WHEN type IN (SELECT type FROM defs) THEN 'NOT_FOUND' ELSE 'UNRESOLVED' END AS state FROM cap""")
def template_verify(spark, d):
    defs = table(spark, d, "nation").select(F.lit("nation").alias("type"), F.col("n_name").alias("name")).unionByName(table(spark, d, "region").select(F.lit("region").alias("type"), F.col("r_name").alias("name")))
    kind = F.when(F.col("p_size") % 3 == 0, "nation").when(F.col("p_size") % 3 == 1, "region").otherwise("planet")
    captures = table(spark, d, "part").select(kind.alias("type"), F.when(F.col("p_size") % 2 == 0, "FRANCE").otherwise(F.col("p_brand")).alias("value")).distinct()
    return rules.verified(captures, defs)


@query("""WITH kinds AS (SELECT unnest(['cost_mult','produces_add','upkeep_mult']) AS kind),
cat AS (SELECT lower(r_name) AS category, r_regionkey AS ord, CASE WHEN r_regionkey % 2 = 0 THEN ['cost_mult','produces_add'] ELSE ['upkeep_mult'] END AS generates FROM region),
res AS (SELECT lower(n_name) AS resource FROM nation UNION ALL SELECT NULL),
gen AS (SELECT concat_ws('_', category, resource, kind) AS name, category, resource, kind, ord FROM cat JOIN kinds ON list_contains(generates, kind) CROSS JOIN res WHERE resource IS NOT NULL OR kind LIKE '%mult')
SELECT name, category, resource, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord, resource NULLS FIRST, kind) AS rn FROM gen) WHERE rn = 1""")
def generated_names(spark, d):
    even = F.col("r_regionkey") % 2 == 0
    cats = table(spark, d, "region").select(F.lower("r_name").alias("category"), F.col("r_regionkey").alias("ord"), F.when(even, F.array(F.lit("cost_mult"), F.lit("produces_add"))).otherwise(F.array(F.lit("upkeep_mult"))).alias("generates"))
    kinds = spark.createDataFrame([("cost_mult",), ("produces_add",), ("upkeep_mult",)], "kind string")
    return rules.generated_names(cats, table(spark, d, "nation").select(F.lower("n_name").alias("resource")), kinds)


@query("""SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderpriority, count(*) AS n_definitions FROM orders GROUP BY o_custkey""")
def definition_override(spark, d):
    return rules.overridden(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT user_id, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS event_type, count(*) AS n_definitions FROM events GROUP BY user_id""")
def first_definition(spark, d):
    return rules.overridden(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], last=False).drop("ts")


@query(f"""WITH {_LINES}, hit AS (SELECT *, CAST(contains(lower(txt), '{TERM}') AS INT) AS h FROM lines),
files AS (SELECT lang, source, doc_id, sum(h) AS hits, count(*) AS n FROM hit GROUP BY ALL),
grp AS (SELECT *, row_number() OVER (ORDER BY gh / sqrt(gl) DESC, gh DESC, lang, source) AS g FROM (SELECT lang, source, sum(hits) AS gh, sum(n) AS gl FROM files GROUP BY ALL) WHERE gh > 0),
ranked AS (SELECT f.*, g, row_number() OVER (PARTITION BY f.lang, f.source ORDER BY hits / sqrt(n) DESC, hits DESC, doc_id) AS f FROM files f JOIN grp USING (lang, source) WHERE hits > 0),
chosen AS (SELECT *, row_number() OVER (ORDER BY f, g) AS fo FROM ranked QUALIFY fo <= 20),
rows_ AS (SELECT h.*, fo, row_number() OVER (PARTITION BY h.doc_id ORDER BY line) AS r FROM hit h JOIN chosen c ON h.doc_id = c.doc_id WHERE h = 1),
top AS (SELECT *, row_number() OVER (ORDER BY r, fo) AS place FROM rows_ QUALIFY place <= 20)
SELECT place, lang, source, doc_id, line, CASE WHEN length(trim(txt)) > 110 THEN rtrim(substr(trim(txt), 1, 109)) || '…' ELSE trim(txt) END AS snippet, CAST((SELECT sum(gh) FROM grp) AS BIGINT) AS total FROM top""")
def text_search_roundrobin(spark, d):
    return textsearch.text_search(_docs(spark, d), TERM)


@query(f"""WITH {_LINES}, tok AS (SELECT doc_id, line, generate_subscripts(a, 1) AS ord, unnest(a) AS token FROM (
 SELECT doc_id, line, regexp_extract_all(lower(regexp_replace(txt, '#.*$', '')), '[a-z_]{{3,}}') AS a FROM lines WHERE contains(txt, ':') OR contains(txt, '='))),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, line, ord) AS rank, count(*) OVER (PARTITION BY token) AS n FROM tok)
SELECT token, rank, doc_id, line, CAST(greatest(n - 3, 0) AS BIGINT) AS calls_more FROM r WHERE rank <= 3""")
def call_sites(spark, d):
    return textsearch.call_sites(_docs(spark, d))


@query(r"""SELECT value, min(page_id) AS first_key, count(*) AS n_keys FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\$[^$]*\$|&[a-z]+;', '', 'g')) AS value FROM pages) WHERE value <> '' GROUP BY value""")
def display_names(spark, d):
    return textsearch.display_names(table(spark, d, "pages"))


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, line, txt, sum(CASE WHEN trim(txt, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM lines)
SELECT doc_id, CAST(island AS BIGINT) AS island, min(line) AS first_line, max(line) AS last_line, CAST(sum(length(txt)) AS BIGINT) AS chars FROM m WHERE trim(txt, ' ') <> '' GROUP BY doc_id, island""")
def island_blocks(spark, d):
    return textsearch.paragraph_islands(_docs(spark, d))


@query(r"""WITH t AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS seq, unnest(a) AS tag FROM (SELECT page_id, regexp_extract_all(html, '</?(?:html|head|body|div|ul|table|tr)\b') AS a FROM pages)),
l AS (SELECT *, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY seq) AS depth FROM t), o AS (SELECT * FROM l WHERE NOT starts_with(tag, '</'))
SELECT page_id, CAST(seq AS BIGINT) AS seq, substr(tag, 2) AS tag, CAST(depth AS BIGINT) AS depth, coalesce((SELECT CAST(max(p.seq) AS BIGINT) FROM o p WHERE p.page_id = o.page_id AND p.seq < o.seq AND p.depth = o.depth - 1), -1) AS parent_seq FROM o""")
def brace_tree(spark, d):
    return textsearch.tag_tree(table(spark, d, "pages"))


@query("SELECT source, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum(doc_id) AS BIGINT) AS stamp FROM documents GROUP BY source")
def fingerprint(spark, d):
    return textsearch.source_fingerprint(_docs(spark, d))


@query("""WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN text || '!' WHEN doc_id % 5 = 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS content FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
 WHEN replace(a.content, chr(13) || chr(10), chr(10)) <> replace(b.content, chr(13) || chr(10), chr(10)) THEN 'changed' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def snapshot_diff(spark, d):
    docs = _docs(spark, d)
    path, n = F.col("doc_id").cast("string").alias("path"), F.col("doc_id")
    other = F.when(n % 5 == 0, F.concat("text", F.lit("!"))).when(n % 5 == 1, F.regexp_replace("text", "\n", "\r\n")).otherwise(F.col("text"))
    return textsearch.snapshot_diff(docs.where(n % 7 != 0).select(path, F.col("text").alias("content")), docs.where(n % 11 != 0).select(path, other.alias("content")))


@query("""SELECT r_name AS key, array_to_string(list(DISTINCT_ITEM ORDER BY first_ord), ',') AS items FROM (
 SELECT r_name, x AS DISTINCT_ITEM, min(o) AS first_ord FROM (SELECT r_name, n_nationkey * 2 + unnest([0, 1]) AS o, unnest([substr(n_name, 1, 1), substr(n_name, 1, 2)]) AS x FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY ALL) GROUP BY r_name""")
def ordered_scope_union(spark, d):
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    rows = joined.select(F.col("r_name").alias("key"), "n_nationkey", F.array(F.substring("n_name", 1, 1), F.substring("n_name", 1, 2)).alias("scopes"))
    return rules.ordered_union(rows, "key", "n_nationkey", "scopes").select("key", F.array_join("items", ",").alias("items"))


_EDGES = "SELECT n_name AS node, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region UNION ALL SELECT 'WORLD', 'ANY' UNION ALL SELECT 'ANY', 'WORLD'"


def _edges(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    pairs = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"))
    return pairs.unionByName(region.select(F.col("r_name").alias("node"), F.lit("WORLD").alias("parent"))).unionByName(spark.createDataFrame([("WORLD", "ANY"), ("ANY", "WORLD")], "node string, parent string"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), up(node, ancestor, depth, trail) AS (SELECT node, parent, 1, [node, parent] FROM e UNION ALL
 SELECT up.node, e.parent, up.depth + 1, list_append(up.trail, e.parent) FROM up JOIN e ON up.ancestor = e.node WHERE NOT list_contains(up.trail, e.parent))
SELECT node, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM up GROUP BY node, ancestor""")
def scope_closure(spark, d):
    return rules.closure(_edges(spark, d))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), walk(root, rule, trail, cyclic) AS (SELECT node, parent, [node, parent], node = parent FROM e UNION ALL
 SELECT w.root, e.parent, list_append(w.trail, e.parent), list_contains(w.trail, e.parent) FROM walk w JOIN e ON w.rule = e.node WHERE NOT w.cyclic)
SELECT root, rule, CAST(len(trail) - 1 AS BIGINT) AS depth, cyclic FROM walk""")
def rule_expansion(spark, d):
    """Every walk from each rule over its references, up to where one leads back to a rule on its way."""
    return rules.walked(_edges(spark, d).select(F.col("node").alias("rule"), F.col("parent").alias("refers_to")))


_DIAMONDS = """SELECT DISTINCT 'n' || p_name AS node, 'b' || p_brand AS parent FROM part UNION SELECT 'n' || p_name, 's' || p_size FROM part UNION SELECT 'b' || p_brand, 't' || p_type FROM part UNION SELECT 's' || p_size, 't' || p_type FROM part
 UNION SELECT 't' || p_type, 'r1' FROM part UNION SELECT 'r1', 'r2' UNION SELECT 'r2', 'r3' UNION SELECT 'r3', 'r1'"""


@query(f"""WITH RECURSIVE e AS ({_DIAMONDS}), walk(node, ancestor, depth) AS (SELECT node, parent, 1 FROM e UNION SELECT w.node, e.parent, w.depth + 1 FROM walk w JOIN e ON w.ancestor = e.node WHERE w.depth < 9)
SELECT node, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node, ancestor""")
def diamond_closure(spark, d):
    """Ancestors in a graph of names, brands, sizes and types: very many ways between two nodes, and a ring at its top."""
    part = table(spark, d, "part")
    pairs = [("n", "p_name", "b", "p_brand"), ("n", "p_name", "s", "p_size"), ("b", "p_brand", "t", "p_type"), ("s", "p_size", "t", "p_type")]
    edges = [part.select(F.concat(F.lit(a), x).alias("node"), F.concat(F.lit(b), y).alias("parent")) for a, x, b, y in pairs]
    top = part.select(F.concat(F.lit("t"), "p_type").alias("node"), F.lit("r1").alias("parent"))
    ring = spark.createDataFrame([("r1", "r2"), ("r2", "r3"), ("r3", "r1")], "node string, parent string")
    return rules.reachable(reduce(lambda a, b: a.unionByName(b), [*edges, top, ring]))


@query("""WITH r AS (SELECT * FROM (VALUES ('R', 0, 2), ('N', 1, 4), ('A', 0, 3)) t(key, lo, hi)), c AS (SELECT l_orderkey AS parent, l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS parent, r.key, coalesce(n, 0) AS n, 'CARDINALITY_MISMATCH' AS code FROM orders CROSS JOIN r LEFT JOIN c ON c.parent = o_orderkey AND c.key = r.key WHERE coalesce(n, 0) < lo OR coalesce(n, 0) > hi""")
def cardinality_check(spark, d):
    declared = spark.createDataFrame([("R", 0, 2), ("N", 1, 4), ("A", 0, 3)], "key string, lo int, hi int")
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_returnflag").alias("key"))
    return rules.cardinality(table(spark, d, "orders").select(F.col("o_orderkey").alias("parent")), children, declared)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 1 AND l_quantity <= 25 THEN 'yes' ELSE 'no' END AS quantity_ok, CASE WHEN l_discount >= 0 AND l_discount < 0.05 THEN 'yes' ELSE 'no' END AS discount_ok FROM lineitem")
def range_check(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.in_range(F.col("l_quantity"), "int(1..25]").alias("quantity_ok"), rules.in_range(F.col("l_discount"), "float[0..0.05)").alias("discount_ok"))


@query(r"""SELECT event_id, CASE WHEN v IS NULL OR trim(v) = '' THEN 'unknown' WHEN lower(v) IN ('yes','no','true','false') THEN 'bool' WHEN regexp_matches(v, '^-?\d+$') THEN 'int' WHEN regexp_matches(v, '^-?\d+\.\d+$') THEN 'float' ELSE 'string' END AS scalar_type
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props ->> '$.k' WHEN 1 THEN event_type WHEN 2 THEN (CASE WHEN value > 50 THEN 'yes' ELSE '' END) ELSE '1.5' END AS v FROM events)""")
def scalar_types(spark, d):
    e = F.col("event_id") % 4
    v = F.when(e == 0, F.get_json_object("props", "$.k")).when(e == 1, F.col("event_type")).when(e == 2, F.when(F.col("value") > 50, "yes").otherwise("")).otherwise("1.5")
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", rules.scalar_type(F.col("v")).alias("scalar_type"))


@query("SELECT o_orderkey, CASE WHEN lower(o_orderpriority) IN ('1-urgent', '2-high') THEN 'yes' ELSE 'no' END AS member FROM orders")
def enum_membership(spark, d):
    members = spark.createDataFrame([("1-URGENT", "yes"), ("2-HIGH", "yes")], "value string, member string").withColumn("value_cf", F.lower("value"))
    orders = table(spark, d, "orders").withColumn("value_cf", F.lower("o_orderpriority"))
    return orders.join(F.broadcast(members), "value_cf", "left").select("o_orderkey", F.coalesce("member", F.lit("no")).alias("member"))  # two rows


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'UNKNOWN_OBJECT_REFERENCE' ELSE 'OBJECT_REFERENCE' END AS code FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 <> 0) ON o_custkey = c_custkey")
def fk_references(spark, d):
    known = table(spark, d, "customer").where(F.col("c_nationkey") % 5 != 0).select("c_custkey")
    joined = table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.when(F.col("c_custkey").isNull(), "UNKNOWN_OBJECT_REFERENCE").otherwise("OBJECT_REFERENCE").alias("code"))


@query("""WITH f AS (SELECT l_orderkey AS script_id, CASE l_returnflag WHEN 'A' THEN 'UNKNOWN' WHEN 'R' THEN 'UNRESOLVED' ELSE 'CONFIRMED_CWT' END AS status FROM lineitem)
SELECT script_id, count(CASE WHEN status = 'UNKNOWN' THEN 1 END) AS n_unknown, count(CASE WHEN status = 'UNRESOLVED' THEN 1 END) AS n_unresolved, count(CASE WHEN status = 'CONFIRMED_CWT' THEN 1 END) AS n_confirmed_cwt,
 arg_min(status, CASE status WHEN 'UNKNOWN' THEN 0 WHEN 'UNRESOLVED' THEN 1 ELSE 4 END) AS overall FROM f GROUP BY script_id""")
def status_fold(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "UNKNOWN").when(F.col("l_returnflag") == "R", "UNRESOLVED").otherwise("CONFIRMED_CWT")
    return textsearch.status_fold(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("script_id"), status.alias("status")))


@query("SELECT event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(38,6))), 4) AS DOUBLE) AS total FROM events GROUP BY event_type")
def stream_refresh(spark, d):
    from cairn.streaming.refresh import event_totals

    totals = event_totals(spark, d, "events.parquet", table(spark, d, "events").schema)
    return totals.select("event_type", "n", F.round(F.col("total"), 4).cast("double").alias("total"))


ORDER_RULES = """
types = { type[customer] = { path = "game/customers" } }
enums = { enum[status] = { F O P } }
orders = {
    order = {
        ## cardinality = 1..1
        status = enum[status]
        ## cardinality = 1..1
        price = float[0..200000]
        ## cardinality = 1..1
        priority = scalar
        ## cardinality = 1..1
        owner = <customer>
        ## cardinality = 1..2
        note = scalar
    }
}
"""
_SCRIPT = "concat_ws('', 'order_', o_orderkey, ' = { status = ', o_orderstatus, ' price = ', cast(o_totalprice as decimal(18,2)), ' priority = \"', o_orderpriority, '\" owner = c', o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN ' oops = 1' ELSE '' END, ' }')"


def _scripts(spark, d):
    """Each order written as a script of the rule language."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.expr(_SCRIPT).alias("text"))


@query("""WITH k AS (SELECT o_orderkey AS doc, unnest([0, 1, 2, 3, 4, 5]) AS node_id, unnest(['order_' || o_orderkey, 'status', 'price', 'priority', 'owner', 'oops']) AS key,
 unnest([NULL, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), o_orderpriority, 'c' || o_custkey, '1']) AS value FROM orders)
SELECT doc, CAST(node_id AS INT) AS node_id, CASE WHEN node_id = 0 THEN 0 ELSE 1 END AS depth, key, value FROM k WHERE node_id < 5 OR doc % 7 = 0""")
def parse_nodes(spark, d):
    from cairn.operators.parse import nodes

    return nodes(_scripts(spark, d)).select("doc", "node_id", "depth", "key", "value")


@query("""SELECT o_orderkey AS doc, 'order' AS identifier, 'CONFIRMED_CWT' AS status, 'CWT_IDENTIFIER' AS code FROM orders
UNION ALL SELECT o_orderkey, 'status', CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN 'CONFIRMED_CWT' ELSE 'UNKNOWN' END, CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN 'CWT_IDENTIFIER' ELSE 'VALUE_MISMATCH' END FROM orders
UNION ALL SELECT o_orderkey, 'price', CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) <= 200000 THEN 'CONFIRMED_CWT' ELSE 'UNKNOWN' END, CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) <= 200000 THEN 'CWT_IDENTIFIER' ELSE 'VALUE_MISMATCH' END FROM orders
UNION ALL SELECT o_orderkey, 'priority', 'CONFIRMED_CWT', 'CWT_IDENTIFIER' FROM orders
UNION ALL SELECT o_orderkey, 'owner', CASE WHEN c_custkey IS NULL THEN 'UNKNOWN' ELSE 'CONFIRMED_GAME_DATA' END, CASE WHEN c_custkey IS NULL THEN 'UNKNOWN_OBJECT_REFERENCE' ELSE 'OBJECT_REFERENCE' END FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 <> 0) ON c_custkey = o_custkey
UNION ALL SELECT o_orderkey, 'oops', 'UNKNOWN', 'UNKNOWN_SCHEMA_FIELD' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'order', 'UNKNOWN', 'CARDINALITY_MISMATCH' FROM orders""")
def validate_scripts(spark, d):
    """Each order against the rules of an order; owners are the customers of nations not divisible by five."""
    from cairn.operators.rulebook import RuleBook
    from cairn.operators.validate import validate

    known = table(spark, d, "customer").where(F.col("c_nationkey") % 5 != 0).select(F.lit("customer").alias("type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    scripts = _scripts(spark, d).select("doc", F.regexp_replace("text", "^order_[0-9]+", "order").alias("text"))
    found = validate(scripts, RuleBook({"orders.cwt": ORDER_RULES}), known, schema="orders")
    return found.select("doc", "identifier", "status", "code")


# Registered by importing it.
from cairn.plans import rule_queries  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
