"""Queries over rules, scripts and snapshots that are written from the driver's tables, each with its SQL.

Texts of the rule language are made of table rows by the same expressions in Spark and in the SQL; the SQL then
says what must come out from the rows themselves, never by reading the texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import evaluate, harvest, lookup, parse, registry, rules, snapshots, textsearch
from cairn.operators.rulebook import RuleBook
from cairn.operators.validate import overall, validate
from cairn.plans.catalogue import _BEST, _CASES, _docs, _index, query
from cairn.sources.tables import shared_path, table

# Definitions out of files.

NATION_TYPES = """types = {
    type[nation] = {
        path = "game/common/nations"
        name_field = name
        subtype[large] = { size = big }
        subtype[coastal] = { sea = yes inner = { port = 1 } }
        subtype[landlocked] = { sea = no }
    }
    ## type_key_filter <> { hidden }
    ## starts_with = r
    type[region] = { path = "common/regions" path_extension = .gfx skip_root_key = list }
}
enums = { complex_enum[port] = { path = "game/common/nations" name = { inner = { enum_name = { } } } } }
"""


def _nation_files(spark, d):
    """A file a region with a block a nation, a file of all regions, and one that cannot be parsed."""
    nation = table(spark, d, "nation")
    block = F.format_string(
        "n_%d = { name = \"%s\" size = %s sea = yes inner = { port = %d dock_%d_%d = yes } }", F.col("n_nationkey"), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("big")).otherwise(F.lit("small")), F.col("n_nationkey") % 3, F.col("n_regionkey"), F.col("n_nationkey") % 4
    )
    files = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("text"))  # 25 rows
    files = files.select(F.format_string("common/nations/%d.txt", "n_regionkey").alias("rel_path"), "text")
    region = table(spark, d, "region").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("r%d = { name = \"%s\" }", F.col("r_regionkey"), F.col("r_name")))), " ").alias("text"))  # five rows
    regions = region.select(F.lit("common/regions/all.gfx").alias("rel_path"), F.concat(F.lit("list = { "), "text", F.lit(" hidden = { } other = { } } r9 = { }")).alias("text"))
    broken = spark.createDataFrame([("common/nations/broken.txt", "n_x = {"), ("common/nations/deep/x.txt", "n_y = { name = y }")], "rel_path string, text string")
    return files.unionByName(regions).unionByName(broken).select(F.lit("game").alias("source"), F.lit(0).alias("priority"), "rel_path", "text")


@query("""SELECT n_name AS name, 'nation' AS type, 'common/nations/' || n_regionkey || '.txt' AS rel_path,
 CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY 'n_' || n_nationkey || ' ') AS INT) AS line, CASE WHEN n_nationkey % 3 = 1 THEN (CASE WHEN n_nationkey % 2 = 0 THEN 'coastal,large' ELSE 'coastal' END) WHEN n_nationkey % 2 = 0 THEN 'large' ELSE '' END AS subtypes FROM nation
 UNION ALL SELECT 'r' || r_regionkey, 'region', 'common/regions/all.gfx', 1, '' FROM region UNION ALL SELECT 'r9', 'region', 'common/regions/all.gfx', 1, ''""")
def harvest_definitions(spark, d):
    """Objects of two types by their directory rules, with the subtypes that their contents meet."""
    book = RuleBook({"types.cwt": NATION_TYPES})
    found = harvest.definitions(_nation_files(spark, d), harvest.directory_rules(spark, book), harvest.subtype_rules(spark, book))
    return found.select("name", "type", "rel_path", "line", F.array_join("subtypes", ",").alias("subtypes"))


@query("""SELECT 'common/nations/s' || s_suppkey || '.txt' AS rel_path, CAST(s_suppkey % 3 + 1 AS INT) AS error_line FROM supplier WHERE s_suppkey % 5 = 0 ORDER BY rel_path LIMIT 20""")
def harvest_errors(spark, d):
    """The first files that cannot be parsed: a file for each supplier, every fifth of them with a brace too many on some line."""
    key = F.col("s_suppkey")
    text = F.concat(F.repeat(F.lit("a = 1\n"), (key % 3).cast("int")), F.when(key % 5 == 0, F.lit("}")).otherwise(F.lit("n_1 = { name = x }")))
    files = table(spark, d, "supplier").select(F.lit("game").alias("source"), F.lit(0).alias("priority"), F.format_string("common/nations/s%d.txt", key).alias("rel_path"), text.alias("text"))
    declared = harvest.directory_rules(spark, RuleBook({"types.cwt": NATION_TYPES}))
    return harvest.file_errors(harvest.parsed_files(files, declared)).select("rel_path", "error_line")


def _enum_members(spark, d):
    book = RuleBook({"types.cwt": NATION_TYPES})
    declared = harvest.directory_rules(spark, book)
    return harvest.enum_members(harvest.parsed_files(_nation_files(spark, d), declared), declared, harvest.complex_enum_sources(book))


@query("SELECT 'port' AS enum, 'port' AS value UNION SELECT 'port', 'dock_' || n_regionkey || '_' || n_nationkey % 4 FROM nation")
def complex_enum_members(spark, d):
    """Values of an enum that is harvested from where a type's objects live: what stands in the nations' files."""
    return _enum_members(spark, d)


ENUM_RULES = """enums = {
    complex_enum[port] = { path = "game/common/nations" name = { inner = { enum_name = { } } } }
    complex_enum[berth] = { path = "game/common/berths" name = { enum_name = { } } }
    enum[flag] = { red white }
}
ship = { slot = enum[port] berth = enum[berth] flag = enum[flag] other = complex_enum[port] }
"""


@query("""WITH m AS (SELECT DISTINCT 'dock_' || n_regionkey || '_' || n_nationkey % 4 AS v FROM nation), c AS (SELECT c_custkey AS doc, 'dock_' || c_nationkey % 5 || '_' || c_nationkey % 6 AS v, v IN (SELECT v FROM m) AS there, c_custkey % 2 = 0 AS red FROM customer)
SELECT doc, 'slot' AS identifier, CASE WHEN there THEN 'CONFIRMED_CWT' ELSE 'UNKNOWN' END AS status, CASE WHEN there THEN 'CWT_IDENTIFIER' ELSE 'VALUE_MISMATCH' END AS code FROM c
UNION ALL SELECT doc, 'other', CASE WHEN there THEN 'CONFIRMED_CWT' ELSE 'UNKNOWN' END, CASE WHEN there THEN 'CWT_IDENTIFIER' ELSE 'VALUE_MISMATCH' END FROM c
UNION ALL SELECT doc, 'berth', 'CONFIRMED_CWT', 'CWT_IDENTIFIER' FROM c UNION ALL SELECT doc, 'berth', 'UNRESOLVED', 'VALUE_REFERENCE_UNRESOLVED' FROM c
UNION ALL SELECT doc, 'flag', CASE WHEN red THEN 'CONFIRMED_CWT' ELSE 'UNKNOWN' END, CASE WHEN red THEN 'CWT_IDENTIFIER' ELSE 'VALUE_MISMATCH' END FROM c""")
def validate_enums(spark, d):
    """Values of harvested enums: members that the nations' files have, values they lack, an enum that nothing was harvested for, and a plain one."""
    c = table(spark, d, "customer")
    dock = F.format_string("dock_%d_%d", F.col("c_nationkey") % 5, F.col("c_nationkey") % 6)
    text = F.concat(F.lit("slot = "), dock, F.lit(" other = "), dock, F.lit(" berth = x flag = "), F.when(F.col("c_custkey") % 2 == 0, "red").otherwise("green"))
    scripts = c.select(F.col("c_custkey").alias("doc"), text.alias("text"))
    none = spark.createDataFrame([], "type string, name string")
    return validate(scripts, RuleBook({"e.cwt": ENUM_RULES}), none, members=_enum_members(spark, d), schema="ship").select("doc", "identifier", "status", "code")


_HOSTS = "SELECT DISTINCT regexp_extract(url, '//([^/]*)', 1) AS name FROM pages"
#: The longest common runs of two texts, found again on both sides of each, as difflib does.
_RATIO = """runs AS (SELECT pool, name, value, 0::BIGINT AS alo, length(name)::BIGINT AS ahi, 0::BIGINT AS blo, length(value)::BIGINT AS bhi, 0::BIGINT AS k FROM pairs
 UNION ALL SELECT pool, name, value, CASE s WHEN 0 THEN alo ELSE m.i + m.k END, CASE s WHEN 0 THEN m.i ELSE ahi END, CASE s WHEN 0 THEN blo ELSE m.j + m.k END, CASE s WHEN 0 THEN m.j ELSE bhi END, CASE s WHEN 0 THEN m.k ELSE 0 END
 FROM (SELECT *, list_min(list_transform(range(alo, ahi), lambda i: list_min(list_transform(range(blo, bhi), lambda j: {'n': -list_max(list_filter(range(0, least(ahi - i, bhi - j) + 1), lambda n: substr(name, i + 1, n) = substr(value, j + 1, n))), 'i': i, 'j': j})))) AS r
  FROM runs WHERE alo < ahi AND blo < bhi) w, LATERAL (SELECT -r.n AS k, r.i AS i, r.j AS j) m, (VALUES (0), (1)) t(s) WHERE m.k > 0),
 scored AS (SELECT pool, value, name, 2.0::DOUBLE * sum(k) / (length(name) + length(value)) AS score FROM runs GROUP BY pool, value, name)"""


@query(f"""WITH RECURSIVE names AS (SELECT DISTINCT 'object/part' AS pool, p_name AS name FROM part UNION ALL SELECT 'object/host', name FROM ({_HOSTS})),
 asked AS (SELECT DISTINCT pool, substr(name, 1, 3) || substr(name, 5) AS value FROM names UNION SELECT DISTINCT pool, 'zz' || substr(name, 3, length(name) - 4) || 'qq' FROM names WHERE length(name) > 5),
 pairs AS (SELECT DISTINCT pool, name, value FROM asked JOIN names USING (pool)), {_RATIO}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pool, value ORDER BY score DESC, name DESC) AS place FROM scored WHERE score >= 0.55)
SELECT pool, value, string_agg(name, ',' ORDER BY place) AS suggestions FROM ranked WHERE place <= 5 GROUP BY pool, value""")
def close_names(spark, d):
    """Suggestions for misspelt names, some of which share neither their first nor their last two characters with any name."""
    from cairn.operators.validate import suggested

    part = table(spark, d, "part").select(F.lit("part").alias("type"), F.col("p_name").alias("name")).distinct()
    names = part.unionByName(table(spark, d, "pages").select(F.lit("host").alias("type"), F.regexp_extract("url", "//([^/]*)", 1).alias("name")).distinct())
    cut = F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)"))
    swapped = F.when(F.length("name") > 5, F.concat(F.lit("zz"), F.expr("substring(name, 3, length(name) - 4)"), F.lit("qq")))
    pool = F.concat(F.lit("object/"), "type")
    asked = names.select(F.array(pool).alias("pools"), F.explode(F.array_compact(F.array(cut, swapped))).alias("wanted"))
    found = suggested(asked, names, spark.createDataFrame([], "pool string, name string"))
    return found.select(F.col("pools")[0].alias("pool"), "value", F.array_join("suggestions", ",").alias("suggestions"))


@query("""SELECT 'p' || r_regionkey AS type, 'common/' || lower(r_name) AS directory, CASE r_regionkey % 2 WHEN 0 THEN '.txt' ELSE '.gfx' END AS extension, CASE r_regionkey % 3 WHEN 0 THEN 'name' END AS name_field, CASE r_regionkey % 2 WHEN 1 THEN 'hidden' ELSE '' END AS excluded, CASE r_regionkey % 2 WHEN 1 THEN 'list' ELSE '' END AS skip_root FROM region""")
def directory_rules(spark, d):
    """Where objects live, read from rules that are written for each region."""
    r = F.col("r_regionkey")
    odd = r % 2 == 1
    text = F.concat(
        F.when(odd, F.lit("## type_key_filter <> { hidden }\n")).otherwise(F.lit("")), F.format_string("type[p%d] = { path = \"game/common/%s\"", r, F.lower("r_name")), F.when(odd, F.lit(" path_extension = .gfx skip_root_key = list")).otherwise(F.lit("")),
        F.when(r % 3 == 0, F.lit(" name_field = name")).otherwise(F.lit("")), F.lit(" }"),
    )
    texts = {f"{x['r_regionkey']}.cwt": "types = {\n" + x["t"] + "\n}" for x in table(spark, d, "region").select("r_regionkey", text.alias("t")).collect()}  # five rows
    declared = harvest.directory_rules(spark, RuleBook(texts))
    return declared.select("type", "directory", "extension", "name_field", F.array_join("exclude", ",").alias("excluded"), F.array_join("skip_root", ",").alias("skip_root"))


@query("""SELECT 'game' AS source, count(DISTINCT n_regionkey) + 3 AS n_files, count(*) + (SELECT count(*) FROM region) + 1 AS n_definitions, CAST(2 AS BIGINT) AS n_types, CAST(1 AS BIGINT) AS n_errors FROM nation""")
def describe_sources(spark, d):
    book = RuleBook({"types.cwt": NATION_TYPES})
    scripts, declared = _nation_files(spark, d), harvest.directory_rules(spark, book)
    files = harvest.parsed_files(scripts, declared)
    return lookup.describe_sources(scripts, harvest.definitions_of(files, declared), harvest.file_errors(files)).drop("bytes")


# Nodes.

_TREE = "concat('a = { b = ', o_orderstatus, ' c = { d = 1 e } b = 2 } ', char(10), '# about z', char(10), 'z = ', o_custkey, ' # end', char(10), char(10), 'y = { }')"


def _trees(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.expr(_TREE).alias("text"))


_NODES = """nodes AS (SELECT o_orderkey AS doc, unnest([{'k': 'a', 'p': 'a', 'v': NULL, 'i': 'b,c,b'}, {'k': 'b', 'p': 'a/b', 'v': o_orderstatus, 'i': o_orderstatus}, {'k': 'c', 'p': 'a/c', 'v': NULL, 'i': 'd,e'}, {'k': 'd', 'p': 'a/c/d', 'v': '1', 'i': '1'},
 {'k': 'e', 'p': 'a/c/e', 'v': NULL, 'i': 'e'}, {'k': 'b', 'p': 'a/b', 'v': '2', 'i': '2'}, {'k': 'z', 'p': 'z', 'v': CAST(o_custkey AS VARCHAR), 'i': CAST(o_custkey AS VARCHAR)}, {'k': 'y', 'p': 'y', 'v': NULL, 'i': ''}]) AS n, CAST(unnest(range(0, 8)) AS INT) AS node_id FROM orders)"""


@query(f"WITH {_NODES} SELECT doc, node_id, n.p AS path, n.i AS items FROM nodes")
def node_paths(spark, d):
    """Ancestor path and items of every node."""
    return lookup.node_items(parse.nodes(_trees(spark, d)), keep=("path",)).select("doc", "node_id", "path", F.array_join("items", ",").alias("items"))


@query("SELECT o_orderkey AS doc, 0 AS node_id, o_orderstatus AS value FROM orders")
def first_fields(spark, d):
    """The first child of a name, where a block has two."""
    return lookup.first_fields(parse.nodes(_trees(spark, d)), "b").select("doc", "node_id", "value")


@query("""SELECT o_orderkey AS doc, 'a' AS key, 1 AS start_line, 1 AS end_line, 'a = { b = ' || o_orderstatus || ' c = { d = 1 e } b = 2 }' AS source FROM orders
 UNION ALL SELECT o_orderkey, 'z', 2, 3, '# about z' || chr(10) || 'z = ' || o_custkey || ' # end' FROM orders UNION ALL SELECT o_orderkey, 'y', 5, 5, 'y = { }' FROM orders""")
def definition_texts(spark, d):
    """Source of each root with the comments that belong to it."""
    docs = _trees(spark, d)
    return lookup.definition_texts(parse.nodes(docs), docs).select("doc", "key", "start_line", "end_line", "source")


@query("SELECT o_orderkey AS doc, TRUE AS lossless FROM orders")
def token_round_trip(spark, d):
    return parse.lossless(_trees(spark, d))


_NOTED = "concat('# head', char(10), '## scope = planet', char(10), '## cardinality = 0..', l_linenumber, char(10), 'x = ', l_quantity, char(10), '### no note', char(10), '## push_scope = { a b }', char(10), 'y = 1')"


@query("SELECT 'scope' AS key, count(*) AS n FROM lineitem UNION ALL SELECT 'cardinality', count(*) FROM lineitem UNION ALL SELECT 'push_scope', count(*) FROM lineitem")
def annotation_inventory(spark, d):
    """How often each annotation is used."""
    docs = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("doc"), F.expr(_NOTED).alias("text"))
    return parse.node_annotations(docs).where("error is null").groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT 'trigger:x' || (p_partkey % 3) AS key, 'alias' AS kind, 'trigger:x' || (p_partkey % 3) AS body, count(*) AS n FROM part GROUP BY ALL")
def declarations(spark, d):
    """Keys of the form kind[body], taken apart."""
    keys = table(spark, d, "part").select(F.concat(F.lit("alias[trigger:x"), F.col("p_partkey") % 3, F.lit("]")).alias("whole"))
    kind, body = parse.declaration(F.col("whole"))
    return keys.select(body.alias("key"), kind.alias("kind"), body.alias("body")).groupBy("key", "kind", "body").agg(F.count("*").alias("n"))


_RUN = "'# lead of ' || s_suppkey || chr(10) || 'alias[trigger:s' || s_suppkey || '] = bool' || chr(10) || 'alias[effect:s' || s_suppkey || '] = { a = int }' || chr(10) || 'alias[trigger:t' || s_suppkey % 7 || '] = bool # tail'"


@query(f"""SELECT s_suppkey AS doc, node_id, CAST(first AS INT) AS start_line, CAST(last AS INT) AS end_line, source FROM supplier, LATERAL (VALUES (0, 1, 4, {_RUN}), (1, 1, 4, {_RUN}), (3, 1, 4, {_RUN}),
 (4, 6, 6, 'other = {{ b = ' || s_suppkey || ' }}'), (6, 7, 7, 'alias[modifier:m' || s_suppkey || '] = float'), (7, 9, 9, 'alias[effect:alone] = int')) t(node_id, first, last, source)""")
def alias_runs(spark, d):
    """The source of aliases with the roots of their run: three in a row, one of another kind, one alone."""
    run = F.expr(_RUN.replace("chr(10)", "'\\n'"))
    key = F.col("s_suppkey").cast("string")
    text = F.concat(run, F.lit("\n\nother = { b = "), key, F.lit(" }\nalias[modifier:m"), key, F.lit("] = float\n \nalias[effect:alone] = int"))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), text.alias("text"))
    return lookup.run_texts(parse.nodes(docs), docs).select("doc", "node_id", "start_line", "end_line", "source")


# Validation.

#: Script, what its root must give, its findings: one line for each code.
SNIPPETS = [
    ("size = 3", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER")]),
    ("size = 9", [("size", "UNKNOWN", "VALUE_MISMATCH")]),
    ("size > 3", [("size", "UNKNOWN", "OPERATOR_MISMATCH")]),
    ("size = { x = 1 }", [("size", "UNKNOWN", "SHAPE_MISMATCH"), ("x", "UNRESOLVED", "UNRESOLVED_CONTEXT")]),
    ("size = 3 what = 1", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("what", "UNKNOWN", "UNKNOWN_SCHEMA_FIELD")]),
    ("size = 3 size = 4", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("size", "UNKNOWN", "CARDINALITY_MISMATCH")]),
    ("size = 3 label = x", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("label", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("label", "UNRESOLVED", "VALUE_REFERENCE_UNRESOLVED")]),
    ("size = 3 @v = 1", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("@v", "UNRESOLVED", "SCRIPT_VARIABLE")]),
    ("size = 3 two = { a = 1 }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("two", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("two", "UNRESOLVED", "AMBIGUOUS_OVERLOAD"), ("a", "CONFIRMED_CWT", "CWT_IDENTIFIER")]),
    ("size = 3 rich = 1", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("rich", "UNRESOLVED", "CONDITIONAL_SCHEMA")]),
    ("size = 3 limited = 1", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("limited", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("limited", "UNRESOLVED", "UNSUPPORTED_CWT_CONSTRAINT")]),
    ("size = 3 on = { wet = yes }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("on", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("wet", "CONFIRMED_CWT", "CWT_IDENTIFIER")]),
    ("size = 3 off = { wet = yes }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("off", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("wet", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("wet", "UNKNOWN", "SCOPE_MISMATCH")]),
    ("size = 3 on = { owner = { wet = yes } }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("on", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("owner", "CONFIRMED_CWT", "CWT_SCOPE_LINK"), ("wet", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("wet", "UNKNOWN", "SCOPE_MISMATCH")]),
    ("size = 3 on = { prev = { } }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("on", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("prev", "UNRESOLVED", "DYNAMIC_SCOPE")]),
    ("size = 3 on = { dry = yes }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("on", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("dry", "UNKNOWN", "UNKNOWN_TRIGGER")]),
    ("size = 3 on = { mine = { q = 1 } }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("on", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("mine", "CONFIRMED_GAME_DATA", "DEFINED_IN_GAME_DATA")]),
    ("size = 3 gone = { q = 1 }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("gone", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("gone", "UNRESOLVED", "UNSUPPORTED_BLOCK_RULE"), ("q", "UNRESOLVED", "INCOMPLETE_SCHEMA")]),
    ("size = 3 ring = { }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("ring", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("ring", "UNRESOLVED", "CYCLIC_CWT_REFERENCE")]),
    ("size = 3 torn = { }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("torn", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("torn", "UNRESOLVED", "UNRESOLVED_INJECTION")]),
    ("size = 3 both = { twin = yes }", [("size", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("both", "CONFIRMED_CWT", "CWT_IDENTIFIER"), ("twin", "UNRESOLVED", "AMBIGUOUS_CONTEXT")]),
    ("size = {", [(None, "UNKNOWN", "SCRIPT_PARSE_ERROR")]),
]
SNIPPET_RULES = """
enums = { enum[color] = { red green } }
scopes = { Planet = { aliases = { planet } } Fleet = { aliases = { fleet } } }
links = { owner = { input_scopes = { planet } output_scope = fleet } }
## scopes = { planet }
alias[trigger:wet] = bool
alias[trigger:twin] = bool
alias[effect:twin] = bool
single_alias[trigger_clause] = { alias_name[trigger] = alias_match_left[trigger] }
single_alias[circle] = single_alias_right[circle]
thing = {
    ## cardinality = 1..1
    size = int[1..5]
    label = localisation
    two = { a = int }
    two = { b = int }
    ## cardinality_max_define = X
    limited = int
    ## push_scope = planet
    on = { alias_name[trigger] = alias_match_left[trigger] }
    ## push_scope = fleet
    off = { alias_name[trigger] = alias_match_left[trigger] }
    both = { alias_name[trigger] = alias_match_left[trigger] alias_name[effect] = alias_match_left[effect] }
    gone = single_alias_right[nothing]
    ring = single_alias_right[circle]
    ## inject = rules.cwt@nowhere/*
    torn = { }
    subtype[r] = { rich = int }
}
"""
_EXPECTED = ", ".join(f"({k}, {'NULL' if i is None else repr(i)}, {s!r}, {c!r})" for k, (_, rows) in enumerate(SNIPPETS) for i, s, c in rows)


def _snippets(spark, d):
    choice = F.col("o_orderkey") % len(SNIPPETS)
    text = F.array(*(F.lit(t) for t, _ in SNIPPETS))[choice.cast("int")]
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), text.alias("text"))


def _snippet_findings(spark, d):
    data = spark.createDataFrame([("scripted_trigger", "mine")], "type string, name string")
    return validate(_snippets(spark, d), RuleBook({"rules.cwt": SNIPPET_RULES}), data, schema="thing")


@query(f"SELECT o_orderkey AS doc, identifier, status, code FROM orders JOIN (VALUES {_EXPECTED}) e(k, identifier, status, code) ON o_orderkey % {len(SNIPPETS)} = k")
def validate_codes(spark, d):
    """A script for each code that a validator gives, one an order."""
    return _snippet_findings(spark, d).select("doc", "identifier", "status", "code")


@query(f"""WITH f AS (SELECT o_orderkey AS doc, status FROM orders JOIN (VALUES {_EXPECTED}) e(k, identifier, status, code) ON o_orderkey % {len(SNIPPETS)} = k)
SELECT doc, count(*) AS n_findings, CASE WHEN count(*) FILTER (status = 'UNKNOWN') > 0 THEN 'UNKNOWN' WHEN count(*) FILTER (status = 'UNRESOLVED') > 0 THEN 'UNRESOLVED' WHEN count(*) FILTER (status = 'CONFIRMED_GAME_DATA') > 0 THEN 'CONFIRMED_GAME_DATA' ELSE 'CONFIRMED_CWT' END AS overall FROM f GROUP BY doc""")
def validate_overall(spark, d):
    return overall(_snippet_findings(spark, d)).select("doc", "n_findings", "overall")


MODIFIER_RULES = """
scopes = { Planet = { aliases = { planet } } Fleet = { aliases = { fleet } } }
modifiers = { pop_growth = { pops } lonely = { nowhere } <nation>_cost = { pops } }
modifier_categories = { pops = { supported_scopes = { planet } } }
alias[modifier:<modifier>] = float
"""


@query("""WITH m AS (SELECT c_custkey AS doc, c_custkey % 5 AS k, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey), e(k, kind, status, code) AS (VALUES
 (0, 'p', 'CONFIRMED_CWT', 'CWT_IDENTIFIER'), (0, 'p', 'CONFIRMED_CWT', 'CWT_IDENTIFIER'), (1, 'l', 'CONFIRMED_CWT', 'CWT_IDENTIFIER'), (1, 'l', 'CONFIRMED_CWT', 'CWT_IDENTIFIER'), (1, 'l', 'UNRESOLVED', 'UNRESOLVED_MODIFIER_CATEGORY'),
 (2, 'n', 'TEMPLATE_MATCH', 'CWT_IDENTIFIER'), (2, 'n', 'TEMPLATE_MATCH', 'CWT_IDENTIFIER'), (3, 'x', 'UNKNOWN', 'UNKNOWN_MODIFIER'), (4, 'g', 'CONFIRMED_GAME_DATA', 'GENERATED_MODIFIER'), (4, 'g', 'UNKNOWN', 'SCOPE_MISMATCH'))
SELECT doc, CASE kind WHEN 'p' THEN 'pop_growth' WHEN 'l' THEN 'lonely' WHEN 'n' THEN replace(lower(n_name), ' ', '-') || '_cost' WHEN 'x' THEN 'nowhere-land_cost' ELSE 'energy_upkeep_mult' END AS identifier, status, code FROM m JOIN e USING (k)""")
def validate_modifiers(spark, d):
    """Modifiers by name, by template (whose object data has, or has not), of no category, and generated."""
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.regexp_replace(F.lower("n_name"), " ", "-")
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "pop_growth").when(k == 1, "lonely").when(k == 2, F.concat(own, F.lit("_cost"))).when(k == 3, "nowhere-land_cost").otherwise("energy_upkeep_mult")
    scripts = customers.select(F.col("c_custkey").alias("doc"), F.concat(name, F.lit(" = 1")).alias("text"), F.lit("modifier").alias("kind"), F.lit("planet").alias("scope"))
    data = table(spark, d, "nation").select(F.lit("nation").alias("type"), own.alias("name"))
    generated = spark.createDataFrame([("energy_upkeep_mult", ["fleet"])], "name string, supported_scopes array<string>")
    return validate(scripts, RuleBook({"m.cwt": MODIFIER_RULES}), data, generated).select("doc", "identifier", "status", "code")


# Searching and looking up.

_SYMBOLS = "symbols AS (SELECT name, 'name' AS type, 'rules' AS origin, name AS id FROM reg UNION ALL SELECT 'the_' || lower(n_name), 'nation', 'data', 'n' || n_nationkey FROM nation UNION ALL SELECT lower(r_name) || '_wide', 'region', 'data', 'r' || r_regionkey FROM region)"


def _symbols(spark, d, reg):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    own = nation.select(F.concat(F.lit("the_"), F.lower("n_name")).alias("name"), F.lit("nation").alias("type"), F.lit("data").alias("origin"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    wide = region.select(F.concat(F.lower("r_name"), F.lit("_wide")).alias("name"), F.lit("region").alias("type"), F.lit("data").alias("origin"), F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return reg.select("name", F.lit("name").alias("type"), F.lit("rules").alias("origin"), F.col("name").alias("id")).unionByName(own).unionByName(wide)


_FOUND = f"""WITH {_BEST}, exact_ AS (SELECT query_id, name, 'name' AS type, 'CONFIRMED_CWT' AS status, 100.0 AS match_score, 1.0 AS s, 1.0 AS c FROM cases JOIN reg ON lower(query) = lower(name)),
fit AS (SELECT query_id, 'the_<word>', 'template', 'TEMPLATE_MATCH', 99.0, 1.0, 1.0 FROM cases WHERE regexp_matches(query, '^the_.{{1,128}}$')),
near AS (SELECT query_id, name, 'name', 'SUGGESTION', match_score, query_support, candidate_coverage FROM best WHERE lower(query) <> name),
every AS (SELECT * FROM exact_ UNION ALL SELECT * FROM fit UNION ALL SELECT * FROM near),
tier AS (SELECT *, CASE WHEN status <> 'SUGGESTION' OR (match_score >= 55 AND s >= 0.5) THEN 'result' WHEN match_score >= 25 AND c >= 0.35 THEN 'related' END AS tier FROM every),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY match_score DESC, name, type) AS rank, count(*) OVER (PARTITION BY query_id, tier) AS total FROM tier WHERE tier IS NOT NULL)"""


@query(f"""{_FOUND}
SELECT query_id, tier, rank, name, type, status, CAST(match_score AS DOUBLE) AS match_score, CAST(1 AS BIGINT) AS n_definitions, total, total > CASE tier WHEN 'result' THEN 20 ELSE 40 END AS truncated FROM ranked WHERE rank <= CASE tier WHEN 'result' THEN 20 ELSE 40 END""")
def search_all(spark, d):
    """Exact names, templates and like names of every query in graded tiers."""
    cases, reg, stats = _index(spark, d)
    symbols = reg.select("name", F.lit("name").alias("type"), F.lit("rules").alias("origin"), F.col("name").alias("id"))
    return lookup.search(cases.select("query_id", "query"), symbols, ["the_<word>"], stats)


@query(f"""{_FOUND}, shown AS (SELECT query_id, CASE status WHEN 'TEMPLATE_MATCH' THEN query ELSE name END AS n, type, CASE status WHEN 'CONFIRMED_CWT' THEN 0 WHEN 'TEMPLATE_MATCH' THEN 1 ELSE 2 END AS g, rank, total FROM ranked JOIN cases USING (query_id) WHERE tier = 'result' AND rank <= 20),
 one AS (SELECT query_id, n, type, min(g) AS g, min(rank) AS rank, max(total) AS total FROM shown GROUP BY query_id, n, type),
 said AS (SELECT query_id, max(total) - count(*) AS more, coalesce(string_agg(n || '=' || n || '!', ',' ORDER BY rank) FILTER (g = 0), '') AS results, coalesce(string_agg(n, ',' ORDER BY rank) FILTER (g = 1), '') AS templates, coalesce(string_agg(n || '=' || n || '!', ',' ORDER BY rank) FILTER (g = 2), '') AS suggestions FROM one GROUP BY query_id)
SELECT *, CASE WHEN suggestions <> '' AND (results <> '' OR templates <> '') THEN '{lookup.TIPS[0]}' WHEN suggestions <> '' THEN '{lookup.TIPS[1]}' WHEN templates <> '' THEN '{lookup.TIPS[2]}' END AS tips FROM said""")
def projected_replies(spark, d):
    """One reply a query: confirmed names, templates and suggestions apart, each with its definitions, and what is left out."""
    cases, reg, stats = _index(spark, d)
    symbols = reg.select("name", F.lit("name").alias("type"), F.lit("rules").alias("origin"), F.col("name").alias("id"))
    asked = cases.select("query_id", "query")
    found = lookup.search(asked, symbols, ["the_<word>"], stats).where("tier = 'result'")
    replies = lookup.projected(found, asked, symbols.select("name", "type", F.concat("name", F.lit("!")).alias("definition")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], F.array_join(x["definitions"], ";"))), ",").alias(c)
    return replies.select("query_id", listed("results"), F.array_join(F.transform("templates", lambda x: x["name"]), ",").alias("templates"), listed("suggestions"), "more", "tips")


@query(f"""WITH {_CASES}, {_SYMBOLS}, targets AS (SELECT query_id AS target_id, CASE query_id % 3 WHEN 0 THEN expected WHEN 1 THEN 'n' || (query_id % 25) ELSE '../secret' END AS target FROM cases)
SELECT target_id, CASE WHEN target LIKE '..%' THEN 'BAD_TARGET' WHEN s.id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS state, s.name, s.type FROM targets LEFT JOIN symbols s ON target NOT LIKE '..%' AND (s.id = target OR (lower(s.name) = lower(target) AND target NOT IN (SELECT id FROM symbols)))""")
def get_definitions(spark, d):
    """What ids and names stand for; targets that are nothing, or no path inside the tree."""
    cases, reg, _ = _index(spark, d)
    i = F.col("query_id")
    target = F.when(i % 3 == 0, F.col("expected")).when(i % 3 == 1, F.concat(F.lit("n"), i % 25)).otherwise("../secret")
    return lookup.get_definitions(cases.select(i.alias("target_id"), target.alias("target")), _symbols(spark, d, reg)).select("target_id", "state", "name", "type")


@query("""WITH c AS (SELECT lower(p_brand) AS token, p_partkey AS line FROM part) SELECT lower(brand) AS name, array_to_string([p || ':' || line FOR line IN lines], ',') AS calls, greatest(n - 3, 0) AS calls_more FROM (
 SELECT p_brand AS brand, 'x' AS p, list(p_partkey ORDER BY p_partkey)[1:3] AS lines, count(*) AS n FROM part GROUP BY p_brand)""")
def attached_calls(spark, d):
    """Symbols with their first call sites and how many more there are."""
    part = table(spark, d, "part")
    symbols = part.select(F.lower("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct()
    calls = part.select(F.lower("p_brand").alias("token"), F.lit("x").alias("path"), F.col("p_partkey").alias("line"))
    found = lookup.get_definitions(symbols.select(F.col("id").alias("target_id"), F.col("name").alias("target")), symbols, calls)
    return found.select(F.lower("name").alias("name"), F.array_join("calls", ",").alias("calls"), "calls_more")


@query("SELECT c_custkey AS id, CASE WHEN min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey) <> c_custkey THEN CAST(min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey) AS VARCHAR) ELSE '' END AS same_as FROM customer")
def same_text(spark, d):
    """Rows of equal text refer to the first."""
    return lookup.same_text(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"]).select("id", F.coalesce(F.col("same_as").cast("string"), F.lit("")).alias("same_as"))


@query(f"""WITH {_CASES}, ask AS (SELECT DISTINCT query_id, qtoken AS token FROM qtok), held AS (SELECT query_id, count(*) AS wanted FROM ask WHERE token IN (SELECT token FROM post) GROUP BY query_id),
full_ AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, name, count(*) AS k FROM ask JOIN post USING (token) GROUP BY ALL) JOIN held USING (query_id) WHERE k = wanted GROUP BY query_id)
SELECT query_id, CASE WHEN wanted IS NULL THEN 1 ELSE coalesce(n, 0) END AS completions FROM cases LEFT JOIN held USING (query_id) LEFT JOIN full_ USING (query_id)""")
def completion_counts(spark, d):
    cases, reg, _ = _index(spark, d)
    return lookup.completion_counts(cases.select("query_id", "query"), registry.postings(reg))


@query("SELECT page_id, CASE WHEN html IS NULL THEN NULL WHEN regexp_matches(html, '[^\\x00-\\x7F]') THEN TRUE ELSE FALSE END AS display FROM pages")
def display_name_queries(spark, d):
    return table(spark, d, "pages").select("page_id", lookup.wants_display_names(F.col("html")).alias("display"))


@query("""WITH t AS (SELECT p.page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS value FROM pages p), q AS (SELECT page_id AS query_id, upper(value) AS query FROM t WHERE page_id % 20 = 0 AND value <> '')
SELECT query_id, 'page_' || t.page_id AS name FROM q JOIN t ON lower(q.query) = lower(t.value)""")
def display_name_search(spark, d):
    """Titles asked for by pages whose id is divisible by 20, against all titles, then to the symbols of their keys."""
    titles = table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("value"))
    texts = titles.select(F.lit("english").alias("lang"), F.concat(F.lit("PAGE_"), "page_id").alias("key"), "value")
    symbols = titles.select(F.concat(F.lit("page_"), "page_id").alias("name"))
    queries = titles.where("page_id % 20 = 0 and value <> ''").select(F.col("page_id").alias("query_id"), harvest.raised(F.col("value")).alias("query"))
    return harvest.by_display_name(queries, texts, symbols).select("query_id", "name")


# Economic names, categories and versions.


@query("""WITH c AS (SELECT lower(r_name) AS key, lower(r_name) AS ec, r_regionkey AS ord, unnest([{'c': 'cost', 't': 'add', 'a': 0}, {'c': 'upkeep', 't': 'mult', 'a': 1}]) AS f, FALSE AS triggered FROM region
 UNION ALL SELECT 'trig_' || (r_regionkey % 2), lower(r_name), r_regionkey, {'c': 'produces', 't': 'mult', 'a': 2}, TRUE FROM region),
r AS (SELECT lower(n_name) AS resource FROM nation UNION ALL SELECT NULL),
g AS (SELECT concat_ws('_', key, resource, f.c, f.t) AS name, ec AS economic_category, resource, f.c AS category, f.t AS modifier_type, triggered, ord, f.a AS at FROM c CROSS JOIN r WHERE resource IS NOT NULL OR f.t = 'mult')
SELECT name, economic_category, resource, category, modifier_type, triggered FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord, resource IS NULL, resource, g.at) = 1""")
def economic_names(spark, d):
    """Names that regions give rise to with nations as resources, triggered blocks among them."""
    block = F.struct(F.concat(F.lit("trig_"), F.col("r_regionkey") % 2).alias("key"), F.lit("produces").alias("category"), F.array(F.lit("mult")).alias("modifier_types"))
    cats = table(spark, d, "region").select(F.lower("r_name").alias("economic_category"), F.col("r_regionkey").alias("ord"), F.array(F.lit("cost")).alias("add"), F.array(F.lit("upkeep")).alias("mult"), F.array(block).alias("triggered"))
    return rules.economic_names(cats, table(spark, d, "nation").select(F.lower("n_name").alias("resource")))


@query("""WITH n AS (SELECT lower(r_name) || '_' || replace(replace(lower(n_name), ' ', ''), '_', '') || '_upkeep_mult' AS name, r_name, n_name FROM region, nation UNION ALL SELECT lower(r_name) || '_cost_add', r_name, NULL FROM region UNION ALL SELECT 'nowhere_food_produces_add', NULL, NULL UNION ALL SELECT 'no_economic_name', NULL, NULL)
SELECT name, coalesce(replace(lower(r_name), '', ''), 'nowhere') AS category, CASE WHEN r_name IS NULL THEN 'food' WHEN n_name IS NULL THEN NULL ELSE replace(replace(lower(n_name), ' ', ''), '_', '') END AS resource,
 CASE WHEN r_name IS NULL THEN 'produces' WHEN n_name IS NULL THEN 'cost' ELSE 'upkeep' END AS category_type, CASE WHEN r_name IS NOT NULL AND n_name IS NOT NULL THEN 'mult' ELSE 'add' END AS modifier_type,
 CASE WHEN r_name IS NULL THEN 'NOT_FOUND' ELSE 'CONFIRMED' END AS state FROM n WHERE name <> 'no_economic_name' AND NOT contains(lower(coalesce(r_name, '')), ' ')""")
def economic_parts(spark, d):
    """Economic names taken apart and held against categories (regions) and resources (nations)."""
    region = table(spark, d, "region").where(~F.contains("r_name", F.lit(" "))).select(F.lower("r_name").alias("category"))
    nation = table(spark, d, "nation").select(F.regexp_replace(F.lower("n_name"), "[ _]", "").alias("resource"))
    made = region.crossJoin(F.broadcast(nation)).select(F.concat_ws("_", "category", "resource", F.lit("upkeep_mult")).alias("name"))  # 25 rows
    whole = region.select(F.concat("category", F.lit("_cost_add")).alias("name"))
    other = spark.createDataFrame([("nowhere_food_produces_add",), ("no_economic_name",)], "name string")
    return lookup.economic_parts(made.unionByName(whole).unionByName(other), region, nation)


@query("""WITH c AS (SELECT r_name AS category, ['s' || r_regionkey, 'all_' || (r_regionkey % 2)] AS scopes, r_regionkey FROM region), m AS (SELECT n_name AS name, n_regionkey, n_nationkey % 3 AS k FROM nation)
SELECT name, CASE k WHEN 2 THEN '' ELSE array_to_string(scopes, ',') END AS scopes, CASE k WHEN 2 THEN 'absent' ELSE '' END AS unresolved FROM m JOIN c ON n_regionkey = r_regionkey""")
def category_scopes(spark, d):
    """Scopes of modifiers whose categories are written as they are, loosely, or are declared nowhere."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    cats = region.select(F.col("r_name").alias("category"), F.array(F.concat(F.lit("s"), "r_regionkey"), F.concat(F.lit("all_"), F.col("r_regionkey") % 2)).alias("scopes"))
    k = F.col("n_nationkey") % 3
    wanted = F.when(k == 0, F.lower("r_name")).when(k == 1, F.concat(F.regexp_replace("r_name", " ", "_"), F.lit("s"))).otherwise("absent")
    modifiers = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.array(wanted).alias("categories"))  # five rows
    return lookup.category_scopes(modifiers, cats).select("name", F.array_join("scopes", ",").alias("scopes"), F.array_join("unresolved", ",").alias("unresolved"))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS source, arg_min('4.' || (s_suppkey % 7) || '.1', s_suppkey) AS version, 'log' AS read_from FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey""")
def game_versions(spark, d):
    """The version of each source from the first line of its log that tells one; lines on something else do not count."""
    supplier = table(spark, d, "supplier")
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Game v4."), F.col("s_suppkey") % 7, F.lit(".1 started"))).otherwise("engine version 9.9")
    order = F.col("s_suppkey").cast("int")
    return lookup.game_version(supplier.select(F.col("s_nationkey").cast("string").alias("source"), order.alias("priority"), F.lit("log").alias("kind"), F.lit(1).alias("line"), text.alias("text")))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'match' ELSE 'unknown' END AS state FROM part")
def version_checks(spark, d):
    k = F.col("p_size") % 4
    part = table(spark, d, "part").select("p_partkey", F.when(k == 0, "4.6.1").when(k == 1, "4.5.*").when(k == 2, "4.*").alias("supported"))
    return part.select("p_partkey", lookup.version_check(F.col("supported"), F.lit("4.6.3")).alias("state"))


# Snapshots.


_ENDED = "CASE doc_id % 3 WHEN 0 THEN replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(coalesce(text, ''), '. ', '.' || chr(13) || chr(10)) ELSE coalesce(text, '') END"


@query(f"""WITH t AS (SELECT doc_id, replace({_ENDED}, chr(13) || chr(13), chr(13)) AS t FROM documents), n AS (SELECT doc_id, t, length(t) - length(replace(t, chr(10), '')) AS lf, (length(t) - length(replace(t, chr(13) || chr(10), ''))) // 2 AS crlf FROM t)
SELECT doc_id, CASE WHEN lf = 0 THEN 'none' WHEN crlf = lf THEN 'crlf' WHEN crlf = 0 THEN 'lf' ELSE 'mixed' END AS endings, CAST(CASE WHEN t = '' THEN 0 WHEN t LIKE '%' || chr(10) THEN lf ELSE lf + 1 END AS INT) AS n_lines FROM n""")
def line_endings(spark, d):
    """Line ends and lines of every text: of one third as they are, of one with all ends changed, of one with some after sentences."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    ended = F.when(k == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).when(k == 1, F.replace(text, F.lit(". "), F.lit(".\r\n"))).otherwise(text)
    ended = F.replace(ended, F.lit("\r\r"), F.lit("\r"))
    return _docs(spark, d).select("doc_id", snapshots.line_endings(ended).alias("endings"), snapshots.line_count(ended).alias("n_lines"))


@query("""SELECT source, count(*) AS n_files, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes,
 CAST(sum(CASE WHEN text = '' THEN 0 ELSE length(replace(text, chr(13) || chr(10), chr(10))) - length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END) AS BIGINT) AS n_lines FROM documents GROUP BY source""")
def manifest(spark, d):
    """Files, bytes and lines of each source."""
    files = _docs(spark, d).select("source", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return snapshots.manifest_of(files, ["source"]).drop("digest")


@query("""SELECT o_orderkey AS path, CASE o_orderkey % 3 WHEN 0 THEN 'FAILED' ELSE 'OK' END AS state FROM orders""")
def verified_snapshot(spark, d):
    """Files of a snapshot that parse and whose tokens make up their text, and files that do not."""
    text = F.when(F.col("o_orderkey") % 3 == 0, "a = {").otherwise(F.concat(F.lit("a = { b = "), F.col("o_orderkey").cast("string"), F.lit(" } # c\n")))
    return snapshots.verified_files(table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), text.alias("content"))).select("path", "state")


@query("""SELECT source, CASE WHEN kept = 0 THEN 'removed' ELSE 'edited' END AS state FROM (SELECT source, count(*) FILTER (doc_id % 3 <> 0) AS kept, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS gone FROM documents GROUP BY source) WHERE gone > 0""")
def stale_sources(spark, d):
    """Sources whose fingerprints differ once every third document is taken away."""
    docs = _docs(spark, d)
    old, new = (textsearch.source_fingerprint(x).select("source", F.struct("n_files", "bytes", "stamp").alias(n)) for x, n in ((docs, "old"), (docs.where("doc_id % 3 <> 0"), "new")))
    both = old.join(new, "source", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("source", F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("edited").alias("state"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN n_chars + 1 WHEN doc_id % 7 = 2 THEN n_chars + 100000 ELSE n_chars END AS n FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT -1 - doc_id, n_chars FROM documents WHERE doc_id % 7 = 3""")
def followed_tree(spark, d):
    """Rows of a tree after files were added, edited (some without a change of size) and deleted: two versions of a followed sink."""
    from cairn.streaming import refresh

    docs = _docs(spark, d).select("doc_id", "n_chars")
    k, sink = F.col("doc_id") % 7, shared_path(spark, "followed")
    old = docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("length"), F.lit(0).cast("bigint").alias("modified"), F.col("n_chars").alias("n"))
    edited = F.when(k == 1, F.struct((F.col("n_chars") + 1).alias("length"), F.lit(0).cast("bigint").alias("modified"), (F.col("n_chars") + 1).alias("n")))
    touched = F.when(k == 2, F.struct(F.col("n_chars").alias("length"), F.lit(1).cast("bigint").alias("modified"), (F.col("n_chars") + 100000).alias("n")))
    same = F.struct(F.col("n_chars").alias("length"), F.lit(0).cast("bigint").alias("modified"), F.col("n_chars").alias("n"))
    new = docs.where(k != 0).select(F.col("doc_id").alias("path"), F.coalesce(edited, touched, same).alias("f")).select("path", "f.*")
    new = new.unionByName(docs.where(k == 3).select((-1 - F.col("doc_id")).alias("path"), F.col("n_chars").alias("length"), F.lit(5).cast("bigint").alias("modified"), F.col("n_chars").alias("n")))
    for tree in (old, new):
        refresh.follow(tree.select("path", "length", "modified"), sink, lambda paths, tree=tree: tree.join(paths, "path", "left_semi").select("path", "n"))
    return refresh.followed(spark, sink).select(F.col("path").alias("doc_id"), "n")


_BUDGET = 200_000


@query(f"""WITH f AS (SELECT source, doc_id, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round, coalesce(text, '') AS text FROM documents),
 b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY round, source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {_BUDGET} AS scanned FROM f),
 h AS (SELECT source, doc_id, round, len(list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: contains(lower(x), 'tion'))) AS hits FROM b WHERE scanned),
 e AS (SELECT (SELECT bool_or(NOT scanned) FROM b) AS truncated, (SELECT CAST(sum(hits) AS BIGINT) FROM h) AS m, (SELECT count(*) FROM h WHERE hits > 0) AS n)
SELECT source, doc_id, round, CAST(hits AS BIGINT) AS hits, truncated, m AS matched_at_least, CASE WHEN NOT truncated THEN m END AS total, truncated OR n > 20 AS has_more FROM h, e WHERE hits > 0 ORDER BY round, source, doc_id LIMIT 20""")
def budgeted_scan(spark, d):
    """A search that opens a file of each source in turn until its budget of characters is spent, and says what that leaves open."""
    return textsearch.budgeted_search(_docs(spark, d), "tion", _BUDGET)


@query("""WITH asked AS (SELECT DISTINCT 'Brand#' || p_size % 5 AS type, p_name AS name FROM part WHERE p_size < 20) SELECT type, name, count(*) AS n, min(p_partkey) AS first FROM part JOIN asked ON p_brand = type AND p_name = name GROUP BY type, name""")
def typed_lookup(spark, d):
    """Definitions looked up in a store by type: parts as objects, their brands as types; five brands are asked for."""
    part, path = table(spark, d, "part"), shared_path(spark, "by-type")
    harvest.write_by_type(part.select(F.col("p_brand").alias("type"), F.col("p_name").alias("name"), "p_partkey"), path)
    asked = part.where("p_size < 20").select(F.concat(F.lit("Brand#"), (F.col("p_size") % 5).cast("string")).alias("type"), F.col("p_name").alias("name"))
    return harvest.of_types(spark, path, asked).groupBy("type", "name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


# Searches that must find nothing, and names in another order.


@query(f"""WITH {_CASES}, p AS (SELECT query_id, mutation, array_to_string(list_reverse(string_split(expected, '_')), '_') AS query, expected FROM cases WHERE len(string_split(expected, '_')) >= 3 UNION ALL SELECT query_id, 'unrelated', 'zzq' || query_id || '_xxk_vvw', expected FROM cases) SELECT count(*) AS asked, count(DISTINCT query) AS names FROM p""")
def permutation_cases(spark, d):
    """How many reversed and unrelated names the evaluation asks for."""
    cases = evaluate.negative_cases(evaluate.mutation_cases(_docs(spark, d)))
    return cases.agg(F.count("*").alias("asked"), F.count_distinct("query").alias("names"))


@query(f"""WITH {_CASES} SELECT query_id, 'zzq' || query_id || '_xxk_vvw' AS query, CAST(0 AS BIGINT) AS n_suggestions FROM cases""")
def unrelated_names(spark, d):
    """How many suggestions each unrelated name gets; there must be none."""
    from cairn.operators.align import fuzzy_search

    cases, reg, stats = _index(spark, d)
    asked = evaluate.negative_cases(cases).where("mutation = 'unrelated'").select("query_id", "query")
    counts = fuzzy_search(asked, reg, stats).groupBy("query_id").agg(F.count("*").alias("n"))
    return asked.join(counts, "query_id", "left").select("query_id", "query", F.coalesce("n", F.lit(0)).alias("n_suggestions"))
