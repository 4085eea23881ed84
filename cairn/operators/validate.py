"""Validation of scripts against a rule book, and of what they refer to against data.

Scripts are parsed and looked up in compiled rules in one narrow pass: a script's findings depend on the
script and on the book, which every task has (``RuleBook`` bounds its size). What only data can tell, whether
an object, a harvested enum member or a name exists, stays as questions in the findings. All
questions are one table, all that data declares is another; one join answers them for all scripts, and a
node's answers turn its findings into what they become. Suggestions are a join, too.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.functions.distance import ALIKE, alike, with_characters
from cairn.operators.blocks import ANY_SCOPE, Finding, wrong
from cairn.operators.parse import ROWS, ScriptError, parse
from cairn.operators.rulebook import API_KINDS, RuleBook
from cairn.operators.walk import OF_NODE, SAID, Rows, Walk
from cairn.sources.tables import bounded_batches, spread, stored

#: Rank of the statuses, most telling first.
STATUSES = ("UNKNOWN", "UNRESOLVED", "TEMPLATE_MATCH", "CONFIRMED_GAME_DATA", "CONFIRMED_CWT")
#: Longest script, in characters; suggestions of one finding.
LONGEST, SUGGESTIONS = 2_000_000, 5
#: Which kind of name a definition of a type is.
KIND_OF_TYPE = {"scripted_trigger": "trigger", "scripted_effect": "effect", "script_value": "trigger"}
SHOWN = ("node_id", "identifier", "line", "end_line", "status", "code", "message", "sources", "expected", "field", "scope", "supported_scopes", "suggestions", "object_type")


def checked(scripts: DataFrame, book: RuleBook, schema: str | None = None, kind: str | None = None, scope: str | None = None, mode: str = "body", doc: str = "doc", text: str = "text") -> DataFrame:
    """Findings of every script with the questions that are left to data.

    Columns schema, kind, scope and mode of ``scripts``, where there are any, say what a script is; the
    arguments do where there are none or nulls. A script of more than LONGEST characters gives one finding that says so.
    """
    given = {"schema": schema, "kind": kind, "scope": scope, "mode": mode}
    context = [F.coalesce(F.col(c) if c in scripts.columns else F.lit(None).cast("string"), F.lit(v).cast("string")).alias(f"told_{c}") for c, v in given.items()]
    spark = scripts.sparkSession
    bounded_batches(spark)
    columns = ", ".join(f"{c} {t}" for c, t in (OF_NODE | SAID).items())
    out = spark.createDataFrame([], f"{doc} {scripts.schema[doc].dataType.simpleString()}, {columns}").schema
    arrow = to_arrow_schema(out)
    too_long = wrong("SCRIPT_TOO_LONG", f"more than {LONGEST} characters")

    def run(batches):
        walk, rows = Walk(book), Rows(doc, arrow)
        for batch in batches:
            for key, source, *told in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if len(source or "") > LONGEST:
                    rows.add(key, None, too_long)
                    continue
                try:
                    for node, finding, pending in walk.findings(parse(source or ""), *told):
                        rows.add(key, node, finding, pending)
                except ScriptError as problem:
                    rows.add(key, None, Finding("UNKNOWN", "SCRIPT_PARSE_ERROR", str(problem)), line=problem.line)
                if len(rows) >= ROWS:
                    yield rows.batch()
        if len(rows):
            yield rows.batch()

    return spread(scripts.select(doc, text, *context), text).mapInArrow(run, out)


def declared_by_data(definitions: DataFrame, generated: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(sort, type, name_cf, declared_type, made, made_scopes), one row each: objects of types, names of kinds, members of enums.

    ``definitions``: type, name; ``generated``: name, supported_scopes (modifiers); ``members``: enum, value.
    """
    kinds = F.create_map(*(F.lit(x) for pair in KIND_OF_TYPE.items() for x in pair))
    none, no_scopes = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    row = lambda frame, sort, type_, name, declared=none, made=False, scopes=no_scopes: frame.select(F.lit(sort).alias("sort"), type_.alias("type"), F.lower(name).alias("name_cf"), declared.alias("declared_type"), F.lit(made).alias("made"), scopes.alias("made_scopes"))
    facts = row(definitions, "object", F.col("type"), F.col("name")).unionByName(row(definitions.where(kinds[F.col("type")].isNotNull()), "name", kinds[F.col("type")], F.col("name"), F.col("type")))
    if generated is not None:
        facts = facts.unionByName(row(generated, "name", F.lit("modifier"), F.col("name"), made=True, scopes=F.col("supported_scopes")))
    if members is not None:
        facts = facts.unionByName(row(members, "enum", F.col("enum"), F.col("value")))
    return facts.groupBy("sort", "type", "name_cf").agg(F.min("declared_type").alias("declared_type"), F.max("made").alias("made"), F.max("made_scopes").alias("made_scopes"), F.lit(True).alias("is_there"))


def answers(found: DataFrame, facts: DataFrame, doc: str = "doc") -> DataFrame:
    """What data says of each node that asks: (doc, node_id, member, object, denied, object_type, torn, declared_type, made, made_scopes).

    A question is confirmed if its name is there, and denied if data has anything of its type but not that name.
    """
    asked = found.where("asks is not null").select(doc, "node_id", "every", F.col("value").alias("own"), F.explode("asks").alias("q"))
    asked = asked.select(doc, "node_id", "every", F.col("q.sort").alias("asked_sort"), F.when(F.col("q.sort") == "hole", "object").otherwise(F.col("q.sort")).alias("sort"), F.col("q.type").alias("type"), F.lower(F.coalesce("q.value", "own")).alias("name_cf")).distinct()
    loaded = facts.select("sort", "type", F.lit(True).alias("loaded")).distinct()
    met = asked.join(facts, ["sort", "type", "name_cf"], "left").join(loaded, ["sort", "type"], "left")
    yes = F.coalesce("is_there", F.lit(False))
    no = ~yes & F.coalesce("loaded", F.lit(False))
    of = lambda sort: F.col("asked_sort") == sort
    return met.groupBy(doc, "node_id").agg(
        F.max(of("enum") & yes).alias("member"), F.max(of("object") & yes).alias("object"), F.min(of("object") | of("enum")).alias("of_value"), F.min(F.col("every") & no).alias("all_no"),
        F.array_join(F.array_sort(F.collect_set(F.when(of("object"), F.col("type")))), "/").alias("object_types"), F.max(of("hole") & no).alias("torn"),
        F.min("declared_type").alias("declared_type"), F.max(of("name") & F.coalesce("made", F.lit(False))).alias("made"), F.max(F.when(of("name"), F.col("made_scopes"))).alias("made_scopes"),
    ).withColumn("denied", F.col("of_value") & F.col("all_no")).drop("of_value", "all_no")


#: What a finding becomes: verdict, then (status, code, message); where a verdict is not listed the finding stays.
BECOMES = {
    "object": ("CONFIRMED_GAME_DATA", "OBJECT_REFERENCE", "the object exists"),
    "no object": ("UNKNOWN", "UNKNOWN_OBJECT_REFERENCE", "no object of this name"),
    "no member": ("UNKNOWN", "VALUE_MISMATCH", "no member that data has"),
    "torn": ("UNKNOWN", "UNKNOWN_MODIFIER", "fits a template, but its object does not exist"),
    "declared": ("CONFIRMED_GAME_DATA", "DEFINED_IN_GAME_DATA", "declared by data"),
    "made": ("CONFIRMED_GAME_DATA", "GENERATED_MODIFIER", "declared by data"),
    "misplaced": ("UNKNOWN", "SCOPE_MISMATCH", "no category of the modifier supports this scope"),
}


def verdicts() -> F.Column:
    """An array of what a finding becomes: nothing, itself ("stays"), something else, or two things."""
    role, one = F.col("role"), lambda *names: F.array(*(F.lit(n) for n in names))
    nothing = F.array().cast("array<string>")
    unfit = F.col("scope").isNotNull() & (F.size("made_scopes") > 0) & ~F.array_contains("made_scopes", F.lower("scope")) & ~F.arrays_overlap("made_scopes", F.array(*map(F.lit, sorted(ANY_SCOPE))))
    by_data = F.when(F.col("made"), F.when(unfit, one("made", "misplaced")).otherwise(one("made"))).when(F.col("declared_type").isNotNull(), one("declared")).otherwise(one("stays"))
    of_value = (
        F.when(F.col("member"), F.when(role == "open", nothing).otherwise(one("stays")))
        .when(F.col("object"), F.when(role == "value", one("object")).when(role == "open", nothing).otherwise(one("stays")))
        .when(F.col("denied"), F.when(role != "value", nothing).when(F.col("object_types") != "", one("no object")).otherwise(one("no member")))
    )
    torn = F.col("asks").isNotNull() & F.col("torn")
    return F.coalesce(F.when(torn, F.when(role == "modifier", one("torn")).otherwise(nothing)), F.when(role == "unknown", by_data), F.when(role.isin("value", "open", "scope"), of_value), one("stays"))


def names_of(book: RuleBook, spark) -> DataFrame:
    """(pool, name) of the names that rules declare, by kind; bounded as the book is."""
    rows = {(f"name/{k}", n) for k in API_KINDS for n in (*book.aliases[k], *(book.modifiers if k == "modifier" else ())) if "<" not in n}
    return spark.createDataFrame(sorted(rows), "pool string, name string")


def close_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(pool, value, name, score): every name of a pool whose difflib ratio to a value of that pool is ALIKE or more.

    Names as alike share at least ALIKE / 2 of all their characters, copies counted. With characters in one
    fixed order, rare ones first, so alike a pair has one in common among the first of both that are
    not needed for that share: that is what they are joined on, and no pair is lost. Lengths and all
    shared characters bound the ratio further before it is worked out.
    """
    share = ALIKE / 2
    n = F.size("all")
    least = F.ceil(share * (n + F.ceil(share / (1 - share) * n - 1e-9)) - 1e-9)
    first = F.slice("all", 1, F.greatest(F.lit(1), n - least + 1).cast("int"))
    left = with_characters(asked.select("pool", "value").where("value <> ''").distinct(), "value", "all").select("pool", "value", F.col("all").alias("own"), F.explode(first).alias("character"))
    right = with_characters(names.select("pool", "name").where("name <> ''").distinct(), "name", "all").select("pool", "name", F.col("all").alias("other"), F.explode(first).alias("character"))
    both = F.size("own") + F.size("other")
    met = left.join(right, ["pool", "character"]).where((2 * F.least(F.size("own"), F.size("other")) >= ALIKE * both) & (2 * F.size(F.array_intersect("own", "other")) >= ALIKE * both))
    near = met.select("pool", "value", "name").distinct().withColumn("score", alike("name", "value"))
    return near.where(F.col("score") >= ALIKE)


def suggested(rows: DataFrame, definitions: DataFrame, names: DataFrame) -> DataFrame:
    """(pools, value, suggestions): the closest names over the pools of a finding, best first, of equals the later name."""
    asked = rows.select("pools", F.col("wanted").alias("value")).distinct()
    each = asked.select("pools", "value", F.explode("pools").alias("pool"))
    listed = each.where(F.startswith("pool", F.lit("near/"))).select("pool").distinct().select("pool", F.explode(F.split(F.substring("pool", 6, 1 << 30), "\0")).alias("name"))
    of_data = definitions.select(F.concat(F.lit("object/"), "type").alias("pool"), "name").where("name is not null")
    near = each.join(close_names(each.select("pool", "value"), names.unionByName(of_data).unionByName(listed)), ["pool", "value"])
    order = Window.partitionBy("pools", "value").orderBy(F.desc("score"), F.desc("name"))
    best = near.select("pools", "value", "name", "score").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= SUGGESTIONS)
    top = best.groupBy("pools", "value").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("l"))  # SUGGESTIONS at most
    return top.select("pools", "value", F.col("l.name").alias("suggestions"))


def answered(found: DataFrame, book: RuleBook, definitions: DataFrame, generated: DataFrame | None = None, members: DataFrame | None = None, doc: str = "doc") -> DataFrame:
    """Findings (stored) with the questions answered by data."""
    told = answers(found, declared_by_data(definitions, generated, members), doc)
    # What stands inside a block whose name data declares is data's own.
    owners = told.where("made or declared_type is not null").select(F.col(doc).alias("owner_doc"), F.col("node_id").alias("owner"))
    inside = found.where("pending is not null").join(owners, (F.col(doc) == F.col("owner_doc")) & (F.col("pending") == F.col("owner")), "left_anti")
    rows = found.where("pending is null").unionByName(inside).join(told, [doc, "node_id"], "left")
    rows = rows.withColumn("verdict", F.explode(verdicts()))
    changed = [F.coalesce(*(F.when(F.col("verdict") == v, F.lit(texts[i])) for v, texts in BECOMES.items()), F.col(c)).alias(c) for i, c in enumerate(("status", "code", "message"))]
    is_object, is_unknown = F.col("verdict").isin("object", "no object"), (F.col("verdict") == "stays") & (F.col("role") == "unknown")
    object_type = F.when(is_object, F.col("object_types")).when(F.col("verdict") == "declared", F.col("declared_type"))
    supported = F.when(F.col("verdict") == "misplaced", F.array_sort("made_scopes")).otherwise(F.col("supported_scopes"))
    prefixed = lambda prefix, c: F.transform(F.split(c, "/"), lambda x: F.concat(F.lit(prefix), x))
    pools = F.when(F.col("verdict") == "no object", prefixed("object/", F.col("object_types"))).when(is_unknown, F.when(F.col("near").isNotNull(), F.array(F.concat(F.lit("near/"), F.array_join("near", "\0")))).otherwise(prefixed("name/", F.col("pool"))))
    kept = [c for c in SHOWN if c not in ("status", "code", "message", "object_type", "supported_scopes", "suggestions")]
    rows = rows.select(doc, *kept, *changed, object_type.alias("object_type"), supported.alias("supported_scopes"), pools.alias("pools"), F.when(is_unknown, F.col("identifier")).otherwise(F.col("value")).alias("wanted"))
    offers = suggested(rows.where("pools is not null"), definitions, names_of(book, found.sparkSession)).withColumnRenamed("value", "wanted")
    return rows.join(offers, ["pools", "wanted"], "left").select(doc, *SHOWN)


def validate(scripts: DataFrame, book: RuleBook, definitions: DataFrame, generated: DataFrame | None = None, members: DataFrame | None = None, doc: str = "doc", **context) -> DataFrame:
    """Findings of every script; what the scripts give is written once, as questions and answers both read it.

    ``definitions``: type, name; ``generated``: name, supported_scopes; ``members``: enum, value, of enums harvested from data.
    """
    return answered(stored(checked(scripts, book, doc=doc, **context), "findings"), book, definitions, generated, members, doc)


def overall(findings: DataFrame, doc: str = "doc") -> DataFrame:
    """Findings of each script by status, and the status that outranks the others."""
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)))
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s.lower()}") for s in STATUSES]
    return findings.groupBy(doc).agg(F.min_by("status", rank[F.col("status")]).alias("overall"), F.count("*").alias("n_findings"), *counts)
