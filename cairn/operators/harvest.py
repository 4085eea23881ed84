"""Definitions out of script trees, by directory rules that rule text declares."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.parse import nodes
from cairn.operators.rulebook import Rule, RuleBook

#: Files with errors that a report names.
ERRORS_SHOWN = 20
RULE_COLUMNS = (
    "type string, directory string, extension string, file_stem string, name_field string, name_from_file boolean, type_per_file boolean, skip_root array<string>, include array<string>,"
    " exclude array<string>, starts_with array<string>, prefix string"
)
SUBTYPE_COLUMNS = "type string, subtype string, include array<string>, exclude array<string>, starts_with array<string>, conditions array<struct<first:string,second:string,wanted:string,never:boolean>>"


def _filters(rule: Rule) -> tuple[list[str], list[str], list[str]]:
    """Keys that a rule takes, keys that it refuses, and what a key has to begin with."""
    named = {v.lower() for v in rule.notes.get("type_key_filter", ())}
    return sorted(named - rule.excluded), sorted(rule.excluded), [v.lower() for v in rule.notes.get("starts_with", ())]


def directory_rules(spark: SparkSession, book: RuleBook, types: list[str] | None = None) -> DataFrame:
    """A row for each path of each declared type (or of those named)."""
    rows = []
    for name, declarations in book.types.items():
        if types is not None and name not in types:
            continue
        for rule in declarations:
            value = lambda key, rule=rule: (f.value if (f := rule.first(key)) is not None else None)
            extension = value("path_extension") or ".txt"
            include, exclude, starts = _filters(rule)
            skipped = [k.lower() for k in rule.first("skip_root_key").items()] if rule.first("skip_root_key") else []
            for path in (c.value for c in rule.children if c.key == "path" and c.value):
                directory = path.replace("\\", "/").strip("/").removeprefix("game/")
                rows.append((name, directory, extension if extension.startswith(".") else f".{extension}", value("path_file"), value("name_field"), rule.first("name_from_file") is not None,
                             rule.first("type_per_file") is not None, skipped, include, exclude, starts, (value("type_key_prefix") or "").lower()))
    return spark.createDataFrame(rows, RULE_COLUMNS)


def subtype_rules(spark: SparkSession, book: RuleBook) -> DataFrame:
    """A row for each subtype of each declared type, with what a definition must contain.

    A condition names a field, and perhaps a field inside it, and the value that it must have (null: it
    must be there). ``yes`` is met by any value; ``no`` by none, as a field that is there and one that is
    not are both no match; neither are conditions that lie deeper.
    """

    def conditions(rules: list[Rule], outer: str | None = None):
        for r in rules:
            where = (r.key, None) if outer is None else (outer, r.key)
            if r.children is None:
                wanted = (r.value or "").lower() if r.op else None
                yield (*where, None if wanted == "yes" else wanted, wanted == "no")
            else:
                yield (*where, None, outer is not None and bool(r.children))
                if outer is None:
                    yield from conditions(r.children, r.key)

    rows = []
    for name, declarations in book.types.items():
        for rule in declarations:
            for sub in (c for c in rule.children if c.kind[0] == "subtype"):
                rows.append((name, sub.kind[1], *_filters(sub), list(conditions(sub.children or []))))
    return spark.createDataFrame(rows, SUBTYPE_COLUMNS)


#: Names that are broadcast to a lookup; more of them are joined like any table.
ASKED = 100_000


def needed_types(book: RuleBook, templates: list[str], extra: list[str] = ()) -> list[str]:
    """Declared types that placeholders of templates, or the caller, ask for; enums harvested from data count through ``path``."""
    asked = {m.split(".")[0].strip() for t in templates for m in re.findall(r"<([^<>\s]+)>", t)} | set(extra) | {t for t, _, _ in complex_enum_sources(book)}
    return sorted(asked & set(book.types))


def complex_enum_sources(book: RuleBook) -> list[tuple[str, str, tuple[str, ...]]]:
    """(type, enum, path of keys) for each enum that is harvested from where a type's objects live."""
    plain = lambda path: (path or "").replace("\\", "/").strip("/").removeprefix("game/")
    lives = {}
    for name, declarations in book.types.items():
        for rule in declarations:
            for c in rule.children:
                if c.key == "path":
                    lives.setdefault(plain(c.value), []).append(name)

    def leaves(rule: Rule, trail: tuple[str, ...]):
        for c in rule.children or ():
            if c.key == "enum_name" or c.value == "enum_name":
                yield (*trail, c.key)
            yield from leaves(c, (*trail, c.key))

    rows = []
    for enum, declarations in book.complex_enums.items():
        for rule in declarations:
            tree = rule.first("name")
            for name in lives.get(plain(rule.first("path").value if rule.first("path") else None), ()):
                rows += [(name, enum, path) for path in (leaves(tree, ()) if tree else ())]
    return rows


def parsed_files(scripts: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes of the files that some rule asks for, with where they are; a file that cannot be parsed is a
    row with its error. ``scripts``: source, priority, rel_path, text.

    Files are matched on their own directory, extension and, if asked, stem, so no other is parsed. Rules
    are declarations (``directory_rules`` makes them from a bounded book), hence the broadcast.
    """
    name = F.element_at(F.split("rel_path", "/"), -1)
    placed = scripts.withColumn("directory", F.regexp_replace(F.regexp_extract("rel_path", "^(.*/)?[^/]*$", 1), "/$", "")).withColumn("extension", F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    placed = placed.withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", "")).withColumn("doc", F.concat_ws("\0", "source", "rel_path"))
    asked = F.broadcast(rules.select(F.col("directory").alias("rd"), F.col("extension").alias("re"), F.col("file_stem").alias("rs")).distinct())
    wanted = placed.join(asked, (F.col("directory") == F.col("rd")) & (F.col("extension") == F.col("re")) & (F.col("rs").isNull() | (F.lower("rs") == F.lower("stem"))), "left_semi")
    return nodes(wanted.select("doc", "text")).join(wanted.drop("text"), "doc")


def file_errors(files: DataFrame, most: int = ERRORS_SHOWN) -> DataFrame:
    """The first files that could not be parsed, and why."""
    return files.where("error is not null").select("source", "rel_path", "error_line", "error").orderBy("source", "rel_path").limit(most)


def definitions_of(files: DataFrame, rules: DataFrame, subtypes: DataFrame | None = None) -> DataFrame:
    """(name, type, source, priority, rel_path, line, start, end, subtypes) of every object in parsed files."""
    good = files.where("error is null")
    at = ["doc", "node_id"]
    rows = good.where("depth <= 1").join(F.broadcast(rules), ["directory", "extension"]).where(F.col("file_stem").isNull() | (F.lower("file_stem") == F.lower("stem")))
    skips = lambda key: F.array_contains("skip_root", F.lower(key)) | F.array_contains("skip_root", "any")
    roots = good.where("depth = 0").select(F.col("doc").alias("rdoc"), F.col("node_id").alias("rid"), F.col("key").alias("root_key"))
    # Roots, or the children of roots that the rule looks into.
    tops = rows.where((F.col("depth") == 0) & (F.col("type_per_file") | ~skips("key")))
    inner = rows.where((F.col("depth") == 1) & ~F.col("type_per_file") & (F.size("skip_root") > 0)).join(roots, (F.col("doc") == F.col("rdoc")) & (F.col("parent_id") == F.col("rid"))).where(skips("root_key")).drop("rdoc", "rid", "root_key")
    low = F.lower("key")
    taken = tops.unionByName(inner).where(
        (F.col("is_block") | F.col("type_per_file")) & ((F.size("include") == 0) | F.array_contains("include", low)) & ~F.array_contains("exclude", low)
        & ((F.size("starts_with") == 0) | F.exists("starts_with", lambda p: F.startswith(low, p))) & F.startswith(low, F.col("prefix"))
    )
    # The first child of a name stands for it.
    child = good.where("parent_id is not null").groupBy("doc", "parent_id", "key").agg(F.min_by(F.struct("node_id", "value"), "ordinal").alias("c"))
    named = child.select(F.col("doc").alias("fdoc"), F.col("parent_id").alias("fid"), F.col("key").alias("fkey"), F.col("c.value").alias("fvalue"))
    taken = taken.join(named, (F.col("doc") == F.col("fdoc")) & (F.col("node_id") == F.col("fid")) & (F.col("name_field") == F.col("fkey")), "left")
    name = F.when(F.col("name_from_file"), F.col("stem")).when(F.col("name_field") == "-", F.col("value")).when(F.col("name_field").isNotNull(), F.col("fvalue")).otherwise(F.col("key"))
    found = taken.select(*at, name.alias("name"), "type", "source", "priority", "rel_path", "line", "start", "end", low.alias("key_cf")).where("name is not null and name <> ''").distinct()
    if subtypes is None:
        return found.drop("doc", "node_id", "key_cf").withColumn("subtypes", F.array().cast("array<string>"))
    return _with_subtypes(found, child, subtypes).drop("doc", "node_id", "key_cf")


def _with_subtypes(found: DataFrame, child: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Relational division: a subtype holds where as many of its conditions are met as it has."""
    possible = found.select("doc", "node_id", "type", "key_cf").distinct().join(F.broadcast(subtypes), "type").where(
        ((F.size("include") == 0) | F.array_contains("include", F.col("key_cf"))) & ~F.array_contains("exclude", F.col("key_cf")) & ((F.size("starts_with") == 0) | F.exists("starts_with", lambda p: F.startswith("key_cf", p)))
    )
    asked = possible.select("doc", "node_id", "type", "subtype", F.size("conditions").alias("n"), F.posexplode_outer("conditions").alias("at", "w")).select("doc", "node_id", "type", "subtype", "n", "at", "w.*")
    one = child.select("doc", F.col("parent_id").alias("node_id"), F.col("key").alias("first"), F.col("c.node_id").alias("inner_id"), F.col("c.value").alias("first_value"))
    two = child.select("doc", F.col("parent_id").alias("inner_id"), F.col("key").alias("second"), F.lit(True).alias("has_second"), F.col("c.value").alias("second_value"))
    joined = asked.join(one, ["doc", "node_id", "first"], "left").join(two, ["doc", "inner_id", "second"], "left")
    there = F.when(F.col("second").isNull(), F.col("inner_id").isNotNull()).otherwise(F.coalesce("has_second", F.lit(False)))
    value = F.lower(F.when(F.col("second").isNull(), F.coalesce("first_value", F.lit(""))).otherwise(F.coalesce("second_value", F.lit(""))))
    met = there & ~F.col("never") & (F.col("wanted").isNull() | (value == F.col("wanted")))
    held = joined.groupBy("doc", "node_id", "type", "subtype", "n").agg(F.count(F.when(met, 1)).alias("met")).where("met = n")
    lists = held.groupBy("doc", "node_id", "type").agg(F.array_sort(F.collect_set("subtype")).alias("subtypes"))  # subtypes of one type
    return found.join(lists, ["doc", "node_id", "type"], "left").withColumn("subtypes", F.coalesce("subtypes", F.array().cast("array<string>")))


def definitions(scripts: DataFrame, rules: DataFrame, subtypes: DataFrame | None = None) -> DataFrame:
    return definitions_of(parsed_files(scripts, rules), rules, subtypes)


def write_by_type(found: DataFrame, path: str) -> None:
    """Definitions by type: a folder for each, so that a lookup opens only the types it asks for."""
    found.write.mode("overwrite").partitionBy("type").parquet(path)


def of_types(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """Stored definitions of the names asked for (type, name). Which folders are read is decided while the query runs, by
    the types that are asked for."""
    wanted = asked.where("name <> ''").select(F.col("type").alias("asked_type"), F.lower("name").alias("asked_name")).distinct()
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(wanted) if wanted.limit(ASKED + 1).count() <= ASKED else wanted, (rows["type"] == F.col("asked_type")) & (F.lower(rows["name"]) == F.col("asked_name"))).drop("asked_type", "asked_name")


def with_source(found: DataFrame, scripts: DataFrame) -> DataFrame:
    """Definitions (few, as a search leaves them) with the text between their offsets; no text of any other file is moved."""
    wanted = found.select("source", "rel_path").distinct()
    texts = scripts.select("source", "rel_path", "text").join(wanted, ["source", "rel_path"], "left_semi")
    cut = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.join(texts, ["source", "rel_path"]).withColumn("body", cut).drop("text")


def enum_members(files: DataFrame, rules: DataFrame, sources: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """(enum, value): values of enums that are harvested along a path of keys below the objects of a type.

    A step named ``enum_name`` is the value itself, a key; where a step's value is asked for it is the
    scalar there.
    """
    good = files.where("error is null")
    out = None
    for kind, enum, path in sources:
        where = F.broadcast(rules.where(F.col("type") == kind).select("directory", "extension").distinct())
        level = good.where("depth = 0").join(where, ["directory", "extension"]).select("doc", F.col("node_id").alias("up"))
        for i, step in enumerate(path):
            below = good.select("doc", F.col("parent_id").alias("up"), "node_id", "key", "value")
            if step != "enum_name":
                below = below.where(F.col("key") == step)
            member = F.col("key") if step == "enum_name" else F.coalesce("value", "key")
            level = level.join(below, ["doc", "up"]).select("doc", *([member.alias("member")] if i == len(path) - 1 else [F.col("node_id").alias("up")]))
        found = level.select(F.lit(enum).alias("enum"), F.lower("member").alias("value")).distinct()
        out = found if out is None else out.unionByName(found)
    return out.distinct() if out is not None else files.sparkSession.createDataFrame([], "enum string, value string")


def localisation(scripts: DataFrame, keys_of_text: int = 200) -> DataFrame:
    """lang, key, value of display-name files; marks are stripped, the first text of a key wins, and of the
    keys of one text the first ``keys_of_text`` stay."""
    lang = F.regexp_extract("rel_path", r"_l_([a-z_]+)\.yml$", 1)
    rows = scripts.withColumn("lang", lang).where("lang <> ''").select("lang", "priority", "rel_path", F.posexplode(F.split("text", "\n")).alias("ord", "row"))
    pattern = r'^\s*([\w.\-]+):\d*\s*"(.*)"'
    value = F.regexp_replace(F.regexp_extract("row", pattern, 2), r"\$[^$]*\$|£\S*", "")
    found = rows.where(F.col("row").rlike(pattern)).select("lang", F.regexp_extract("row", pattern, 1).alias("key"), F.trim(value).alias("value"), "priority", "rel_path", "ord")
    first = found.groupBy("lang", "key").agg(F.min_by("value", F.struct("priority", "rel_path", "ord")).alias("value"), F.min(F.struct("priority", "rel_path", "ord")).alias("place"))
    order = Window.partitionBy("lang", "value").orderBy("place", "key")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keys_of_text).select("lang", "key", "value")


def raised(text: Column) -> Column:
    """Upper case character by character: one that has no single upper-case character (as ß) stays, so lower case leads back to it."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), ""))


def by_display_name(queries: DataFrame, texts: DataFrame, symbols: DataFrame, languages: tuple[str, ...] = ("simp_chinese", "english")) -> DataFrame:
    """Two hops: a display text to the keys that have it, and these to the symbols of that name; of several
    languages the first in which a text is found counts. ``queries``: query_id, query."""
    rank = F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)))
    hits = queries.join(texts, F.lower("query") == F.lower("value")).withColumn("preference", F.coalesce(rank[F.col("lang")], F.lit(len(languages))))
    best = Window.partitionBy("query_id")
    hits = hits.withColumn("best", F.min("preference").over(best)).where("preference = best").select("query_id", "query", "key").distinct()
    return hits.join(symbols, F.lower("key") == F.lower("name")).select("query_id", "query", "key", *symbols.columns)
