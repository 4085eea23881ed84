"""Searching, looking up and describing what rules and data declare."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.align import RELATED_COVERAGE, RELATED_SCORE, RESULT_SCORE, RESULT_SUPPORT, fuzzy_matches
from cairn.operators.registry import tokens_of
from cairn.operators.rules import template_match
from cairn.sources.tables import stored

#: Scores of what is no suggestion; statuses whose rows stay one for each place; limits.
EXACT, TEMPLATE = 100.0, 99.0
ONE_EACH = ("CONFIRMED_CWT", "TEMPLATE_MATCH")
RELATED_LIMIT, QUERY_CHARS, MOST_ROWS, SNIPPET = 40, 512, 500, 110
#: What an economic name ends in.
ECONOMIC = r"(?i)^([a-z0-9][a-z0-9_.-]*)_(cost|produces|upkeep|logistics)_(mult|add)$"
#: Fixed text of the scoring legend.
LEGEND = (
    ("CONFIRMED_CWT", "declared by the rules"), ("CONFIRMED_GAME_DATA", "declared by data"), ("TEMPLATE_MATCH", "fits a template of the rules"), ("SUGGESTION", "a name like the one asked for"), ("UNKNOWN", "declared nowhere"),
    ("UNRESOLVED", "could not be decided"),
)


def accepted(symbols: DataFrame, selected: dict | None) -> DataFrame:
    """The symbols that a resolved type filter (``RuleBook.resolve_type``) lets through."""
    if selected is None or selected["status"] == "ALL":
        return symbols
    column = {"KIND": "kind", "FILE": "path", "DYNAMIC_TYPE": "type"}.get(selected["status"])
    if column is None:
        raise ValueError(f"no type filter: {selected}")
    return symbols.where(F.col(column) == selected["value"])


def search(queries: DataFrame, symbols: DataFrame, templates: list[str], stats: DataFrame, limit: int = 20, selected: dict | None = None) -> DataFrame:
    """(query_id, tier, rank, name, type, status, match_score, n_definitions, total, truncated) of every query.

    ``symbols``: name, type, origin (rules or data), id. Exact names, templates that a query fits and
    names like it are united, none cuts another short; ``total`` counts rows before the limit. A name that
    data declares and that goes on where the query ends, with nothing read differently, is evidence of
    data, no suggestion.
    """
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit is 1 to {MOST_ROWS}")
    symbols = accepted(symbols, selected)
    asked = queries.where(F.length(F.trim("query")).between(1, QUERY_CHARS))
    exact = asked.join(symbols, F.lower("query") == F.lower("name")).select(
        "query_id", "query", "name", "type", "id", F.when(F.col("origin") == "data", "CONFIRMED_GAME_DATA").otherwise("CONFIRMED_CWT").alias("status"), F.lit(EXACT).alias("match_score"), F.lit(1.0).alias("support"), F.lit(1.0).alias("coverage")
    )
    fitted = template_match(asked, templates).select("query_id", "query", F.col("template").alias("name"), F.lit("template").alias("type"), F.col("template").alias("id"), F.lit("TEMPLATE_MATCH").alias("status"), F.lit(TEMPLATE).alias("match_score"), F.lit(1.0).alias("support"), F.lit(1.0).alias("coverage"))
    like = fuzzy_matches(asked.select("query_id", "query"), symbols.select(F.lower("name").alias("name")).distinct(), stats, least=RELATED_SCORE).withColumn("cf", F.col("name"))
    goes_on = F.startswith(F.lower("name"), F.lower("query")) & (F.col("origin") == "data") & (F.col("match_score") < EXACT)
    near = like.drop("name").join(symbols, F.col("cf") == F.lower("name")).where(F.lower("query") != F.lower("name")).select(
        "query_id", "query", "name", "type", "id", F.when(goes_on, "CONFIRMED_GAME_DATA").otherwise("SUGGESTION").alias("status"), "match_score", F.col("query_support").alias("support"), F.col("candidate_coverage").alias("coverage")
    )
    rows = deduplicated(exact.unionByName(fitted).unionByName(near))
    result = ~F.col("status").isin("SUGGESTION") | ((F.col("match_score") >= RESULT_SCORE) & (F.col("support") >= RESULT_SUPPORT))
    related = (F.col("match_score") >= RELATED_SCORE) & (F.col("coverage") >= RELATED_COVERAGE)
    tiered = rows.withColumn("tier", F.when(result, "result").when(related, "related")).where("tier is not null")
    part = Window.partitionBy("query_id", "tier")
    most = F.when(F.col("tier") == "result", limit).otherwise(RELATED_LIMIT)
    ranked = tiered.withColumn("rank", F.row_number().over(part.orderBy(F.desc("match_score"), "name", "type", "id")).cast("bigint")).withColumn("total", F.count("*").over(part))
    return ranked.where(F.col("rank") <= most).select("query_id", "tier", "rank", "name", "type", "status", "match_score", "n_definitions", "total", (F.col("total") > most).alias("truncated"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row for each (query, name, type), the best and first, and how many there were; rows of evidence
    that stand for a place of their own stay apart."""
    place = F.when(F.col("status").isin(*ONE_EACH), F.col("id").cast("string")).otherwise("")
    pick = F.min_by(F.struct("id", "status", "match_score", "support", "coverage"), F.struct(-F.col("match_score"), "status", "id"))
    grouped = rows.withColumn("place", place).groupBy("query_id", "query", "name", "type", "place").agg(pick.alias("r"), F.count("*").alias("n_definitions"))
    return grouped.select("query_id", "query", "name", "type", "r.*", "n_definitions")


def definition_texts(node_rows: DataFrame, docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """The source of each root node with the comment lines that lead up to it and a comment behind it:
    (doc, node_id, key, start_line, end_line, source)."""
    tops = node_rows.where("error is null and depth = 0").select(doc, "node_id", "key", "start", "end", "line", "end_line").join(docs.select(doc, text), doc)
    before = F.substring(text, F.lit(1), F.col("start"))
    lead = F.regexp_extract(before, r"((?:(?<=\n|^)[ \t]*#[^\n]*\n)*[^\n]*)\z", 1)
    behind = F.regexp_extract(F.substring(text, F.col("end") + 1, F.length(text)), r"^([ \t]*#[^\r\n]*)", 1)
    body = F.substring(text, F.col("start") + 1, F.col("end") - F.col("start"))
    return tops.select(doc, "node_id", "key", (F.col("line") - F.regexp_count(lead, F.lit("\n"))).cast("int").alias("start_line"), "end_line", F.concat(lead, body, behind).alias("source"))


#: Kinds of alias whose source is the whole run of roots around them.
RUN_KINDS = r"^alias\[(trigger|effect):"


def run_texts(node_rows: DataFrame, docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``definition_texts``, but a trigger or effect alias comes with all roots before and after it that no blank line parts
    from it: overloads and what belongs to them stand in one run. Runs are islands over the text between roots."""
    tops = node_rows.where("error is null and depth = 0").select(doc, "node_id", "key", "start", "end", "line", "end_line", "depth", "error")
    order = Window.partitionBy(doc).orderBy("start")
    between = tops.withColumn("before", F.lag("end").over(order)).join(docs.select(doc, text), doc)
    parted = F.substring(text, F.col("before") + 1, F.col("start") - F.col("before")).rlike(r"\n[ \t\r]*\n")
    islands = between.select(*tops.columns, F.sum(F.coalesce(parted, F.lit(False)).cast("int")).over(order).alias("island"))
    run = Window.partitionBy(doc, "island")
    whole = {"start": F.min("start"), "end": F.max("end"), "line": F.min("line"), "end_line": F.max("end_line")}
    is_run = F.lower("key").rlike(RUN_KINDS)
    spread = islands.select(doc, "node_id", "key", "depth", "error", *(F.when(is_run, f.over(run)).otherwise(F.col(c)).alias(c) for c, f in whole.items()))
    return definition_texts(spread, docs, doc, text)


#: What a reply says of its rows, by the kinds that it has.
TIPS = ("candidates, not confirmed interfaces", "candidates only: a definition belongs to the name suggested, not to the one asked for", "a known shape; whether its object exists is not said")


def projected(found: DataFrame, queries: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """One row a query for a reader: ``results``, ``templates`` and ``suggestions`` (arrays of name, type, definitions), ``more`` and ``tips``.

    A name of a type stands once, as confirmed before as a template before as a suggestion; what fits a template is shown
    under the name that was asked for. ``found``: rows of ``search`` of the tier "result"; ``details`` (name, type, definition)
    are joined to the rows that are shown only.
    """
    group = F.when(F.col("status").isin("CONFIRMED_CWT", "CONFIRMED_GAME_DATA"), 0).when(F.col("status") == "TEMPLATE_MATCH", 1).otherwise(2)
    rows = found.join(queries.select("query_id", "query"), "query_id").withColumn("group", group).withColumn("shown", F.when(F.col("group") == 1, F.col("query")).otherwise(F.col("name")))
    one = rows.groupBy("query_id", F.col("shown").alias("name"), "type").agg(F.min(F.struct("group", "rank")).alias("r"), F.max("total").alias("total")).select("query_id", "name", "type", "r.*", "total")
    one = stored(one, "shown")  # the few rows of each query that are shown; details and replies both read them
    if details is not None:
        wanted = one.where("group <> 1").select("name", "type").distinct()
        texts = details.join(wanted, ["name", "type"], "left_semi").groupBy("name", "type").agg(F.array_sort(F.collect_list("definition")).alias("definitions"))  # definitions of one name
        one = one.join(texts, ["name", "type"], "left")
    else:
        one = one.withColumn("definitions", F.lit(None).cast("array<string>"))
    row = F.struct("rank", "name", "type", "definitions")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("group") == i, row))), lambda x: x.dropFields("rank")).alias(n) for i, n in enumerate(("results", "templates", "suggestions"))]
    replies = one.groupBy("query_id").agg(F.count("*").alias("shown"), F.max("total").alias("total"), *lists)
    has = lambda c: F.size(c) > 0
    tips = F.when(has("suggestions") & (has("results") | has("templates")), TIPS[0]).when(has("suggestions"), TIPS[1]).when(has("templates"), TIPS[2])
    return replies.select("query_id", "results", "templates", "suggestions", F.greatest(F.col("total") - F.col("shown"), F.lit(0)).alias("more"), tips.alias("tips"))


def same_text(rows: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """``same_as``: the first row (by ``key``) with equal values of ``by``; null for that row itself.

    First rows are partial minima, joined back; a value that very many rows share is a skewed key of a plain join, which
    Spark splits, and no task holds its rows as a group.
    """
    firsts = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min(key).alias("first_id"))
    joined = rows.join(firsts, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)))
    return joined.select(*rows.columns, F.when(F.col("first_id") != F.col(key), F.col("first_id")).alias("same_as"))


def get_definitions(targets: DataFrame, symbols: DataFrame, calls: DataFrame | None = None, first: int = 3) -> DataFrame:
    """Everything that a target names, by id if it is one, else by name; a target that is nothing gives
    NOT_FOUND, and one that is no path inside the tree gives BAD_TARGET. With ``calls`` (token, path, line) the
    first call sites and how many more there are. ``targets``: target_id, target; ``symbols``: id, name, ..."""
    unsafe = F.col("target").rlike(r"(^/)|(^[A-Za-z]:[\\/])|(^|/)\.\.(/|$)")
    asked = targets.withColumn("bad", unsafe)
    by_id = asked.where("not bad").join(symbols, F.col("target") == F.col("id").cast("string")).withColumn("found_by", F.lit("id"))
    by_name = asked.where("not bad").join(by_id.select("target_id").distinct(), "target_id", "left_anti").join(symbols, F.lower("target") == F.lower("name")).withColumn("found_by", F.lit("name"))
    hits = by_id.unionByName(by_name)
    found = targets.join(hits.drop("target", "bad"), "target_id", "left").join(asked.select("target_id", "bad").distinct(), "target_id")
    found = found.withColumn("state", F.when(F.col("bad"), "BAD_TARGET").when(F.col("found_by").isNull(), "NOT_FOUND").otherwise("FOUND")).drop("bad")
    if calls is None:
        return found
    order = Window.partitionBy("token").orderBy("path", "line")
    tops = calls.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("n", "path", "line"))).alias("calls"))
    counts = calls.groupBy("token").agg(F.count("*").alias("n_calls"))
    both = tops.join(counts, "token").select(F.col("token"), F.transform("calls", lambda c: F.concat_ws(":", c["path"].cast("string"), c["line"].cast("string"))).alias("calls"), F.greatest(F.col("n_calls") - first, F.lit(0)).alias("calls_more"))
    return found.join(both, F.lower("name") == F.col("token"), "left").drop("token")


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """A text on one line, cut with an ellipsis where it is longer."""
    line = F.trim(text)
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


def wants_display_names(query: Column) -> Column:
    """Whether a query has other than ASCII characters, so that display names are asked for."""
    return query.rlike(r"[^\x00-\x7F]")


def completion_counts(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """How many names hold every token of a query that any name holds; 1 where none is held.

    Equal sets of tokens are counted once. A set of one token is counted by the token's names, a larger one among the names of its
    two rarest tokens, which are looked up as a pair: no query meets all names of a frequent token.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens_of("query"))).alias("token"))
    counts = postings.groupBy("token").agg(F.count("*").alias("df"))
    known = asked.join(counts, "token")
    held = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t")).select("query_id", F.col("t.token").alias("wanted"), F.col("t")[0]["df"].alias("df"))  # tokens of a query
    several = held.where("size(wanted) > 1").select("wanted").distinct().withColumn("pair", F.concat_ws("_", F.array_sort(F.slice("wanted", 1, 2))))
    # Only tokens of such pairs are paired in names.
    tokens = several.select(F.explode(F.slice("wanted", 1, 2)).alias("token")).distinct()
    whole = postings.join(tokens, "token", "left_semi").groupBy("name").agg(F.array_sort(F.collect_list("token")).alias("own")).where("size(own) > 1")  # tokens of a name
    pairs = F.flatten(F.transform("own", lambda t, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda u: F.concat_ws("_", t, u))))
    met = whole.select("name", F.explode(pairs).alias("pair")).join(several, "pair")
    full = met.where(F.size(F.array_except("wanted", F.array_distinct(tokens_of()))) == 0).groupBy("wanted").agg(F.count("*").alias("n"))
    counted = queries.select("query_id").join(held, "query_id", "left").join(full, "wanted", "left")
    completions = F.when(F.col("wanted").isNull(), 1).when(F.size("wanted") == 1, F.col("df")).otherwise(F.coalesce("n", F.lit(0)))
    return counted.select("query_id", completions.cast("bigint").alias("completions"))


def economic_parts(names: DataFrame, categories: DataFrame, resources: DataFrame) -> DataFrame:
    """Economic names taken apart: category and resource, and whether both exist. A prefix that is a category
    as a whole has no resource; else its last word is the resource."""
    part = lambda i: F.regexp_extract("name", ECONOMIC, i)
    parts = names.where(F.col("name").rlike(ECONOMIC)).select("name", part(1).alias("prefix"), F.lower(part(2)).alias("category_type"), F.lower(part(3)).alias("modifier_type"))
    cats = categories.select(F.lower("category").alias("c")).distinct()
    whole = cats.select(F.col("c").alias("whole"))
    rest, last = F.regexp_extract("prefix", "^(.*)_[^_]*$", 1), F.regexp_extract("prefix", "([^_]*)$", 1)
    joined = parts.join(whole, F.lower("prefix") == F.col("whole"), "left")
    joined = joined.withColumn("category", F.when(F.col("whole").isNotNull(), F.col("prefix")).otherwise(rest)).withColumn("resource", F.when(F.col("whole").isNull(), last))
    joined = joined.join(cats, F.lower("category") == F.col("c"), "left").join(resources.select(F.lower("resource").alias("r")).distinct(), F.lower("resource") == F.col("r"), "left")
    state = F.when(F.col("c").isNotNull() & (F.col("resource").isNull() | F.col("r").isNotNull()), "CONFIRMED").otherwise("NOT_FOUND")
    return joined.select("name", "category", "resource", "category_type", "modifier_type", state.alias("state"))


def loose_key(name: Column) -> Column:
    """A category's name as people write it: any case, spaces or underscores, with or without a final s."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit("_"), F.lit(" ")), "s$", "")


def category_scopes(modifiers: DataFrame, categories: DataFrame, default: str = "economic_unit") -> DataFrame:
    """(name, scopes, unresolved): scopes of the categories of each modifier, in order, each once. A category is
    met by its name, else loosely; one met by nothing is unresolved; without any the default counts.
    ``modifiers``: name, categories (array); ``categories``: category, scopes (array)."""
    each = modifiers.select("name", F.posexplode(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit(default)))).alias("at", "wanted"))
    exact = categories.select(F.lower("category").alias("exact_key"), F.col("scopes").alias("exact_scopes"))
    loose = categories.groupBy(loose_key(F.col("category")).alias("loose_key")).agg(F.min_by("scopes", "category").alias("loose_scopes"))
    joined = each.join(exact, F.lower("wanted") == F.col("exact_key"), "left").join(loose, loose_key(F.col("wanted")) == F.col("loose_key"), "left")
    joined = joined.withColumn("scopes", F.coalesce("exact_scopes", "loose_scopes"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "scopes", "wanted")))  # the categories of one modifier
    grouped = joined.groupBy("name").agg(ordered.alias("l"))
    return grouped.select("name", F.array_distinct(F.flatten(F.transform(F.filter("l", lambda x: x["scopes"].isNotNull()), lambda x: x["scopes"]))).alias("scopes"), F.transform(F.filter("l", lambda x: x["scopes"].isNull()), lambda x: x["wanted"]).alias("unresolved"))


def describe_sources(files: DataFrame, definitions: DataFrame, errors: DataFrame) -> DataFrame:
    """A row for each source: files, bytes, definitions, types and errors."""
    a = files.groupBy("source").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text")).alias("bytes"))
    b = definitions.groupBy("source").agg(F.count("*").alias("n_definitions"), F.count_distinct("type").alias("n_types"))
    c = errors.groupBy("source").agg(F.count("*").alias("n_errors"))
    return a.join(b, "source", "left").join(c, "source", "left").na.fill(0)


def legend(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEGEND), "status string, meaning string")


def node_items(node_rows: DataFrame, doc: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, node_id, ``keep``, items): keys of a block's children in order, else the value, else the key.

    A node is a row of its own and one of its parent's, so nodes are read once and meet in one grouping.
    """
    good = node_rows.where("error is null")
    value = F.coalesce(F.when(F.col("value") != "", F.col("value")), F.col("key"))
    own = F.struct(F.col("node_id").alias("at"), F.struct("is_block", value.alias("value"), *keep).alias("self"), F.lit(None).cast("struct<ordinal:int,key:string>").alias("child"))
    inner = F.struct(F.col("parent_id").alias("at"), F.lit(None).cast(good.select(own.alias("o")).schema["o"].dataType["self"].dataType).alias("self"), F.struct("ordinal", "key").alias("child"))
    both = good.select(doc, F.inline(F.filter(F.array(own, inner), lambda x: x["at"].isNotNull())))
    one = both.groupBy(doc, F.col("at").alias("node_id")).agg(F.max("self").alias("self"), F.array_sort(F.collect_list("child")).alias("children"))  # the children of one block
    return one.select(doc, "node_id", *(F.col(f"self.{c}").alias(c) for c in keep), F.when(F.col("self.is_block"), F.col("children.key")).otherwise(F.array("self.value")).alias("items"))


def first_fields(node_rows: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """(doc, node_id, value) of the first child of that key in each block that has one."""
    picked = node_rows.where((F.col("key") == key) & F.col("parent_id").isNotNull()).groupBy(doc, F.col("parent_id").alias("node_id")).agg(F.min_by("value", "ordinal").alias("value"))
    return picked


def is_safe_query(query: str, limit: int) -> None:
    """Raise for arguments that no search takes."""
    if not isinstance(query, str) or not 1 <= len(query.strip()) <= QUERY_CHARS:
        raise ValueError(f"query has 1 to {QUERY_CHARS} characters")
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit is 1 to {MOST_ROWS}")


def version_numbers(text: Column) -> Column:
    """The first version in a text, as in v4.6 or 4.6.1."""
    return F.regexp_extract(text, r"v?(\d+\.\d+(?:\.\d+)?)", 1)


def game_version(readings: DataFrame, noise: str = r"(?i)engine|driver|directx|opengl") -> DataFrame:
    """(source, version, read_from): the version of each source from the first of its readings that has one.

    ``readings``: source, priority, kind (marker, launcher, log), line, text. Of a log only the first 80 lines count,
    and none that speaks of something else's version.
    """
    usable = readings.where((F.col("kind") != "log") | ((F.col("line") <= 80) & ~F.col("text").rlike(noise))).withColumn("version", version_numbers(F.col("text"))).where("version <> ''")
    return usable.groupBy("source").agg(F.min_by(F.struct("version", "kind"), F.struct("priority", "line")).alias("r")).select("source", "r.version", F.col("r.kind").alias("read_from"))


def version_check(supported: Column, actual: Column) -> Column:
    """Whether two versions agree in major and minor number; a star stands for any; unknown without either."""
    part = lambda c, i: F.try_element_at(F.split(c, r"\."), F.lit(i))
    agrees = lambda i: (part(supported, i) == "*") | (part(supported, i) == part(actual, i))
    return F.when(supported.isNull() | actual.isNull() | (part(supported, 2).isNull() & (part(supported, 1) != "*")), "unknown").when(agrees(1) & F.coalesce(agrees(2), F.lit(True)), "match").otherwise("mismatch")


def template_source(category: str) -> list[str]:
    """Names that a category generates, as templates: with a resource, and without one."""
    kinds = re.findall(r"\(([a-z|]+)\)", ECONOMIC)
    return [f"{category}_{middle}{a}_{b}" for a in kinds[0].split("|") for b in kinds[1].split("|") for middle in (("<resource>_", "") if b == "mult" else ("<resource>_",))]
