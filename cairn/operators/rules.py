"""Templates, generated names, overrides, references, scopes, cardinality and value checks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.tables import stored

_PART = re.compile(r"<[^<>\s]+>|enum\[[^\[\]]+\]")
#: The longest capture, and the fewest fixed characters of a usable template.
LONGEST_CAPTURE, LEAST_FIXED = 128, 3


def template_rows(names: list[str]) -> list[tuple[str, str, list[str], int, str]]:
    """(template, anchored regex, placeholders, fixed characters, longest literal) of each name."""
    rows = []
    for name in names:
        literals, holes = _PART.split(name), _PART.findall(name)
        pattern = re.escape(literals[0])
        for literal in literals[1:]:
            pattern += f"(.{{1,{LONGEST_CAPTURE}}}?)" + re.escape(literal)
        fixed = sum(len(x) for x in literals)
        if holes and fixed >= LEAST_FIXED:
            rows.append((name, f"^{pattern}$", holes, fixed, max(literals, key=len)))
    return rows


def template_match(queries: DataFrame, names: list[str]) -> DataFrame:
    """Templates that a whole query fits, with its captures in order.

    Only queries that hold a template's longest literal are tried against its regex. The templates
    are a list given by the caller, so each is a constant pattern of its own branch.
    """
    rows = template_rows(names)
    query = F.lower("query")
    tests = [
        F.when(
            F.contains(query, F.lit(longest.lower())) & query.rlike(pattern.lower()),
            F.struct(F.lit(name).alias("template"), F.array(*(F.regexp_extract(query, pattern.lower(), i + 1) for i in range(len(holes)))).alias("captures"), F.array(*map(F.lit, holes)).alias("placeholders")),
        )
        for name, pattern, holes, _, longest in rows
    ]
    found = F.filter(F.array(*tests), lambda m: m.isNotNull())
    return queries.select("query_id", "query", F.explode(found).alias("m")).select("query_id", "query", "m.*")


def verified(captures: DataFrame, definitions: DataFrame) -> DataFrame:
    """CONFIRMED or NOT_FOUND for each (type, value); UNRESOLVED for a type nobody defines."""
    known = definitions.select(F.col("type").alias("type"), F.lower("name").alias("value_cf"), F.lit(1).alias("hit")).distinct()
    types = definitions.select("type", F.lit(1).alias("declared")).distinct()
    joined = captures.withColumn("value_cf", F.lower("value")).join(known, ["type", "value_cf"], "left").join(types, "type", "left")
    state = F.when(F.col("hit") == 1, "CONFIRMED").when(F.col("declared") == 1, "NOT_FOUND").otherwise("UNRESOLVED")
    return joined.select("type", "value", state.alias("state"))


#: Rows of declarations that are sent to every task; above that they are joined like any table.
DECLARATIONS = 100_000


def _small(declarations: DataFrame) -> DataFrame:
    """A hint to broadcast declarations, given only where they are counted and few."""
    return F.broadcast(declarations) if declarations.limit(DECLARATIONS + 1).count() <= DECLARATIONS else declarations


def generated_names(categories: DataFrame, resources: DataFrame, kinds: DataFrame) -> DataFrame:
    """category x (resources and none) x kinds that the category generates; without a resource only mult.

    The product is what is declared: each category has a name for each resource. The first of equal
    names wins.
    """
    some = resources.select("resource").unionByName(resources.sparkSession.createDataFrame([(None,)], "resource string"))
    pairs = categories.select("category", "ord", F.explode("generates").alias("generated")).join(kinds, F.col("generated") == F.col("kind"))
    rows = pairs.crossJoin(_small(some)).where("resource is not null or kind like '%mult'")
    name = F.concat_ws("_", "category", "resource", "kind")
    order = Window.partitionBy("name").orderBy("ord", "resource", "kind")
    named = rows.select(name.alias("name"), "category", "resource", "kind", "ord").withColumn("rank", F.row_number().over(order))
    return named.where("rank = 1").select("name", "category", "resource", "kind")


def economic_names(categories: DataFrame, resources: DataFrame) -> DataFrame:
    """(name, economic_category, resource, category, modifier_type, triggered): all names that economic categories
    give rise to, the first of equal names in the order of categories and resources.

    ``categories``: economic_category, ord, add and mult (arrays of enum categories), triggered (array of
    struct<key, category, modifier_types>): a triggered block has a fixed category and a key of its own. A name
    without a resource is there for mult only.
    """
    own = lambda column, kind: F.transform(column, lambda c: F.struct(F.col("economic_category").alias("key"), c.alias("category"), F.lit(kind).alias("modifier_type"), F.lit(False).alias("triggered")))
    blocks = F.flatten(F.transform("triggered", lambda t: F.transform(F.array_distinct(t["modifier_types"]), lambda m: F.struct(t["key"].alias("key"), t["category"].alias("category"), m.alias("modifier_type"), F.lit(True).alias("triggered")))))
    forms = categories.select("economic_category", "ord", F.posexplode(F.concat(own("add", "add"), own("mult", "mult"), blocks)).alias("at", "f")).select("economic_category", "ord", "at", "f.*").where("key is not null")
    some = resources.select("resource").distinct().unionByName(resources.sparkSession.createDataFrame([(None,)], "resource string"))
    rows = forms.crossJoin(_small(some)).where("resource is not null or modifier_type = 'mult'").withColumn("name", F.concat_ws("_", "key", "resource", "category", "modifier_type"))
    first = F.min_by(F.struct("economic_category", "resource", "category", "modifier_type", "triggered"), F.struct("ord", F.col("resource").isNull(), "resource", "at"))
    return rows.groupBy("name").agg(first.alias("r")).select("name", "r.*")


def overridden(definitions: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """The last (or first) definition of each key in source order; partial aggregation, no sort."""
    rest = [c for c in definitions.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return definitions.groupBy(*keys).agg(pick.alias("d"), F.count("*").alias("n_definitions")).select(*keys, "d.*", "n_definitions")


def ordered_union(rows: DataFrame, key: str, ord_col: str, list_col: str) -> DataFrame:
    """The lists of each key one after the other by order, each value once, at its first place."""
    gathered = F.array_sort(F.collect_list(F.struct(ord_col, list_col)))
    return rows.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(gathered, lambda x: x[list_col]))).alias("items"))


def reachable(edges: DataFrame) -> DataFrame:
    """Every (node, ancestor, depth) over parent links, ``depth`` the shortest way, by doubling.

    A shortest way of more than n and at most 2 n steps begins with one of n, so each round joins the pairs
    that are exactly n apart with all that are known and keeps those never met, with their least sum. A pair is found once however
    many ways there are, cycles end by themselves, and rounds grow with the logarithm of the longest
    shortest way. Each round's pairs are written and read back, so plans stay short. A node on a cycle is its own ancestor.
    """
    links = edges.select("node", F.col("parent").alias("ancestor")).where("node is not null and parent is not null").distinct()
    rounds, far = [stored(links.withColumn("depth", F.lit(1).cast("bigint")), "reachable-1")], 1
    while True:
        met = reduce(DataFrame.unionByName, rounds)
        ends = rounds[-1].where(F.col("depth") == far).select("node", F.col("ancestor").alias("middle"))
        goes_on = met.select(F.col("node").alias("middle"), "ancestor", "depth")
        longer = ends.join(goes_on, "middle").groupBy("node", "ancestor").agg((F.min("depth") + far).alias("depth"))
        new = stored(longer.join(met, ["node", "ancestor"], "left_anti"), f"reachable-{2 * far}")
        if new.isEmpty():
            return met
        rounds.append(new)
        far *= 2


def closure(edges: DataFrame) -> DataFrame:
    """The same without what leads from a node back to itself."""
    return reachable(edges).where("node <> ancestor")


def expanded(rules: DataFrame) -> DataFrame:
    """(root, rule, depth, cyclic) of all rules reachable over references: the shortest way, and whether the rule leads
    back to itself. ``rules``: rule, refers_to."""
    pairs = reachable(rules.select(F.col("rule").alias("node"), F.col("refers_to").alias("parent")))
    rings = pairs.where("node = ancestor").select(F.col("node").alias("rule"), F.lit(True).alias("rings"))
    return pairs.select(F.col("node").alias("root"), F.col("ancestor").alias("rule"), "depth").join(rings, "rule", "left").select("root", "rule", "depth", F.coalesce("rings", F.lit(False)).alias("cyclic"))


def walked(rules: DataFrame) -> DataFrame:
    """(root, rule, depth, cyclic): a row for each walk over references, which ends where a reference leads back to a rule on its
    way (cyclic). Each round makes the open walks one step longer, and is written and read back; ``expanded`` has a pair once."""
    steps = rules.where("rule is not null and refers_to is not null")
    start = steps.select(F.col("rule").alias("root"), F.col("refers_to").alias("rule"), F.array("rule", "refers_to").alias("trail"), (F.col("rule") == F.col("refers_to")).alias("cyclic"))
    rounds = [stored(start, "walks-1")]
    while True:
        goes_on = rounds[-1].where("not cyclic").withColumnRenamed("rule", "at").join(steps.withColumnRenamed("rule", "at"), "at")
        longer = goes_on.select("root", F.col("refers_to").alias("rule"), F.array_append("trail", F.col("refers_to")).alias("trail"), F.array_contains("trail", F.col("refers_to")).alias("cyclic"))
        new = stored(longer, f"walks-{len(rounds) + 1}")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, rounds).select("root", "rule", (F.size("trail") - 1).cast("bigint").alias("depth"), "cyclic")
        rounds.append(new)


def cardinality(parents: DataFrame, children: DataFrame, rules: DataFrame) -> DataFrame:
    """Parents whose number of children breaks lo..hi of a rule; a parent without any counts as 0.

    Counts meet rules by a join on the key. A parent's missing keys are those of the rules that ask for one at least (one
    array for all) less the keys that it has, so the plan does not grow with the rules.
    """
    rules = rules.select("key", "lo", "hi").distinct()
    own = parents.select("parent").where("parent is not null").distinct()
    counts = children.groupBy("parent", "key").agg(F.count("*").alias("n")).join(_small(rules), "key").join(own, "parent", "left_semi")
    wrong = counts.where((F.col("n") < F.col("lo")) | (F.col("n") > F.col("hi"))).select("parent", "key", "n")
    asking = rules.where("lo > 0").agg(F.collect_set("key").alias("wanted"))  # one row of declared keys
    have = counts.where("lo > 0").groupBy("parent").agg(F.collect_set("key").alias("have"))  # keys of rules
    lacking = own.join(have, "parent", "left").crossJoin(F.broadcast(asking)).select("parent", F.explode(F.array_except("wanted", F.coalesce("have", F.array().cast("array<string>")))).alias("key"))
    none = lacking.select("parent", "key", F.lit(0).cast("bigint").alias("n"))
    return wrong.unionByName(none).withColumn("code", F.lit("CARDINALITY_MISMATCH"))


def parse_range(rule: str) -> tuple[float, float, bool, bool] | None:
    """``int[a..b)`` as (low, high, low is open, high is open); inf is allowed."""
    found = re.fullmatch(r"(?:int|float)([\[(])\s*(-?[\d.]+|-?inf)\s*\.\.\s*(-?[\d.]+|-?inf)\s*([\])])", rule)
    return (float(found[2]), float(found[3]), found[1] == "(", found[4] == ")") if found else None


def in_range(value: Column, rule: str) -> Column:
    """yes, no, or unknown where the value is no number: three states, never null."""
    bounds = parse_range(rule)
    if bounds is None:
        raise ValueError(f"not a range: {rule!r}")
    low, high, open_low, open_high = bounds
    number = value.try_cast("double")
    above = number > low if open_low else number >= low
    below = number < high if open_high else number <= high
    return F.when(number.isNull(), "unknown").when(above & below, "yes").otherwise("no")


def scalar_type(value: Column) -> Column:
    """bool, int, float, string or unknown (empty) of a text."""
    return (
        F.when(value.isNull() | (F.trim(value) == ""), "unknown").when(F.lower(value).isin("yes", "no", "true", "false"), "bool")
        .when(value.rlike(r"^-?\d+$"), "int").when(value.rlike(r"^-?\d+\.\d+$"), "float").otherwise("string")
    )
