"""A case for each code of the validator, and the questions that data answers."""

import pytest

from cairn.operators import validate
from cairn.operators.rulebook import RuleBook

RULES = """
types = { type[thing] = { path = "common/things" } ## type_key_filter = special
 type[file_thing] = { path = "common/x" } type[person] = { path = "common/people" } }
enums = { enum[color] = { red green } enum[open] = { <person> x } }
scopes = { Planet = { aliases = { planet world } is_subscope_of = { galaxy } } Galaxy = { aliases = { galaxy } } Fleet = { aliases = { fleet } } }
links = { owner = { input_scopes = { planet } output_scope = fleet } solo = { input_scopes = { fleet } output_scope = planet } }
modifiers = { pop_growth = { pops } lonely = { nowhere } <person>_cost = { pops } }
modifier_categories = { pops = { supported_scopes = { planet } } }
alias[modifier:<modifier>] = float
## scopes = { planet }
alias[trigger:has_water] = bool
## scopes = { galaxy }
alias[trigger:in_galaxy] = bool
alias[trigger:any_thing] = { alias_name[trigger] = alias_match_left[trigger] }
alias[trigger:both] = bool
alias[effect:both] = bool
alias[effect:make_<person>] = bool
single_alias[trigger_clause] = { alias_name[trigger] = alias_match_left[trigger] }
single_alias[ring] = single_alias_right[ring]
extra = { borrowed = scalar }
looped = { a = single_alias_right[ring] }
thing = {
    ## cardinality = 1..1
    size = int[1..5]
    ## cardinality = 0..1
    label = localisation
    owner = <person>
    lord = <person>
    lord = <person.king>
    hue = enum[color]
    maybe = enum[open]
    ratio == float
    inner = thing
    two = { a = int }
    two = { b = int }
    ## cardinality_max_define = X
    limited = int
    ## push_scope = fleet
    crew = { alias_name[trigger] = alias_match_left[trigger] }
    ## replace_scopes = { this = planet root = fleet }
    ground = { alias_name[trigger] = alias_match_left[trigger] }
    trigger = single_alias_right[trigger_clause]
    mixed = { alias_name[trigger] = alias_match_left[trigger] alias_name[effect] = alias_match_left[effect] }
    broken = single_alias_right[nothing]
    loop = single_alias_right[ring]
    ## inject = extra.cwt@extra/*
    open_block = { }
    ## inject = extra.cwt@gone/*
    torn_block = { }
    keyed = { enum[color] = int <person> = scalar x_<person>_y = int }
    list = { int }
    subtype[rich] = { gold = int }
}
"""
THING = "thing = {{ size = 3 {0} }}"


@pytest.fixture(scope="module")
def book():
    return RuleBook({"rules.cwt": RULES.replace("extra = { borrowed = scalar }", ""), "extra.cwt": "extra = { borrowed = scalar }"})


@pytest.fixture(scope="module")
def data(spark):
    definitions = spark.createDataFrame([("person", "bob"), ("person", "bobby"), ("scripted_trigger", "my_trigger"), ("scripted_effect", "my_effect")], "type string, name string")
    generated = spark.createDataFrame([("energy_cost_mult", ["planet"])], "name string, supported_scopes array<string>")
    return definitions, generated


CASES = [
    ("size", "size = 3", "CWT_IDENTIFIER"), ("size", "size = 9", "VALUE_MISMATCH"), ("size", "size = { }", "SHAPE_MISMATCH"), ("what", "size = 3 what = 1", "UNKNOWN_SCHEMA_FIELD"), ("deep", "size = 3 what = { deep = 1 }", "UNRESOLVED_CONTEXT"),
    ("label", "size = 3 label = x", "VALUE_REFERENCE_UNRESOLVED"), ("owner", "size = 3 owner = bob", "OBJECT_REFERENCE"), ("owner", "size = 3 owner = bobb", "UNKNOWN_OBJECT_REFERENCE"), ("lord", "size = 3 lord = bob", "OBJECT_REFERENCE"),
    ("hue", "size = 3 hue = red", "CWT_IDENTIFIER"), ("hue", "size = 3 hue = blue", "VALUE_MISMATCH"), ("maybe", "size = 3 maybe = blue", "VALUE_REFERENCE_UNRESOLVED"), ("size", "size > 3", "OPERATOR_MISMATCH"), ("ratio", "size = 3 ratio > 0.5", "CWT_IDENTIFIER"),
    ("@v", "size = 3 @v = 1", "SCRIPT_VARIABLE"), ("two", "size = 3 two = { a = 1 }", "AMBIGUOUS_OVERLOAD"), ("limited", "size = 3 limited = 1", "UNSUPPORTED_CWT_CONSTRAINT"), ("label", "size = 3 label = x label = y", "CARDINALITY_MISMATCH"),
    ("has_water", "size = 3 ground = { has_water = yes }", "CWT_IDENTIFIER"), ("has_water", "size = 3 crew = { has_water = yes }", "SCOPE_MISMATCH"), ("owner", "size = 3 ground = { owner = { has_water = yes } }", "CWT_SCOPE_LINK"),
    ("has_water", "size = 3 ground = { owner = { has_water = yes } }", "SCOPE_MISMATCH"), ("in_galaxy", "size = 3 ground = { in_galaxy = yes }", "CWT_IDENTIFIER"), ("owner", "size = 3 crew = { owner = { } }", "SCOPE_MISMATCH"), ("prev", "size = 3 crew = { prev = { has_water = yes } }", "DYNAMIC_SCOPE"),
    ("has_water", "size = 3 crew = { prev = { has_water = yes } }", "SCOPE_CONTEXT_REQUIRED"), ("both", "size = 3 mixed = { both = yes }", "AMBIGUOUS_CONTEXT"), ("broken", "size = 3 broken = { x = 1 }", "UNSUPPORTED_BLOCK_RULE"), ("x", "size = 3 broken = { x = 1 }", "INCOMPLETE_SCHEMA"),
    ("loop", "size = 3 loop = { }", "CYCLIC_CWT_REFERENCE"), ("borrowed", "size = 3 open_block = { borrowed = 1 }", "CWT_IDENTIFIER"), ("torn_block", "size = 3 torn_block = { }", "UNRESOLVED_INJECTION"), ("gold", "size = 3 gold = 1", "CONDITIONAL_SCHEMA"),
    ("red", "size = 3 keyed = { red = 1 }", "CWT_IDENTIFIER"), ("bob", "size = 3 keyed = { bob = 1 }", "CWT_IDENTIFIER"), ("x_bob_y", "size = 3 keyed = { x_bob_y = 1 }", "CWT_IDENTIFIER"), ("my_trigger", "size = 3 crew = { my_trigger = { any = 1 } }", "DEFINED_IN_GAME_DATA"),
    ("no_trigger", "size = 3 crew = { no_trigger = yes }", "UNKNOWN_TRIGGER"),
]


def test_a_case_for_each_code(spark, book, data):
    scripts = spark.createDataFrame([(k, text) for k, (_, text, _) in enumerate(CASES)], "doc int, text string")
    found = {}
    for r in validate.validate(scripts, book, *data, schema="thing").collect():
        found.setdefault(r.doc, []).append(r)
    for k, (identifier, text, code) in enumerate(CASES):
        assert (identifier, code) in {(r.identifier, r.code) for r in found[k]}, (text, [(r.identifier, r.code) for r in found[k]])
    of = lambda text: found[[t for _, t, _ in CASES].index(text)]
    assert [r for r in of("size = 3 owner = bobb") if r.code == "UNKNOWN_OBJECT_REFERENCE"][0].suggestions == ["bobby", "bob"]
    assert {r.identifier for r in of("size = 3 owner = bob")} == {"size", "owner"} and len(of("size = 3 owner = bob")) == 2
    assert {r.identifier for r in of("size = 3 crew = { my_trigger = { any = 1 } }")} == {"size", "crew", "my_trigger"}  # what it holds is not checked
    assert [r.expected for r in of("size = 3 label = x label = y") if r.code == "CARDINALITY_MISMATCH"] == [["0..1"]]
    assert [r.status for r in of("size = 3 keyed = { bob = 1 }") if r.identifier == "bob"] == ["TEMPLATE_MATCH"]


CALLED = [
    ("pop_growth = 0.5", "modifier", "planet", [("CONFIRMED_CWT", "CWT_IDENTIFIER"), ("CONFIRMED_CWT", "CWT_IDENTIFIER")]), ("pop_growth = x", "modifier", "fleet", [("CONFIRMED_CWT", "CWT_IDENTIFIER"), ("UNKNOWN", "SCOPE_MISMATCH"), ("UNKNOWN", "VALUE_MISMATCH")]),
    ("lonely = 1", "modifier", "planet", [("CONFIRMED_CWT", "CWT_IDENTIFIER"), ("CONFIRMED_CWT", "CWT_IDENTIFIER"), ("UNRESOLVED", "UNRESOLVED_MODIFIER_CATEGORY")]), ("bob_cost = 1", "modifier", "planet", [("TEMPLATE_MATCH", "CWT_IDENTIFIER")] * 2),
    ("eve_cost = 1", "modifier", "planet", [("UNKNOWN", "UNKNOWN_MODIFIER")]), ("energy_cost_mult = 1", "modifier", "planet", [("CONFIRMED_GAME_DATA", "GENERATED_MODIFIER")]),
    ("energy_cost_mult = 1", "modifier", "fleet", [("CONFIRMED_GAME_DATA", "GENERATED_MODIFIER"), ("UNKNOWN", "SCOPE_MISMATCH")]), ("pop_grwth = 1", "modifier", "planet", [("UNKNOWN", "UNKNOWN_MODIFIER")]), ("<x>_y = 1", "trigger", "planet", [("UNRESOLVED", "CWT_METASYNTAX")]),
    ("both = yes", None, "planet", [("UNRESOLVED", "AMBIGUOUS_CONTEXT")]), ("has_water = yes", None, "world", [("CONFIRMED_CWT", "CWT_IDENTIFIER")]), ("has_water = yes", None, "nowhere", [("UNRESOLVED", "UNKNOWN_SCOPE_CONTEXT")]), ("has_water = yes", None, None, [("CONFIRMED_CWT", "CWT_IDENTIFIER"), ("UNRESOLVED", "SCOPE_CONTEXT_REQUIRED")]),
    ("my_effect = yes", None, "planet", [("CONFIRMED_GAME_DATA", "DEFINED_IN_GAME_DATA")]), ("nothing_at_all = { a = 1 }", None, "planet", [("UNKNOWN", "UNKNOWN_IDENTIFIER"), ("UNRESOLVED", "UNRESOLVED_CONTEXT")]), ("a = {", None, None, [("UNKNOWN", "SCRIPT_PARSE_ERROR")]),
    ("make_bob = yes", "effect", "planet", [("TEMPLATE_MATCH", "CWT_IDENTIFIER")]), ("", "effect", "planet", []), (None, None, None, []),
    ("has_water = yes", "trigger", "planet", [("CONFIRMED_CWT", "CWT_IDENTIFIER")]),
]


def test_names_that_are_called(spark, book, data):
    scripts = spark.createDataFrame([(i, text, kind, scope) for i, (text, kind, scope, _) in enumerate(CALLED)], "doc int, text string, kind string, scope string")
    found = {}
    for r in validate.validate(scripts, book, *data).collect():
        found.setdefault(r.doc, []).append(r)
    for i, (text, _, _, want) in enumerate(CALLED):
        assert sorted((r.status, r.code) for r in found.get(i, [])) == sorted(want), text
        if text == "pop_grwth = 1":
            assert found[i][0].suggestions == ["pop_growth"]


def test_files_and_depth(spark, book, data):
    deep = "size = 3 " + "inner = { size = 1 " * 90 + "}" * 90
    scripts = spark.createDataFrame([(1, "special = { size = 2 } other = { size = 2 } loose = 1"), (2, "x = 1")], "doc int, text string")
    frame = validate.validate(scripts, book, *data, schema="thing", mode="file")
    found = frame.collect()
    assert ("loose", "FILE_LEVEL_DIRECTIVE") in {(r.identifier, r.code) for r in found}
    nested = validate.validate(spark.createDataFrame([(3, deep)], "doc int, text string"), book, *data, schema="thing").collect()
    limit = [r for r in nested if r.code == "DEPTH_LIMIT"]
    assert len(limit) >= 1 and len(nested) >= 180 and {r.code for r in nested} <= {"CWT_IDENTIFIER", "DEPTH_LIMIT", "UNRESOLVED_CONTEXT"}
    assert sum(r.identifier == "inner" for r in nested) == 90  # no node goes without a finding
    missing = validate.validate(scripts, book, *data, schema="nothing").collect()
    assert {r.code for r in missing if r.doc == 2} == {"AMBIGUOUS_CONTEXT", "UNRESOLVED_CONTEXT"}
    folded = {r.doc: r for r in validate.overall(frame).collect()}
    assert folded[1].overall == "UNRESOLVED" and folded[1].n_findings == sum(r.doc == 1 for r in found)


def test_type_filters(book):
    assert [book.resolve_type(t)["status"] for t in ("all", "triggers", "rules", "rules.cwt", "person", "per", "nope")] == ["ALL", "KIND", "FILE", "FILE", "DYNAMIC_TYPE", "UNKNOWN_TYPE", "UNKNOWN_TYPE"]
    assert book.resolve_type("per")["candidates"] == ["person"]
    twice = RuleBook({"a/x.cwt": "s = { }", "b/x.cwt": "t = { }"})
    assert twice.resolve_type("x") == {"status": "AMBIGUOUS_TYPE", "candidates": ["a/x", "b/x"]}
    names = {(n, k) for n, k, *_ in book.public_names()}
    assert {("pop_growth", "modifier"), ("has_water", "trigger"), ("thing", "schema"), ("thing", "type")} <= names and not any(n == "size" for n, _ in names)
    assert book.scope_line("world") == {"planet", "galaxy"}


def test_a_task_has_no_more_scripts_as_their_number_grows(spark, monkeypatch):
    """Scripts are dealt out by rows and characters, not by cores alone; many short ones and few long ones alike."""
    from pyspark.sql import functions as F

    from cairn.sources import tables

    monkeypatch.setattr(tables, "PIECE", 100)
    most = lambda docs: docs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).agg(F.max("n"), F.max("c")).first()
    for n in (1_000, 8_000):
        short = spark.range(0, n, 1, 2).select(F.col("id").alias("doc"), F.lit("a = b").alias("text"))
        assert most(tables.spread(short, "text"))[0] <= 200
    long = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc"), F.repeat(F.lit("a = b "), 400).alias("text"))
    assert most(tables.spread(long, "text"))[1] <= 20 * 2_400
