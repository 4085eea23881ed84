"""Closures over graphs with very many ways, long ways and rings; cardinality by join; suggestions that lose nothing."""

import difflib
import random

import pytest

from cairn.operators import rules
from cairn.operators.validate import close_names, validate
from cairn.operators.rulebook import RuleBook


def brute(edges):
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    out = {}
    for start in up:
        seen, wave, depth = {}, {start}, 0
        while wave:
            depth += 1
            wave = {p for n in wave for p in up.get(n, ()) if p not in seen}
            seen.update(dict.fromkeys(wave, depth))
        out |= {(start, p): d for p, d in seen.items()}
    return out


def shown(frame):
    rows = [(r["node"], r["ancestor"], r["depth"]) for r in frame.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2] for r in rows}


def graph(spark, edges):
    return spark.createDataFrame(edges, "node string, parent string")


def layers(n):
    return [(f"{i}{a}", f"{i + 1}{b}") for i in range(n) for a in "xy" for b in "xy"]


@pytest.mark.parametrize("edges", [layers(18), [("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "b"), (None, "a"), ("a", None)]], ids=["diamonds", "loop", "ring"])
def test_reachable(spark, edges):
    assert shown(rules.reachable(graph(spark, edges))) == brute(edges)


def test_random_graphs_and_long_chains(spark):
    rng = random.Random(3)
    edges = [(str(rng.randint(0, 30)), str(rng.randint(0, 30))) for _ in range(60)]
    assert shown(rules.reachable(graph(spark, edges))) == brute(edges)
    chain = rules.reachable(graph(spark, [(str(i), str(i + 1)) for i in range(1000)]))
    assert chain.count() == 1000 * 1001 // 2 and chain.where("depth = cast(ancestor as int) - cast(node as int)").count() == 1000 * 1001 // 2
    assert rules.closure(graph(spark, [])).count() == 0


def test_expansion_marks_rules_that_lead_back(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("r", "c")], "rule string, refers_to string")
    found = {(r["root"], r["rule"]): (r["depth"], r["cyclic"]) for r in rules.expanded(edges).collect()}
    assert found == {("r", "a"): (1, True), ("r", "b"): (2, True), ("r", "c"): (1, False), ("a", "b"): (1, True), ("a", "a"): (2, True), ("b", "a"): (1, True), ("b", "b"): (2, True)}


def test_cardinality_of_many_rules(spark):
    """3,000 rules are a table, not a plan; two rules of one key both count."""
    declared = [(f"k{i}", 1 if i < 3 else 0, 2) for i in range(3000)] + [("k0", 0, 1)]
    children = [(1, "k0"), (1, "k0"), (1, "k1"), (2, "k5"), (2, "k5"), (2, "k5"), (9, "k0"), (None, "k0"), (1, "other")]
    got = rules.cardinality(spark.createDataFrame([(1,), (2,), (1,), (None,)], "parent int"), spark.createDataFrame(children, "parent int, key string"), spark.createDataFrame(declared, "key string, lo int, hi int"))
    assert sorted((r["parent"], r["key"], r["n"]) for r in got.collect()) == [(1, "k0", 2), (1, "k2", 0), (2, "k0", 0), (2, "k1", 0), (2, "k2", 0), (2, "k5", 3)]
    assert rules.cardinality(spark.createDataFrame([(1,)], "parent int"), spark.createDataFrame([], "parent int, key string"), spark.createDataFrame([], "key string, lo int, hi int")).count() == 0


def test_no_close_name_is_lost(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcde_é") for _ in range(n))
    names = {word(rng.randint(1, 14)) for _ in range(120)} | {"farmerland_two", "x" * 40, "aab", ""}
    asked = {word(rng.randint(1, 14)) for _ in range(40)} | {"cfarmerland_two", "dfarmerland_owt", "xx", "baa", ""}
    pair = lambda rows: spark.createDataFrame([("p", r) for r in sorted(rows)], "pool string, value string")
    got = {(r["value"], r["name"]): r["score"] for r in close_names(pair(asked), pair(names).withColumnRenamed("value", "name")).collect()}
    ratio = lambda name, value: difflib.SequenceMatcher(None, name, value).ratio()
    assert got == {(v, n): ratio(n, v) for v in asked for n in names if v and n and ratio(n, v) >= 0.55}
    assert ("dfarmerland_owt", "farmerland_two") in got


def test_suggestions_are_those_of_difflib(spark):
    names = ["farmerland_two", "farmer", "land_farmer", "two_farm", "arm", "owt", "farmerland_one", "farmerland_six", "farmerland_ten", "farmerland_red"]
    data = spark.createDataFrame([("place", n) for n in names] + [("king", "farmerland_owt")], "type string, name string")
    scripts = spark.createDataFrame([(1, "at = dfarmerland_owt"), (2, "at = farmer"), (3, "ta = x"), (4, "sizes = 1"), (5, "at = arm sizes = 1")], "doc int, text string")
    found = {(r["doc"], r["identifier"]): r for r in validate(scripts, RuleBook({"r.cwt": "thing = { at = <place> size = int seize = int }"}), data, schema="thing").collect()}
    assert found[1, "at"]["suggestions"] == difflib.get_close_matches("dfarmerland_owt", names, 5, 0.55) and found[2, "at"]["code"] == "OBJECT_REFERENCE"
    assert found[4, "sizes"]["suggestions"] == difflib.get_close_matches("sizes", ["at", "size", "seize"], 5, 0.55) and found[3, "ta"]["suggestions"] is None or found[3, "ta"]["suggestions"] == ["at"]


ENUMS = """
enums = { complex_enum[port] = { path = "game/x" name = { enum_name = { } } } complex_enum[berth] = { path = "game/y" name = { enum_name = { } } } enum[port] = { fixed } }
scopes = { Planet = { aliases = { planet } } Fleet = { aliases = { fleet } } }
ship = {
    slot = complex_enum[port]
    both = enum[port]
    berth = enum[berth]
    either = enum[berth]
    either = complex_enum[port]
    mixed = <person>
    mixed = complex_enum[port]
    ## scopes = { planet }
    held = complex_enum[port]
    ## scopes = { planet }
    lord = <person>
}
"""
ASKED = [
    ("slot = dock", [("CONFIRMED_CWT", "CWT_IDENTIFIER")]), ("slot = DOCK", [("CONFIRMED_CWT", "CWT_IDENTIFIER")]), ("slot = none", [("UNKNOWN", "VALUE_MISMATCH")]), ("both = fixed", [("CONFIRMED_CWT", "CWT_IDENTIFIER")]),
    ("berth = x", [("CONFIRMED_CWT", "CWT_IDENTIFIER"), ("UNRESOLVED", "VALUE_REFERENCE_UNRESOLVED")]), ("either = dock", [("CONFIRMED_CWT", "CWT_IDENTIFIER")]), ("either = none", [("CONFIRMED_CWT", "CWT_IDENTIFIER"), ("UNRESOLVED", "VALUE_REFERENCE_UNRESOLVED")]),
    ("mixed = dock", [("CONFIRMED_CWT", "CWT_IDENTIFIER")]), ("mixed = bob", [("CONFIRMED_GAME_DATA", "OBJECT_REFERENCE")]), ("mixed = none", [("UNKNOWN", "UNKNOWN_OBJECT_REFERENCE")]),
    ("held = dock", [("CONFIRMED_CWT", "CWT_IDENTIFIER"), ("UNKNOWN", "SCOPE_MISMATCH")]), ("held = none", [("UNKNOWN", "VALUE_MISMATCH")]), ("lord = bob", [("CONFIRMED_GAME_DATA", "OBJECT_REFERENCE"), ("UNKNOWN", "SCOPE_MISMATCH")]), ("lord = eve", [("UNKNOWN", "UNKNOWN_OBJECT_REFERENCE")]),
]


def test_harvested_enums_answer_values(spark):
    scripts = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(ASKED)], "doc int, text string")
    people, members = spark.createDataFrame([("person", "bob")], "type string, name string"), spark.createDataFrame([("port", "dock")], "enum string, value string")
    found = {}
    for r in validate(scripts, RuleBook({"e.cwt": ENUMS}), people, members=members, schema="ship", scope="fleet").collect():
        found.setdefault(r["doc"], []).append((r["status"], r["code"]))
    for i, (text, want) in enumerate(ASKED):
        assert sorted(found[i]) == sorted(want), text
    unread = validate(scripts, RuleBook({"e.cwt": ENUMS}), people, schema="ship", scope="fleet").where("doc = 0").collect()
    assert sorted(r["code"] for r in unread) == ["CWT_IDENTIFIER", "VALUE_REFERENCE_UNRESOLVED"]


def test_a_long_script_says_so(spark):
    scripts = spark.createDataFrame([(1, "a = 1 " * 400_000)], "doc int, text string")
    none = spark.createDataFrame([], "type string, name string")
    assert [r["code"] for r in validate(scripts, RuleBook({"e.cwt": ENUMS}), none, schema="ship").collect()] == ["SCRIPT_TOO_LONG"]


def test_openings_follow_each_reference_once():
    shared = "".join(f"single_alias[l{i}] = {{ f{i} = int }}\n" for i in range(3))
    text = shared + "a = { x = int }\nb = { inner = { y = int } }\n## inject = r.cwt@b/inner/*\n## inject = r.cwt@a/*\nroot = { z = int subtype[s] = { w = int } }"
    book = RuleBook({"r.cwt": text})
    fields, trouble = book.openings.of(book.schemas["root"])
    assert [(r.key, c) for r, c in fields] == [("z", False), ("w", True), ("y", False), ("x", False)] or {(r.key, c) for r, c in fields} == {("z", False), ("w", True), ("y", False), ("x", False)}
    assert not trouble
    ring = RuleBook({"r.cwt": "single_alias[p] = single_alias_right[q]\nsingle_alias[q] = single_alias_right[p]\nthing = { a = single_alias_right[p] }"})
    opened = ring.openings.of([ring.schemas["thing"][0].children[0]])
    assert opened[0] == () and [code for code, _ in opened[1]] == ["CYCLIC_CWT_REFERENCE"]


def test_walks_are_all_kept(spark):
    """Two ways between two rules are two walks, and a walk ends where it comes back to a rule on its way."""
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "b"), ("e", "e"), ("f", None), (None, "a")]
    want, open_ = [], [[a, b] for a, b in edges if a is not None and b is not None]
    while open_:
        trail = open_.pop()
        cyclic = trail[-1] in trail[:-1]
        want.append((trail[0], trail[-1], len(trail) - 1, cyclic))
        if not cyclic:
            open_ += [[*trail, b] for a, b in edges if a == trail[-1] and b is not None]
    found = rules.walked(spark.createDataFrame(edges, "rule string, refers_to string"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
