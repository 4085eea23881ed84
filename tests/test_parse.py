import pytest

from cairn.operators import harvest, parse, rulebook, rules, textsearch
from cairn.sources import tables
from pyspark.sql import functions as F

SOURCE = """# head
## scope = planet
## cardinality = 0..1
alpha = { beta = "two words" gamma? = { 1 2 3 } <ref.sub>_x >= 5 }\r
\tenum[kind] ?= int[1..5]
{ loose }
"""


def test_tokens_join_to_the_source():
    assert "".join(t[1] for t in parse.lex(SOURCE)) == SOURCE
    assert [t[0] for t in parse.lex("a?=b")] == ["atom", "operator", "atom"]


def test_nodes():
    rows = parse.parse(SOURCE)
    assert [(r["key"], r["op"], r["value"], r["depth"]) for r in rows] == [
        ("alpha", "=", None, 0), ("beta", "=", "two words", 1), ("gamma?", "=", None, 1), ("1", None, None, 2), ("2", None, None, 2), ("3", None, None, 2),
        ("<ref.sub>_x", ">=", "5", 1), ("enum[kind]", "?=", "int[1..5]", 0), ("", None, None, 0), ("loose", None, None, 1),
    ]
    assert rows[0]["line"] == 4 and rows[0]["end_line"] == 4
    assert [(a["key"], a["values"]) for a in parse.annotations(SOURCE, rows)] == [("scope", ["planet"]), ("cardinality", ["0..1"])]


@pytest.mark.parametrize("text", ['a = "open', "}", "a = {", "a =! b", "a = [x", "= b", "a ="])
def test_errors_become_rows(spark, text):
    rows = parse.nodes(spark.createDataFrame([("x", text), ("y", "k = v")], "doc string, text string")).collect()
    bad, good = [r for r in rows if r.error], [r for r in rows if not r.error]
    assert [r.doc for r in bad] == ["x"] and [(r.doc, r.key, r.value) for r in good] == [("y", "k", "v")]


def test_round_trip_and_islands(spark):
    docs = spark.createDataFrame([("a", SOURCE), ("b", "x = 1\ny = 2\n\nz = 3"), ("c", None)], "doc string, text string")
    assert all(r.lossless for r in parse.round_trip(parse.tokens(docs), docs).collect())
    islands = parse.source_islands(parse.nodes(docs.where("doc = 'b'")), docs).collect()
    assert sorted(r.n_nodes for r in islands) == [1, 2]


TYPES = """types = {
    type[job] = { path = "game/common/jobs" name_field = name }
    ## type_key_filter = planet
    type[world] = { path = "common/worlds" path_extension = .gfx skip_root_key = list subtype[rich] = { gold = yes } subtype[deep] = { size = big inner = { x = 1 } } subtype[never] = { gold = no } }
    ## type_key_filter <> { hidden }
    ## starts_with = a_
    type[unit] = { path = "common/units" path_file = main type_key_prefix = A_ }
    type[page] = { path = "common/pages" name_from_file = yes type_per_file = yes }
    type[slot] = { path = "common/slots" name_field = - }
}
enums = { complex_enum[section] = { path = "game/common/jobs" name = { parts = { enum_name = { } } } } }
"""


@pytest.fixture(scope="module")
def harvested(spark):
    files = [
        ("game", 0, "common/jobs/a.txt", "job_a = { name = miner parts = { Left = { } right = { } } }\njob_b = { name = x name = y }\nnameless = { }\nscalar = 1"), ("mod", 1, "common/jobs/a.txt", "job_b = { name = X }"),
        ("game", 0, "common/jobs/deep/b.txt", "job_c = { name = deep }"), ("game", 0, "common/jobs/broken.txt", "{"), ("game", 0, "common/jobs/c.yml", "job_d = { name = yml }"),
        ("game", 0, "common/worlds/w.gfx", "list = { planet = { gold = 1 } planet = { size = Big inner = { x = 1 } } moon = { } } planet = { size = big inner = { y = 1 } }"),
        ("game", 0, "common/units/main.txt", "a_one = { } A_two = { } hidden = { } b_three = { }"), ("game", 0, "common/units/other.txt", "a_four = { }"),
        ("game", 0, "common/pages/p_1.txt", "x = 1"), ("game", 0, "common/slots/s.txt", "k = { }"),
    ]
    scripts = spark.createDataFrame(files, "source string, priority int, rel_path string, text string")
    book = rulebook.RuleBook({"types.cwt": TYPES})
    declared = harvest.directory_rules(spark, book)
    return harvest.parsed_files(scripts, declared), declared, book


def test_definitions_follow_directory_rules(spark, harvested):
    files, declared, book = harvested
    found = harvest.definitions_of(files, declared, harvest.subtype_rules(spark, book))
    assert sorted((r.type, r.name, r.source, ",".join(r.subtypes)) for r in found.collect()) == [
        ("job", "X", "mod", ""), ("job", "miner", "game", ""), ("job", "x", "game", ""), ("page", "p_1", "game", ""), ("unit", "A_two", "game", ""), ("unit", "a_one", "game", ""),
        ("world", "planet", "game", ""), ("world", "planet", "game", "deep"), ("world", "planet", "game", "rich"),
    ]
    last = rules.overridden(found.select(F.lower("name").alias("name"), "type", "source", "priority", "line"), ["type", "name"], ["priority", "line"])
    assert {r.name: r.source for r in last.where("type = 'job'").collect()} == {"x": "mod", "miner": "game"}
    assert [(r.source, r.rel_path, r.error is not None) for r in harvest.file_errors(files).collect()] == [("game", "common/jobs/broken.txt", True)]


def test_enums_are_harvested_and_types_are_needed(harvested):
    files, declared, book = harvested
    assert harvest.complex_enum_sources(book) == [("job", "section", ("parts", "enum_name"))]
    assert sorted(r.value for r in harvest.enum_members(files, declared, harvest.complex_enum_sources(book)).collect()) == ["left", "right"]
    assert harvest.needed_types(book, ["<world>_cost", "enum[x]_<unit.rich>", "<unknown>_y"]) == ["job", "unit", "world"]


def test_display_names_lead_to_symbols(spark):
    scripts = spark.createDataFrame([(0, "loc/a_l_english.yml", 'l_english:\n key_a:0 "Miner"\n key_b:0 "Miner"\n key_c:0 "Farmer"'), (0, "loc/a_l_simp_chinese.yml", 'l_simp_chinese:\n key_d:0 "Miner"')], "priority int, rel_path string, text string")
    symbols = spark.createDataFrame([("key_a", "job"), ("KEY_B", "job"), ("key_c", "job"), ("key_d", "job")], "name string, kind string")
    queries = spark.createDataFrame([(1, "miner"), (2, "farmer")], "query_id long, query string")
    found = harvest.by_display_name(queries, harvest.localisation(scripts), symbols)
    assert sorted((r.query_id, r.name) for r in found.collect()) == [(1, "key_d"), (2, "key_c")]


def test_raised_titles_lead_back_to_themselves(spark):
    """A letter without a single upper-case form, as ß, must not turn into two."""
    texts = spark.createDataFrame([("english", "k1", "Große Straße 😀"), ("english", "k2", "Grosse Strasse 😀"), ("english", "k3", "äb")], "lang string, key string, value string")
    queries = texts.select("key", harvest.raised(F.col("value")).alias("query")).withColumn("query_id", F.substring("key", 2, 1).cast("long"))
    assert [r.query for r in queries.orderBy("key").collect()] == ["GROßE STRAßE 😀", "GROSSE STRASSE 😀", "ÄB"]
    found = harvest.by_display_name(queries.select("query_id", "query"), texts, texts.select(F.col("key").alias("name")))
    assert sorted((r.query_id, r.name) for r in found.collect()) == [(1, "k1"), (2, "k2"), (3, "k3")]


def test_descriptors(spark):
    text = 'Name="A mod"\nversion2 = "1"\nsupported_version="3.*"\nname="Last"\n'
    assert spark.createDataFrame([(text,), (None,)], "t string").select(tables.descriptor(F.col("t")).alias("d")).first().d == {"name": "Last", "version2": "1", "supported_version": "3.*"}


def test_trees_and_archives(spark, tmp_path):
    import io
    import tarfile

    folder = tmp_path / "a+b (1).x"
    (folder / "deep").mkdir(parents=True)
    (folder / "z.txt").write_bytes(b"one\r\ntwo")
    (folder / "deep" / "y.txt").write_bytes("ü".encode())
    assert sorted((r.rel_path, r.text) for r in tables.text_tree(spark, str(folder)).collect()) == [("deep/y.txt", "ü"), ("z.txt", "one\r\ntwo")]
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as archive:
        for name in ("repo/config/a.cwt", "repo/readme"):
            info = tarfile.TarInfo(name)
            info.size = 3
            archive.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "good.tar.gz").write_bytes(packed.getvalue())
    (tmp_path / "packs" / "bad.tar.gz").write_bytes(b"no archive")
    rows = tables.archive_members(spark, str(tmp_path / "packs"), r"config/(.*\.cwt)$").collect()
    assert sorted((r.rel_path or "", r.error is None) for r in rows) == [("", False), ("a.cwt", True)]


def test_localisation_first_wins(spark):
    scripts = spark.createDataFrame([(0, "loc/x_l_english.yml", 'l_english:\n key_a:0 "A $b$ thing"\n key_a:1 "other"')], "priority int, rel_path string, text string")
    assert [(r.lang, r.key, r.value) for r in harvest.localisation(scripts).collect()] == [("english", "key_a", "A  thing")]


def test_ranges(spark):
    frame = spark.createDataFrame([("1",), ("2",), ("5",), ("6",), ("x",)], "v string")
    assert [r[0] for r in frame.select(rules.in_range(F.col("v"), "float(1..5]")).collect()] == ["no", "yes", "yes", "no", "unknown"]


def test_text_search_is_fair(spark):
    """Three hits in one group, two in another, one in a third; limit 2 takes a row of each of the densest two."""
    rows = [("x", "a", 1, "hit\nhit\nhit"), ("x", "b", 2, "hit\nhit\nno"), ("x", "c", 3, "no\nno\nhit")]
    found = textsearch.text_search(spark.createDataFrame(rows, "lang string, source string, doc_id long, text string"), "HIT", limit=2).collect()
    assert [(r.source, r.total) for r in sorted(found, key=lambda r: r.place)] == [("a", 6), ("b", 6)]


def test_templates(spark):
    queries = spark.createDataFrame([(1, "fleet_cost_mult"), (2, "cost")], "query_id long, query string")
    assert [(r.query_id, r.captures) for r in rules.template_match(queries, ["<ship>_cost_<kind>", "<a><b>"]).collect()] == [(1, ["fleet", "mult"])]


def test_round_trip_without_a_shuffle(spark):
    """Equal texts, an empty and a missing one, and one that cannot be read; no rows are exchanged to put tokens together."""
    docs = spark.createDataFrame([(1, "a = { b }"), (2, "a = { b }"), (3, ""), (4, None), (5, "a = ]"), (6, "x = 1 # é\n")], "doc int, text string").coalesce(1)
    found = parse.lossless(docs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, parse.round_trip(parse.tokens(docs), docs).collect()))
    assert "hashpartitioning" not in found._jdf.queryExecution().toString()


def test_equal_texts_are_read_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def produce(text):
        calls.add(1)
        if text == "bad":
            raise parse.ScriptError(3, "no")
        return [{"n": len(text)}]

    docs = spark.range(300).select(F.col("id").alias("doc"), F.element_at(F.array(F.lit("aa"), F.lit("bad"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("text")).coalesce(1)
    rows = parse._per_document(docs.repartition(4), "doc", "text", produce, "n int").collect()
    assert sorted((r.doc, r.n, r.error_line) for r in rows) == [(i, (2, None, 1)[i % 3], (None, 3, None)[i % 3]) for i in range(300)]
    assert calls.value <= 12


def test_items_need_no_join(spark):
    from cairn.operators import lookup

    tree = parse.nodes(spark.createDataFrame([(1, "a = { b = 1 c = { } } z"), (2, "a = {")], "doc int, text string"))
    found = lookup.node_items(tree, keep=("path",))
    assert sorted((r.node_id, r.path, r["items"]) for r in found.collect()) == [(0, "a", ["b", "c"]), (1, "a/b", ["1"]), (2, "a/c", []), (3, "z", ["z"])]
    assert "Join" not in found._jdf.queryExecution().toString()
