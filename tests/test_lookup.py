"""Snapshots, versions, lookups and streams."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import lookup, snapshots
from cairn.streaming import refresh

FILES = "path string, content string"


def test_a_snapshot_is_installed_whole_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "corpus")
    good = spark.createDataFrame([("a.cwt", "x = { y = 1 }\r\n"), ("b.cwt", "z = 2")], FILES)
    assert snapshots.install(good, target)["n_files"] == 2
    with pytest.raises(ValueError, match="b.cwt"):
        snapshots.install(spark.createDataFrame([("a.cwt", "x = 1"), ("b.cwt", "z = {")], FILES), target)
    assert spark.read.parquet(target).count() == 2  # as it was
    more = spark.createDataFrame([("a.cwt", "x = { y = 1 }\n"), ("c.cwt", "new = 1")], FILES)
    states = {r.state: r.paths for r in snapshots.changed_paths(spark.read.parquet(target), more).collect()}
    assert states == {"added": ["c.cwt"], "removed": ["b.cwt"], "unchanged": []}  # line ends are no change
    snapshots.install(more, target)
    assert sorted(r.path for r in spark.read.parquet(target).collect()) == ["a.cwt", "c.cwt"]
    assert not (tmp_path / "corpus.old").exists() and not (tmp_path / "corpus.fresh").exists()


def test_manifests_do_not_depend_on_order_or_line_ends(spark):
    rows = [("a", "x\r\ny"), ("b", "z"), ("c", "")]
    one = snapshots.manifest_of(spark.createDataFrame(rows, FILES)).first()
    two = snapshots.manifest_of(spark.createDataFrame([(p, t.replace("\r\n", "\n")) for p, t in rows[::-1]], FILES).repartition(3)).first()
    assert one.digest == two.digest and (one.n_files, one.n_lines) == (3, 3)
    assert snapshots.manifest_of(spark.createDataFrame([("a", "x\ny!"), ("b", "z"), ("c", "")], FILES)).first().digest != one.digest


def test_line_endings(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\rb", "a\nb\r\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(snapshots.line_endings(F.col("t")).alias("e"), snapshots.line_count(F.col("t")).alias("n"))
    assert [tuple(r) for r in frame.collect()] == [("none", 0), ("none", 1), ("lf", 1), ("crlf", 2), ("cr", 2), ("mixed", 2)]


def test_status_cache_and_json(spark, tmp_path):
    path = str(tmp_path / "status")
    assert snapshots.read_status(spark, path, 60).count() == 0
    snapshots.write_status(spark, {"commit": "abc", "state": "current"}, path)
    assert [r.commit for r in snapshots.read_status(spark, path, 3600).collect()] == ["abc"]
    assert snapshots.read_status(spark, path, -1).count() == 0
    assert snapshots.as_json(spark.createDataFrame([(1, None, "x")], "a int, b string, c string")).first().json == '{"a":1,"c":"x"}'
    shown = spark.createDataFrame([(5.0,), (184.0,), (3725.0,)], "s double").select(snapshots.duration(F.col("s")).alias("d")).collect()
    assert [r.d for r in shown] == ["5s", "3m 04s", "1h 02m"]


def test_versions(spark):
    readings = spark.createDataFrame(
        [("a", 0, "marker", 1, "none here"), ("a", 1, "launcher", 1, "v4.6.1"), ("a", 2, "log", 1, "9.9"), ("b", 2, "log", 90, "4.0"), ("c", 2, "log", 3, "OpenGL 4.6"), ("c", 2, "log", 4, "Game 3.2")],
        "source string, priority int, kind string, line int, text string",
    )
    assert {r.source: (r.version, r.read_from) for r in lookup.game_version(readings).collect()} == {"a": ("4.6.1", "launcher"), "c": ("3.2", "log")}
    checks = [("4.6", "4.6.2"), ("4.5.1", "4.6"), ("4.*", "4.6"), (None, "4.6"), ("3.*", "4.6")]
    got = spark.createDataFrame(checks, "s string, a string").select(lookup.version_check(F.col("s"), F.col("a")).alias("c")).collect()
    assert [r.c for r in got] == ["match", "mismatch", "match", "unknown", "mismatch"]


def test_arguments_and_targets(spark):
    for query, limit in (("", 5), ("x" * 600, 5), ("x", 0), ("x", 501)):
        with pytest.raises(ValueError):
            lookup.is_safe_query(query, limit)
    symbols = spark.createDataFrame([("a:1", "Name", "t"), ("b:2", "name", "t"), ("c:3", "other", "t")], "id string, name string, type string")
    targets = spark.createDataFrame([(1, "NAME"), (2, "c:3"), (3, "../x"), (4, "/etc"), (5, "none")], "target_id int, target string")
    found = [(r.target_id, r.state, r.id) for r in lookup.get_definitions(targets, symbols).collect()]
    assert sorted(found, key=str) == [(1, "FOUND", "a:1"), (1, "FOUND", "b:2"), (2, "FOUND", "c:3"), (3, "BAD_TARGET", None), (4, "BAD_TARGET", None), (5, "NOT_FOUND", None)]


def test_comments_belong_to_definitions(spark):
    from cairn.operators import parse

    text = "# lost\n\n# one\n# two\na = { } # behind\nb = 1"
    docs = spark.createDataFrame([(1, text)], "doc int, text string")
    rows = {r.key: (r.start_line, r.end_line, r.source) for r in lookup.definition_texts(parse.nodes(docs), docs).collect()}
    assert rows == {"a": (3, 5, "# one\n# two\na = { } # behind"), "b": (6, 6, "b = 1")}


def test_changed_files_are_noticed_and_streamed(spark, tmp_path):
    """An added file, an edit of the same size, a deletion: fingerprints see all, the stream reads new files once."""
    import os

    folder = tmp_path / "tree" / "x"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("one")
    (folder / "b.txt").write_text("two")
    refresh.tree_fingerprint(spark, str(tmp_path / "tree")).write.parquet(str(tmp_path / "seen"))
    seen = spark.read.parquet(str(tmp_path / "seen"))
    assert seen.count() == 1 and refresh.stale(seen, refresh.tree_fingerprint(spark, str(tmp_path / "tree"))).count() == 0
    (folder / "a.txt").write_text("ONE")
    os.utime(folder / "a.txt", (1, 1))
    assert refresh.stale(seen, refresh.tree_fingerprint(spark, str(tmp_path / "tree"))).count() == 1
    os.remove(folder / "b.txt")
    assert refresh.stale(seen, refresh.tree_fingerprint(spark, str(tmp_path / "tree"))).count() == 1
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for n in (1, 2):
        spark.range(n * 10).write.mode("append").parquet(source)
        refresh.refresh(spark, source, "*.parquet", "id long", sink, checkpoint, lambda batch: batch.selectExpr("id * 2 as twice"))
        assert spark.read.parquet(sink).count() == (10 if n == 1 else 30)


def test_completions_of_frequent_tokens(spark):
    """Sets of one, two and more tokens, some of which no name has, against plain counting."""
    import random

    from cairn.operators.registry import postings

    rng = random.Random(4)
    names = sorted({"_".join(rng.choices("of the a b c d".split(), [9, 9, 3, 2, 1, 1], k=rng.randint(2, 4))) for _ in range(90)})
    asked = dict(enumerate(["of", "of_the", "of_the_a", "the_b_of_a", "zz", "of_zz", "zz_d_c", "d_c_b_a_the_of", "of_of", "of_the"]))
    found = lookup.completion_counts(spark.createDataFrame(list(asked.items()), "query_id long, query string"), postings(spark.createDataFrame([(n,) for n in names], "name string")))
    known = {t for n in names for t in n.split("_")}
    want = {q: sum(held <= set(n.split("_")) for n in names) if (held := set(text.split("_")) & known) else 1 for q, text in asked.items()}
    assert {r.query_id: r.completions for r in found.collect()} == want
