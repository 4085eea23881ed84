"""Following a tree with edits and deletions; scans under a budget; definitions stored by type."""

import os
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators import harvest, textsearch
from cairn.streaming import refresh


@pytest.fixture
def tree(tmp_path):
    for name, text in {"common/a.txt": "one", "common/deep/b.txt": "two", "localisation/english/n_l_english.yml": "x", "c.txt": "three"}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def content(paths):
    """Rows of files: a build that reads those it is given and counts them."""
    spark = paths.sparkSession
    names = [r["path"] for r in paths.collect()]
    if not names:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.format("binaryFile").load(names).select("path", F.decode("content", "UTF-8").alias("text"))


def files(spark, tree):
    return refresh.listing(spark, [f"file://{tree}/tree/common", f"file://{tree}/tree/localisation"])


def shown(spark, sink):
    return {r["path"].rsplit("/", 1)[-1]: r["text"] for r in refresh.followed(spark, sink).collect()}


def test_additions_edits_and_deletions_reach_the_sink(spark, tree):
    sink, common = f"file://{tree}/sink", tree / "tree" / "common"
    assert refresh.follow(files(spark, tree), sink, content) == 1
    assert shown(spark, sink) == {"a.txt": "one", "b.txt": "two", "n_l_english.yml": "x"}
    assert refresh.follow(files(spark, tree), sink, content) is None  # nothing differs, nothing is written
    (common / "a.txt").write_text("ONE")  # of the same size
    os.utime(common / "a.txt", (2_000_000_000, 2_000_000_000))
    (common / "new.txt").write_text("four")
    (common / "deep" / "b.txt").unlink()
    (tree / "tree" / "localisation" / "english" / "n_l_english.yml").write_text("yy")
    read = []
    assert refresh.follow(files(spark, tree), sink, lambda paths: content(paths.where(F.lit(read.append(paths.count()) is None)))) == 2
    assert read == [3]  # only what is new or edited is read
    assert shown(spark, sink) == {"a.txt": "ONE", "new.txt": "four", "n_l_english.yml": "yy"}
    (common / "deep" / "b.txt").write_text("back")
    (common / "new.txt").unlink()
    assert refresh.follow(files(spark, tree), sink, content) == 3
    assert shown(spark, sink) == {"a.txt": "ONE", "b.txt": "back", "n_l_english.yml": "yy"}


def test_a_run_that_dies_loses_nothing(spark, tree, monkeypatch):
    sink = f"file://{tree}/sink"
    refresh.follow(files(spark, tree), sink, content)
    (tree / "tree" / "common" / "a.txt").write_text("longer")
    good = type(spark.range(1).write).parquet

    def dies(self, path, *args, **kwargs):
        if path.endswith("/commits"):
            raise RuntimeError("lost")
        return good(self, path, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", dies)
    with pytest.raises(RuntimeError, match="lost"):
        refresh.follow(files(spark, tree), sink, content)
    monkeypatch.undo()
    assert shown(spark, sink)["a.txt"] == "one"  # as it was
    (tree / "tree" / "common" / "deep" / "b.txt").unlink()
    assert refresh.follow(files(spark, tree), sink, content) == 2
    assert shown(spark, sink) == {"a.txt": "longer", "n_l_english.yml": "x"}


def test_a_stream_follows(spark, tree):
    sink = f"file://{tree}/sink"
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = refresh.follow_stream(clock, [f"file://{tree}/tree/common"], sink, content, f"file://{tree}/checkpoint", 1)
    try:
        def until(want):
            end = time.monotonic() + 60
            while time.monotonic() < end:
                try:
                    if shown(spark, sink) == want:
                        return True
                except ValueError:
                    pass
                time.sleep(0.5)
            return False

        assert until({"a.txt": "one", "b.txt": "two"})
        (tree / "tree" / "common" / "a.txt").unlink()
        assert until({"b.txt": "two"})
    finally:
        query.stop()


def test_an_empty_sink_says_so(spark, tree):
    with pytest.raises(ValueError, match="nothing"):
        refresh.followed(spark, f"file://{tree}/none")


@pytest.mark.parametrize("budget", [0, 1, 7, 15, 1000])
def test_budget_is_spent_a_file_of_each_directory_in_turn(spark, budget):
    docs = [("d1", "a", "x hit\nhit"), ("d1", "b", "hit"), ("d2", "c", None), ("d2", "d", "no"), ("d3", "e", "HIT " * 3), ("d1", "f", "hit hit")]
    frame = spark.createDataFrame(docs, "source string, doc_id string, text string")
    by_dir = {}
    for source, path, text in docs:
        by_dir.setdefault(source, []).append((path, text or ""))
    order = sorted((i + 1, s, p, t) for s, own in by_dir.items() for i, (p, t) in enumerate(sorted(own)))
    opened, spent = [], 0
    for r, s, p, t in order:
        if spent < budget:
            opened.append((r, s, p, sum("hit" in line.lower() for line in t.split("\n"))))
        spent += len(t)
    hits = [x for x in opened if x[3]]
    got = textsearch.budgeted_search(frame, "hit", budget, limit=2).collect()
    assert [(r["round"], r["source"], r["doc_id"], r["hits"]) for r in sorted(got, key=lambda r: r["round"])] == hits[:2]
    whole = len(opened) == len(order)
    for r in got:
        found = sum(x[3] for x in hits)
        assert (r["truncated"], r["matched_at_least"], r["total"], r["has_more"]) == (not whole, found, found if whole else None, not whole or len(hits) > 2)


def test_a_lookup_reads_the_folders_of_its_types(spark, tmp_path):
    found = spark.createDataFrame([(f"t{i % 7}", f"Name{i}", "game", "f.txt", 2 * i, 2 * i + 2) for i in range(70)], "type string, name string, source string, rel_path string, start int, end int")
    path = f"file://{tmp_path}/by-type"
    harvest.write_by_type(found, path)
    asked = spark.createDataFrame([("t1", "name1"), ("t1", "name2"), ("t3", "NAME3"), ("t9", "name9")], "type string, name string")
    rows = harvest.of_types(spark, path, asked)
    assert sorted((r["type"], r["name"]) for r in rows.collect()) == [("t1", "Name1"), ("t3", "Name3")]
    assert "dynamicpruning" in rows._jdf.queryExecution().toString().lower()
    texts = spark.createDataFrame([("game", "f.txt", "".join(f"{i:02d}" for i in range(70))), ("game", "g.txt", "other")], "source string, rel_path string, text string")
    assert {(r["name"], r["body"]) for r in harvest.with_source(rows, texts).collect()} == {("Name1", "01"), ("Name3", "03")}
