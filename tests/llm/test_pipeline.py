"""Each stage on its own input, against brute force where the stage has one, and on odd rows."""

import corpus_pipeline as cp
import pytest
from cairn.llm import quality
from cairn.llm.common import read_table
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ODD = [(1, None, None, None, None, 7), (2, "", "en", "s", 0, 7), (None, "no id " * 9, "en", "s", 54, 7), (3, "x y z " * 40_000, "en", "s", 240_000, 7), (4, "same words in both of these rows", "en", "s", 31, 7), (4, "same words in both of these rows", "en", "s", 31, 7)]


@pytest.fixture(scope="module")
def stages(spark, small):
    """Input and result of each stage, one after the other."""
    docs, out = read_table(spark, small, "documents").persist(), []
    for name, stage in cp.STAGES:
        result = stage(spark, docs, small).persist()
        out.append((name, docs, result))
        docs = result
    return {name: (given, result) for name, given, result in out}


def test_stages_take_effect(stages):
    counts = {name: (given.count(), result.count()) for name, (given, result) in stages.items()}
    for name in ("quality", "near_dedup", "secrets"):
        assert stages[name][1].columns == COLUMNS
    assert counts["quality"][1] < counts["quality"][0] and counts["near_dedup"][1] < counts["near_dedup"][0] and counts["secrets"][1] == counts["secrets"][0]


def test_quality_keeps_what_the_net_accepts(spark, small, stages):
    given, result = stages["quality"]
    net = quality.train_quality(given, read_table(spark, small, "labels"))
    rows = given.collect()
    want = {r.doc_id for r, p in zip(rows, net.probabilities([(r.text or "").encode() for r in rows]), strict=True) if p >= 0.3}
    assert {r.doc_id for r in result.collect()} == want


def test_near_dedup_keeps_one_of_each_exact_group(stages):
    from tests_brute import exact_components

    given, result = stages["near_dedup"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    assert {r.doc_id for r in result.collect()} == {i for i, (_, root) in exact_components(rows).items() if i == root}


def test_secrets_are_gone_and_the_rest_stays(stages):
    from tests_brute import every_span

    given, result = stages["secrets"]
    before, after = ({r.doc_id: r for r in frame.collect()} for frame in (given, result))
    for i, row in before.items():
        spans, text, at = every_span(row.text or ""), "", 0
        for start, _, end, kind in spans:
            if start >= at:
                text += (row.text or "")[at:start] + f"[{kind}]"
            at = max(at, end)
        text += (row.text or "")[at:]
        assert (after[i].text or "") == text and (not spans or after[i].n_chars == len(text))


def test_packing_returns_every_id_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    given, result = stages["packing"]
    pieces = {}
    for r in result.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    for r in given.collect():
        assert [x for _, ids in sorted(pieces[r.doc_id]) for x in ids] == library.encode(r.text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("stage", [stage for _, stage in cp.STAGES], ids=[name for name, _ in cp.STAGES])
def test_odd_rows_and_clashing_columns(spark, small, stage):
    """Nulls in every column, empty, long and repeated rows, and columns that results or steps between have, too."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for clash in ("predicted", "kept", "spans", "row", "queue", "__text", "kept_id"):
        docs = docs.withColumn(clash, F.lit("x"))
    rows = stage(spark, docs, small).collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {1, 2, 3, 4, None}
    if stage is cp.near_dedup:
        assert {1, 2, 3, 4, None} == ids  # what has no words, or no id, is nobody's copy
    if stage in (cp.secret_redaction, cp.packing):
        assert ids == {1, 2, 3, 4, None} and (stage is cp.packing or len(rows) == len(ODD))


@pytest.mark.parametrize("stage", [stage for _, stage in cp.STAGES], ids=[name for name, _ in cp.STAGES])
def test_empty_tables(spark, small, stage):
    assert stage(spark, read_table(spark, small, "documents").where("false"), small).count() == 0
