import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.distance import near_pairs, osa
from cairn.operators.align import align, fuzzy_matches, fuzzy_search, tiers
from cairn.operators.registry import token_stats

NAMES = ["any_owned_pop_job", "has_background_job", "set_ship_flag", "pop_growth"]


def brute_osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa():
    assert [osa("job", "job"), osa("job", "jb"), osa("background", "backgorund"), osa("ab", "ba"), osa("job", "pop"), osa("ca", "abc")] == [0, 1, 1, 1, 2, 3]
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert osa(a, b) == brute_osa(a, b)


def brute_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_pairs_are_all_pairs_within_the_edits():
    """Blocks of words of many letters, of few, with copies beyond the third and longer than a machine word."""
    rng = random.Random(5)
    for letters, longest in (("ab", 9), ("abcßé😀", 9), ("ab", 70), ("abcdef", 66)):
        size = rng.randint(longest - 3, longest)
        left = ["".join(rng.choice(letters) for _ in range(rng.randint(max(1, size - 2), size + 2))) for _ in range(9)]
        right = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(8)] + [left[0][:1] * size]
        most = np.array([34 * max(len(x), size) // 100 for x in left])
        for swaps, distance in ((True, brute_osa), (False, brute_levenshtein)):
            want = {(i, j): distance(a, b) for i, a in enumerate(left) for j, b in enumerate(right)}
            i, j, edits = near_pairs(left, right, most, swaps)
            assert dict(zip(zip(i.tolist(), j.tolist()), edits.tolist())) == {k: d for k, d in want.items() if d <= most[k[0]]}


def test_typos_meet_in_one_block_only(spark, monkeypatch):
    """Very many tokens of one length and of the same letters: each pair is met once, in even pieces."""
    from cairn.operators import registry as names

    monkeypatch.setattr(names, "BLOCK", 8)
    rng = random.Random(7)
    tokens = sorted({"".join(rng.choice("theory") for _ in range(rng.choice((3, 6, 6, 6, 7, 9)))) for _ in range(150)})
    stats = spark.createDataFrame([(t,) for t in tokens], "token string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(tokens[::5])], "query_id long, query string")
    pairs = [(q, t) for q in tokens[::5] for t in tokens if q != t and abs(len(q) - len(t)) <= (2 if min(len(q), len(t)) >= 7 else 1)]
    for found, distance in ((names.osa_typos(queries, stats), brute_osa), (names.typo_candidates(queries, stats), brute_levenshtein)):
        rows = sorted(map(tuple, found.collect()))
        assert rows == sorted((q, t, d) for q, t in pairs if (d := distance(q, t)) <= 34 * max(len(q), len(t)) // 100)
    assert names._blocks(stats, "l").where(F.size("l") > 32).isEmpty()


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def test_golden_scores(spark, registry):
    """Scores worked out by hand from the cost model."""
    queries = spark.createDataFrame([(1, "any_pop_job"), (2, "has_backgroud_job"), (3, "job_any_pop")], "query_id long, query string")
    stats = token_stats(registry)
    found = {(r.query_id, r.name): r.match_score for r in fuzzy_matches(queries, registry, stats).collect()}
    assert found[1, "any_owned_pop_job"] == pytest.approx(88.53, abs=0.011)
    assert found[2, "has_background_job"] == pytest.approx(94.58, abs=0.011)
    assert found[3, "any_owned_pop_job"] == pytest.approx(18.73, abs=0.011)


def test_order_matters_and_tiers_are_disjoint(spark, registry):
    queries = spark.createDataFrame([(1, "any_pop_job"), (2, "job_any_pop"), (3, "zzz_qqq")], "query_id long, query string")
    stats = token_stats(registry)
    top = {(r.query_id, r.name) for r in fuzzy_search(queries, registry, stats).collect()}
    assert (1, "any_owned_pop_job") in top and not any(q in (2, 3) for q, _ in top)
    rows = tiers(fuzzy_matches(queries, registry, stats)).collect()
    assert len({(r.query_id, r.name) for r in rows}) == len(rows)


def test_separator_is_explained():
    facts = align(["has", "background", "job"], ["has", "back", "ground", "job"], {}, {})
    assert {"query": "background", "candidate": "back_ground", "kind": "separator", "distance": 0} in facts["substitutions"]


def test_placeholder_binds():
    facts = align(["fleet", "cost", "mult"], ["<ship>", "cost", "mult"], {}, {})
    assert facts["bindings"] == [{"placeholder": "<ship>", "value": "fleet"}] and facts["matched"] == ["cost", "mult"]



def every_script(q, c, weight, i=0, j=0):
    """All scripts from (i, j) on as (cost, moves), by plain recursion; moves in the order of taste."""
    from cairn.operators.align import COSTS, LONGEST_CAPTURE

    if (i, j) == (len(q), len(c)):
        yield 0.0, []
        return
    slot = lambda t: t.startswith("<") or t.startswith("enum[")
    steps = []
    if i < len(q) and j < len(c):
        if slot(c[j]):
            steps += [(COSTS["capture"] * k, ("2capture", k), i + k, j + 1) for k in range(1, len(q) - i + 1) if len("_".join(q[i : i + k])) <= LONGEST_CAPTURE]
        else:
            a, b = q[i], c[j]
            near = min(len(a), len(b)) >= 3 and abs(len(a) - len(b)) <= (2 if min(len(a), len(b)) >= 7 else 1) and brute_osa(a, b) <= 0.34 * max(len(a), len(b))
            if a == b or near:
                steps.append((COSTS["typo"] * (brute_osa(a, b) if a != b else 0) * weight(b), ("0read", 0), i + 1, j + 1))
            elif 3 <= len(a) < len(b) and b.startswith(a):
                steps.append((COSTS["prefix"] * (0.5 + 0.5 * len(a) / len(b)) * weight(b), ("0read", 0), i + 1, j + 1))
            if j + 1 < len(c) and not slot(c[j + 1]) and len(a) >= 4 and b + c[j + 1] == a:
                steps.append((COSTS["join"] * (weight(b) + weight(c[j + 1])), ("1join", 0), i + 1, j + 2))
    if j < len(c):
        steps.append((COSTS["missing"] * weight(c[j]), ("3skip", 0), i, j + 1))
    if i < len(q):
        seen, k, has = 0, 0, set()
        for token in q:
            while k < len(c) and c[k] != token:
                k += 1
            if k == len(c):
                break
            has.add(token)
            seen += 1
        steps.append((COSTS["extra"] * (2 if q[i] in has else 1), ("4drop", 0), i + 1, j))
    for cost, move, ni, nj in steps:
        for rest, moves in every_script(q, c, weight, ni, nj):
            yield cost + rest, [move, *moves]


def test_alignment_is_the_first_of_the_cheapest_scripts():
    rng = random.Random(5)
    words = ["job", "jobs", "pop", "owned", "ownde", "back", "ground", "background", "backg", "has", "any", "energy"]
    holes = ["<ship>", "enum[kind]"]
    for _ in range(400):
        q = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        c = [rng.choice(words + holes * 2) for _ in range(rng.randint(1, 4))]
        weights = {w: 1 + rng.random() for w in words}
        want = min(every_script(q, c, lambda t, w=weights: w.get(t, 1.4)), key=lambda x: (round(x[0], 9), x[1]))
        got = align(q, c, weights, {})
        assert got["cost"] == pytest.approx(want[0])
        moves = [m for m, _ in want[1]]
        assert (len(got["missing"]), len(got["extra"]), len(got["bindings"])) == (moves.count("3skip"), moves.count("4drop"), moves.count("2capture"))
        assert len(got["matched"]) + len(got["substitutions"]) == moves.count("0read") + moves.count("1join")
        assert [len(b["value"].split("_")) for b in got["bindings"]] == [k for m, k in want[1] if m == "2capture"]


def test_batches_give_what_single_pairs_give(spark, registry):
    """Shapes of many sizes in one batch, empty token lists among them."""
    from cairn.operators.align import NUMBERS, with_facts

    rng = random.Random(6)
    words = ["job", "pop", "owned", "background", "has", "any"]
    rows = []
    for k in range(120):
        q, c = ([rng.choice(words) for _ in range(rng.randint(0, 4))] for _ in range(2))
        rows.append((k, "_".join(c), q, c, [1.5] * len(q), [0.5] * len(q), [1.2] * len(c), [0.7] * len(c)))
    frame = spark.createDataFrame(rows, "id int, name string, q array<string>, c array<string>, qw array<double>, qi array<double>, cw array<double>, ci array<double>")
    for r in with_facts(frame).collect():
        if r.q and r.c:
            from cairn.operators.align import _shapes

            ((_, shape),) = _shapes([r.q], [r.c], [r.qw], [r.qi], [r.cw], [r.ci])
            import numpy as np

            assert [r[n] for n in NUMBERS] == pytest.approx(shape.facts(np.zeros(1), np.zeros(1))[0].tolist())
        else:
            assert r.cost != r.cost  # not aligned


TEMPLATED = [*NAMES, "<planet_class>_habitability", "country_<resource>_produces_mult", "<a>_<b>_add", "<ship_size>_max_per_member_add"]


def test_templates_have_to_be_carried_by_their_fixed_text(spark):
    """A placeholder binds, a wildcard that takes most of the query is no suggestion."""
    names = spark.createDataFrame([(n,) for n in TEMPLATED], "name string")
    queries = spark.createDataFrame([(1, "country_energy_produces_mult"), (2, "country_resource_energy"), (3, "corvette_max_per_member_add"), (4, "continental_hab"), (5, "some_long_words_here_add")], "query_id long, query string")
    found = {}
    for r in fuzzy_search(queries, names, token_stats(names)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.name, r.match_kind, r.bindings))
    assert found[1][0][1:3] == ("country_<resource>_produces_mult", "template_fuzzy") and '"energy"' in found[1][0][3]
    assert "<ship_size>_max_per_member_add" in [x[1] for x in found[3]]
    assert not any("<a>_<b>_add" in x[1] for rows in found.values() for x in rows)
    assert 5 not in found


def test_anchor():
    from cairn.operators.align import anchor

    assert anchor("<planet_class>_habitability") == (12, 12) and anchor("<a>_<b>_add") == (0, 0) and anchor("country_<x>_add") == (7, 7) and anchor("plain_name") == (9, 9)


def test_swapped_letters_reach_the_shortlist(spark):
    from cairn.operators.registry import readings, shortlist_topk

    names = spark.createDataFrame([("job_xyz",), ("other_name",), ("energy_pops",), ("x_" + "y" * 200,)], "name string")
    stats = token_stats(names)
    queries = spark.createDataFrame([(1, "jbo_pop"), (2, "nam"), (3, "ergy")], "query_id long, query string")
    assert {(r.query_id, r.name) for r in shortlist_topk(queries, names, stats).collect()} >= {(1, "job_xyz"), (2, "other_name"), (3, "energy_pops")}
    read = {(r.qtoken, r.token): r.priority for r in readings(queries, stats).collect()}
    assert read["jbo", "job"] == 2 and ("nam", "name") in read


def test_unrelated_names_and_permutations_are_not_suggested(spark, registry):
    queries = spark.createDataFrame([(1, "quantum_flux_inverter"), (2, "zeta"), (3, "job_pop_owned_any"), (4, "job_background_has")], "query_id long, query string")
    assert not fuzzy_search(queries, registry, token_stats(registry)).count()


def test_shortlist_of_frequent_tokens_is_the_whole_ranking(spark):
    """Names of few tokens, most of them frequent, against the plain sum of readings over all names; equal queries too."""
    from cairn.operators import registry as names

    rng = random.Random(11)
    words = ["alpha", "alpah", "beta", "betta", "gamma", "delta", "rare", "omega"]
    every = sorted({"_".join(rng.choices(words, [9, 3, 9, 3, 8, 8, 1, 5], k=rng.randint(3, 5))) for _ in range(400)} | {f"rare_x{i}_alpha" for i in range(3)})
    reg = spark.createDataFrame([(n,) for n in every], "name string").persist()
    stats = token_stats(reg).persist()
    asked = {1: "alpha_beta", 2: "alpha_beta_gamma", 3: "betta_betta_rare", 4: "alpha_beta", 5: "gamma", 6: "alpha_alpah_beta_betta_gamma_delta", 7: "zzz_qqq", 8: "omega_rare_delta"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    read = {}
    for r in names.readings(queries, stats).collect():
        read.setdefault(r.qtoken, []).append((r.token, r.priority))
    contained = {(q, n) for q, t in asked.items() for n in every if len(t.split("_")) <= 2 and t in n}
    for k in (3, 20, 100):
        want = []
        for q, text in asked.items():
            rows = []
            for n in every:
                hits = [p for t in text.split("_") for token, p in read.get(t, ()) if token in n.split("_")]
                if hits or (q, n) in contained:
                    rows.append((-len(hits), min(hits + [4] * ((q, n) in contained)), n))
            want += [(q, n, -s, p, i) for i, (s, p, n) in enumerate(sorted(rows)[:k], 1)]
        assert sorted(map(tuple, names.shortlist_topk(queries, reg, stats, k).collect())) == sorted(want)


def test_frequent_tokens_bring_no_more_rows_as_names_grow(spark):
    """Four times the names of the same frequent token give a query no more rows to rank."""
    from cairn.operators import registry as names

    made = []
    for n in (300, 1200):
        tagged = spark.createDataFrame([(f"of_the_n{i}" if i % 2 else f"of_n{i}_x", ["of", "the"] if i % 2 else ["of"]) for i in range(n)], "name string, held array<string>")
        frequent = spark.createDataFrame([(1, "of", 1, 0), (1, "the", 1, 0)], "query_id long, token string, weight long, priority long")
        made.append(names._by_frequent(frequent, tagged, 20).count())
    assert made[0] == made[1] <= 60


def test_names_that_may_rank_are_found_where_names_are_ranked(spark):
    """The bound of a block lets through every name that reaches a bar, and of names that cannot no more than a part goes on to be aligned."""
    from functools import partial

    from cairn.operators import align
    from cairn.operators import registry as names

    class Everything:
        """A bound that rules nothing out."""

        def __init__(self, bar, names, asked):
            pass

        def __call__(self, q, qw, qi, rows):
            return rows >= 0

    rng = random.Random(23)
    words = ["energy", "enregy", "produces", "produce", "country", "job", "jobs", "background", "back", "ground", "pop", "owned", "has", "any", "add"]
    every = sorted({"_".join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(600)} | {"country_<resource>_add"})
    reg = spark.createDataFrame([(n,) for n in every], "name string").persist()
    stats = token_stats(reg).persist()
    texts = ["enrgy_produces_country", "background_job", "back_ground_jbo", "pop_ownd_has_any", "country_energy_add", "produces_zzz_add", "energ"] * 2
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string").persist()
    asked = queries.select(F.col("query_id").alias("query_id"), "query", F.col("query").alias("needle")).where("query_id < 7").persist()
    for bar in ("result", "related"):
        rows = {}
        for kind, bound in (("all", partial(Everything, bar)), ("bound", partial(align.MayRank, bar))):
            pairs = names.ranked_names(asked, names.searchable(reg), stats, 500, bound)
            facts = align.with_facts(pairs.withColumn("query_chars", F.length(F.regexp_replace("needle", "_", "")).cast("double"))).select("query_id", "name", *(c.alias(n) for n, c in align.scored().items()))
            result = (F.col("match_score") >= align.RESULT_SCORE) & (F.col("query_support") >= align.RESULT_SUPPORT)
            related = (F.col("match_score") >= align.RELATED_SCORE) & (F.col("candidate_coverage") >= align.RELATED_COVERAGE)
            wanted = result if bar == "result" else result | related
            rows[kind] = facts.count(), {(r.query_id, r.name, r.match_score) for r in facts.where(wanted & F.col("admitted") & (F.col("query_support") >= align.LEAST_SUPPORT)).collect()}
        assert rows["all"][1] == rows["bound"][1] != set()
        assert rows["bound"][0] < rows["all"][0] / (2 if bar == "result" else 1)
    found = {}
    for r in align.fuzzy_matches(queries, reg, stats).collect():
        found.setdefault(r.query_id % 7, {}).setdefault(r.query_id, set()).add((r.name, r.match_score))
    assert found and all(len(x) == 2 and len({frozenset(rows) for rows in x.values()}) == 1 for x in found.values())  # equal queries, equal rows


def test_parts_of_names_give_the_whole_ranking(spark, monkeypatch):
    """Names over many parts and queries over several blocks give what one part gives; a query without tokens aligns with nothing."""
    from cairn.operators import registry as names

    rng = random.Random(31)
    words = ["energy", "enregy", "produces", "country", "job", "jobs", "pop", "owned", "has", "any"]
    reg = spark.createDataFrame([(n,) for n in sorted({"_".join(rng.choices(words, k=rng.randint(2, 4))) for _ in range(300)})], "name string").persist()
    stats = token_stats(reg).persist()
    texts = ["enrgy_produces_country", "jbo_pop", "pop_ownd_has_any", "any", "job_job_zzz"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string").persist()
    whole = sorted(map(tuple, names.shortlist_topk(queries, reg, stats, 40).collect()))
    monkeypatch.setattr(names, "PART_NAMES", 60)
    monkeypatch.setattr(names, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, names.shortlist_topk(queries, reg, stats, 40).collect())) == whole != []
    assert not fuzzy_matches(spark.createDataFrame([(1, "_")], "query_id long, query string"), reg, stats).count()
