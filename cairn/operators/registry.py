"""Identifier registry and its inverted indexes: names, tokens, statistics, bigrams, readings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.functions.distance import near_pairs
from cairn.sources.tables import bounded_batches, lines, stored

#: Reading limits: shortest token of a typo or prefix reading, and the largest share of changed characters.
TYPO_LEAST, PREFIX_LEAST, TYPO_RATIO = 3, 3, 0.34
MERGE_LEAST = 6
#: Fixed values of the shortlist: a token in more names is no rare one; readings kept for a query token;
#: names kept for a query; query tokens and characters up to which names that contain the query are offered; sizes of names.
RARE_SEEDS, READINGS, SHORTLIST, BROWSE_TOKENS, BROWSE_CHARS, MOST_TOKENS, LEAST_CHARS = 150, 60, 400, 2, 24, 24, 3
#: Characters of a template's fixed text that lead to it.
RUN = 3
#: Rows that a broadcast has at most.
FEW = 100_000
#: Fixed value: the weight of a token that no name has.
UNKNOWN_WEIGHT = 1.4
#: Names and distinct queries that meet in one task, about; names that are worth a task.
PART_NAMES, BLOCK_QUERIES, LEAST_NAMES = 100_000, 16_384, 2_000
PLACEHOLDER = r"^(?:<[^<>\s]+>|enum\[[^\[\]]+\])$"


def words_of_line(txt: str = "txt"):
    return F.filter(F.regexp_extract_all(F.col(txt), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 2)


def line_names(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The name that each line with three words or more declares: its first four words."""
    named = lines(docs, keep).withColumn("w", words_of_line())
    return named.where(F.size("w") >= 3).select(*keep, "line", F.array_join(F.slice("w", 1, 4), "_").alias("name"))


def identifier_registry(docs: DataFrame) -> DataFrame:
    return line_names(docs).select("name").distinct()


def tokens_of(name: str = "name"):
    """Lower-case tokens at ``_``; placeholders ``<x>`` and ``enum[x]`` stay whole."""
    parts = F.regexp_extract_all(F.lower(F.col(name)), F.lit(r"<[^<>\s]+>|enum\[[^\[\]]+\]|[^_<]+"), F.lit(0))
    return F.filter(parts, lambda p: p != "")


def postings(registry: DataFrame, key: str = "name") -> DataFrame:
    """Every name by each of its tokens that is no placeholder."""
    return registry.select(key, F.explode(F.array_distinct(tokens_of())).alias("token")).where(~F.col("token").rlike(PLACEHOLDER))


def token_stats(registry: DataFrame) -> DataFrame:
    """token, df, weight = 1 + min(1, ln((N+1)/(df+1)) / 8), info = max(0, ln(N/df))."""
    total = registry.agg(F.count("*").alias("n"))
    stats = postings(registry).groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row
    weight = 1 + F.least(F.lit(1.0), F.log((F.col("n") + 1) / (F.col("df") + 1)) / 8)
    return stats.select("token", "df", F.round(weight, 6).alias("weight"), F.round(F.greatest(F.lit(0.0), F.log(F.col("n") / F.col("df"))), 6).alias("info"))


def postings_top(registry: DataFrame, k: int = RARE_SEEDS) -> DataFrame:
    """The first k names of each token in alphabetical order."""
    order = Window.partitionBy("token").orderBy("name")
    return postings(registry).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("token", "name", "rank")


def bigrams(token: str = "token"):
    padded = F.concat(F.lit("^"), F.col(token), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) + 1), lambda i: padded.substr(i, F.lit(2))))


def bigram_index(stats: DataFrame) -> DataFrame:
    return stats.select(F.explode(bigrams()).alias("gram"), "token")


def exact_lookup(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Case-insensitive equality; (query_id, query) by name."""
    return queries.join(registry, F.lower("query") == F.lower("name")).select("query_id", "query", "name")


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.posexplode(tokens_of("query")).alias("at", "qtoken"))


#: Tokens of one length that are compared as a block.
BLOCK = 2048


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys over all shuffle partitions. Spark would join small partitions into few, but here few rows
    make many: what follows on them multiplies."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _blocks(tokens: DataFrame, name: str) -> DataFrame:
    """(size, block, ``name``): arrays of about BLOCK tokens of one length."""
    sized = tokens.withColumn("size", F.length("token"))
    counts = sized.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt_out = sized.join(counts, "size").withColumn("block", F.pmod(F.xxhash64("token"), F.col("blocks")))
    return dealt_out.groupBy("size", "blocks", "block").agg(F.collect_list("token").alias(name))  # about BLOCK tokens


def _near(queries: DataFrame, stats: DataFrame, swaps: bool) -> DataFrame:
    """(qtoken, token, distance) of the distinct query tokens and the tokens, unlike them, that a typo makes of them.

    Blocks of tokens meet if their lengths allow a typo, each pair of tokens in one pair of blocks only, and a pair of blocks is
    one piece of work whatever bigrams or letters are frequent.
    """
    least = F.length("token") >= TYPO_LEAST
    asked = _blocks(query_tokens(queries).select(F.col("qtoken").alias("token")).distinct().where(least), "asked").select(F.col("size").alias("own"), "asked")
    known = _blocks(stats.select("token").where(least), "known")
    counts = known.groupBy("size").agg(F.max("blocks").alias("blocks"))
    sizes = F.filter(F.sequence(F.col("own") - 2, F.col("own") + 2), lambda n: (n >= TYPO_LEAST) & ((F.abs(n - F.col("own")) <= 1) | (F.least(n, F.col("own")) >= 7)))
    met = asked.withColumn("size", F.explode(sizes)).join(counts, "size").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    pairs = dealt(met.join(known.drop("blocks"), ["size", "block"]).select("own", "size", "asked", "known"), "size", "block", "own", F.xxhash64("asked"))
    bounded_batches(queries.sparkSession)
    percent = round(100 * TYPO_RATIO)

    def run(batches):
        for batch in batches:
            for own, size, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, j, edits = near_pairs(left, right, np.full(len(left), percent * max(own, size) // 100), swaps)
                found = (edits > 0).nonzero()[0]
                left, right = pa.array(left, pa.string()), pa.array(right, pa.string())
                yield pa.RecordBatch.from_arrays([left.take(pa.array(i[found])), right.take(pa.array(j[found])), pa.array(edits[found])], names=["qtoken", "token", "distance"])

    return pairs.mapInArrow(run, "qtoken string, token string, distance bigint")


def typo_candidates(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """Tokens near a query token by Levenshtein distance."""
    return _near(queries, stats, False)


def osa_typos(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """The same by optimal string alignment, in which swapped neighbours count once."""
    return _near(queries, stats, True)


def prefix_readings(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """Tokens that a truncated query token opens: an equi-join on every prefix of a token."""
    opened = stats.where(F.length("token") > PREFIX_LEAST).select("token", F.explode(F.transform(F.sequence(F.lit(PREFIX_LEAST), F.length("token") - 1), lambda n: F.col("token").substr(F.lit(1), n))).alias("qtoken"))
    return opened.join(query_tokens(queries).select("qtoken").distinct(), "qtoken").select("qtoken", "token")


def merge_segments(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """Neighbouring query tokens whose joint text is a token of the registry."""
    t = tokens_of("query")
    pairs = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.struct(i.cast("bigint").alias("at"), F.concat(t[i], t[i + 1]).alias("token")))
    formed = queries.where(F.size(t) >= 2).select("query_id", "query", F.inline(pairs)).where(F.length("token") >= MERGE_LEAST)
    return formed.join(stats.select("token"), "token").select("query_id", "query", "at", "token")


def readings(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """(qtoken, token, priority): what each distinct query token may stand for, at most READINGS each.

    Priority 0 is the token itself, 2 a typo of it, 1 a token that it opens; that one only where both
    are rare, so that a common stem does not bring in all its completions.
    """
    asked = query_tokens(queries).select("qtoken").distinct()
    exact = asked.join(stats, F.col("qtoken") == F.col("token"))
    rare = stats.where(F.col("df") <= RARE_SEEDS)
    opened = prefix_readings(queries, rare).join(rare.select(F.col("token").alias("qtoken")), "qtoken", "left_semi")
    every = (
        exact.select("qtoken", "token", F.lit(0).alias("priority"), F.lit(0).cast("bigint").alias("distance"))
        .unionByName(osa_typos(queries, stats).withColumn("priority", F.lit(2)))
        .unionByName(opened.select("qtoken", "token", F.lit(1).alias("priority"), F.lit(0).cast("bigint").alias("distance")))
    )
    # A token that is a typo as well as a completion counts as a typo.
    one = every.groupBy("qtoken", "token").agg(F.max_by(F.struct("priority", "distance"), "priority").alias("r")).select("qtoken", "token", "r.*")
    order = Window.partitionBy("qtoken").orderBy((F.col("priority") != 0), "distance", "token")
    return dealt(one, "qtoken").withColumn("place", F.row_number().over(order)).where(F.col("place") <= READINGS).select("qtoken", "token", "priority", "distance")


def containing(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, name) of the names that contain a short query, by an equi-join on its first characters."""
    short = queries.withColumn("needle", F.lower(F.coalesce("needle", "query"))).where((F.size(tokens_of("query")) <= BROWSE_TOKENS) & (F.length("needle") <= BROWSE_CHARS) & (F.length("needle") > 0))
    asked = short.select("query_id", "needle", F.substring("needle", 1, RUN).alias("start"))
    cf = F.lower("name")
    # Runs of the lengths that starts have, RUN at most: a query shorter than RUN is its own start.
    counts = asked.groupBy(F.length("start").alias("n")).count().collect()
    sizes = F.array(*(F.lit(r["n"]) for r in counts)).cast("array<int>")
    asked = F.broadcast(asked) if sum(r["count"] for r in counts) <= FEW else asked
    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(cf)), lambda i: F.transform(sizes, lambda n: cf.substr(i, n)))))
    return registry.select("name", F.explode(starts).alias("start")).join(asked, "start").where(F.contains(cf, F.col("needle"))).select("query_id", "name").distinct()


def templates_for(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, name) of the templates whose fixed text begins, somewhere, with characters of the query."""
    needle = F.lower(F.regexp_replace(F.coalesce("needle", "query"), "_", ""))
    windows = F.transform(F.sequence(F.lit(1), F.length("squashed") - RUN + 1), lambda i: F.col("squashed").substr(i, F.lit(RUN)))
    asked = queries.withColumn("squashed", needle).where(F.length("squashed") >= RUN).select("query_id", F.explode(F.array_distinct(windows)).alias("run"))
    fixed = F.filter(tokens_of(), lambda t: ~t.rlike(PLACEHOLDER) & (F.length(t) >= 2))
    dynamic = registry.where(F.exists(tokens_of(), lambda t: t.rlike(PLACEHOLDER)))
    runs = dynamic.select("name", F.explode(F.array_distinct(F.transform(fixed, lambda t: F.substring(t, 1, RUN)))).alias("run"))
    return runs.join(asked, "run").select("query_id", "name").distinct()


def _sets(tokens: str) -> Column:
    """The sets of one, two and three of an array of sorted tokens, each joined by ``_``, which no token has."""
    after = lambda i: F.slice(tokens, i + 2, F.size(tokens))
    two = F.flatten(F.transform(tokens, lambda t, i: F.transform(after(i), lambda u: F.concat_ws("_", t, u))))
    three = F.flatten(F.transform(tokens, lambda t, i: F.flatten(F.transform(after(i), lambda u, j: F.transform(after(i + j + 1), lambda v: F.concat_ws("_", t, u, v))))))
    return F.concat(tokens, two, three)


def _frequent_lists(frequent: DataFrame, tagged: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, set), (set, name, held): the names that frequent readings alone may bring among a query's first k, and no fewer.

    All names that hold a set of readings have at least that set's support and priority. So a name that is read by one or two
    frequent readings only is among the first k in alphabetical order of those that hold these, or k others come first; names
    that three are found in are all listed. A set is not looked up if another of the query has k names and outranks it.
    """
    own = frequent.groupBy("query_id").agg(F.array_sort(F.collect_list("token")).alias("read"), F.map_from_entries(F.collect_list(F.struct("token", F.struct("weight", "priority")))).alias("of"))  # readings of a query
    sets = own.select("query_id", "of", F.explode(_sets("read")).alias("set")).withColumn("part", F.split("set", "_"))
    weight = F.aggregate("part", F.lit(0).cast("bigint"), lambda n, t: n + F.col("of")[t]["weight"])
    wanted = sets.select("query_id", "set", F.struct(weight.alias("weight"), (-F.array_min(F.transform("part", lambda t: F.col("of")[t]["priority"]))).alias("first")).alias("place"))
    listed = tagged.where(F.size("held") > 0).select("name", "held", F.explode(_sets("held")).alias("set")).join(wanted.select("set").distinct(), "set", "left_semi").persist()
    counts = listed.groupBy("set").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("n") >= k, F.col("place"))).over(Window.partitionBy("query_id"))
    wanted = wanted.join(counts, "set").withColumn("best", best).where("best is null or place >= best")
    order = Window.partitionBy("set").orderBy("name")
    singles_and_pairs = listed.where("size(split(set, '_')) < 3").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    return wanted.select("query_id", "set"), singles_and_pairs.unionByName(listed.where("size(split(set, '_')) = 3"))


def _by_frequent(frequent: DataFrame, tagged: DataFrame, k: int) -> DataFrame:
    """(query_id, name, held) of ``_frequent_lists``."""
    wanted, lists = _frequent_lists(frequent, tagged, k)
    return dealt(wanted, "set").join(lists, "set").select("query_id", "name", "held")


def token_arrays(rows: DataFrame, key: str, tokens: str, stats: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Weights and information of each key's tokens, in the order of the tokens."""
    each = rows.select(key, F.posexplode(tokens).alias("at", "token")).join(stats.select("token", "weight", "info"), "token", "left")
    facts = F.struct("at", F.coalesce("weight", F.lit(UNKNOWN_WEIGHT)).alias("w"), F.coalesce("info", F.lit(0.0)).alias("i"))
    gathered = each.groupBy(key).agg(F.array_sort(F.collect_list(facts)).alias("facts"))  # the tokens of one name
    return gathered.select(key, F.col("facts.w").alias(names[0]), F.col("facts.i").alias(names[1]))


class Names:
    """The names of a part, each once and in order: tokens by number (``code``, one row a name, filled up with ``len(tokens)``), their
    weights and information, and the names of each token."""

    def __init__(self, rows: pa.Table, facts: pa.Table):
        order = pc.sort_indices(rows, sort_keys=[("name", "ascending")])
        self.name, self.lists = (rows.column(c).combine_chunks().take(order) for c in ("name", "c"))
        sizes = pc.list_value_length(self.lists).to_numpy()
        flat = self.lists.flatten().dictionary_encode()
        self.tokens = flat.dictionary
        self.filled = np.arange(max(int(sizes.max(initial=0)), 1)) < sizes[:, None]
        self.code = np.full(self.filled.shape, len(self.tokens), np.int64)
        self.code[self.filled] = flat.indices.to_numpy()
        at = pc.fill_null(pc.index_in(facts.column("text").combine_chunks(), value_set=self.tokens), -1).to_numpy()
        self.weight, self.info = (self._of(facts.column(c), at, rest)[self.code] for c, rest in (("w", UNKNOWN_WEIGHT), ("i", 0.0)))
        once = self.filled.copy()  # each token of a name at its first place
        for j in range(1, once.shape[1]):
            once[:, j] &= (self.code[:, :j] != self.code[:, j : j + 1]).all(axis=1)
        codes = self.code[once]
        order = np.argsort(codes, kind="stable")
        self.holders, self.ends = np.nonzero(once)[0][order], np.searchsorted(codes[order], np.arange(len(self.tokens) + 1))

    def _of(self, values: pa.ChunkedArray, at: np.ndarray, rest: float) -> np.ndarray:
        """A value of each token by number, ``rest`` where no name's statistics have it, 0 for what rows are filled up with."""
        out = np.full(len(self.tokens) + 1, rest)
        out[at[at >= 0]] = values.combine_chunks().flatten().to_numpy()[at >= 0]
        out[-1] = 0.0
        return out

    def listed(self, values: np.ndarray, rows: np.ndarray) -> pa.ListArray:
        """Values of the tokens of some names, a list for each name."""
        filled = self.filled[rows]
        return pa.ListArray.from_arrays(pa.array(np.append(0, filled.sum(axis=1).cumsum()), pa.int32()), pa.array(values[rows][filled]))


#: What a row for a part of the names says: readings of a query token, a query, a name that another strategy brings to a query, what is known of a token.
_READS, _QUERY, _BROUGHT, _FACT = range(4)
_SAID = (("text", "string"), ("tokens", "array<string>"), ("numbers", "array<bigint>"), ("w", "array<double>"), ("i", "array<double>"))
#: A priority that no strategy has.
_NONE = 9


class _Part:
    """What a block of queries finds among the names of a part."""

    def __init__(self, left: pa.Table, right: pa.Table):
        kind = left.column("kind").to_numpy()
        of = lambda k: left.take(pa.array(np.flatnonzero(kind == k)))
        self.names, self.queries = Names(right, of(_FACT)), of(_QUERY)
        numbers = dict(zip(self.names.tokens.to_pylist(), range(len(self.names.tokens)), strict=True))
        reads = of(_READS)
        self.reads = {t: [(numbers[x], p) for x, p in zip(tokens, first, strict=True) if x in numbers] for t, tokens, first in zip(*(reads.column(c).to_pylist() for c in ("text", "tokens", "numbers")), strict=True)}
        self.met: dict[str, tuple] = {}
        brought = of(_BROUGHT)
        rows = pc.index_in(brought.column("text").combine_chunks(), value_set=self.names.name).to_pylist() if brought.num_rows else []
        self.brought: dict = {}
        for query, row, (first,) in zip(brought.column("query_id").to_pylist(), rows, brought.column("numbers").to_pylist(), strict=True):
            self.brought.setdefault(query, []).append((row, first))
        self.support, self.first = np.zeros(len(self.names.name), np.int64), np.full(len(self.names.name), _NONE, np.int8)

    def _names_of(self, token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The names that hold readings of a query token: (row, readings that it holds, least priority)."""
        if token not in self.met:
            read, ends, holders = self.reads.get(token, ()), self.names.ends, self.names.holders
            key = np.sort(np.concatenate([np.empty(0, np.int64), *(holders[ends[c] : ends[c + 1]] * 16 + p for c, p in read)]))
            start = np.flatnonzero(np.diff(key >> 4, prepend=-1))
            self.met[token] = (key[start] >> 4).astype(np.int32), np.diff(start, append=len(key)).astype(np.int16), (key[start] & 15).astype(np.int8)
        return self.met[token]

    def found(self, query, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the names found, in order, their places: less comes first)."""
        for token in tokens:
            rows, held, first = self._names_of(token)
            self.support[rows] += held
            self.first[rows] = np.minimum(self.first[rows], first)
        for row, first in self.brought.get(query, ()):
            self.first[row] = min(self.first[row], first)
        rows = np.flatnonzero(self.first < _NONE)
        place = self.first[rows] - 16 * self.support[rows]
        self.support[rows], self.first[rows] = 0, _NONE
        return rows, place


def _count_places(left: pa.Table, right: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """How many names of a part have which place for each query, as far as they may be among its first k."""
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    part, out = _Part(left, right), []
    for query, tokens in zip(part.queries.column("query_id").to_pylist(), part.queries.column("tokens").to_pylist(), strict=True):
        _, place = part.found(query, tokens)
        if len(place):
            counts = np.bincount(place - place.min())
            cells = np.flatnonzero(counts)
            cells = cells[counts[cells].cumsum() - counts[cells] < k]
            out.append((query, (cells + place.min()).tolist(), counts[cells].tolist()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 3, (schema.field(c).type for c in ("query_id", "places", "counts")), strict=True)] + [pa.array(np.full(len(out), left.column(c)[0].as_py()), schema.field(c).type) for c in ("part", "block")], schema=schema)


def _take_places(left: pa.Table, right: pa.Table, bound: Callable | None, schema: pa.Schema) -> pa.Table:
    """The names of a part that are among each query's first ones, by how many of each place it may take; of these the ones that ``bound`` lets through."""
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    part, out = _Part(left, right), []
    names, queries = part.names, part.queries
    columns = [queries.column(c).to_pylist() for c in ("query_id", "tokens", "numbers", "w", "i")]
    told = bound and bound(names, {t for tokens in columns[1] for t in tokens})
    for at, (query, tokens, takes, w, i) in enumerate(zip(*columns, strict=True)):
        rows, place = part.found(query, tokens)
        picks = [(np.flatnonzero(place == wanted)[:take], before) for wanted, take, before in zip(takes[::3], takes[1::3], takes[2::3], strict=True)]  # in the order of names
        picked = np.concatenate([top for top, _ in picks])
        top, place, ranks = rows[picked], place[picked], np.concatenate([np.arange(before + 1, before + 1 + len(top)) for top, before in picks])
        if told:
            kept = told(tokens, np.array(w, float), np.array(i, float), top)
            top, place, ranks = top[kept], place[kept], ranks[kept]
        out.append((np.full(len(top), at), top, -(place // 16), place % 16, ranks))
    if not out:
        return schema.empty_table()
    query, rows, *numbers = (np.concatenate(c) for c in zip(*out, strict=True))
    asked = queries.take(pa.array(query))
    columns = {"query_id": asked.column("query_id"), "name": names.name.take(pa.array(rows)), **dict(zip(("support", "priority", "rank"), map(pa.array, numbers), strict=True))}
    if bound:
        columns |= {"needle": asked.column("text"), "q": asked.column("tokens"), "qw": asked.column("w"), "qi": asked.column("i")}
        columns |= {"c": names.lists.take(pa.array(rows)), "cw": names.listed(names.weight, rows), "ci": names.listed(names.info, rows)}
    return pa.table([columns[c].cast(schema.field(c).type) for c in schema.names], schema=schema)


def ranked_names(one: DataFrame, registry: DataFrame, stats: DataFrame, k: int, bound: Callable | None = None) -> DataFrame:
    """(query_id, name, support, priority, rank) of the first k names of each of the distinct queries ``one`` (query_id, query, needle).

    Names are dealt out in order over parts of about PART_NAMES, and each block of BLOCK_QUERIES queries meets each part: a query's
    readings are looked up among a part's tokens, and support and priority summed in arrays. No name is copied for a query. First
    every part says how many of its names have which support and priority; a running sum over these counts, the parts in order, says how
    many of each a part gives to a query's first k; then the parts give just these. ``bound`` is told a part's names and the
    query tokens, then the names that each query takes; of those that it lets through needle, q, qw, qi, c, cw and ci are given too.
    """
    spark = one.sparkSession
    one = one.persist()  # a row a query
    blocks = max(1, -(-one.count() // BLOCK_QUERIES))
    names = registry.count()
    parts = max(-(-names // PART_NAMES), min(2 * spark.sparkContext.defaultParallelism, -(-names // LEAST_NAMES)), 1)
    # Both rounds have to see the same parts.
    indexed = stored(registry.select("name", tokens_of().alias("c")).repartitionByRange(parts, "name").withColumn("part", F.spark_partition_id()), "names")
    parts = (indexed.agg(F.max("part")).first()[0] or 0) + 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    every_part, every_block = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
    kind = one.schema["query_id"].dataType

    def said(rows: DataFrame, sort: int, **columns: Column) -> DataFrame:
        query = F.col("query_id") if sort in (_QUERY, _BROUGHT) else F.lit(None)
        return rows.select("part", "block", F.lit(sort).alias("kind"), query.cast(kind).alias("query_id"), *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in _SAID))

    read = readings(one, stats).groupBy("qtoken").agg(F.collect_list("token").alias("tokens"), F.collect_list("priority").alias("first"))  # READINGS at most
    read = query_tokens(one).select(block, "qtoken").distinct().join(read, "qtoken").persist()
    brought = templates_for(one, registry).withColumn("first", F.lit(0)).unionByName(containing(one, registry).withColumn("first", F.lit(4))).join(indexed.select("name", "part"), "name").select("*", block)
    shared = said(read.select("*", every_part), _READS, text=F.col("qtoken"), tokens=F.col("tokens"), numbers=F.col("first")).unionByName(said(brought, _BROUGHT, text=F.col("name"), numbers=F.array("first"))).persist()
    own = one.select("query_id", "needle", tokens_of("query").alias("q"), block)
    none = F.array().cast("array<double>")
    own = own.join(token_arrays(own, "query_id", "q", stats, ("qw", "qi")), "query_id", "left").select("query_id", "needle", "q", F.coalesce("qw", none).alias("qw"), F.coalesce("qi", none).alias("qi"), "block").persist()
    names = indexed.select("part", every_block, "name", "c")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parts * blocks)
    met = lambda rows: rows.repartition(groups, "part", "block").groupBy("part", "block").cogroup(names.repartition(groups, "part", "block").groupBy("part", "block"))

    counts = T.StructType([T.StructField("query_id", kind), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType())])
    arrow_counts = to_arrow_schema(counts)
    asked = said(own.select("*", every_part), _QUERY, tokens=F.col("q"))
    counted = met(shared.unionByName(asked)).applyInArrow(lambda a, b: _count_places(a, b, k, arrow_counts), counts)
    cells = counted.select("query_id", "part", "block", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("counts").alias("n"))))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    takes = cells.withColumn("before", before).where(F.col("before") < k).groupBy("query_id", "part", "block").agg(F.flatten(F.collect_list(F.array("place", F.least("n", k - F.col("before")), "before"))).alias("takes"))  # places of a part

    made = [T.StructField("query_id", kind), T.StructField("name", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("support", "priority", "rank"))]
    asked = said(takes.join(own.drop("block"), "query_id"), _QUERY, text=F.col("needle"), tokens=F.col("q"), numbers=F.col("takes"), w=F.col("qw"), i=F.col("qi"))
    if bound:
        texts, numbers = T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())
        made += [T.StructField("needle", T.StringType()), *(T.StructField(c, t) for s in "qc" for c, t in ((s, texts), (f"{s}w", numbers), (f"{s}i", numbers)))]
        held = indexed.select("part", F.explode("c").alias("token")).distinct().join(stats.select("token", "weight", "info"), "token")
        asked = asked.unionByName(said(held.select("*", every_block), _FACT, text=F.col("token"), w=F.array("weight"), i=F.array("info")))
    schema = T.StructType(made)
    arrow = to_arrow_schema(schema)
    return met(shared.unionByName(asked)).applyInArrow(lambda a, b: _take_places(a, b, bound, arrow), schema)


def shortlist_topk(queries: DataFrame, registry: DataFrame, stats: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """The k names of each query that most of its token readings are found in.

    Strategies are united, none cuts another short: readings of tokens, fixed text of templates, and
    for short queries names that contain them. A name's priority is its best strategy's (templates 0,
    containing names 4), its support the number of readings found in it. Names for rare tokens are
    there through those tokens' own readings. Equal queries are worked out once, ``ranked_names`` says how.
    ``queries`` may have a ``needle``, the text as it was asked.
    """
    if "needle" not in queries.columns:
        queries = queries.withColumn("needle", F.col("query"))
    queries = queries.withColumn("needle", F.coalesce("needle", "query"))
    one = queries.groupBy("query", "needle").agg(F.min("query_id").alias("query_id")).persist()
    first = ranked_names(one, searchable(registry), stats, k)
    equal = queries.select(F.col("query_id").alias("own_id"), "query", "needle").join(one, ["query", "needle"]).select("query_id", "own_id")
    equal = F.broadcast(equal) if queries.count() <= FEW else equal
    return first.join(equal, "query_id").select(F.col("own_id").alias("query_id"), "name", "support", "priority", "rank")


def searchable(registry: DataFrame) -> DataFrame:
    """The names that are neither too short nor of too many tokens to be searched."""
    return registry.where((F.size(tokens_of()) <= MOST_TOKENS) & (F.length("name") >= LEAST_CHARS))
