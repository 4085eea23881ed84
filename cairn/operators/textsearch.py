"""Full-text line search, call sites, paragraphs, fingerprints and evidence folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.tables import lines, stored


def text_search(docs: DataFrame, term: str, limit: int = 20, group: tuple[str, ...] = ("lang", "source"), file: str = "doc_id") -> DataFrame:
    """Lines that hold the term (any case): the densest files of the densest groups in turn.

    A group's density is hits / sqrt(lines) over all its files. Files are taken round-robin over the
    groups, then rows round-robin over the files; each time up to ``limit``. Counting is one grouped
    aggregate; texts are joined back for the chosen files alone.
    """
    rows = lines(docs, (*group, file)).withColumn("hit", F.contains(F.lower("txt"), F.lit(term.lower())).cast("int"))
    files = rows.groupBy(*group, file).agg(F.sum("hit").alias("hits"), F.count("*").alias("n_lines"))
    groups = files.groupBy(*group).agg(F.sum("hits").alias("g_hits"), F.sum("n_lines").alias("g_lines")).where("g_hits > 0")
    total = groups.agg(F.sum("g_hits").alias("total"))
    best = [F.desc(F.col("g_hits") / F.sqrt("g_lines")), F.desc("g_hits"), *group]
    # Only as many groups as there are rows to give can take part; they are found before they are numbered.
    groups = groups.orderBy(*best).limit(limit).withColumn("g", F.row_number().over(Window.orderBy(*best)))
    f = Window.partitionBy(*group).orderBy(F.desc(F.col("hits") / F.sqrt("n_lines")), F.desc("hits"), file)
    ranked = files.where("hits > 0").withColumn("f", F.row_number().over(f)).where(F.col("f") <= limit)
    ranked = ranked.join(F.broadcast(groups), list(group))  # limit rows
    chosen = ranked.orderBy("f", "g").limit(limit).withColumn("fo", F.row_number().over(Window.orderBy("f", "g")))
    opened = docs.join(F.broadcast(chosen.select(file, "fo")), file)  # ``limit`` files: no other is cut into lines again
    hits = lines(opened, (*group, file, "fo")).where(F.contains(F.lower("txt"), F.lit(term.lower())))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy(file).orderBy("line"))).where(F.col("r") <= limit).orderBy("r", "fo").limit(limit)
    place = F.row_number().over(Window.orderBy("r", "fo")).cast("bigint")
    text = F.trim("txt")
    shown = F.when(F.length(text) > 110, F.concat(F.rtrim(F.substring(text, 1, 109)), F.lit("…"))).otherwise(text)
    return hits.crossJoin(F.broadcast(total)).select(place.alias("place"), *group, file, "line", shown.alias("snippet"), F.col("total").cast("bigint").alias("total"))  # one row


def running_total(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``before``: the sum of ``size`` over all rows that come before in ``order``, whose values are distinct.

    Rows are sorted by ranges; a range's own sums are a window over it, and the ranges before it come to one number
    each, so no task sees all rows.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "running-total")
    sums = ranged.groupBy("range").agg(F.sum(size).alias("n"))
    bases = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))  # a row a partition
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("own", F.coalesce(F.sum(size).over(own), F.lit(0))).join(F.broadcast(bases), "range").withColumn("before", F.col("base") + F.col("own")).drop("own", "base", "range")


def budgeted(files: DataFrame, budget: int, directory: str = "directory", path: str = "path", size: str = "size") -> DataFrame:
    """``files`` with ``round`` and ``scanned``: directories give one file each a round, in order of their paths, until
    files of ``budget`` altogether have been opened. ``files`` need no contents."""
    rounds = files.withColumn("round", F.row_number().over(Window.partitionBy(directory).orderBy(path)).cast("bigint"))
    return running_total(rounds, ["round", directory, path], size).withColumn("scanned", F.col("before") < budget).drop("before")


def budgeted_search(docs: DataFrame, term: str, budget: int, directory: str = "source", path: str = "doc_id", limit: int = 20) -> DataFrame:
    """Files with lines that hold the term, found within a budget of characters, and what that leaves open.

    ``truncated``: some files were not opened. ``matched_at_least``: hits in those that were; ``total``: all hits, null
    where files were not opened; ``has_more``: whether more files than ``limit`` have hits, or may have. Only the contents
    of opened files are searched.
    """
    sized = budgeted(docs.select(directory, path, F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size")), budget, directory, path)
    opened = docs.select(path, "text").join(sized.where("scanned").select(directory, path, "round"), path)
    hits = lines(opened, (directory, path, "round")).where(F.contains(F.lower("txt"), F.lit(term.lower()))).groupBy(directory, path, "round").agg(F.count("*").alias("hits"))
    ends = sized.agg(F.max(~F.col("scanned")).alias("truncated")).crossJoin(hits.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("matched_at_least"), F.count("*").alias("n_files")))  # a row each
    first = hits.orderBy("round", directory, path).limit(limit).crossJoin(F.broadcast(ends))
    return first.select(directory, path, "round", "hits", "truncated", "matched_at_least", F.when(~F.col("truncated"), F.col("matched_at_least")).alias("total"), (F.col("truncated") | (F.col("n_files") > limit)).alias("has_more"))


def call_sites(docs: DataFrame, first: int = 3) -> DataFrame:
    """Word-like tokens on lines with an assignment mark: the first places and how many more."""
    marked = lines(docs).where(F.contains("txt", F.lit(":")) | F.contains("txt", F.lit("="))).withColumn("code", F.regexp_replace("txt", "#.*$", ""))
    tokens = marked.select("doc_id", "line", F.posexplode(F.regexp_extract_all(F.lower("code"), F.lit("[a-z_]{3,}"), F.lit(0))).alias("ord", "token"))
    # Counts are partial aggregates, and the window keeps only the first places of a token in each task.
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("token").orderBy("doc_id", "line", "ord")
    ranked = tokens.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= first)
    return ranked.join(counts, "token").select("token", "rank", "doc_id", "line", F.greatest(F.col("n") - first, F.lit(0)).cast("bigint").alias("calls_more"))


def display_names(pages: DataFrame) -> DataFrame:
    """First title of each page, markup stripped, with the smallest key for each text (first wins)."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\$[^$]*\$|&[a-z]+;", ""))
    named = pages.select("page_id", title.alias("value")).where("value <> ''")
    return named.groupBy("value").agg(F.min("page_id").alias("first_key"), F.count("*").alias("n_keys"))


def paragraph_islands(docs: DataFrame) -> DataFrame:
    """Runs of non-blank lines: gaps and islands by a running count of blank lines."""
    order = Window.partitionBy("doc_id").orderBy("line")
    blank = (F.trim("txt") == "").cast("int")
    marked = lines(docs).withColumn("island", F.sum(blank).over(order)).where(blank == 0)
    return marked.groupBy("doc_id", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum(F.length("txt")).alias("chars")).select("doc_id", F.col("island").cast("bigint").alias("island"), "first_line", "last_line", "chars")


def tag_tree(pages: DataFrame) -> DataFrame:
    """Opening and closing tags with depth and parent, from running sums over the tag sequence."""
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("</?(?:html|head|body|div|ul|table|tr)\\b"), F.lit(0))).alias("seq", "tag"))
    step = F.when(F.startswith("tag", F.lit("</")), -1).otherwise(1)
    order = Window.partitionBy("page_id").orderBy("seq")
    placed = tags.withColumn("step", step).withColumn("level", F.sum("step").over(order))
    depth = F.when(F.col("step") == 1, F.col("level")).otherwise(F.col("level") + 1)
    placed = placed.withColumn("depth", depth).where("step = 1")
    # The parent is the latest tag before that is one level up. Each tag stands once at its own level
    # and once, asking, at the level above: a running last value there answers it.
    at_level = placed.select("page_id", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("asks")), F.struct((F.col("depth") - 1).alias("level"), F.lit(True).alias("asks")))).alias("x"), "seq", "tag", "depth").select("page_id", "x.*", "seq", "tag", "depth")
    levels = Window.partitionBy("page_id", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    found = at_level.withColumn("parent_seq", F.last(F.when(~F.col("asks"), F.col("seq")), ignorenulls=True).over(levels)).where("asks")
    return found.select("page_id", F.col("seq").cast("bigint").alias("seq"), F.substring("tag", 2, 10).alias("tag"), F.col("depth").cast("bigint").alias("depth"), F.coalesce("parent_seq", F.lit(-1)).cast("bigint").alias("parent_seq"))


def source_fingerprint(docs: DataFrame) -> DataFrame:
    """Count and sums of each source: it changes with an added, edited or deleted document."""
    return docs.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("bytes"), F.sum("doc_id").alias("stamp"))


def status_fold(findings: DataFrame) -> DataFrame:
    """Findings of each script by status, and the status that outranks the others."""
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(("UNKNOWN", "UNRESOLVED", "TEMPLATE_MATCH", "CONFIRMED_GAME_DATA", "CONFIRMED_CWT")) for x in (s, i)))
    counts = findings.groupBy("script_id").agg(
        *(F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s.lower()}") for s in ("UNKNOWN", "UNRESOLVED", "CONFIRMED_CWT")), F.min_by("status", rank[F.col("status")]).alias("overall")
    )
    return counts


def snapshot_diff(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """added, removed, changed or unchanged of each path; line ends do not count as a change."""
    plain = lambda d, n: d.select("path", F.sha2(F.regexp_replace("content", "\r\n", "\n"), 256).alias(n))
    both = plain(current, "old").join(plain(incoming, "new"), "path", "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return both.select("path", state.alias("state"))
