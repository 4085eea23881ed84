"""Command line over a folder of rule texts and, if given, folders of scripts.

    python -m cairn.cli --rules DIR [--data NAME=DIR ...] VERB ...

    list                         the rule documents
    search QUERY [--type T] [--limit N]
    get TARGET                   definitions of a name or an id, with their source
    text TERM [--limit N]        lines of the scripts that hold a term
    validate FILE [--schema S | --kind K] [--scope S] [--mode body|file]
    doctor                       what was read from where
    verify                       whether every rule text parses and is the sum of its tokens

Results are JSON lines. The exit code is 2 where nothing was found or something is unknown, else 0.
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import harvest, lookup, snapshots, textsearch
from cairn.operators.registry import token_stats
from cairn.operators.rulebook import RuleBook
from cairn.operators.rules import overridden, LEAST_FIXED, template_rows
from cairn.operators.validate import validate
from cairn.sources.tables import text_tree

SYMBOLS = "name string, type string, kind string, origin string, path string, line int, end_line int, id string, source string"


class Workspace:
    """Rules, scripts and what is declared in both."""

    def __init__(self, spark: SparkSession, rules: str, data: dict[str, str]):
        self.spark = spark
        self.rules = text_tree(spark, rules, "*.cwt")
        self.book = RuleBook({r["rel_path"]: r["text"] for r in self.rules.select("rel_path", "text").collect()})  # bounded by the book
        trees = [text_tree(spark, folder).select(F.lit(name).alias("source"), F.lit(i).alias("priority"), "rel_path", "text") for i, (name, folder) in enumerate(data.items())]
        none = spark.createDataFrame([], "source string, priority int, rel_path string, text string")
        self.scripts = reduce(DataFrame.unionByName, trees, none)
        self.declared = harvest.directory_rules(spark, self.book)
        self.files = harvest.parsed_files(self.scripts, self.declared)
        found = harvest.definitions_of(self.files, self.declared, harvest.subtype_rules(spark, self.book))
        # Of several sources that define an object the last one counts.
        self.definitions = overridden(found, ["type", "name"], ["priority", "rel_path", "line"])

    def symbols(self) -> DataFrame:
        rows = [(n, k, k, "rules", d.removesuffix(".cwt"), a, b, f"{d}:{a}", text) for n, k, d, a, b, text in self.book.public_names()]
        own = self.spark.createDataFrame(rows, SYMBOLS)
        place = F.concat_ws(":", "source", "rel_path", "line")
        data = self.definitions.select("name", "type", "type", F.lit("data"), "rel_path", "line", F.lit(None).cast("int"), place, F.lit(None).cast("string")).toDF(*own.columns)
        return own.unionByName(data)

    def templates(self) -> list[str]:
        names = {n for n, *_ in self.book.public_names()}
        return [row[0] for row in template_rows(sorted(names)) if row[3] >= LEAST_FIXED]


def _search(work: Workspace, args) -> DataFrame:
    lookup.is_safe_query(args.query, args.limit)
    selected = work.book.resolve_type(args.type)
    if selected["status"] in ("UNKNOWN_TYPE", "AMBIGUOUS_TYPE"):
        return work.spark.createDataFrame([(selected["status"], selected["candidates"])], "status string, candidates array<string>")
    symbols = lookup.accepted(work.symbols(), selected).persist()
    stats = token_stats(symbols.select(F.lower("name").alias("name")).distinct())
    asked = work.spark.createDataFrame([(1, args.query)], "query_id long, query string")
    return lookup.search(asked, symbols, work.templates(), stats, args.limit).orderBy(F.desc("tier"), "rank")


def _get(work: Workspace, args) -> DataFrame:
    targets = work.spark.createDataFrame([(1, args.target)], "target_id int, target string")
    found = lookup.get_definitions(targets, work.symbols())
    return lookup.same_text(found.withColumn("key", F.monotonically_increasing_id()), ["source"], "key").drop("key")


def _text(work: Workspace, args) -> DataFrame:
    folder = F.regexp_replace("rel_path", "/[^/]*$", "")
    docs = work.scripts.select("source", folder.alias("folder"), F.concat_ws(":", "source", "rel_path").alias("file"), "text")
    return textsearch.text_search(docs, args.term, args.limit, ("source", "folder"), "file").orderBy("place")


def _validate(work: Workspace, args) -> DataFrame:
    with open(args.file, encoding="utf-8") as script:
        scripts = work.spark.createDataFrame([(args.file, script.read())], "doc string, text string")
    members = harvest.enum_members(work.files, work.declared, harvest.complex_enum_sources(work.book))
    return validate(scripts, work.book, work.definitions.select("type", "name"), members=members, schema=args.schema, kind=args.kind, scope=args.scope, mode=args.mode).orderBy("line", "node_id")


VERBS = {
    "list": lambda work, args: work.rules.select("rel_path", "length").orderBy("rel_path"),
    "search": _search,
    "get": _get,
    "text": _text,
    "validate": _validate,
    "doctor": lambda work, args: lookup.describe_sources(work.scripts, work.definitions, harvest.file_errors(work.files)),
    "verify": lambda work, args: snapshots.verified_files(work.rules.select(F.col("rel_path").alias("path"), F.col("text").alias("content"))),
}
#: What makes the exit code 2.
_BAD = ("UNKNOWN", "UNRESOLVED", "NOT_FOUND", "BAD_TARGET", "UNKNOWN_TYPE", "AMBIGUOUS_TYPE", "FAILED", "CHANGED")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cairn")
    parser.add_argument("--rules", required=True)
    parser.add_argument("--data", action="append", default=[], metavar="NAME=DIR")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in VERBS:
        verb = verbs.add_parser(name)
        if name in ("search", "text"):
            verb.add_argument("query" if name == "search" else "term")
            verb.add_argument("--limit", type=int, default=20)
        if name == "search":
            verb.add_argument("--type")
        if name == "get":
            verb.add_argument("target")
        if name == "validate":
            verb.add_argument("file")
            for option in ("--schema", "--kind", "--scope"):
                verb.add_argument(option)
            verb.add_argument("--mode", default="body", choices=("body", "file"))
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("cairn").getOrCreate()
    work = Workspace(spark, args.rules, dict(d.partition("=")[::2] for d in args.data))
    lines = [row["json"] for row in snapshots.as_json(VERBS[args.verb](work, args)).collect()]  # what a person reads
    for line in lines:
        print(line)
    nothing = not lines and args.verb in ("search", "get", "text")
    return 2 if nothing or any(f'"{key}":"{word}"' in line for line in lines for key in ("status", "state") for word in _BAD) else 0


if __name__ == "__main__":
    sys.exit(main())
