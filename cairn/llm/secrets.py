"""Operator 3, secret scans: multipart credentials linked by an interval join. DataFrame only.

Spans are ``struct<start, end, kind>``, code points, end exclusive. Base kinds, in this order:

    assign  a secret word, ``=`` or ``:``, and a value of 6 characters or more
    access  an access identifier of 20 characters or more
    hex     24 lower-case hexadecimal digits or more

They are always reported. Weak kinds are found beside them and reported only together:

    key           a lone word of exactly 40 base-64 characters that has digits and both cases
    login         a user, client or account word, ``=`` or ``:``, and a value of 3 characters or more
    endpoint      a URL, or a host name with a database or service scheme
    short_assign  what is an assign but for a value of 1 to 5 characters
    short_access  what is an access identifier but for 8 to 19 characters
    short_hex     16 to 23 lower-case hexadecimal digits

Each part has a role: it identifies (access, short_access, login), it proves (assign, short_assign,
hex, short_hex, key) or it locates (endpoint). A scope is a stretch of text without a blank line (one
of spaces, tabs and carriage returns is blank). A weak part is reported if a part of another role,
base or weak, starts in the same scope, however far away: an interval join of parts with scopes. Parts
and scope ends of a text are sorted together by start, so a scope's parts are a slice of that array:
the join is linear in the parts and emits no pairs. Parts come from one text only, so nothing is
shuffled and a hot key or source costs nothing extra.

Odd rows: a null or empty text has no spans; repeated rows give repeated results; equal texts have
equal spans; other columns cannot clash, as results are built in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import text_or_empty


def _either_case(words: str) -> str:
    """A pattern that takes the ASCII letters of ``words`` in either case, and nothing else for them."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: The base patterns, as the contract of the scan states them.
ASSIGN = rf"""((?:{_either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Weak kinds: our own choice. All patterns mean the same to Java and to RE2.
KEY = r"[A-Za-z0-9+/=_-]{40,}"
LOGIN = rf"""(?:{_either_case("user|username|login|client_id|account|account_id")})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{3,}}"""
ENDPOINT = r"""(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]{4,}"""
BREAK = r"\n[\x20\t\r]*\n"

#: Kinds in the order in which spans of equal start are listed; the first BASE are base kinds.
KINDS = ("assign", "access", "hex", "key", "login", "endpoint", "short_assign", "short_access", "short_hex")
BASE = 3
#: Role of each kind: 0 identifies, 1 proves, 2 locates.
ROLES = {"assign": 1, "access": 0, "hex": 1, "key": 1, "login": 0, "endpoint": 2, "short_assign": 1, "short_access": 0, "short_hex": 1}
#: The number of a scope end among the kinds.
END = len(KINDS)
#: Least size of a kind's matches (of the value of an assign), and of what is short of it.
LEAST = {"assign": (6, 1), "access": (20, 8), "hex": (24, 16), "key": (40, 40), "login": (0, 0), "endpoint": (0, 0), "break": (0, 0)}
SPAN = "struct<start:int,ord:int,end:int,kind:string>"
_NONE = f"array<{SPAN}>"
_BLOCK = 64


def _running(steps: Column) -> Column:
    """Running sums of an array of ints, by blocks, so that long arrays are not copied at each step."""
    total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x)

    def within(values: Column, base: Column) -> Column:
        return F.aggregate(
            values, F.array().cast("array<int>"),
            lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), base))),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    bases = within(F.transform(blocks, total), F.lit(0))
    return F.flatten(F.transform(blocks, lambda block, b: within(block, F.when(b == 0, F.lit(0)).otherwise(F.try_element_at(bases, b)))))


def _spans(kind: str) -> Column:
    """Spans of one kind out of the columns ``<kind>_hits``, ``<kind>_gaps`` and ``<kind>_sizes``.

    ``gaps`` are the lengths of the texts between matches, so a match ends where the gaps and
    matches up to it sum to. Matches that are too small have counted by then and go.
    """
    hits, gaps, sizes = (F.col(f"{kind}_{x}") for x in ("hits", "gaps", "sizes"))
    ends = _running(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: gap + hit))
    spans = F.zip_with(
        F.zip_with(ends, hits, lambda end, hit: F.struct((end - hit).alias("start"), end.alias("end"))), sizes,
        lambda at, size: F.struct(at["start"].alias("start"), at["end"].alias("end"), size.alias("size")),
    )
    least, short = LEAST[kind]

    def named(s: Column) -> Column:
        number, name = F.lit(END if kind == "break" else KINDS.index(kind)), F.lit(kind)
        if short < least:
            number, name = F.when(s["size"] >= least, number).otherwise(F.lit(KINDS.index(f"short_{kind}"))), F.when(s["size"] >= least, name).otherwise(F.lit(f"short_{kind}"))
        return F.struct(s["start"].alias("start"), number.alias("ord"), s["end"].alias("end"), name.alias("kind"))

    return F.when(F.size(hits) > 0, F.transform(F.filter(spans, lambda s: s["size"] >= short), named)).otherwise(F.array().cast(_NONE))


def _linked(frame: DataFrame) -> DataFrame:
    """``spans`` out of ``parts`` and ``ends``: base parts, and weak ones with another role in their scope."""
    bit = F.array(*(F.lit(1 << ROLES[k]) for k in KINDS))
    weak = F.exists("parts", lambda p: p["ord"] >= BASE)
    # Only texts that have a weak part are joined; sorted, the scope ends cut the parts into scopes.
    frame = frame.withColumn("sorted", F.when(weak, F.array_sort(F.concat("parts", "ends"))))
    size = F.size("sorted")
    frame = frame.withColumn(
        "cuts", F.when(F.col("sorted").isNotNull(), F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.col("sorted")[i]["ord"] == END), F.array(size)))
    )
    scope = lambda k: F.slice("sorted", F.col("cuts")[k] + 2, F.col("cuts")[k + 1] - F.col("cuts")[k] - 1)
    frame = frame.withColumn("scopes", F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), scope))
    roles = lambda parts: F.aggregate(parts, F.lit(0), lambda mask, p: mask.bitwiseOR(bit[p["ord"]]))
    frame = frame.withColumn("scopes", F.transform("scopes", lambda parts: F.struct(roles(parts).alias("roles"), parts.alias("parts"))))
    kept = F.transform("scopes", lambda s: F.filter(s["parts"], lambda p: (p["ord"] < BASE) | (s["roles"] != bit[p["ord"]])))
    return frame.withColumn("spans", F.when(F.col("sorted").isNull(), F.col("parts")).otherwise(F.flatten(kept)))


def scan_secrets(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``keep`` columns of each row (the id by default) and ``spans``, sorted by start, then kind.

    With ``with_text`` the text follows as ``scanned_text``. ``spans`` is built in stages of plain
    projections: what a stage reads several times is worked out once below it.
    """
    keep = keep if keep is not None else ["doc_id"]
    row = F.struct(*(F.col(c) for c in keep)).alias("row")
    text = F.col("text")
    signed = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    rules = {
        "assign": (ASSIGN, signed),
        "access": (ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": (HEX, F.lit(True)),
        "key": (KEY, F.lit(True)),
        "login": (LOGIN, signed),
        "endpoint": (ENDPOINT, F.contains(text, F.lit("://"))),
    }
    none, no_ints = F.array().cast("array<string>"), F.array().cast("array<int>")
    frame = docs.select(row, text_or_empty(text_col).alias("text"))
    frame = frame.select("row", "text", *(F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(k) for k, (p, may) in rules.items()))
    found = sum((F.size(k) for k in rules), F.lit(0)) > 0
    frame = frame.withColumn("break", F.when(found, F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))).otherwise(none))
    columns = ["row", "text"]
    for kind, pattern in [*((k, p) for k, (p, _) in rules.items()), ("break", BREAK)]:
        some, lengths = F.size(kind) > 0, lambda x: F.transform(x, F.length)
        sizes = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else F.col(kind))
        if kind == "key":
            whole = lambda w: (F.length(w) == 40) & w.rlike("^[A-Za-z0-9+/]*$") & w.rlike("[0-9]") & w.rlike("[a-z]") & w.rlike("[A-Z]")
            sizes = F.transform(F.col(kind), lambda w: F.when(whole(w), 40).otherwise(0))
        columns += [
            F.when(some, lengths(F.col(kind))).otherwise(no_ints).alias(f"{kind}_hits"),
            F.when(some, lengths(F.split(text, pattern, -1))).otherwise(no_ints).alias(f"{kind}_gaps"),
            F.when(some, sizes).otherwise(no_ints).alias(f"{kind}_sizes"),
        ]
    frame = frame.select(*columns)
    frame = frame.select("row", "text", F.array_sort(F.concat(*(_spans(k) for k in rules))).alias("parts"), _spans("break").alias("ends"))
    return _linked(frame).select("row.*", "spans", *([text.alias("scanned_text")] if with_text else []))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    base = F.filter(F.col("spans"), lambda s: s["ord"] < BASE)
    count = lambda i: F.size(F.filter(F.col("spans"), lambda s: s["ord"] == i)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter(F.col("spans"), lambda s: s["ord"] >= BASE)).cast("long").alias("n_weak"),
    )


#: Characters of a stretch of text, and spans of a block, that redaction looks at together.
STRETCH, BLOCK = 512, 128


def stretches(text: Column) -> Column:
    """A text in stretches of STRETCH characters: a cut in it then costs one stretch, not the way from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def redacted(parts: str, length: Column, spans: str) -> Column:
    """The text whose stretches are in ``parts`` with every span, overlapping ones as one, replaced by its kind in brackets.

    Spans are worked off in blocks, so that what has been put out so far is copied once a block and not once a span.
    """
    stretch = lambda at: F.floor(at / STRETCH).cast("int")

    def cut(start: Column, end: Column) -> Column:
        inside = F.transform(F.sequence(stretch(start), stretch(end - 1)), lambda k: F.substring(F.col(parts)[k], F.greatest(start - k * STRETCH, F.lit(0)) + 1, F.least(end - k * STRETCH, F.lit(STRETCH)) - F.greatest(start - k * STRETCH, F.lit(0))))
        return F.when(end > start, F.array_join(inside, "")).otherwise(F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(F.concat(cut(acc["at"], s["start"]), mark))).alias("out"))

    def of_block(done: Column, b: Column) -> Column:
        start = F.struct(F.element_at(done, -1)["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        block = F.aggregate(F.slice(F.col(spans), b * BLOCK + 1, BLOCK), start, step, lambda acc: F.struct(acc["at"].alias("at"), F.array_join(acc["out"], "").alias("text")))
        return F.concat(done, F.array(block))

    first = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("text")))
    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    every = F.aggregate(blocks, first, of_block, lambda done: F.concat(F.array_join(F.transform(done, lambda d: d["text"]), ""), cut(F.element_at(done, -1)["at"], length)))
    return F.when(F.size(spans) > 0, every).otherwise(F.array_join(F.col(parts), ""))


def redact(scanned: DataFrame, name: str = "text") -> DataFrame:
    """``scanned`` (with ``scanned_text`` and ``spans``) with the redacted text as ``name``."""
    staged = scanned.withColumn("stretches", stretches(F.col("scanned_text")))
    return staged.withColumn(name, redacted("stretches", F.length("scanned_text"), "spans")).drop("stretches")
