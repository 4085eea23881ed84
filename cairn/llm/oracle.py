"""SQL, as DuckDB runs it, of the operators whose whole result SQL can express."""

from __future__ import annotations

from cairn.llm import secrets

WHITE = r"[\x20\x09-\x0D]+"


def near_dedup_sql() -> str:
    """Every pair of documents that share a shingle, by exact sets; components by reaching."""
    return rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WHITE}'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS lo, b.doc_id AS hi FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
    SELECT lo AS x, hi AS y FROM links UNION ALL SELECT hi, lo FROM links
), reached AS (
    SELECT doc_id AS node, doc_id AS root FROM sets
    UNION
    SELECT y, root FROM reached JOIN edges ON x = node WHERE root < y
), component AS (
    SELECT node, min(root) AS root FROM reached GROUP BY node
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept FROM sets JOIN component ON node = doc_id
"""


def secret_scan_sql() -> str:
    """Spans of every kind from matches and the texts between them; weak ones by roles in their scope."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "key": secrets.KEY, "login": secrets.LOGIN, "endpoint": secrets.ENDPOINT, "break": secrets.BREAK}
    hits = []
    for kind, pattern in patterns.items():
        p, least = quoted(pattern), secrets.LEAST[kind]
        size = {"assign": "length(v[i])", "key": "CASE WHEN length(m[i]) = 40 AND regexp_full_match(m[i], '[A-Za-z0-9+/]*') AND regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]') THEN 40 ELSE 0 END"}.get(kind, "length(m[i])")
        group = 2 if kind == "assign" else 0
        hits.append(f"""
    SELECT r, '{kind}' AS base, {size} AS size, {least[0]} AS least, {least[1]} AS short, length(m[i]) AS n,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS stop
    FROM (SELECT r, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, {group}) AS v FROM texts) found, unnest(range(1, len(m) + 1)) AS u(i)""")
    order = ", ".join(f"'{k}'" for k in secrets.KINDS)
    roles = " ".join(f"WHEN '{k}' THEN {role}" for k, role in secrets.ROLES.items())
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord){}, '')"
    return f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), hits AS ({' UNION ALL '.join(hits)}
), parts AS (
    SELECT r, CASE WHEN size < least THEN 'short_' || base ELSE base END AS kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM hits WHERE size >= short AND base <> 'break'
), scoped AS (
    SELECT p.*, list_position([{order}], kind) AS ord, CASE kind {roles} END AS role,
        (SELECT count(*) FROM hits h WHERE h.r = p.r AND h.base = 'break' AND h.stop - h.n < p.start) AS scope
    FROM parts p
), kept AS (
    SELECT * FROM scoped s WHERE ord <= {secrets.BASE} OR EXISTS (SELECT 1 FROM scoped o WHERE o.r = s.r AND o.scope = s.scope AND o.role <> s.role)
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256({joined.format(f" FILTER (ord <= {secrets.BASE})")}) AS base_sha256, {joined.format("")} AS spans, count(*) FILTER (ord > {secrets.BASE}) AS n_weak
FROM texts LEFT JOIN kept USING (r) GROUP BY r
"""

#: CRC-32 in SQL: the table by the polynomial's rule, then byte by byte over the hex digits of the UTF-8 bytes.
CRC_TABLE = """crc_rows AS (
    SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) AS c FROM range(0, 256) AS u(b)
), crc_table AS MATERIALIZED (
    SELECT list(c ORDER BY b) AS crcs FROM crc_rows
)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; needs ``crcs`` of CRC_TABLE in scope."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i::INTEGER + 1, 2))::BIGINT"
    return f"xor(list_reduce(range(0, octet_length(encode({text}))), lambda c, i: xor(crcs[1 + (xor(c, {byte}) & 255)], c >> 8), 4294967295), 4294967295)"


def vector_codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round of the weighted Lloyd algorithm as two queries over all parts (vectors of one length that ``parts`` divides)."""
    out = [f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), each AS MATERIALIZED (
    SELECT r, vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS part FROM kept, range(0, {parts}) AS u(p)
), book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, part AS entry FROM each WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
)"""]  # fmt: skip
    near = "(SELECT r, p, any_value(part) AS part, arg_min(k, [d, k]) AS k, min(d) AS d FROM (SELECT r, p, part, k, list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i])))::BIGINT AS d FROM each JOIN book{n} USING (p)) x GROUP BY r, p)"
    for n in range(rounds):
        out.append(f"""book{n + 1} AS MATERIALIZED (
    SELECT b.p, b.k, coalesce(m.entry, b.entry) AS entry FROM book{n} b LEFT JOIN (
        SELECT p, k, list(x ORDER BY i) AS entry FROM (
            SELECT p, k, i, ((sum(part[i])::BIGINT - (sum(part[i])::BIGINT % count(*) + count(*)) % count(*)) // count(*)) AS x FROM {near.format(n=n)} a, (SELECT unnest(range(1, max(len(part)) + 1)) AS i FROM each) w GROUP BY p, k, i
        ) y GROUP BY p, k
    ) m ON m.p = b.p AND m.k = b.k
)""")  # fmt: skip
    return f"""
WITH {', '.join(out)}, coded AS MATERIALIZED {near.format(n=rounds)}, summed AS (
    SELECT r, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM coded GROUP BY r
), books AS (
    SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, k)) AS digest FROM book{rounds}
), labels AS (
    SELECT label, sum(error)::BIGINT AS label_error FROM summed JOIN kept USING (r) GROUP BY label
)
SELECT vec_id, code, error, label_error, digest AS codebooks_sha256 FROM kept JOIN summed USING (r) JOIN labels ON kept.label IS NOT DISTINCT FROM labels.label, books
"""


def resampling_sql(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> str:
    """Single words as features: counts, dictionary, gains, weights and the draw."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+'), lambda x: x <> '')"
    return f"""
WITH {CRC_TABLE}, texts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents
), counts AS MATERIALIZED (
    SELECT r, feature, count(*) AS n FROM (SELECT r, unnest(w) AS feature FROM texts) x GROUP BY r, feature
), target AS (
    SELECT unnest({words}) AS feature FROM benchmark
), dictionary AS MATERIALIZED (
    SELECT feature, s, t, {crc32_sql('feature')} % {buckets} AS bucket FROM (
        SELECT feature, sum(s) AS s, sum(t) AS t FROM (SELECT feature, n AS s, 0 AS t FROM counts UNION ALL SELECT feature, 0, 1 FROM target) u GROUP BY feature
    ) y, crc_table
), gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (SELECT coalesce(sum(s), 0) + {buckets} FROM dictionary) / ((sum(s) + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + {buckets} FROM dictionary))))::BIGINT AS gain
    FROM dictionary GROUP BY bucket
), weights AS (
    SELECT r, sum(n * gain)::BIGINT AS weight FROM counts JOIN dictionary USING (feature) JOIN gains USING (bucket) GROUP BY r
), scored AS (
    SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {least_words} AS eligible,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (r)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN eligible AND place <= (SELECT {percent} * count(*) // 100 FROM scored WHERE eligible) THEN place END AS rank FROM ranked
"""
