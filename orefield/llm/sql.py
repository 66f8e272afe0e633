"""The SQL that gives the rows of those queries that SQL can express: plain statements of the contracts, without the methods."""

from __future__ import annotations

from . import decontamination, licenses, mixing, neardups, secrets, substrings, warc

SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def mixing_sql(weights: tuple[float, ...], cap: float, shapes: tuple[mixing.Shape, ...]) -> str:
    """Schedules of one linear piece each; documents in the order of md5, doc_id and size."""

    def by_rank(values: list[float]) -> str:
        return f"(CASE rank % {len(values)} " + " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in enumerate(values)) + " END)"

    heights = []
    for shape in shapes:
        (_, a), (_, b) = shape
        whole = (a + b) / 2
        heights.append((a / whole, b / whole))
    return f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'z') AS key, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o, len({SPACE_WORDS})::BIGINT AS size FROM documents),
p AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
r AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank, {cap!r}::DOUBLE * source_size AS lim, sum(source_size) OVER () AS all_size FROM p),
w AS (SELECT *, {by_rank([float(w) for w in weights])} AS weight, {by_rank([a for a, _ in heights])} AS a, {by_rank([b for _, b in heights])} AS b FROM r),
l AS (SELECT *, (all_size - coalesce(sum(lim) OVER (ORDER BY lim / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY lim / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, max(CASE WHEN level * weight < lim THEN level END) OVER () AS rate FROM l),
t AS (SELECT *, CASE WHEN rate IS NULL THEN lim ELSE least(lim, rate * weight) END AS target FROM g),
u AS (SELECT *, floor(target)::BIGINT AS goal FROM t),
s AS (SELECT d.*, u.* EXCLUDE (key), coalesce(sum(size) OVER (PARTITION BY d.key ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS rounds FROM d JOIN u ON d.key = u.key),
c AS (SELECT *, least(size, greatest(0, goal - rounds * source_size - start)) AS cut FROM s),
x AS (SELECT *, CASE WHEN rounds > 0 OR cut > 0 THEN start / goal::DOUBLE END AS share FROM c),
y AS (SELECT *, a + sqrt(greatest(a * a + 2 * (b - a) * share, 0)) AS root FROM x)
SELECT doc_id, size, source_size, target, (rounds * size + cut)::BIGINT AS taken, (rounds + CASE WHEN cut > 0 AND 2 * cut >= size THEN 1 ELSE 0 END)::INTEGER AS copies,
CASE WHEN size > 0 AND share IS NOT NULL THEN floor(least(1.0::DOUBLE, CASE WHEN root = 0 THEN 0 ELSE 2 * share / root END) * all_size)::BIGINT END AS position FROM y"""


def substrings_sql(width: int) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SPACE_WORDS} AS ws FROM documents),
v AS (SELECT r, unnest(range(1, len(ws) - {width - 2})) AS k, ws FROM d WHERE len(ws) >= {width}),
h AS (SELECT r, k, sha256(array_to_string(ws[k:k + {width - 1}], ' ')) AS h FROM v),
m AS (SELECT r, k FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, k + o AS pos FROM m CROSS JOIN (SELECT unnest(range({width})) AS o)),
w AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM d),
s AS (SELECT w.r, count(g.r) AS gone, sha256(coalesce(string_agg(x, ' ' ORDER BY w.pos) FILTER (WHERE g.r IS NULL), '')) AS sha FROM w LEFT JOIN g ON w.r = g.r AND w.pos = g.pos GROUP BY w.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(sha, sha256('')) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""


def decontamination_sql(width: int) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LETTER_WORDS} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {LETTER_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(len(ws), {width}) AS n, array_to_string(ws[k:k + {width - 1}], ' ') AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS k FROM i WHERE len(ws) > 0)),
z AS (SELECT DISTINCT n FROM p),
v AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS k, ws FROM d CROSS JOIN z WHERE len(ws) >= n),
f AS (SELECT v.r, v.n, v.k, p.item FROM v JOIN p ON v.n = p.n AND array_to_string(v.ws[v.k:v.k + v.n - 1], ' ') = p.w),
c AS (SELECT r, count(DISTINCT pos) AS hit FROM (SELECT r, unnest(range(k, k + n)) AS pos FROM f) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""


def warc_sql(least: int) -> str:
    """The columns of the contract and the time of capture."""
    return f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS largest FROM p),
f AS (SELECT *, CASE WHEN n >= {least} AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM m)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM f"""


def licenses_sql(phrases: dict[str, str], notices: dict[str, str], threshold: float) -> str:
    """Phrases and short notices word by word; every block against every other notice."""
    sets = {k: sorted(set(licenses.tokens(v))) for k, v in notices.items()}
    runs = phrases | {k: " ".join(licenses.tokens(v)) for k, v in notices.items() if len(sets[k]) < licenses.SHORT}
    string = lambda x: "'" + x + "'"
    named = ", ".join(f"({string(k)}, {string(v)}, {len(v.split())}, {str(k in phrases).lower()})" for k, v in sorted(runs.items()))
    long = {True: [], False: []}
    for k in notices:
        if k not in runs:
            long[len(licenses.tokens(notices[k])) > licenses.STEP].append(k)
    held = [(k, max([licenses.STEP, *(len(licenses.tokens(notices[x])) for x in part)])) for part in long.values() for k in part]
    blocks = ", ".join(f"({string(k)}, [{', '.join(map(string, sets[k]))}], {step})" for k, step in held)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LETTER_WORDS} AS ws FROM documents),
p(label, phrase, n, base) AS (VALUES {named}),
t(label, words, step) AS (VALUES {blocks}),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS k, ws FROM d WHERE len(ws) > 0),
f AS (SELECT r, label, base, k - 1 AS pos FROM w JOIN p ON ws[k] = string_split(phrase, ' ')[1] AND array_to_string(ws[k:k + n - 1], ' ') = phrase),
a AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(pos) FILTER (WHERE base) AS first_word, max(pos) FILTER (WHERE base) AS last_word FROM f GROUP BY r),
b AS (SELECT r, label, words, step, ws, unnest(range(0, len(ws), step)) AS s FROM d CROSS JOIN t WHERE len(list_intersect(ws, words)) >= {threshold!r} * len(words) - 1e-9),
g AS (SELECT r, label, len(list_intersect(ws[s + 1:s + 2 * step], words)) / len(words)::DOUBLE AS share FROM b),
h AS (SELECT r, label, max(share) AS share FROM g GROUP BY r, label HAVING max(share) >= {threshold!r} - 1e-9),
l AS (SELECT r, label, base, 1.0::DOUBLE AS share FROM f UNION ALL SELECT r, label, false, share FROM h),
o AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, max(share) AS score FROM l GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (r) LEFT JOIN o USING (r)"""


def either_case(pattern: str) -> str:
    """Letters outside classes in either case; RE2's own flag would take letters beyond A-Z too."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2 if pattern[at + 1] != "x" else at + 4])
            at += len(out[-1])
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not inside else c)
        at += 1
    return "".join(out)


def secrets_sql(rules: tuple[tuple[str, str, bool, int], ...]) -> str:
    """Matches from left to right, and what lies between them gives their places."""
    parts = []
    for n, (kind, pattern, any_case, least) in enumerate(rules):
        rule = "'" + (either_case(pattern) if any_case else pattern).replace("'", "''") + "'"
        value = f"AND length(regexp_extract(x, {rule}, 2)) >= {secrets.VALUE}" if kind == "assign" else ""
        parts.append(f"SELECT r, {n} AS kind, '{kind}' AS name, s, s + length(x) AS e FROM (SELECT r, ms[k] AS x, list_sum([length(y) FOR y IN ps[1:k]]) + coalesce(list_sum([length(y) FOR y IN ms[1:k - 1]]), 0) AS s FROM "
            f"(SELECT r, ms, regexp_split_to_array(t, {rule}) AS ps, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT r, t, regexp_extract_all(t, {rule}) AS ms FROM d))) WHERE length(x) >= {least} {value}")
    base = ", ".join(f"'{b}'" for b in secrets.BASE)
    span = "name || ':' || s::BIGINT || ':' || e::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE name = '{b}') AS n_{b}" for b in secrets.BASE)}, string_agg({span}, ',' ORDER BY s, kind) FILTER (WHERE name IN ({base})) AS base, string_agg({span}, ',' ORDER BY s, kind) AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{b}, 0)::BIGINT AS n_{b}" for b in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


def neardups_sql(shingle: int, percent: int) -> str:
    """All pairs of distinct sets that share a shingle; then what can be reached. Rows of equal doc_id and text are one document."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
q AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct([array_to_string(ws[k:k + {shingle - 1}], ' ') FOR k IN range(1, greatest(len(ws) - {shingle - 2}, 2))])) END AS sh FROM d),
u AS (SELECT sh, len(sh) AS n, row_number() OVER () AS id FROM (SELECT DISTINCT sh FROM q WHERE len(sh) > 0)),
v AS (SELECT id, n, unnest(sh) AS s FROM u),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM v a JOIN v b ON a.s = b.s AND a.id < b.id AND 100 * b.n >= {percent} * a.n AND 100 * a.n >= {percent} * b.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= {percent} * (n + m - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk(id, other) AS (SELECT id, id FROM u UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a = w.other),
i AS (SELECT u.id, min(doc_id) AS least FROM q JOIN u USING (sh) GROUP BY 1),
k AS (SELECT walk.id, min(least) AS component FROM walk JOIN i ON i.id = walk.other GROUP BY 1)
SELECT doc_id, len(q.sh)::BIGINT AS n_shingles, CASE WHEN len(q.sh) = 0 THEN doc_id ELSE component END AS component_id, doc_id IS NOT DISTINCT FROM CASE WHEN len(q.sh) = 0 THEN doc_id ELSE component END AS kept FROM q LEFT JOIN u USING (sh) LEFT JOIN k USING (id)"""


ORACLE_SQL = {
    "op1_mixing": mixing_sql((1, 2, 3), 3.0, mixing.CURRICULUM),
    "op2_substrings": substrings_sql(substrings.WIDTH),
    "op3_decontamination": decontamination_sql(decontamination.WIDTH),
    "op4_secrets": secrets_sql(secrets.RULES),
    "op5_warc": warc_sql(warc.LEAST),
    "op9_neardups": neardups_sql(3, neardups.PERCENT),
    "op10_licenses": licenses_sql(licenses.PHRASES, licenses.NOTICES, licenses.THRESHOLD),
}
