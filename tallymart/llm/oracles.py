"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

import string

from tallymart.llm import collocations, licenses, reputation, secrets

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _alnum_words(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_alnum_words('text')} AS w FROM documents),
items AS (SELECT * FROM (SELECT item_id, {_alnum_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (
    SELECT DISTINCT item_id, w[i:i + least(13, len(w)) - 1] AS g
    FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i)
),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
probes AS (
    SELECT doc_id, i, n, w[i:i + n - 1] AS g
    FROM lens, d, unnest(range(1, len(w) + 1)) AS t(i) WHERE i + n - 1 <= len(w)
),
hits AS (SELECT doc_id, i, n, item_id FROM probes JOIN win USING (g)),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
),
found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _located(source: str, pattern: str, kind: str, rank: int, keep: str = "true") -> str:
    """Matches of a pattern with their places: lengths of the gaps and matches before them add up."""
    p = _quoted(pattern)
    return f"""
    SELECT doc_id, {rank} AS rank, {_quoted(kind)} AS kind, v, pos, pos + length(v) AS upto FROM (
        SELECT doc_id, vals[i] AS v,
               CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(vals[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
        FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS vals, string_split_regex(text, {p}) AS gaps
              FROM {source}), unnest(range(1, len(vals) + 1)) AS t(i)
    ) WHERE {keep}"""


def _entropy(c: secrets.EntropyClass, rank: int) -> str:
    needs = " AND ".join(f"regexp_matches(v, {_quoted(n)})" for n in c.needs)
    allowed = " AND ".join(f"NOT regexp_matches(v, {_quoted(a)})" for a in secrets.ALLOWED)
    before = f"substr(text, greatest(pos - {secrets.BEFORE}, 0) + 1, pos - greatest(pos - {secrets.BEFORE}, 0))"
    terms = "[" + ", ".join(map(str, c.terms)) + "]"
    return f"""
    SELECT doc_id, {rank} AS rank, '{c.kind}' AS kind, pos + min(k) AS pos, pos + max(k) + {c.window} AS upto FROM (
        SELECT doc_id, pos, k, sum(fresh) OVER (PARTITION BY doc_id, pos ORDER BY k) AS run FROM (
            SELECT doc_id, pos, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id, pos ORDER BY k) + {c.window}
                                  THEN 0 ELSE 1 END AS fresh
            FROM (SELECT doc_id, pos, k, string_split(v[k + 1:k + {c.window}], '') AS chars
                  FROM ({_located("d", c.pattern, c.kind, rank)}) JOIN d USING (doc_id),
                       unnest(range(0, length(v) - {c.window} + 1)) AS t(k)
                  WHERE {needs} AND {allowed} AND NOT regexp_matches({before}, {_quoted(secrets.ALLOWED_BEFORE)}))
            WHERE list_sum(list_transform(list_distinct(chars),
                lambda ch: {terms}[len(list_filter(chars, lambda x: x = ch)) + 1])) <= {c.limit}
        )
    ) GROUP BY doc_id, pos, run"""


def _secrets() -> str:
    assigned = f"length(regexp_extract(v, {_quoted(secrets.ASSIGN)}, 2)) >= {secrets.MIN_ASSIGNED}"
    base = [
        _located("d", secrets.ASSIGN, "assign", 0, assigned), _located("d", "AKIA[A-Z0-9]+", "access", 1, "length(v) >= 20"),
        _located("d", "[0-9a-f]+", "hex", 2, "length(v) >= 24"),
    ]
    added = [_entropy(c, len(base) + i) for i, c in enumerate(secrets.ENTROPY_CLASSES)]
    listed = "string_agg(kind || ':' || pos || ':' || upto, ',' ORDER BY pos, rank)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(base)}),
added AS ({" UNION ALL ".join(added)}),
spans AS (
    SELECT doc_id, rank, kind, pos, upto FROM base
    UNION ALL SELECT doc_id, rank, kind, pos, upto FROM added a WHERE NOT EXISTS (
        SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.pos <= a.pos AND b.upto >= a.upto)
),
found AS (
    SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
           count(*) FILTER (rank = 2) AS n_hex, {listed} FILTER (rank < 3) AS base_spans, {listed} AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)
"""


def _licenses() -> str:
    rows = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, texts in licenses.TEMPLATES.items() for t in texts)
    k = licenses.SHINGLE
    grams = f"list_transform(range(1, greatest(len(w) - {k - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
    return f"""
WITH t AS (SELECT license, {grams} AS g FROM (
    SELECT license, {_alnum_words("text")} AS w FROM (VALUES {rows}) AS v(license, text))),
d AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {_alnum_words("text")} AS w FROM documents)),
places AS (SELECT license, g AS template, len(g) AS n, i - 1 AS place, g[i] AS gram FROM t, unnest(range(1, len(g) + 1)) AS u(i)),
grams AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS pos FROM d),
hits AS (
    SELECT DISTINCT doc_id, license, template, n, pos - place AS start FROM grams JOIN places USING (gram)
),
found AS (
    SELECT DISTINCT doc_id, license FROM (
        SELECT *, greatest(8, CAST(ceil(n / 4) AS BIGINT)) AS slack FROM hits JOIN d USING (doc_id)
    ) WHERE len(list_intersect(template, g[greatest(start - slack, 0) + 1:start + n + slack]))
            >= {licenses.CONTAINMENT} * len(list_distinct(template))
),
per_doc AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN per_doc USING (doc_id)
"""


def _rule(column: str) -> str:
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN '{r.name if column == 'name' else r.verdict}'"
        for r in sorted(reputation.RULES, key=lambda r: (-len(r.name), r.name))
    ]
    return f"CASE {' '.join(cases)} END"


def _prior(table: str, n: str, g: str, mean: str) -> str:
    low, high = reputation.LEAST_CORRELATION, reputation.MOST_CORRELATION
    return f"""(SELECT round(1 / least(greatest(coalesce(
        (sum(({g} - {n} * {mean}) * ({g} - {n} * {mean}) / ({n} * {mean} * (1 - {mean}))) - count(*))
        / nullif(sum({n} - 1), 0), 0), {low}::DOUBLE), {high}::DOUBLE) - 1, 3) FROM {table} WHERE {n} > 1)"""


def _urls() -> str:
    last = "array_to_string(string_split(host, '.')[-{}:], '.')"
    return f"""
WITH rest AS (
    SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
    FROM pages
),
u AS (
    SELECT page_id, translate(place, '{UPPER}', '{LOWER}') AS host,
           regexp_extract(substr(r, length(place) + 1), '^[^?#]*') AS path
    FROM (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS place FROM rest)
),
outcomes AS (
    SELECT host, CAST(quality = 1 AND coalesce(toxic, 0) <> 1 AS INT) AS good
    FROM u JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL
),
counted AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS g FROM outcomes GROUP BY host),
h AS (
    SELECT host, {last.format(2)} AS domain, {last.format(1)} AS suffix, coalesce(n, 0) AS n, coalesce(g, 0) AS g
    FROM (SELECT DISTINCT host FROM u) LEFT JOIN counted USING (host)
),
dn AS (SELECT domain, suffix, sum(n) AS n, sum(g) AS g FROM h GROUP BY domain, suffix),
sn AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM dn GROUP BY suffix),
m0 AS (SELECT (sum(g) + 1) / (sum(n) + 2) AS m FROM sn),
s0 AS (SELECT sn.*, m FROM sn, m0),
s1 AS (SELECT suffix, (m * k + g) / (n + k) AS m FROM s0, (SELECT {_prior("s0", "n", "g", "m")} AS k)),
d0 AS (SELECT dn.*, m FROM dn JOIN s1 USING (suffix)),
d1 AS (SELECT domain, (m * k + g) / (n + k) AS m FROM d0, (SELECT {_prior("d0", "n", "g", "m")} AS k)),
h0 AS (SELECT h.*, m FROM h JOIN d1 USING (domain)),
h1 AS (SELECT host, m * k + g AS a, (1 - m) * k + n - g AS b FROM h0, (SELECT {_prior("h0", "n", "g", "m")} AS k)),
bound AS (
    SELECT host, a / (a + b) + {reputation.DEVIATIONS} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS upper FROM h1
)
SELECT page_id, host, path, {_rule("name")} AS rule,
       coalesce({_rule("verdict")}, CASE WHEN upper < {reputation.FLOOR} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN bound USING (host)
"""


#: Five hex digits are four digits of base 32.
_BASE32 = """array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(sha, 5 * i + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31) + 1 AS BIGINT), 1)), '')), '')"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, max(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (sha)
"""



def _collocations() -> str:
    least, covered, top = collocations.LEAST, collocations.COVERED, collocations.TOP
    score = "CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT)"
    return rf"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
f2 AS (
    SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM w, unnest(range(1, len(w))) AS t(i) GROUP BY ALL HAVING count(*) >= {least}
),
f3 AS (
    SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f
    FROM w, unnest(range(1, len(w) - 1)) AS t(i) GROUP BY ALL HAVING count(*) >= {least}
),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
inside AS (SELECT lang, x, y, max(f) AS most FROM (
    SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
cuts AS (
    SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, p.f AS l, q.f AS r, 1 AS k
    FROM f2 JOIN f1 AS p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 AS q ON q.lang = f2.lang AND q.x = f2.y
    LEFT JOIN inside AS i ON i.lang = f2.lang AND i.x = f2.x AND i.y = f2.y
    WHERE i.most IS NULL OR 100 * i.most < {covered} * f2.f
    UNION ALL
    SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, p.f, q.f, 1
    FROM f3 JOIN f1 AS p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 AS q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
    UNION ALL
    SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, p.f, q.f, 2
    FROM f3 JOIN f2 AS p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f1 AS q ON q.lang = f3.lang AND q.x = f3.z
),
weakest AS (
    SELECT * FROM (SELECT *, {score} AS score FROM cuts)
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN totals USING (lang) QUALIFY rank <= {top}
"""


ORACLES = {
    "op1_decontamination": DECONTAMINATION,
    "op2_secrets": _secrets(),
    "op8_licenses": _licenses(),
    "op9_url_filter": _urls(),
    "op10_warc": WARC,
    "op11_collocations": _collocations(),
}
