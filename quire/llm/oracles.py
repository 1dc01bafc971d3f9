"""DuckDB SQL for the queries that SQL can express; the others are tested by brute force."""

from __future__ import annotations

from . import balltree, decontam, lexical, licenses, quality, secrets, topk

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, i, w[i:i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT k, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
n AS (SELECT k, count(DISTINCT i) AS n_repeat_words FROM r GROUP BY k),
f AS (SELECT k, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN n USING (k)),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_SHARE} * n_words AS base_failed,
  len(list_filter({[round(10 * g) for g in quality.SYMBOL_GRADES]}, lambda g: 10 * n_symbols > g * n_words)) + CAST(10 * n_dup_lines > 3 * n_lines AS INT) + CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INT) AS n_soft FROM f),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed OR n_soft > 0 AS INT)) AS DOUBLE) AS k FROM j GROUP BY host),
p AS (SELECT sum(k) / sum(n) AS m, sum(k / n * k) / sum(n) AS s FROM h),
v AS (SELECT host, CASE WHEN s - m * m < 1e-9 THEN m ELSE (k + m * (m * (1 - m) / (s - m * m) - 1)) / (n + m * (1 - m) / (s - m * m) - 1) END > {quality.BAD_HOST_RATE} AS bad FROM h, p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_soft <= CASE WHEN bad THEN {quality.ALLOWED_BAD} ELSE {quality.ALLOWED_GOOD} END AS kept
FROM j JOIN v ON j.host IS NOT DISTINCT FROM v.host"""

_PHRASES = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""
WITH b AS (SELECT item_id, {_PHRASES} AS w FROM benchmark),
s AS (SELECT *, least({decontam.WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, n, array_to_string(w[o + 1:o + n], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS o FROM s)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_PHRASES} AS w FROM documents),
g AS (SELECT k, o, n, array_to_string(w[o + 1:o + n], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(0, len(w) - n + 1)) AS o FROM d, (SELECT DISTINCT n FROM s))),
m AS (SELECT g.k, g.o, g.n, i.item_id FROM g JOIN i ON g.g = i.g AND g.n = i.n),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(o, o + n)) AS p FROM m) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT k, item_id AS x FROM m WHERE item_id IS NOT NULL) GROUP BY k),
v AS (SELECT DISTINCT g, n, n * {decontam.MISSING} // {decontam.WINDOW} AS a, string_split(g, ' ') AS w FROM i WHERE n > 1),
l AS (SELECT *, CAST(least({decontam.RUN}, ceil((n - a) / (a + 1))) AS BIGINT) AS l FROM v),
q AS (SELECT g, l, i, greatest(n - a - (l - 1) * (a + 1), 1) AS need, array_to_string(w[i + 1:i + l], ' ') AS run FROM (SELECT *, unnest(range(0, n - l + 1)) AS i FROM l)),
x AS (SELECT k, l, pos, array_to_string(w[pos + 1:pos + l], ' ') AS run FROM (SELECT k, w, l, unnest(range(0, len(w) - l + 1)) AS pos FROM d, (SELECT DISTINCT l FROM l))),
o AS (SELECT k, g, need, i, pos - i AS o, CAST(floor((pos - i) / {decontam.SLOP + 1}.0) AS BIGINT) AS f FROM x JOIN q USING (l, run)),
y AS (SELECT DISTINCT k, g, unnest(o) AS o FROM (SELECT k, g, list(DISTINCT o) AS o FROM (SELECT *, unnest([f, f - 1]) AS b FROM o) GROUP BY k, g, need, b HAVING count(DISTINCT i) >= need)),
r AS (SELECT k, g FROM y JOIN v USING (g) JOIN d USING (k) WHERE len(list_filter(range(0, n), lambda i: list_contains(
  d.w[greatest(o + i - {decontam.SLOP}, 0) + 1:greatest(o + i + {decontam.SLOP} + 1, 0)], v.w[i + 1]))) >= n - a),
e AS (SELECT k, count(DISTINCT item_id) AS n_near_items FROM (SELECT k, item_id FROM m UNION ALL SELECT k, item_id FROM r JOIN i USING (g)) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k) LEFT JOIN e USING (k)"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses_sql() -> str:
    t = licenses.THRESHOLD
    rows = [
        (i, name, grams)
        for i, (name, grams) in enumerate(
            (name, licenses.bigrams(notice)) for name in sorted(licenses.TEMPLATES) for notice in licenses.TEMPLATES[name]
        )
        if grams
    ]
    listed = ", ".join(f"({i}, {_literal(name)}, [{', '.join(map(_literal, grams))}])" for i, name, grams in rows)
    return rf"""
WITH t(i, id, g) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS x FROM documents),
u AS (SELECT DISTINCT k, unnest(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '[.!?]+\s+'), regexp_split_to_array(x, '\n\s*\n'), [x])) AS unit FROM d),
w AS (SELECT k, unit, list_filter(regexp_split_to_array(lower(unit), '[^0-9a-z]+'), lambda y: y <> '') AS w FROM u),
b AS (SELECT k, unit, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS g FROM w),
c AS (SELECT k, unit, i, id, 2.0::DOUBLE * len(list_intersect(t.g, b.g)) / (len(t.g) + len(b.g)) AS dice FROM b, t),
m AS (SELECT k, unit, dice, id FROM c WHERE dice >= {t} QUALIFY row_number() OVER (PARTITION BY k, unit ORDER BY dice DESC, i) = 1),
z AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY dice DESC, id DESC, unit DESC) AS r FROM m)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, id AS license_id, dice, unit AS matched_text, coalesce(ids, '') AS licenses
FROM d LEFT JOIN (SELECT k, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM m GROUP BY k) USING (k) LEFT JOIN (SELECT * FROM z WHERE r = 1) USING (k)"""


def _spans(kind: int, pattern: str, keep: str) -> str:
    p = _literal(pattern)
    return rf"""SELECT k, {kind} AS kind, s AS start, s + length(m[j]) AS stop, m[j] AS run FROM (
  SELECT k, m, j, list_sum(list_transform(p[1:j], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda y: length(y))), 0) AS s
  FROM (SELECT k, p, m, g, unnest(range(1, len(m) + 1)) AS j FROM (
    SELECT k, regexp_split_to_array(x, {p}) AS p, regexp_extract_all(x, {p}) AS m, regexp_extract_all(x, {p}, {2 if kind == 0 else 0}) AS g
    FROM d WHERE regexp_matches(x, {p})))
  WHERE {keep})"""


def secrets_sql() -> str:
    allowed = " OR ".join(f"regexp_matches(rest, {_literal(p)})" for p in secrets.ALLOW)
    bits = "CASE " + " ".join(f"WHEN regexp_matches(rest, {_literal(p)}) THEN {least}" for _, p, least in secrets.CLASSES) + " END"
    n = secrets.WINDOW
    peak = f"list_max(list_transform(range(1, length(rest) - {n - 2}), lambda q: list_aggregate(string_split(substr(rest, q, {n}), ''), 'entropy')))"
    text = "string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS x FROM documents),
b AS ({_spans(0, secrets.ASSIGN, "length(g[j]) >= 6")} UNION ALL {_spans(1, secrets.ACCESS, "true")} UNION ALL {_spans(2, secrets.HEX, "true")}),
e AS (SELECT k, kind, start, stop, run FROM (SELECT *, regexp_replace(run, {_literal(secrets.ALLOWED_WORDS)}, '', 'g') AS rest FROM ({_spans(3, secrets.CANDIDATE, "true")})) r
  WHERE length(rest) >= {n} AND NOT ({allowed}) AND {peak} >= {bits}
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.k = r.k AND b.start <= r.start AND r.stop <= b.stop)),
s AS (SELECT k, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, {text} AS base FROM b GROUP BY k),
f AS (SELECT k, {text} AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (k) LEFT JOIN f USING (k)"""


_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_DOT = "coalesce(list_sum(list_transform({}, lambda i: {})), 0)"


def _integers(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


def clustering_sql() -> str:
    """A round after the other, each with its assignment and its centroids."""
    rank, dims = f"sha256('{balltree.SALT}:' || vec_id)", balltree.DIMS
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, {_integers(balltree.SCALE)} AS v FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {rank}) - 1 AS j, v AS c FROM v ORDER BY {rank} LIMIT {balltree.CENTROIDS})",
    ]
    apart = _DOT.format(f"range(1, {dims + 1})", "(v[i] - c[i]) * (v[i] - c[i])")
    for r in range(balltree.ROUNDS + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, j, d FROM (SELECT vec_id, v, j, CAST({apart} AS BIGINT) AS d FROM v, c{r}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)"
        )
        if r < balltree.ROUNDS:
            parts.append(
                f"m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY j, i) GROUP BY j)"
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))")
    last = balltree.ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} USING (j)"""


TOP_K = f"""
WITH v AS (SELECT vec_id, {_integers(topk.SCALE)} AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST({_DOT.format("range(1, least(len(q.v), len(c.v)) + 1)", "q.v[i] * c.v[i]")} AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {topk.EVERY} = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {topk.K}"""

_TERMS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
t AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY k, term),
g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
m AS (SELECT k, doc_id, 75 + (25 * len(w) * docs) // terms AS m FROM d, t WHERE len(w) > 0),
i AS (SELECT b, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS b, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY b, item_id, term),
s AS (SELECT b, item_id, k, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM i JOIN g USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY b, item_id, k),
r AS (SELECT b, item_id, doc_id, score, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (k) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= {lexical.K}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": secrets_sql(),
        "op4_quality_rules": QUALITY,
        "op5_license_scans": licenses_sql(),
        "op7_benchmark_decontamination": DECONTAMINATION,
        "op11_centroid_clustering": clustering_sql(),
        "op12_exact_top_k": TOP_K,
        "op13_lexical_search": LEXICAL,
    }
