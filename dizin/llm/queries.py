"""Queries of the numbered operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from dizin.llm import counts, decontaminate, licenses, mixing, packing, phrases, ppm, secrets, simhash, spelling, substrings, topk, toxicity
from dizin.llm.common import table


def op1_packed_ids(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_secret_ledger(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_simhash_components(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op4_levenshtein_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_positional_index(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_prefix_doubling(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"))


def op7_bit_sliced_topk(spark, sf_dir):
    return topk.digest(table(spark, sf_dir, "embeddings"))


def op8_pareto_mix(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_license_rules(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


def op10_ppm_language(spark, sf_dir):
    return ppm.digest(table(spark, sf_dir, "documents"))



def op11_token_counts(spark, sf_dir):
    return counts.digest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.digest(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark, sf_dir):
    return phrases.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packed_ids, op2_secret_ledger, op3_simhash_components, op4_levenshtein_toxicity, op5_positional_index,
        op6_prefix_doubling, op7_bit_sliced_topk, op8_pareto_mix, op9_license_rules, op10_ppm_language, op11_token_counts, op12_spelling_variants,
        op13_phrase_mining,
    )
}


def _secrets_sql() -> str:
    """Spans from the lengths of matches and of the pieces between them; kinds as the operator lists them."""
    parts, joined = [], []
    for n, r in enumerate(secrets.RULES):
        pattern = ("(?i)" if r.any_case else "") + r.pattern
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {n} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, {quoted}) AS m, "
            f"regexp_extract_all(t, {quoted}, {r.group}) AS g, string_split_regex(t, {quoted}) AS gaps, {r.least} AS least, {'true' if r.inner else 'false'} AS inside FROM docs"
        )
        joined.append(f"'{r.kind}'")
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
each AS (SELECT doc_id, rank, kind, least, inside, gaps, m, g, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT doc_id, rank, kind, len(g[i]) AS size,
  CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)
    + CASE WHEN inside THEN len(m[i]) - len(g[i]) ELSE 0 END AS BIGINT) AS s,
  CASE WHEN inside THEN len(g[i]) ELSE len(m[i]) END AS n, least FROM each),
kept AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || (s + n) AS span FROM spans WHERE size >= least),
told AS (SELECT doc_id, {counts},
  coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (kind IN ({base})), '') AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN told t ON d.doc_id = t.doc_id"""


#: The same mix with plain windows over whole sources, in the order of the rank.
MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS u FROM documents),
docs AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM sized),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][CAST((source_no - 1) % 3 + 1 AS INT)] AS w FROM
  (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM sizes)),
fill AS (SELECT *, sum(source_size) OVER () * 3 AS total,
  coalesce(sum(source_size) OVER (ORDER BY source_size * (10 // w), source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS before,
  sum(w) OVER (ORDER BY source_size * (10 // w), source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM weighed),
marked AS (SELECT *, (total - 2 * before) * w >= source_size * w_rest * 4 AS is_full FROM fill),
goal AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE)
  ELSE CAST((total - 2 * sum(CASE WHEN is_full THEN source_size * 2 ELSE 0 END) OVER ()) * w AS DOUBLE)
    / CAST(2 * sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM marked),
classes AS (SELECT source, bits, CAST(sum(size) AS BIGINT) AS words FROM docs GROUP BY source, bits),
downward AS (SELECT c.*, target, source_size,
  (target - 2 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * bits
    >= CAST(2 * sum(bits * words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS is_full
  FROM classes c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source),
likely AS (SELECT *, CASE WHEN bits = 0 THEN 1.0::DOUBLE WHEN is_full THEN 2.0::DOUBLE ELSE greatest(0.0::DOUBLE,
  (target - sum(CASE WHEN is_full THEN words * 2 ELSE 0 END) OVER (PARTITION BY source)) * bits
    / CAST(sum(CASE WHEN is_full THEN 0 ELSE bits * words END) OVER (PARTITION BY source) AS DOUBLE)) END AS expected FROM downward),
parts AS (SELECT *, floor(expected) AS certain, expected - floor(expected) AS part FROM likely),
rests AS (SELECT *, target - sum(certain * words) OVER (PARTITION BY source) AS rest FROM parts),
placed AS (SELECT d.*, source_size, target, certain, part, rest,
  CASE WHEN part > 0 THEN (CAST(u AS DOUBLE) / CAST(281474976710656 - u AS DOUBLE)) / (part / (1 - part)) END AS rank
  FROM docs d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source AND d.bits = r.bits),
run AS (SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, u) AS upto FROM placed),
got AS (SELECT *, rank IS NOT NULL AND upto <= rest AS more FROM run),
gaps AS (SELECT *, rest - coalesce(max(CASE WHEN more THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM got),
near AS (SELECT source, arg_min({'rank': rank, 'u': u}, {'off': abs(size - gap), 'rank': rank, 'u': u}) AS x FROM gaps
  WHERE rank IS NOT NULL AND NOT more AND abs(size - gap) < gap GROUP BY source)
SELECT g.doc_id, g.size, g.source_size, g.target,
  CAST(g.size * (g.certain + CAST(g.more OR n.x IS NOT NULL AS INT)) AS BIGINT) AS taken
FROM gaps g LEFT JOIN near n ON g.source IS NOT DISTINCT FROM n.source AND g.rank = n.x.rank AND g.u = n.x.u"""

#: The same by joining all runs of words.
DECONTAMINATE_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, coalesce(w, []) AS w FROM low),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wide AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM wide)),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM win))),
met AS (SELECT doc_id, item_id, i, g.n FROM grams g JOIN win USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM met GROUP BY doc_id),
rows AS (SELECT row_number() OVER () AS d, doc_id, w FROM docs),
places AS (SELECT d, p, w[p] AS term FROM (SELECT d, w, unnest(range(1, len(w) + 1)) AS p FROM rows)),
totals AS (SELECT term, count(*) AS total FROM places GROUP BY 1),
terms AS (SELECT n, win, ww, pos, ww[pos] AS term FROM (SELECT *, unnest(range(1, len(ww) + 1)) AS pos FROM (SELECT DISTINCT n, win, string_split(win, ' ') AS ww FROM win))),
rarest AS (SELECT t.n, win, any_value(ww) AS ww, arg_min(t.term, {'t': coalesce(total, 0), 'a': pos}) AS term, min(coalesce(total, 0)) AS least FROM terms t LEFT JOIN totals USING (term) GROUP BY t.n, win),
around AS (SELECT p.d, r.n, r.win, r.ww, x.w[greatest(1, p - 15):p + 15] AS ws FROM rarest r JOIN places p ON p.term = r.term JOIN rows x ON x.d = p.d WHERE least > 0),
close_by AS (SELECT DISTINCT d, n, win FROM around WHERE len(list_filter(list_distinct(ww), lambda t: len(list_filter(ws, lambda x: x = t)) < len(list_filter(ww, lambda x: x = t)))) = 0),
near AS (SELECT c.d, count(DISTINCT item_id) AS n_near FROM close_by c JOIN win USING (n, win) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM rows d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id LEFT JOIN near e ON d.d = e.d"""

#: The same by scoring all rows for each query.
TOPK_SQL = """
WITH q AS (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.row_no AS query_no, a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.row_no <> b.row_no AND len(a.q) = len(b.q)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_no ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20"""
#: The same by grouping all runs of words.
PHRASES_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, d, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 30 AND k > 1),
cuts AS (SELECT c.*, i, array_to_string(w[:i], ' ') AS p1, array_to_string(w[i + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS i FROM cand) c),
scored AS (SELECT c.lang, c.k, c.phrase, a, i, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.k = c.i AND x.phrase = c.p1 JOIN f y ON y.lang = c.lang AND y.k = c.k - c.i AND y.phrase = c.p2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, i) = 1),
inner_of AS (SELECT lang, j AS k, array_to_string(w[i:i + j - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM cand))),
cover AS (SELECT lang, k, phrase, max(a) AS m FROM inner_of GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.k = b.k AND c.phrase = b.phrase WHERE c.m IS NULL OR CAST(100 AS HUGEINT) * c.m < CAST(80 AS HUGEINT) * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r.r AS r, n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000"""

SQL = {"op13_phrase_mining": PHRASES_SQL, "op7_bit_sliced_topk": TOPK_SQL, "op5_positional_index": DECONTAMINATE_SQL, "op2_secret_ledger": _secrets_sql(), "op8_pareto_mix": MIX_SQL}
