"""DuckDB SQL for the operators that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, coalesce(source, '') AS host FROM documents),
split AS (SELECT rid, doc_id, host, body, regexp_extract_all(body, '{WORD}') AS w FROM docs),
windows AS (SELECT rid, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g
            FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
again AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before
          FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rid, CAST(sum(least(3, i - coalesce(before, -3))) AS BIGINT) AS n FROM again GROUP BY rid),
lines AS (SELECT rid, host, body, l, len(regexp_extract_all(l, '{WORD}')) AS words,
                 regexp_replace(regexp_replace(lower(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')),
                                               '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') AS norm
          FROM (SELECT rid, host, body, unnest(string_split(body, chr(10))) AS l FROM docs)
          WHERE regexp_matches(l, '{WORD}')),
dup AS (SELECT rid, CAST(count(*) - count(DISTINCT l) AS BIGINT) AS n FROM lines GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT body) AS documents FROM docs GROUP BY host),
frequent AS (SELECT host, norm FROM lines JOIN hosts USING (host) GROUP BY host, norm, documents
             HAVING count(DISTINCT body) > greatest(10, documents * 0.05)),
gone AS (SELECT rid, CAST(sum(words) AS BIGINT) AS n FROM lines JOIN frequent USING (host, norm) GROUP BY rid),
counted AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                   CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_removed_words
            FROM split s LEFT JOIN dup d USING (rid) LEFT JOIN repeats r USING (rid) LEFT JOIN gone g USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM counted"""


FILL_IN_MIDDLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
hashed AS (SELECT *, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM docs),
formed AS (SELECT doc_id, body, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                  CASE WHEN body = '' OR regexp_matches(body, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
cut AS (SELECT doc_id, n, form, body, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM cut"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The codes' SQL, round by round; distances by inner products of integers in doubles, which are exact."""
    ctes = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT r, vec_id, i, w[i * len(w) // {parts} + 1:(i + 1) * len(w) // {parts}] AS x FROM v, range({parts}) t(i))",
        "d AS MATERIALIZED (SELECT i, x, count(*) AS n, list_inner_product(x, x) AS xx FROM p GROUP BY i, x)",
        f"c0 AS MATERIALIZED (SELECT i, rank - 1 AS e, x, list_inner_product(x, x) AS xx FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY vec_id) AS rank FROM p) WHERE rank <= {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""a{k} AS MATERIALIZED (SELECT i, x, any_value(n) AS n, arg_min(e, (far, e)) AS e, min(far) AS far
                FROM (SELECT d.i, d.x, d.n, c.e, d.xx - 2 * list_inner_product(d.x, c.x) + c.xx AS far FROM d JOIN c{k} c ON d.i = c.i) GROUP BY i, x)"""
        )
        if k < rounds:
            ctes.append(
                f"""m{k} AS (SELECT i, e, list(floor(s / n) ORDER BY j) AS x FROM (SELECT i, e, j, sum(n * x[j]) AS s, sum(n) AS n FROM a{k}, range(1, (SELECT len(x) + 1 FROM d LIMIT 1)) t(j) GROUP BY i, e, j) GROUP BY i, e)"""
            )
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT i, e, coalesce(m.x, c.x) AS x, list_inner_product(coalesce(m.x, c.x), coalesce(m.x, c.x)) AS xx FROM c{k} c LEFT JOIN m{k} m USING (i, e))")
    return f"""
WITH {", ".join(ctes)},
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY i, e)) AS sha FROM c{rounds}),
coded AS (SELECT v.vec_id, v.label, s.code, s.error FROM v JOIN (
            SELECT p.r, string_agg(lpad(to_hex(a.e), 2, '0'), '' ORDER BY p.i) AS code, CAST(sum(a.far) AS BIGINT) AS error FROM p JOIN a{rounds} a ON p.i = a.i AND p.x = a.x GROUP BY p.r) s ON v.r = s.r)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha FROM books) AS codebooks_sha256 FROM coded"""
