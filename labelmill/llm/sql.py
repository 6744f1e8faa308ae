"""DuckDB SQL that the queries' results are compared with."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS p, w FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[p + 1 : p + k], ' ') AS g FROM bw),
dw AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM bg) WHERE len(w) >= k),
dg AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM dw),
hits AS (SELECT DISTINCT doc_id, item_id, k, p FROM dg JOIN bg USING (k, g)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = "regexp_replace(x, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"

CHAT_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
    UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER w AS r, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, x)),
s AS (SELECT *, length({_ESCAPED}) + CASE WHEN role IS NOT DISTINCT FROM before THEN 10 ELSE 12 + length(role) + 1 + 11 END AS n FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY r)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY r) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

_SPACED = r"'[^\x20\x09-\x0D]+'"

NEAR_DUPLICATE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
p AS (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[p + 1 : p + k], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
links AS (SELECT x, y FROM half UNION SELECT y, x FROM half),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

_NGRAMS = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}


def _repeats(n: int, least: int) -> str:
    """Words of each text inside n-grams that occur again; least 1 counts the first ones too, 2 only later ones."""
    chosen = "times > 1" if least == 1 else "nth > 1"
    return f"""r{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[q + 1])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(p, p + {n})) AS q FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id, g ORDER BY p) AS nth, count(*) OVER (PARTITION BY doc_id, g) AS times
    FROM (SELECT doc_id, p, array_to_string(w[p + 1 : p + {n}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - {n - 1})) AS p FROM d WHERE len(w) >= {n})))
    WHERE {chosen}) JOIN d USING (doc_id) GROUP BY doc_id)"""


REPETITION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
{_repeats(3, 1)}, {", ".join(_repeats(n, 2) for n in _NGRAMS)},
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
x AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM l WHERE regexp_matches(line, {_SPACED})) WHERE nth > 1 GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(x.n, 0) AS n_dup_lines, coalesce(r3.words, 0) AS n_repeat_words,
    CAST(coalesce(x.chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(f"CAST(coalesce(r{n}.chars, 0) AS BIGINT) AS dup_{n}" for n in _NGRAMS)}
    FROM d LEFT JOIN x USING (doc_id) LEFT JOIN r3 USING (doc_id) {" ".join(f"LEFT JOIN r{n} USING (doc_id)" for n in _NGRAMS)})
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 5 * greatest(word_chars, 1) AS symbols_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * dup_line_chars > 20 * word_chars
         {"".join(f" OR 100 * dup_{n} > {c} * word_chars" for n, c in _NGRAMS.items())}) AS kept
FROM s
"""

_DRAWN = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT) AS h{k + 1}" for k in range(4))

INFILL_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, u, len(u) AS n, {_DRAWN} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:low], '') AS a, array_to_string(u[low + 1:high], '') AS b, array_to_string(u[high + 1:], '') AS c FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(a) END AS BIGINT) AS prefix_chars,
    CAST(CASE WHEN form <> 'plain' THEN length(b) END AS BIGINT) AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""


def _lloyd_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Rounds of assigning and moving, one after the other, over one row for each component."""

    def assigned(t: int) -> str:
        return f"""d{t} AS (SELECT rid, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM v JOIN c{t} USING (i) GROUP BY rid, k),
a{t} AS (SELECT rid, min_by(k, distance * 1000 + k) AS k, min(distance) AS distance FROM d{t} GROUP BY rid)"""

    def moved(t: int) -> str:
        return f"""m{t} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN v USING (rid) GROUP BY k, i),
c{t + 1} AS (SELECT k, i, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM c{t} LEFT JOIN m{t} USING (k, i))"""

    steps = ",\n".join(f"{assigned(t)},\n{moved(t)}" for t in range(rounds))
    return f"""
WITH kept AS (SELECT *, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS rid FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dim}),
v AS (SELECT rid, unnest(range({dim})) AS i, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
c0 AS (SELECT rid AS k, i, x AS c FROM v WHERE rid < {k}),
{steps},
{assigned(rounds)},
s AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN s USING (k) JOIN kept USING (rid)
"""


LLOYD_SQL = _lloyd_sql()

VECTOR_DUPLICATE_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: isfinite(x))) = len(v) AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
links AS (SELECT a.rid AS x, b.rid AS y FROM f a JOIN f b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.9 END),
n AS (SELECT x AS rid, count(*) AS n FROM links GROUP BY x),
reach AS (SELECT rid AS x, rid AS y FROM e UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
c AS (SELECT x AS rid, min(vec_id) AS component_id FROM reach JOIN e ON e.rid = reach.y GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e LEFT JOIN n USING (rid) JOIN c USING (rid)
"""
