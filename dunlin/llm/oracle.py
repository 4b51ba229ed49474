"""DuckDB SQL for the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

from dunlin.llm import secret_scan, substring_dedup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ngram_join() -> str:
    return f"""WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWERED}, '{SPACED}') AS w FROM documents),
sh AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN '<' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
size AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON b.x = reach.y),
least AS (SELECT reach.x AS r, min(d.doc_id) AS c FROM reach JOIN d ON d.r = reach.y GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, least.c AS component_id
FROM d LEFT JOIN size USING (r) JOIN least USING (r)"""


def decontamination() -> str:
    return f"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWERED}, '{PLAIN}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{PLAIN}') AS w FROM benchmark),
win AS (
  SELECT item, i AS o, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
here AS (
  SELECT r, i AS p, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM d, (SELECT DISTINCT k FROM win), unnest(generate_series(1, len(w) - k + 1)) AS t(i) WHERE len(w) >= k),
m AS (SELECT DISTINCT r, p, here.k AS k, item, o FROM here JOIN win ON here.s = win.s AND here.k = win.k),
hit AS (SELECT r, count(DISTINCT p + j) AS n FROM m, unnest(generate_series(0, k - 1)) AS t(j) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
run AS (SELECT r, max(p) + max(k) - min(p) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY r, item, p - o ORDER BY p) AS g FROM m) GROUP BY r, item, p - o, g)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated,
  CAST(coalesce((SELECT max(n) FROM run WHERE run.r = d.r), 0) AS BIGINT) AS longest
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""


def _any_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


def secrets() -> str:
    """Each pattern or else one character at a time: pieces add up to the text, so lengths give the places."""
    names = "|".join(_any_case(n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    value = "[A-Za-z0-9+/_.=-]"
    head = rf"(?:{names})[\"'']?\x20*[:=]\x20*[\"'']?"
    # kind: (what matches, the part whose length counts, least length)
    patterns = {
        "assign": (f"{head}{value}+", f"^{head}({value}+)$", 6), "access": ("AKIA[A-Z0-9]+", "^(AKIA[A-Z0-9]+)$", 20), "hex": ("[0-9a-f]+", "^([0-9a-f]+)$", 24),
        "pem": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", r"^(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)$", 1),
        "bearer": (rf"{_any_case('bearer')}\x20+{value}+", rf"^({_any_case('bearer')}\x20+{value}+)$", 27)}
    assert list(patterns) == list(secret_scan.RULES)
    ctes = [f"""k{i} AS (
  SELECT r, {i} AS i, '{kind}' AS kind, e - len(s) AS a, e FROM (
    SELECT r, s, sum(len(s)) OVER (PARTITION BY r ORDER BY o) AS e FROM (
      SELECT r, unnest(x) AS s, unnest(generate_series(1, len(x))) AS o FROM (SELECT r, regexp_extract_all(t, '(?s){find}|.') AS x FROM d)))
  WHERE len(regexp_extract(s, '(?s){part}', 1)) >= {least})""" for i, (kind, (find, part, least)) in enumerate(patterns.items())]
    every = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(patterns)))
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
{", ".join(ctes)},
found AS (SELECT r, i, kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS s, a FROM ({every})),
g AS (SELECT r, count(*) FILTER (i = 0) AS n0, count(*) FILTER (i = 1) AS n1, count(*) FILTER (i = 2) AS n2,
  string_agg(s, ',' ORDER BY a, i) FILTER (i < 3) AS base, string_agg(s, ',' ORDER BY a, i) AS every FROM found GROUP BY r)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (r)"""


def substrings() -> str:
    """Rank is doc_id; the given tables have one row for each."""
    S = substring_dedup
    same = ("coalesce(nullif(list_position(list_transform(generate_series(1, least(len({a}), len({b}))), lambda k: {a}[k] = {b}[k]), false), 0), "
            "least(len({a}), len({b})) + 1) - 1")
    return rf"""WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
piece AS (
  SELECT r, o, s, sum(len(s)) OVER before - len(s) AS a, sum(len(s) - len(replace(s, chr(10), ''))) OVER before AS line FROM (
    SELECT r, unnest(x) AS s, unnest(generate_series(1, len(x))) AS o FROM (SELECT r, regexp_extract_all(text, '{SPACED}|[\x20\x09-\x0D]+') AS x FROM t))
  WINDOW before AS (PARTITION BY r ORDER BY o)),
w AS (
  SELECT r, line, a, a + len(s) AS e, w, row_number() OVER (PARTITION BY r ORDER BY o) - 1 AS i, strlen(w) AS size,
    CAST('0x' || hex(encode(w))[1:2] AS INTEGER) AS first, CAST('0x' || hex(encode(w))[-2:] AS INTEGER) AS last
  FROM (SELECT *, translate(s, '{UPPER}', '{LOWER}') AS w FROM piece WHERE regexp_matches(s, '^{SPACED}'))),
c1 AS (SELECT *, (131 * size + 31 * last + 17 * first + 7 * coalesce(lag(last) OVER v, 0) + 3 * coalesce(lag(first) OVER v, 0)) % 251 AS value FROM w WINDOW v AS (PARTITION BY r ORDER BY i)),
c2 AS (SELECT r, i, min(value * 10000000 - i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {S.WINDOW - 1} PRECEDING AND CURRENT ROW) AS least FROM c1),
c3 AS (SELECT DISTINCT r, (10000000 - least % 10000000) % 10000000 AS i, TRUE AS opens FROM c2 WHERE i >= {S.WINDOW - 1}),
c5 AS (SELECT w.*, sum(CASE WHEN opens OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS chunk FROM w LEFT JOIN c3 USING (r, i)),
u AS (
  SELECT r, 0 AS kind, line AS o, min(a) AS a, max(e) AS e, min(i) AS i, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS k FROM c5 GROUP BY r, line UNION ALL
  SELECT r, 1, chunk, min(a), max(e), min(i), count(*), string_agg(w, ' ' ORDER BY i) FROM c5 GROUP BY r, chunk),
f AS (SELECT u.*, row_number() OVER v AS nth, first_value(r) OVER v AS fr, first_value(i) OVER v AS fi FROM u JOIN t USING (r) WINDOW v AS (PARTITION BY kind, k ORDER BY doc_id, o)),
g AS (SELECT *, o - row_number() OVER (PARTITION BY r ORDER BY o) AS island FROM f WHERE kind = 1 AND nth > 1),
run AS (
  SELECT r, min(a) AS a, max(e) AS e, min(i) AS i, max(i + n) AS j, arg_min(fr, o) AS hr, arg_min(fi, o) AS hi, arg_max(fr, o) AS tr, arg_max(fi + n, o) AS tj
  FROM g GROUP BY r, island HAVING sum(n) >= {S.LEAST_RUN}),
l AS (SELECT r, list(w ORDER BY i) AS ws, list(a ORDER BY i) AS starts, list(e ORDER BY i) AS stops FROM w GROUP BY r),
near AS (
  SELECT run.*, own.starts, own.stops, list_reverse(own.ws[greatest(i - {S.MOST - 1}, 1):i]) AS l1, list_reverse(h.ws[greatest(hi - {S.MOST - 1}, 1):hi]) AS l2,
    own.ws[j + 1:j + {S.MOST}] AS r1, q.ws[tj + 1:tj + {S.MOST}] AS r2
  FROM run JOIN l own ON own.r = run.r JOIN l h ON h.r = hr JOIN l q ON q.r = tr),
grown AS (SELECT *, {same.format(a="l1", b="l2")} AS lefts, {same.format(a="r1", b="r2")} AS rights FROM near),
gone AS (
  SELECT r, kind, a, e, n FROM f WHERE kind = 0 AND nth > 1 UNION ALL
  SELECT r, 1, starts[i - lefts + 1], stops[j + rights], j - i + lefts + rights FROM grown WHERE j - i + lefts + rights >= {S.LEAST_PASSAGE}),
reach AS (SELECT r, a, e, max(e) OVER (PARTITION BY r ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT r, a, e FROM gone)),
isle AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY a, e) AS k FROM reach),
cut AS (SELECT r, min(a) AS a, max(e) AS e FROM isle GROUP BY r, k),
span AS (SELECT r, sum(e - a) AS n, string_agg(CAST(a AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY a) AS s FROM cut GROUP BY r),
num AS (SELECT r, count(*) FILTER (kind = 0) AS n_lines, sum(n) FILTER (kind = 0) AS line_words, count(*) FILTER (kind = 1) AS n_passages, max(n) FILTER (kind = 1) AS longest
  FROM gone GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(line_words, 0) AS BIGINT) AS line_words, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest_passage, CAST(coalesce(span.n, 0) AS BIGINT) AS n_removed, coalesce(span.s, '') AS spans
FROM t LEFT JOIN num USING (r) LEFT JOIN span USING (r)"""


def content_sort() -> str:
    return r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""


def resampling() -> str:
    """CRC-32 is linear: a feature's is the exclusive or of what each byte adds at its distance from the end, and of a start value for the length."""
    B, crc_bit = 10000, "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS b, 0 AS k, CAST(i AS BIGINT) AS c FROM generate_series(0, 255) AS t(i)
  UNION ALL SELECT b, k + 1, {crc_bit} FROM bits WHERE k < 8),
tab AS (SELECT b, c FROM bits WHERE k = 8),
words AS (SELECT 0 AS side, row_number() OVER () AS r, regexp_extract_all({LOWERED}, '{PLAIN}') AS w FROM documents
  UNION ALL SELECT 1, -row_number() OVER (), regexp_extract_all({LOWERED}, '{PLAIN}') FROM benchmark),
f AS (SELECT side, r, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
ff AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
depth AS (SELECT max(len(x)) // 2 AS n FROM ff),
shift AS (
  SELECT 0 AS d, b, c FROM tab UNION ALL
  SELECT 0, -1, xor(tab.c, 4294967295 >> 8) FROM tab WHERE tab.b = 255
  UNION ALL SELECT d + 1, shift.b, xor(tab.c, shift.c >> 8) FROM shift JOIN tab ON tab.b = shift.c & 255 WHERE d + 1 < (SELECT n FROM depth)),
byte AS (SELECT f, len(x) // 2 - 1 - i AS d, CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT) AS b FROM ff, unnest(generate_series(0, len(x) // 2 - 1)) AS t(i)
  UNION ALL SELECT f, len(x) // 2 - 1, -1 FROM ff),
crc AS (SELECT f, xor(bit_xor(c), 4294967295) % {B} AS bucket FROM byte JOIN shift USING (d, b) GROUP BY f),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN crc USING (f) GROUP BY bucket),
every AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + {B} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + {B} AS DOUBLE)))) AS BIGINT) AS g FROM n, every),
weight AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM f JOIN crc USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
ids AS (SELECT doc_id, row_number() OVER () AS r, len(regexp_extract_all({LOWERED}, '{PLAIN}')) AS n_words FROM documents),
d AS (SELECT doc_id, r, n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
  CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
  CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[:8] AS BIGINT) AS h FROM ids LEFT JOIN weight USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)"""


def centroids() -> str:
    """Every round as a step of its own: distances of all vectors to all centroids, then floors of the means."""
    near = """SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT r, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS BIGINT) AS d FROM v, {at}) GROUP BY r"""
    steps = []
    for k in range(10):
        steps.append(f"""a{k} AS MATERIALIZED ({near.format(at=f"m{k}")}),
s{k} AS (SELECT c, i, CAST(sum(y) AS HUGEINT) AS s, count(*) AS n FROM (
  SELECT c, unnest(x) AS y, unnest(range(1, 65)) AS i FROM v JOIN a{k} USING (r)) GROUP BY c, i),
m{k + 1} AS MATERIALIZED (SELECT c, coalesce(f.m, m{k}.m) AS m FROM m{k} LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY c) AS f USING (c))""")
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (
  SELECT x, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, x LIMIT 8)),
{", ".join(steps)},
a AS MATERIALIZED ({near.format(at="m10")})
SELECT vec_id, CAST(c AS INTEGER) AS "cluster", d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a JOIN v USING (r) JOIN m10 USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": ngram_join(), "op6_secret_scan": secrets(), "op7_substring_dedup": substrings(), "op8_decontamination": decontamination(),
            "op11_content_sort": content_sort(), "op12_importance_resampling": resampling(), "op13_centroids": centroids()}
