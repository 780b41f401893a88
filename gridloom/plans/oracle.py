"""The SQL that each query equals, for DuckDB over the same tables; the made tables are those of fixtures."""

from __future__ import annotations

from gridloom.plans.fixtures import LINES, TABLE_ANSWERS, THOUGHTS

_BASE = f"""lines AS ({LINES.format(lineitem="lineitem", part="part")}),
tru0 AS (SELECT uid, pk, row, unnest(range(7)) AS col, unnest([name, qty, price, flag, tax, disc, status]) AS text FROM lines),
tru AS (SELECT uid, pk, row, CAST(col AS INT) AS col, text, CASE WHEN col = 0 AND pk % 5 = 0 THEN 2 ELSE 1 END AS colspan, CASE WHEN col = 3 AND pk % 9 = 0 THEN 2 ELSE 1 END AS rowspan FROM tru0),
pred AS (SELECT uid, pk, row, CASE WHEN pk % 7 = 0 THEN col - 1 ELSE col END AS col, text, CASE WHEN pk % 10 = 0 THEN 1 ELSE colspan END AS colspan,
  CASE WHEN pk % 27 = 0 AND rowspan = 2 THEN 3 ELSE rowspan END AS rowspan FROM tru WHERE NOT (pk % 11 = 0 AND col = 2) AND NOT (pk % 7 = 0 AND col = 0)),
words AS (SELECT uid AS doc_id, row * 7 + col AS ord, text, CAST(col * 100 + pk % 13 AS DOUBLE) AS x, CAST(row * 20 + pk % 5 AS DOUBLE) AS y, CAST(length(text) * 7 AS DOUBLE) AS w, 12.0::DOUBLE AS h, pk, row, col FROM tru WHERE text <> '')"""


def with_base(*more: str, last: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_BASE, *more]) + "\n" + last


def kind(t: str) -> str:
    """A value's kind."""
    return f"""CASE WHEN {t} = '' THEN 'other' WHEN contains({t}, '%') AND regexp_matches({t}, '^[-+(]?\\s*\\d[\\d,]*\\.?\\d*\\s*%\\)?$') THEN 'percent'
 WHEN regexp_matches({t}, '^\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}$') OR regexp_matches({t}, '(?i)^\\d{{1,2}}[-\\s](jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*([-\\s,]*\\d{{2,4}})?$') THEN 'date'
 WHEN regexp_matches({t}, '[$€£¥₩₹฿]') OR regexp_matches({t}, '^\\(?[-+]?\\s*\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?\\)?$') OR regexp_matches({t}, '^\\(\\s*[-+]?\\d[\\d,]*\\.?\\d*\\s*\\)$') THEN 'amount'
 WHEN regexp_matches({t}, '^[-+]?\\d+(\\.\\d+)?$') THEN 'numeric' WHEN length({t}) = 1 OR (length({t}) <= 2 AND NOT regexp_matches({t}, '\\d')) THEN 'symbol' ELSE 'text' END"""


def norm(t: str) -> str:
    """White space of any script collapsed."""
    return f"trim(regexp_replace({t}, '[\\t-\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


def shapes(texts: tuple[str, ...]) -> str:
    """Every turn's text in one of several shapes."""
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"r AS (SELECT conv_id, turn, replace([{quoted}][CAST((conv_id + turn) % {len(texts)} + 1 AS INT)], '@', text) AS raw FROM conversations)"


_PLACED = """b AS (SELECT t.uid, t.row, t.col, lower(t.text) AS t, coalesce(lower(p.text), '') AS p FROM tru t LEFT JOIN pred p ON t.uid = p.uid AND t.row = p.row AND t.col = p.col),
s AS (SELECT uid, count(*) FILTER (t <> '' AND t = p) AS placed, count(*) FILTER (t <> '') AS texts, count(*) FILTER (t = '' AND p = '') AS kept, count(*) FILTER (t = '') AS blanks FROM b GROUP BY uid),
m AS (SELECT *, CASE WHEN texts = 0 THEN 1.0::DOUBLE ELSE placed / texts::DOUBLE END AS content_placement, CASE WHEN blanks = 0 THEN 1.0::DOUBLE ELSE kept / blanks::DOUBLE END AS blank_preservation FROM s),
dif AS (SELECT uid, CASE WHEN max(row) + 1 <= 3 THEN 'easy' WHEN max(row) + 1 <= 5 THEN 'medium' ELSE 'hard' END AS difficulty FROM tru GROUP BY uid)"""
_SPANS = """ts AS (SELECT DISTINCT uid, row, col, rowspan, colspan FROM tru WHERE rowspan > 1 OR colspan > 1),
ps AS (SELECT DISTINCT uid, row, col, rowspan, colspan FROM pred WHERE rowspan > 1 OR colspan > 1),
mt AS (SELECT uid, count(*) AS n FROM (SELECT * FROM ts INTERSECT SELECT * FROM ps) GROUP BY uid),
tt AS (SELECT uid, count(*) AS n FROM ts GROUP BY uid), sp AS (SELECT uid, count(*) AS n FROM (SELECT * FROM ps EXCEPT SELECT * FROM ts) GROUP BY uid),
sr AS (SELECT u.uid, coalesce(mt.n, 0) AS matched, coalesce(tt.n, 0) AS total, coalesce(sp.n, 0) AS spurious FROM (SELECT DISTINCT uid FROM tru) u LEFT JOIN mt USING (uid) LEFT JOIN tt USING (uid) LEFT JOIN sp USING (uid))"""
_SEPS = """r AS (SELECT doc_id, x, x + w AS e, max(x + w) OVER (PARTITION BY doc_id ORDER BY x, x + w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words),
sep AS (SELECT doc_id, (reach + x) / 2 AS separator, row_number() OVER (PARTITION BY doc_id ORDER BY (reach + x) / 2) - 1 AS k FROM r WHERE x - reach > 12)"""
_COLS = _SEPS + """,
plc AS (SELECT w.*, (SELECT count(*) FROM sep s WHERE s.doc_id = w.doc_id AND w.x + w.w / 2 > s.separator) AS gcol FROM words w),
nc AS (SELECT d.doc_id, coalesce(n, 0) + 1 AS n_cols FROM (SELECT DISTINCT doc_id FROM words) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sep GROUP BY doc_id) USING (doc_id))"""
_SCANNED = """scanned AS (SELECT doc_id AS ord, text AS html, CAST(n_chars AS DOUBLE) / 30000 AS score, lang FROM documents)"""

ORACLES: dict[str, str] = {}

ORACLES["content_placement"] = with_base(_PLACED, last="SELECT uid, placed, texts, round(content_placement, 9) AS content_placement FROM m")
ORACLES["blank_preservation"] = with_base(_PLACED, last="SELECT uid, kept, blanks, round(blank_preservation, 9) AS blank_preservation FROM m")
ORACLES["schema_match"] = with_base(
    "ss AS (SELECT uid, max(row + rowspan) AS true_rows, max(col + colspan) AS true_cols FROM tru GROUP BY uid), pp AS (SELECT uid, max(row + rowspan) AS pred_rows, max(col + colspan) AS pred_cols FROM pred GROUP BY uid)",
    last="SELECT uid, true_rows, true_cols, coalesce(pred_rows, 0) AS pred_rows, coalesce(pred_cols, 0) AS pred_cols, true_cols = coalesce(pred_cols, 0) AS cols_correct FROM ss LEFT JOIN pp USING (uid)",
)
ORACLES["span_recovery"] = with_base(
    _SPANS,
    "q AS (SELECT *, CASE WHEN matched + spurious = 0 THEN 1.0::DOUBLE ELSE matched / (matched + spurious)::DOUBLE END AS p, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE matched / total::DOUBLE END AS r FROM sr)",
    last="SELECT uid, matched, total, spurious, round(r, 9) AS span_recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS span_f1 FROM q",
)
_RUN = "e AS (SELECT difficulty, content_placement, blank_preservation FROM m JOIN dif USING (uid))"
ORACLES["run_summary_by_bin"] = with_base(
    _PLACED, _RUN,
    last="SELECT coalesce(difficulty, 'all') AS difficulty, count(*) AS n, round(avg(content_placement), 6) AS mean_content_placement, round(avg(blank_preservation), 6) AS mean_blank_preservation FROM e GROUP BY GROUPING SETS ((), (difficulty))",
)
ORACLES["compare_delta"] = with_base(
    _PLACED, _RUN,
    "k AS (SELECT coalesce(difficulty, 'all') AS difficulty, avg(blank_preservation) AS a, avg(content_placement) AS b FROM e GROUP BY GROUPING SETS ((), (difficulty)))",
    last="SELECT difficulty, round(a, 6) AS baseline, round(b, 6) AS candidate, round(b - a, 6) AS delta FROM k",
)
ORACLES["classify_kind_hist"] = with_base(last=f"SELECT col, {kind('text')} AS kind, count(*) AS n FROM tru GROUP BY ALL")
ORACLES["kind_of_words"] = f"""
WITH w AS (SELECT unnest(string_split_regex(text, '[\\t-\\r ]+')) AS t FROM documents), d AS (SELECT t, {norm('t')} AS s, count(*) AS n FROM w WHERE t <> '' GROUP BY t)
SELECT {kind('s')} AS kind, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY ALL"""
ORACLES["induce_kind"] = with_base(
    f"v AS (SELECT uid, col, {kind('text')} AS kind, row FROM tru WHERE text <> ''), c AS (SELECT uid, col, kind, count(*) AS n, min(row) AS f FROM v GROUP BY ALL), b AS (SELECT uid, col, kind, row_number() OVER (PARTITION BY uid, col ORDER BY n DESC, f) AS k FROM c)",
    last="SELECT t.uid, t.col, coalesce(b.kind, 'other') AS kind FROM (SELECT DISTINCT uid, col FROM tru) t LEFT JOIN b ON b.uid = t.uid AND b.col = t.col AND b.k = 1",
)
ORACLES["kind_accepts"] = with_base(
    f"v AS (SELECT col, text, {kind('text')} AS seen FROM pred), k AS (SELECT * FROM (VALUES (0, 'text'), (1, 'numeric'), (2, 'amount'), (3, 'symbol'), (4, 'percent'), (5, 'percent'), (6, 'symbol')) x(col, want))",
    last="SELECT col, want, count(*) FILTER (text = '' OR want = 'text' OR (want IN ('numeric', 'amount', 'percent') AND seen IN ('numeric', 'amount', 'percent')) OR (want = 'symbol' AND seen = 'symbol')) AS accepted, count(*) AS n FROM v JOIN k USING (col) GROUP BY ALL",
)
ORACLES["parse_number"] = with_base(last="SELECT col, count(*) AS n, count(TRY_CAST(replace(text, '%', '') AS DOUBLE)) AS numbers, round(sum(TRY_CAST(replace(text, '%', '') AS DOUBLE)), 2) AS total FROM tru GROUP BY col")
ORACLES["dedup_first"] = """
WITH k AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents)
SELECT doc_id AS ord FROM k WHERE n = 1"""
ORACLES["top_n_hardest"] = f"WITH {_SCANNED} SELECT ord, round(score, 9) AS score FROM scanned ORDER BY scanned.score DESC, ord LIMIT 50"
ORACLES["score_summary"] = f"""WITH {_SCANNED}, r AS (SELECT score, row_number() OVER (ORDER BY score, ord) - 1 AS k, count(*) OVER () AS n FROM scanned)
SELECT max(n) AS n, round(max(score) FILTER (k = least(CAST(floor(0.1::DOUBLE * n) AS BIGINT), n - 1)), 9) AS p10, round(max(score) FILTER (k = least(CAST(floor(0.5::DOUBLE * n) AS BIGINT), n - 1)), 9) AS p50,
 round(max(score) FILTER (k = least(CAST(floor(0.9::DOUBLE * n) AS BIGINT), n - 1)), 9) AS p90, count(*) FILTER (score < 0.3) AS easy, count(*) FILTER (score >= 0.3 AND score < 0.55) AS medium, count(*) FILTER (score >= 0.55) AS hard, 0::BIGINT AS empty FROM r"""
ORACLES["percentile_bins"] = f"""WITH {_SCANNED}, r AS (SELECT ord, score, row_number() OVER (ORDER BY score, ord) - 1 AS k, count(*) OVER () AS n FROM scanned),
c AS (SELECT max(score) FILTER (k = least(CAST(floor(0.4::DOUBLE * n) AS BIGINT), n - 1)) AS m, max(score) FILTER (k = least(CAST(floor(0.7::DOUBLE * n) AS BIGINT), n - 1)) AS h FROM r)
SELECT CASE WHEN score >= h THEN 'hard' WHEN score >= m THEN 'medium' ELSE 'easy' END AS bin, count(*) AS n FROM r, c GROUP BY ALL"""
ORACLES["leakage_overlap"] = "SELECT trim(text) AS text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT trim(text) AS text FROM documents WHERE doc_id % 2 = 1"
ORACLES["difficulty_score"] = with_base(
    """c AS (SELECT uid, max(row + rowspan) AS n_rows, max(col + colspan) AS n_cols, count(*) AS n_cells, count(*) FILTER (rowspan > 1 OR colspan > 1) AS n_spanning, sum(rowspan * colspan) AS covered FROM tru GROUP BY uid)""",
    last="""SELECT uid, n_rows, n_cols, n_cells, n_spanning, round(0.40 * least(n_spanning / n_cells::DOUBLE / 0.15, 1.0) + 0.25 * 0.5 + 0.15 * least(greatest(0.0, (n_rows * n_cols - covered) / (n_rows * n_cols)::DOUBLE) / 0.05, 1.0) + 0.20 * least(n_cells / 150.0::DOUBLE, 1.0), 6) AS score FROM c""",
)
ORACLES["column_separators"] = with_base(_SEPS, last="SELECT doc_id, k, separator FROM sep")
ORACLES["grid_assign"] = with_base(_COLS, last="SELECT doc_id, ord, gcol AS col FROM plc")
ORACLES["grid_complete"] = with_base(
    _COLS,
    "g AS (SELECT doc_id, row, gcol AS col, string_agg(text, ' ' ORDER BY x, ord) AS text FROM plc GROUP BY ALL), e AS (SELECT doc_id, row, unnest(range(n_cols)) AS col FROM (SELECT DISTINCT doc_id, row FROM plc) JOIN nc USING (doc_id))",
    last="SELECT e.doc_id, e.row, CAST(e.col AS INT) AS col, coalesce(g.text, '') AS text FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.row = e.row AND g.col = e.col",
)
ORACLES["cluster_rows"] = with_base(
    """q AS (SELECT doc_id, ord, row * 20 + (pk * 7 + col * 5) % 17 + h / 2 AS cy, row_number() OVER (PARTITION BY doc_id ORDER BY row * 20 + (pk * 7 + col * 5) % 17, ord) AS k FROM words)""",
    """f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS ord, 0.0::DOUBLE AS total, 0::BIGINT AS n, -1 AS row FROM q UNION ALL
  SELECT q.doc_id, q.k, q.ord, CASE WHEN stays THEN total + cy ELSE cy END, CASE WHEN stays THEN n + 1 ELSE 1 END, CASE WHEN stays THEN row ELSE row + 1 END
  FROM (SELECT q.doc_id, q.k, q.ord, q.cy, f.total, f.n, f.row, f.n > 0 AND abs(q.cy - f.total / greatest(f.n, 1)) <= 12.0::DOUBLE * 0.6::DOUBLE AS stays FROM f JOIN q ON q.doc_id = f.doc_id AND q.k = f.k + 1) q)""",
    last="SELECT doc_id, ord, row FROM f WHERE k > 0",
)
_TRACKS = _COLS + """,
nr AS (SELECT doc_id, count(DISTINCT row) AS n_rows FROM plc GROUP BY doc_id),
tr AS (SELECT doc_id, gcol AS col, min(x) AS x1, max(x + w) AS x2, count(DISTINCT row) AS fill FROM plc GROUP BY ALL)"""
ORACLES["track_fill"] = with_base(_TRACKS, last="SELECT doc_id, col, x1, x2, fill, n_rows FROM tr JOIN nr USING (doc_id)")
ORACLES["anchors"] = with_base(
    _TRACKS,
    "o AS (SELECT doc_id, col, fill / n_rows::DOUBLE AS o FROM tr JOIN nr USING (doc_id)), b AS (SELECT *, max(o) OVER (PARTITION BY doc_id) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, col) AS k FROM o)",
    last="SELECT doc_id, col FROM b WHERE CASE WHEN m >= 0.8 THEN o >= 0.8 ELSE k = 1 END",
)
ORACLES["contested"] = with_base(_COLS, last="SELECT doc_id, ord, min(k) AS k FROM words w JOIN sep s USING (doc_id) WHERE abs(w.x + w.w / 2 - s.separator) <= 12 GROUP BY ALL")
ORACLES["alignment"] = with_base(
    _COLS, "s AS (SELECT doc_id, gcol AS col, count(*) AS n, round(stddev_pop(x), 9) AS l, round(stddev_pop(x + w), 9) AS r, round(stddev_pop(x + w / 2), 9) AS c FROM plc GROUP BY ALL)",
    last="SELECT doc_id, col, CASE WHEN n < 2 OR (l <= r AND l <= c) THEN 'left' WHEN r <= c THEN 'right' ELSE 'center' END AS align FROM s",
)
ORACLES["pitch"] = with_base(
    "rc AS (SELECT doc_id, row, avg(y + h / 2) AS cy FROM words GROUP BY ALL), g AS (SELECT doc_id, cy - lag(cy) OVER (PARTITION BY doc_id ORDER BY cy) AS gap FROM rc)",
    last="SELECT doc_id, round(coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 12.0), 6) AS pitch FROM g GROUP BY doc_id",
)
ORACLES["merge_fragments"] = with_base(
    """q AS (SELECT doc_id, CASE WHEN row >= 3 THEN 2 ELSE 1 END AS page, read * 100000 + ord AS ord, CASE WHEN read = 2 AND pk % 4 = 0 THEN text || '?' ELSE text END AS text, x + read * w * (20 + pk % 30) / 100.0 AS x, y, w, h
  FROM words, (VALUES (0), (1), (2)) v(read)), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS k FROM q)""",
    """f AS (SELECT DISTINCT doc_id, page, 0::BIGINT AS k, 0::BIGINT AS ord, 0::BIGINT AS cluster, CAST([] AS STRUCT(o BIGINT, x DOUBLE, y DOUBLE, u DOUBLE, v DOUBLE)[]) AS seeds FROM p UNION ALL
  SELECT doc_id, page, k, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(seeds, {'o': ord, 'x': x, 'y': y, 'u': u, 'v': v}) ELSE seeds END
  FROM (SELECT p.doc_id, p.page, p.k, p.ord, p.x, p.y, p.x + p.w AS u, p.y + p.h AS v, f.seeds, list_filter(f.seeds, lambda s: greatest(0, least(s.u, p.x + p.w) - greatest(s.x, p.x)) * greatest(0, least(s.v, p.y + p.h) - greatest(s.y, p.y))
    >= 0.5::DOUBLE * ((s.u - s.x) * (s.v - s.y) + p.w * p.h - greatest(0, least(s.u, p.x + p.w) - greatest(s.x, p.x)) * greatest(0, least(s.v, p.y + p.h) - greatest(s.y, p.y))))[1].o AS hit
    FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page AND p.k = f.k + 1))""",
    """c AS (SELECT f.doc_id, f.page, f.cluster, p.ord, p.text, p.x, p.y, p.w, p.h FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page AND p.ord = f.ord WHERE f.k > 0),
t AS (SELECT doc_id, page, cluster, text, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT doc_id, page, cluster, max(n) / sum(n)::DOUBLE AS conf, count(*) > 1 AS contested FROM t GROUP BY ALL),
b AS (SELECT doc_id, page, cluster, avg(x) AS x, avg(y) AS y, avg(w) AS w, avg(h) AS h FROM c GROUP BY ALL),
i AS (SELECT b.*, m.conf, m.contested, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.page, round(y + h / 2, 1), x + w / 2, b.cluster) - 1 AS id FROM b JOIN m USING (doc_id, page, cluster))""",
    last="SELECT doc_id, count(*) AS fragments, count(*) FILTER (contested) AS contested, round(sum(x), 6) AS x_sum, round(sum(conf), 6) AS conf_sum, round(sum(id * conf * page), 6) AS order_sum FROM i GROUP BY doc_id",
)
ORACLES["fragment_identity"] = with_base(
    """c AS (SELECT doc_id, ord, CASE WHEN pk % 6 = 0 THEN [ord + 50000] WHEN pk % 9 = 1 THEN [ord, ord] WHEN pk % 10 = 3 THEN [] ELSE [ord] END AS f FROM words),
refs AS (SELECT doc_id, ord, unnest(f) AS fid, unnest(range(len(f))) AS pos FROM c), known AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fid ORDER BY ord, pos) AS n FROM refs r WHERE EXISTS (SELECT 1 FROM words w WHERE w.doc_id = r.doc_id AND w.ord = r.fid)),
ign AS (SELECT doc_id, ord AS fid FROM words WHERE pk % 4 = 1 UNION ALL SELECT DISTINCT doc_id, 90000 FROM words),
found AS (SELECT doc_id, 'uncited' AS k FROM c WHERE len(f) = 0
  UNION ALL SELECT doc_id, 'invented' FROM refs r WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = r.doc_id AND w.ord = r.fid)
  UNION ALL SELECT doc_id, 'duplicated' FROM known WHERE n > 1
  UNION ALL SELECT doc_id, 'unknown' FROM ign i WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = i.doc_id AND w.ord = i.fid)
  UNION ALL SELECT doc_id, 'both' FROM ign i WHERE EXISTS (SELECT 1 FROM known u WHERE u.doc_id = i.doc_id AND u.fid = i.fid)
  UNION ALL SELECT doc_id, 'dropped' FROM words w WHERE NOT EXISTS (SELECT 1 FROM known u WHERE u.doc_id = w.doc_id AND u.fid = w.ord) AND NOT EXISTS (SELECT 1 FROM ign i WHERE i.doc_id = w.doc_id AND i.fid = w.ord))""",
    last="SELECT doc_id, " + ", ".join(f"count(*) FILTER (k = '{k}') AS {k}" for k in ("uncited", "invented", "duplicated", "dropped", "both", "unknown")) + " FROM found GROUP BY doc_id",
)
ORACLES["fill_cells"] = with_base(last="SELECT doc_id, row AS r, string_agg(text, ' ' ORDER BY x, ord) AS t, min(x) AS x1, max(x + w) AS x2 FROM words GROUP BY ALL")
ORACLES["vote_cells"] = with_base(
    """d AS (SELECT doc_id, ord, row, col, text, pk, unnest([0, 1, 2]) AS draft FROM words), e AS (SELECT doc_id, draft, row, col, CASE WHEN (draft = 1 AND pk % 3 = 0) OR (draft = 2 AND pk % 4 = 0) THEN text || '*' ELSE text END AS t FROM d WHERE NOT (draft > 0 AND pk % 5 = 0)),
k AS (SELECT doc_id, count(DISTINCT draft) AS k FROM e GROUP BY doc_id), c AS (SELECT doc_id, row, col, lower(t) AS key, count(*) AS votes, min(draft) AS f, arg_min(t, draft) AS t FROM e GROUP BY ALL),
a AS (SELECT *, sum(votes) OVER (PARTITION BY doc_id, row, col) AS entries, row_number() OVER (PARTITION BY doc_id, row, col ORDER BY votes DESC, f) AS n FROM c)""",
    last="SELECT a.doc_id, a.row AS r, a.col AS c, a.t, a.votes, round(a.votes / k.k::DOUBLE, 9) AS confidence FROM a JOIN k ON k.doc_id = a.doc_id WHERE n = 1 AND 2 * entries > k.k",
)
ORACLES["overlap_check"] = with_base(
    "c AS (SELECT doc_id, ord, row AS r, col AS c, CASE WHEN pk % 8 = 0 THEN 2 ELSE 1 END AS cs FROM words), p AS (SELECT doc_id, ord, r, c + i AS x FROM c, (VALUES (0), (1)) v(i) WHERE i < cs), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, r, x ORDER BY ord) AS n FROM p)",
    last="SELECT doc_id, count(*) AS overlaps FROM n WHERE n > 1 GROUP BY doc_id",
)
ORACLES["word_bag"] = with_base(
    """c AS (SELECT doc_id, string_agg(CASE WHEN pk % 6 = 0 THEN text || '!' WHEN pk % 10 = 1 THEN 'zz' || substr(text, 2) ELSE text END, ' ' ORDER BY ord) AS joined, list_distinct(flatten(list(string_split(text, ' ')))) AS bag FROM words GROUP BY doc_id),
n AS (SELECT doc_id, len(list_filter(list_distinct(string_split(joined, ' ')), lambda t: t <> '' AND NOT list_contains(bag, t))) AS invented, (SELECT count(*) FROM words w WHERE w.doc_id = c.doc_id AND NOT contains(c.joined, w.text)) AS dropped FROM c)""",
    last="SELECT * FROM n WHERE invented + dropped > 0",
)
ORACLES["type_coherence"] = with_base(
    f"""v AS (SELECT uid, pk, row, col, text, {kind('text')} AS k FROM pred WHERE text <> ''), c AS (SELECT uid, col, k, count(*) AS n, min(row) AS f FROM v GROUP BY ALL),
b AS (SELECT uid, col, k AS kind, row_number() OVER (PARTITION BY uid, col ORDER BY n DESC, f) AS o FROM c),
j AS (SELECT v.*, b.kind, CASE WHEN kind IN ('numeric', 'amount', 'percent') THEN k IN ('numeric', 'amount', 'percent') WHEN kind = 'symbol' THEN k = 'symbol' WHEN kind = 'date' THEN k IN ('date', 'numeric') ELSE true END AS ok FROM v JOIN b ON b.uid = v.uid AND b.col = v.col AND b.o = 1),
s AS (SELECT *, count(*) OVER (PARTITION BY uid, col) AS n, count(*) FILTER (ok) OVER (PARTITION BY uid, col) AS good FROM j)""",
    last="SELECT uid AS doc_id, row AS r, col AS c FROM s WHERE kind IN ('numeric', 'amount', 'percent', 'symbol', 'date') AND n >= 3 AND good / n::DOUBLE >= 0.66 AND NOT ok",
)
ORACLES["arithmetic_near_miss"] = with_base(
    """v AS (SELECT uid, col, row, TRY_CAST(replace(text, '%', '') AS DOUBLE) AS v FROM tru WHERE text <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY uid, col ORDER BY abs(v) DESC, row) AS k FROM v WHERE v IS NOT NULL),
s AS (SELECT uid, col, count(*) AS n, max(v) FILTER (k = 1) AS t, max(abs(v)) FILTER (k = 2) AS s2, sum(v) - max(v) FILTER (k = 1) AS rest FROM r GROUP BY ALL)""",
    last="SELECT uid AS doc_id, col AS c FROM s WHERE n >= 4 AND abs(t) >= 1.2 * s2 AND abs(t - rest) / greatest(abs(t), abs(rest), 1.0) > 0.005 AND abs(t - rest) / greatest(abs(t), abs(rest), 1.0) <= 0.08",
)
ORACLES["geometry_shift"] = with_base(
    """c AS (SELECT doc_id, ord, row, CASE WHEN doc_id % 13 = 0 THEN 6 - col WHEN pk % 17 = 0 AND col > 0 THEN col - 1 ELSE col END AS c, x + w / 2 AS m FROM words), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, row, c ORDER BY ord) AS k FROM c) WHERE k = 1),
q AS (SELECT doc_id, c, quantile_cont(m, 0.5) AS z FROM d GROUP BY ALL), n AS (SELECT d.doc_id, d.row, d.c, q.c AS near, row_number() OVER (PARTITION BY d.doc_id, d.row, d.c ORDER BY abs(q.z - d.m), q.c) AS k, count(*) OVER (PARTITION BY d.doc_id, d.row, d.c) AS nq FROM d JOIN q ON q.doc_id = d.doc_id),
o AS (SELECT doc_id, c, z >= lead(z) OVER (PARTITION BY doc_id ORDER BY c) AS wrong FROM q)""",
    last="SELECT doc_id, row AS r, c FROM n WHERE k = 1 AND nq >= 2 AND near <> c UNION ALL SELECT doc_id, NULL, c FROM o WHERE wrong",
)
ORACLES["schema_echo"] = with_base(last="SELECT d.doc_id, c.c FROM (SELECT DISTINCT doc_id FROM words) d, (SELECT unnest(range(7))::INT AS c) c WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = d.doc_id AND w.col = c.c)")
_TRIAL = f"""v AS (SELECT uid, pk, row, col, text, {kind('text')} AS k FROM pred WHERE text <> '' AND col >= 0),
att AS (SELECT uid, count(DISTINCT col) AS n FROM v GROUP BY uid), pos AS (SELECT uid, col, row_number() OVER (PARTITION BY uid ORDER BY col) - 1 AS pos FROM (SELECT DISTINCT uid, col FROM v)),
cand AS (SELECT * FROM (VALUES (0, 0, 'text'), (0, 1, 'numeric'), (0, 2, 'amount'), (0, 3, 'symbol'), (0, 4, 'percent'), (0, 5, 'percent'), (0, 6, 'symbol'), (1, 0, 'text'), (1, 1, 'numeric'), (1, 2, 'numeric'), (1, 3, 'numeric'), (1, 4, 'percent'), (1, 5, 'symbol'), (2, 0, 'text'), (2, 1, 'symbol'), (2, 2, 'date')) x(cand, pos, want)),
sz AS (SELECT cand, count(*) AS n FROM cand GROUP BY cand),
bad AS (SELECT v.uid, c.cand, count(*) FILTER (NOT (want = 'text' OR (want IN ('numeric', 'amount', 'percent') AND k IN ('numeric', 'amount', 'percent')) OR (want = 'symbol' AND k = 'symbol') OR (want = 'date' AND k IN ('date', 'numeric')))) AS b FROM v JOIN pos USING (uid, col) JOIN cand c USING (pos) GROUP BY ALL),
t AS (SELECT att.uid AS doc_id, sz.cand, sz.n - att.n AS column_count_delta, coalesce(bad.b, 0) AS type_violations, abs(sz.n - att.n) * 100 + coalesce(bad.b, 0) AS total FROM att CROSS JOIN sz LEFT JOIN bad ON bad.uid = att.uid AND bad.cand = sz.cand)"""
ORACLES["schema_trial"] = with_base(_TRIAL, last="SELECT doc_id, cand, column_count_delta, type_violations, total FROM t")
ORACLES["select_schema"] = with_base(
    _TRIAL, "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total, cand) AS rank, min(total) OVER (PARTITION BY doc_id) AS best FROM t)",
    last="SELECT doc_id, cand, CAST(rank AS INT) AS rank, rank = 1 OR (rank = 2 AND total - best <= 50) AS carried, best > 300 AS out_of_family FROM r",
)
ORACLES["plan_tiles"] = """
WITH p AS (SELECT p_partkey AS page_id, 300 + p_partkey % 3000 AS width, 200 + p_size * 100 AS height FROM part),
x AS (SELECT page_id, width, height, unnest(CASE WHEN width <= 1024 THEN [0] ELSE list_distinct(list_concat(range(0, width - 1024 + 1, 819), [width - 1024])) END) AS x1 FROM p),
y AS (SELECT *, unnest(CASE WHEN height <= 1024 THEN [0] ELSE list_distinct(list_concat(range(0, height - 1024 + 1, 819), [height - 1024])) END) AS y1 FROM x)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, x1) - 1 AS INT) AS tile_no, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(least(x1 + 1024, width) AS INT) AS x2, CAST(least(y1 + 1024, height) AS INT) AS y2 FROM y"""
ORACLES["iou_pairs"] = with_base(
    "b AS (SELECT doc_id, ord, x AS x1, y AS y1, x + w * 1.5 AS x2, y + 26 AS y2 FROM words)",
    """i AS (SELECT a.doc_id, a.ord AS a, b.ord AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS n,
 (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM b a JOIN b ON a.doc_id = b.doc_id AND a.ord < b.ord)""",
    last="SELECT doc_id, a, b, round(n / (u - n), 6) AS iou FROM i WHERE n > 0",
)
ORACLES["levenshtein"] = "SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
ORACLES["clean_predictions"] = f"""
WITH {shapes(TABLE_ANSWERS)}, b AS (SELECT conv_id, turn, coalesce(list_filter(string_split(coalesce(raw, ''), '```'), lambda b, i: i % 2 = 0 AND contains(b, '<table'))[1], raw, '') AS s FROM r),
t AS (SELECT conv_id, turn, instr(lower(s), '<table') AS start, substr(s, instr(lower(s), '<table')) AS body FROM b),
c AS (SELECT *, instr(reverse(lower(body)), '>elbat/<') AS back FROM t)
SELECT conv_id, turn, CASE WHEN start = 0 THEN '' ELSE regexp_replace(CASE WHEN back > 0 THEN substr(body, 1, length(body) - back + 1) ELSE body END, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g') END AS html FROM c"""
ORACLES["strip_thinking"] = f"""
WITH {shapes(THOUGHTS)} SELECT conv_id, turn, regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS text FROM r"""
ORACLES["registry_gate"] = """
SELECT * FROM (VALUES ('mineru-2.5-pro', 'reader', 'specialist'), ('paddleocr-vl-1.6', 'reader', 'specialist'), ('dots-ocr', 'reader', 'specialist'), ('glm-ocr', 'reader', 'specialist'), ('qwen3-vl-30b-a3b', 'anchor', 'generative'), ('qwen3-vl-8b', 'student', 'generative'), ('qwen3-vl-4b', 'student', 'generative')) t(name, role, backend)"""
ORACLES["resume_anti_join"] = "SELECT doc_id AS uid, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"
ORACLES["length_filter"] = """
SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) + CAST(floor(least((200 + doc_id % 900) * 800, 1000000) / 784) AS INT) + 512 <= 2048"""
ORACLES["adjacency_f1"] = with_base(
    """c AS (SELECT uid, row, col, lower(text) AS t FROM tru WHERE text <> ''), d AS (SELECT uid, row, col, lower(text) AS t FROM pred WHERE text <> ''),
ta AS (SELECT a.uid, a.t AS a, b.t AS b, CASE WHEN a.row = b.row THEN 'r' ELSE 'd' END AS k, count(*) AS n FROM c a JOIN c b ON a.uid = b.uid AND ((a.row = b.row AND b.col = a.col + 1) OR (a.col = b.col AND b.row = a.row + 1)) GROUP BY ALL),
pa AS (SELECT a.uid, a.t AS a, b.t AS b, CASE WHEN a.row = b.row THEN 'r' ELSE 'd' END AS k, count(*) AS n FROM d a JOIN d b ON a.uid = b.uid AND ((a.row = b.row AND b.col = a.col + 1) OR (a.col = b.col AND b.row = a.row + 1)) GROUP BY ALL),
j AS (SELECT coalesce(ta.uid, pa.uid) AS uid, coalesce(ta.n, 0) AS t, coalesce(pa.n, 0) AS p FROM ta FULL JOIN pa ON ta.uid = pa.uid AND ta.a = pa.a AND ta.b = pa.b AND ta.k = pa.k)""",
    last="SELECT uid, round(2 * sum(least(t, p)) / (sum(t) + sum(p))::DOUBLE, 9) AS adjacency_f1 FROM j GROUP BY uid",
)
ORACLES["diagnostics"] = with_base(
    _PLACED,
    "ss AS (SELECT uid, max(row + rowspan) AS tr, max(col + colspan) AS tc, count(*) AS nt FROM tru GROUP BY uid), pp AS (SELECT uid, max(row + rowspan) AS pr, max(col + colspan) AS pc, count(*) AS np FROM pred GROUP BY uid)",
    last="SELECT uid, abs(tr - coalesce(pr, 0)) AS row_error, abs(tc - coalesce(pc, 0)) AS col_error, greatest(0, coalesce(np, 0) - nt) AS over_split, greatest(0, nt - coalesce(np, 0)) AS under_split, round(blank_preservation, 9) AS empty_recall FROM ss LEFT JOIN pp USING (uid) JOIN m USING (uid)",
)
ORACLES["reliability"] = with_base(
    _PLACED, "x AS (SELECT content_placement AS c, blank_preservation = 1.0 AS ok FROM m)",
    last="SELECT CAST(least(floor(c * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(c), 6) AS mean_confidence, round(avg(ok::INT), 6) AS accuracy FROM x GROUP BY ALL",
)
ORACLES["edge_accuracy"] = with_base(
    "t AS (SELECT doc_id, ord AS id, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS nx FROM words), p AS (SELECT doc_id, ord AS id, lead(ord) OVER (PARTITION BY doc_id ORDER BY CASE WHEN pk % 7 = 0 THEN ord + 100 ELSE ord END, ord) AS nx FROM words)",
    last="SELECT t.doc_id, count(*) AS edges, round(count(p.nx) / count(*)::DOUBLE, 9) AS edge_accuracy FROM t LEFT JOIN p ON p.doc_id = t.doc_id AND p.id = t.id AND p.nx = t.nx WHERE t.nx IS NOT NULL GROUP BY t.doc_id",
)

ORACLES["pages_table_scan"] = "SELECT 'empty' AS bin, count(*) AS n FROM pages"

_POISSON = []
_total, _term = 0.0, 0.36787944117144233
for _k in range(8):
    _total += _term
    _POISSON.append(f"CASE WHEN u >= {_total!r}::DOUBLE THEN 1 ELSE 0 END")
    _term /= _k + 1
ORACLES["bootstrap_poisson"] = with_base(
    _PLACED, _RUN.replace("SELECT difficulty", "SELECT uid, difficulty"),
    "d AS (SELECT uid, difficulty, content_placement AS v, b, CAST('0x' || substr(md5(uid || ':' || b), 1, 10) AS BIGINT)::DOUBLE / 1099511627776.0::DOUBLE AS u FROM e, (SELECT unnest(range(1, 21)) AS b))",
    f"k AS (SELECT difficulty, b, {' + '.join(_POISSON)} AS w, v FROM d), r AS (SELECT difficulty, b, sum(w * v) / sum(w) AS m FROM k GROUP BY ALL)",
    "l AS (SELECT difficulty, quantile_cont(m, 0.025::DOUBLE) AS lo, quantile_cont(m, 0.975::DOUBLE) AS hi FROM r GROUP BY ALL), g AS (SELECT difficulty, avg(content_placement) AS mean FROM e GROUP BY ALL)",
    last="SELECT difficulty, round(mean, 6) AS mean, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM g JOIN l USING (difficulty)",
)
ORACLES["grid_tokens"] = with_base(
    """c AS (SELECT uid, row, col, colspan AS cs FROM tru WHERE NOT (col = 1 AND pk % 5 = 0) AND NOT (col = 2 AND pk % 11 = 0)),
a AS (SELECT uid, row, col + i AS x, CASE WHEN i = 0 THEN 'C' ELSE 'L' END AS t FROM c, (VALUES (0), (1)) v(i) WHERE i < cs), d AS (SELECT uid, max(row) AS h, max(x) AS w FROM a GROUP BY uid),
g AS (SELECT uid, w, unnest(range(w + 1)) AS x, row FROM (SELECT uid, w, unnest(range(h + 1)) AS row FROM d))""",
    last="SELECT g.uid, string_agg(coalesce(a.t, 'E') || CASE WHEN g.x = g.w THEN ' NL' ELSE '' END, ' ' ORDER BY g.row, g.x) AS tokens FROM g LEFT JOIN a ON a.uid = g.uid AND a.row = g.row AND a.x = g.x GROUP BY g.uid",
)
_GRID = _COLS + """,
gc AS (SELECT doc_id, row, gcol AS col, string_agg(text, ' ' ORDER BY x, ord) AS text FROM plc GROUP BY ALL), ge AS (SELECT doc_id, row, unnest(range(n_cols)) AS col FROM (SELECT DISTINCT doc_id, row FROM plc) JOIN nc USING (doc_id)),
grid AS (SELECT e.doc_id, e.row, e.col, coalesce(g.text, '') AS text FROM ge e LEFT JOIN gc g ON g.doc_id = e.doc_id AND g.row = e.row AND g.col = e.col)"""
ORACLES["layout_text"] = with_base(
    _GRID, "w AS (SELECT *, max(length(text)) OVER (PARTITION BY doc_id, col) AS wide FROM grid), l AS (SELECT doc_id, row, rtrim(string_agg(text || repeat(' ', wide - length(text)), ' | ' ORDER BY col)) AS line FROM w GROUP BY ALL)",
    last="SELECT doc_id, string_agg(line, chr(10) ORDER BY row) AS text FROM l GROUP BY doc_id",
)
_SURVEY = _GRID + f""",
tk AS (SELECT doc_id, gcol AS col, {kind('text')} AS k, count(*) AS n, min(struct_pack(r := row, x := x, o := ord)) AS f FROM plc GROUP BY ALL), tkind AS (SELECT doc_id, col, arg_min(k, struct_pack(n := -n, f := f)) AS kind FROM tk GROUP BY ALL),
tfill AS (SELECT doc_id, gcol AS col, count(DISTINCT row) / (max(nr))::DOUBLE AS o FROM plc JOIN (SELECT doc_id, count(DISTINCT row) AS nr FROM plc GROUP BY doc_id) USING (doc_id) GROUP BY ALL),
anc AS (SELECT doc_id, col FROM (SELECT *, max(o) OVER (PARTITION BY doc_id) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, col) AS k FROM tfill) WHERE CASE WHEN m >= 0.8 THEN o >= 0.8 ELSE k = 1 END),
cell AS (SELECT g.doc_id, g.row, g.col, g.text, {kind('g.text')} AS k, t.kind, a.col IS NOT NULL AS lead FROM grid g LEFT JOIN tkind t ON t.doc_id = g.doc_id AND t.col = g.col LEFT JOIN anc a ON a.doc_id = g.doc_id AND a.col = g.col),
rk AS (SELECT doc_id, row, string_agg(text, '|' ORDER BY col) AS cells, count(*) FILTER (text <> '') AS n, arg_min(text, col) FILTER (text <> '') AS first, coalesce(bool_or(k IN ('numeric', 'amount', 'percent', 'symbol', 'date')) FILTER (text <> ''), false) AS value,
  coalesce(bool_and(lead) FILTER (text <> ''), true) AS inside, coalesce(bool_or(kind IN ('numeric', 'amount', 'percent', 'symbol', 'date') AND k = kind) FILTER (text <> ''), false) AS body FROM cell GROUP BY ALL),
rq AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN lower(trim(first)) IN ('total', 'totals', 'sum', 'subtotal', 'sub-total', 'final', 'balance', 'grand total') THEN 'summary' WHEN inside AND NOT value THEN 'section' ELSE 'data' END AS k0, min(row) FILTER (body) OVER (PARTITION BY doc_id) AS b FROM rk),
sv AS (SELECT doc_id, row, cells, CASE WHEN row < coalesce(b, 1073741824) AND k0 <> 'empty' AND n >= 2 AND NOT body THEN 'header' ELSE k0 END AS kind FROM rq)"""
ORACLES["page_survey"] = with_base(_SURVEY, last="SELECT s.doc_id, s.row, s.kind, s.cells, round(avg(w.y + w.h / 2), 6) AS cy FROM sv s JOIN words w ON w.doc_id = s.doc_id AND w.row = s.row GROUP BY ALL")
_HTML = """hc AS (SELECT doc_id, row, col, '<td data-bbox="' || CAST(round_even(x + {dx}, 0) AS BIGINT) || ',' || CAST(round_even(y, 0) AS BIGINT) || ',' || CAST(round_even(x + {dx} + w, 0) AS BIGINT) || ',' || CAST(round_even(y + h, 0) AS BIGINT) || '">' || text || '</td>' AS s FROM words),
hr AS (SELECT doc_id, unnest(range(max(row) + 1)) AS row FROM words GROUP BY doc_id), hg AS (SELECT doc_id, row, unnest(range(7)) AS col FROM hr),
ht AS (SELECT g.doc_id, g.row, '<tr>' || string_agg(coalesce(c.s, '<td></td>'), '' ORDER BY g.col) || '</tr>' AS s FROM hg g LEFT JOIN hc c ON c.doc_id = g.doc_id AND c.row = g.row AND c.col = g.col GROUP BY ALL),
html AS (SELECT doc_id, '<table>' || string_agg(s, '' ORDER BY row) || '</table>' AS html FROM ht GROUP BY doc_id)"""
ORACLES["cells_html"] = with_base(_HTML.format(dx="0"), last="SELECT doc_id, html FROM html")
ORACLES["skew"] = with_base(
    "a AS (SELECT doc_id, -3.0::DOUBLE + 2 * 3.0::DOUBLE * i / 60 AS a, x + w / 2 AS cx, y + h / 2 AS cy FROM words, (SELECT unnest(range(61)) AS i)), b AS (SELECT doc_id, a, floor((cx * cos(radians(a)) + cy * sin(radians(a))) / 12.0::DOUBLE) AS bin, count(*) AS n FROM a GROUP BY ALL)",
    "s AS (SELECT doc_id, a, sum(n * n) AS s FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, round(abs(a), 9), a DESC) AS k FROM s)",
    last="SELECT doc_id, round(a, 6) AS degrees FROM k WHERE k = 1",
)
# The predicted trees lack cells and nothing else, and no edit script is shorter than the difference of the sizes.
ORACLES["teds"] = with_base(
    "t AS (SELECT uid, 1 + count(DISTINCT row) + count(*) AS n FROM tru GROUP BY uid), p AS (SELECT uid, 1 + count(DISTINCT row) + count(*) AS n FROM pred GROUP BY uid)",
    last="SELECT uid, round(1 - (t.n - p.n) / t.n::DOUBLE, 9) AS teds_struct FROM t JOIN p USING (uid)",
)
