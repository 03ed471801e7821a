"""The registered queries over the star schema and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions import jaro as J
from mapweave.functions import text as T
from mapweave.operators import baselines as B
from mapweave.operators import candidates as C
from mapweave.operators import coherence as H
from mapweave.operators import evaluation as E
from mapweave.operators import explore as X
from mapweave.operators import resolution as R
from mapweave.operators import synonyms as Y
from mapweave.operators import synthesis as S
from mapweave.operators import views as V
from mapweave.operators.graph import checkpointed, shared_folder
from mapweave.plans import star_corpus as K
from mapweave.sources import corpus as L

QUERIES, SQL = {}, {}
NOISE = r"regexp_matches(trim(value), '^-?\d+(?:[.,]\d+)?$') OR regexp_matches(trim(value), '^(?:#|0x)[0-9a-fA-F]+$') OR lower(trim(value)) IN ('', '-', '--', '—', 'n/a', 'na', 'null', 'none', '?')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r9(c, name):
    return F.round(c, 9).alias(name)


# ---- coherence

COLUMNS = f"""{K.sql()}, vals AS (
  SELECT DISTINCT table_idx, col_idx, value FROM cells WHERE value <> '' AND NOT ({NOISE})
), cols AS (
  SELECT table_idx, col_idx, count(*) AS n FROM vals GROUP BY ALL
), good AS (
  SELECT v.* FROM vals v JOIN cols USING (table_idx, col_idx) WHERE n >= 2
), vc AS (SELECT value, count(*) AS n_cols FROM good GROUP BY value
), total AS (SELECT count(*) AS n FROM cols WHERE n >= 2
), prs AS (
  SELECT table_idx, col_idx, x.value AS u, y.value AS v FROM good x JOIN good y USING (table_idx, col_idx) WHERE x.value < y.value
), cooc AS (SELECT u, v, count(*) AS n FROM prs GROUP BY ALL
), scores AS (
  SELECT u, v, c.n, CASE WHEN c.n = t.n THEN 1.0 ELSE greatest(-1.0, least(1.0, ln((c.n / t.n) / ((a.n_cols / t.n) * (b.n_cols / t.n))) / -ln(c.n / t.n))) END AS npmi
  FROM cooc c JOIN vc a ON u = a.value JOIN vc b ON v = b.value, total t
), scored AS (
  SELECT table_idx, col_idx, coalesce(m, -1.0) AS score FROM (SELECT DISTINCT table_idx, col_idx FROM cells)
  LEFT JOIN (SELECT table_idx, col_idx, avg(npmi) AS m FROM prs JOIN scores USING (u, v) GROUP BY ALL) USING (table_idx, col_idx)
)"""


def _columns(spark, sf_dir):
    return checkpointed(H.column_values(K.cells(spark, sf_dir)))


def _scored(spark, sf_dir, width=K.FINE):
    return checkpointed(H.coherence(checkpointed(K.cells(spark, sf_dir, width))))


@query(f"WITH {COLUMNS} SELECT value, n_cols FROM vc")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.value_counts(_columns(spark, sf_dir))


@query(f"WITH {COLUMNS} SELECT u, v, n FROM cooc")
def cooccurrence(spark, sf_dir):
    return H.cooccurrence(_columns(spark, sf_dir))


@query(f"WITH {COLUMNS} SELECT n FROM total")
def total_columns(spark, sf_dir):
    return H.total_columns(_columns(spark, sf_dir))


@query(f"WITH {COLUMNS} SELECT u, v, n, round(npmi, 9) AS npmi FROM scores")
def npmi(spark, sf_dir):
    return H.npmi(_columns(spark, sf_dir)).select("u", "v", "n", r9("npmi", "npmi"))


@query(f"WITH {COLUMNS} SELECT table_idx, col_idx, round(score, 9) AS score FROM scored")
def coherence(spark, sf_dir):
    return _scored(spark, sf_dir).select("table_idx", "col_idx", r9("score", "score"))


@query(f"WITH {COLUMNS} SELECT table_idx, col_idx, round(score, 9) AS score FROM scored WHERE score >= 0.3")
def coherence_filter(spark, sf_dir):
    return H.keep_columns(_scored(spark, sf_dir)).select("table_idx", "col_idx", r9("score", "score"))


@query(f"""WITH {COLUMNS}, r AS (SELECT table_idx, string_agg(CASE WHEN score >= 0.3 THEN col_idx END, ',' ORDER BY col_idx) AS kept,
  string_agg(CASE WHEN score < 0.3 THEN col_idx END, ',' ORDER BY col_idx) AS rejected FROM scored GROUP BY table_idx)
SELECT table_idx, kept, coalesce(rejected, '') AS rejected FROM r WHERE kept IS NOT NULL""")
def rebuild_corpus(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return H.rebuild(_scored(spark, sf_dir)).select("table_idx", joined("kept_columns").alias("kept"), joined("rejected_columns").alias("rejected"))


@query(f"""WITH {COLUMNS}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS threshold)
SELECT threshold, count(*) FILTER (score >= threshold) AS kept, count(*) FILTER (score < threshold) AS removed, round(100.0 * count(*) FILTER (score >= threshold) / count(*), 1) AS pct_kept
FROM scored, t GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    return H.threshold_sweep(_scored(spark, sf_dir))


@query(f"WITH {COLUMNS} SELECT CAST(least(39, floor((round(score, 9) + 1) * 20)) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY ALL")
def coherence_histogram(spark, sf_dir):
    return H.histogram(_scored(spark, sf_dir).withColumn("score", F.round("score", 9)))


@query(f"""WITH {COLUMNS}, s AS (SELECT table_idx, col_idx, round(score, 9) AS score FROM scored),
r AS (SELECT *, CAST('removed' AS VARCHAR) AS kind, row_number() OVER (ORDER BY score, table_idx, col_idx) AS rank FROM s WHERE score < 0.3
UNION ALL SELECT *, 'kept', row_number() OVER (ORDER BY score DESC, table_idx, col_idx) FROM s WHERE score >= 0.3)
SELECT table_idx, col_idx, score, kind, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def filtering_report(spark, sf_dir):
    return H.filtering_report(_scored(spark, sf_dir).withColumn("score", F.round("score", 9)))


@query(f"WITH {COLUMNS} SELECT u, v, n FROM cooc ORDER BY n DESC, u, v LIMIT 20")
def top_pairs(spark, sf_dir):
    return H.top_pairs(_columns(spark, sf_dir))


@query(f"WITH {K.sql()} SELECT count(DISTINCT table_idx) AS tables, count(DISTINCT (table_idx, col_idx)) AS columns, count(DISTINCT value) AS unique_values FROM cells")
def corpus_summary(spark, sf_dir):
    return H.corpus_summary(K.cells(spark, sf_dir))


# ---- candidates

CANDS = COLUMNS + r""", kept AS (SELECT c.* FROM cells c JOIN scored USING (table_idx, col_idx) WHERE score >= 0.3 AND value <> ''
), cnt AS (
  SELECT a.table_idx, a.col_idx AS left_col, b.col_idx AS right_col, a.value AS x, b.value AS y, count(*) AS cnt, min(row_idx) AS seen
  FROM kept a JOIN kept b USING (table_idx, row_idx) WHERE a.col_idx <> b.col_idx GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY table_idx, left_col, right_col, x ORDER BY cnt DESC, seen) AS k,
    min(seen) OVER (PARTITION BY table_idx, left_col, right_col, x) AS first_row FROM cnt
), fd AS (
  SELECT table_idx, left_col, right_col, CAST(sum(cnt) AS BIGINT) AS row_count, CAST(sum(CASE WHEN k = 1 THEN cnt END) AS BIGINT) AS covered_rows,
    sum(CASE WHEN k = 1 THEN cnt END) / sum(cnt) AS theta, count(*) FILTER (k = 1) AS n_pairs FROM best GROUP BY ALL
  HAVING sum(cnt) >= 3 AND count(DISTINCT x) >= 2 AND count(DISTINCT y) >= 2
), cands AS (SELECT row_number() OVER (ORDER BY table_idx, left_col, right_col) - 1 AS cand, * FROM fd WHERE theta >= 0.95
), cp AS (
  SELECT cand, CAST(row_number() OVER (PARTITION BY cand ORDER BY first_row, x, y) - 1 AS INTEGER) AS pos, x AS l, y AS r
  FROM cands JOIN best USING (table_idx, left_col, right_col) WHERE k = 1
)"""
COARSE = CANDS.replace(K.sql(), K.sql(K.COARSE))


def _kept(spark, sf_dir, width=K.FINE):
    cells = checkpointed(K.cells(spark, sf_dir, width))
    return cells.join(H.keep_columns(H.coherence(cells)).select("table_idx", "col_idx"), ["table_idx", "col_idx"], "left_semi")


def _cands(spark, sf_dir, width=K.FINE):
    return checkpointed(C.candidates(_kept(spark, sf_dir, width)))


@query(f"WITH {CANDS} SELECT table_idx, left_col, right_col, round(theta, 9) AS theta, row_count, covered_rows FROM fd")
def approx_fd(spark, sf_dir):
    return C.approximate_fds(_kept(spark, sf_dir)).select("table_idx", "left_col", "right_col", r9("theta", "theta"), "row_count", "covered_rows")


@query(f"WITH {CANDS} SELECT cand, pos, l, r FROM cp")
def fd_candidates(spark, sf_dir):
    return C.explode_pairs(_cands(spark, sf_dir))


@query(f"WITH {CANDS} SELECT count(*) AS candidates, round(min(theta), 9) AS min_theta, round(avg(theta), 9) AS mean_theta, round(max(theta), 9) AS max_theta, CAST(sum(n_pairs) AS BIGINT) AS pairs FROM cands")
def candidate_summary(spark, sf_dir):
    return C.summary(_cands(spark, sf_dir)).select("candidates", r9("min_theta", "min_theta"), r9("mean_theta", "mean_theta"), r9("max_theta", "max_theta"), "pairs")


@query(f"WITH {CANDS} SELECT cand, CAST(n_pairs AS INTEGER) AS n_pairs, round(theta, 9) AS theta, CAST(row_number() OVER (ORDER BY n_pairs DESC, cand) AS INTEGER) AS rank FROM cands QUALIFY rank <= 5")
def top_candidates(spark, sf_dir):
    return C.top_candidates(_cands(spark, sf_dir)).select("cand", "n_pairs", r9("theta", "theta"), "rank")


#: Candidates made of dimensions that meet each rule: number, left, right, table.
_NOISY = [
    ("lower(n_name)", "lower(n_name)", "nation"), ("cast(n_nationkey as string)", "cast(n_regionkey as string)", "nation"), ("concat('0x', cast(n_nationkey as string))", "concat('#', cast(n_regionkey as string))", "nation"),
    ("lower(n_name)", "'n/a'", "nation"), ("lower(n_name)", "concat(cast(n_nationkey as string), ',5.1')", "nation"), ("lower(n_name)", "concat('$', cast(n_nationkey as string), ' x')", "nation"), ("lower(s_name)", "'abc'", "supplier"),
    ("lower(r_name)", "case when r_regionkey % 2 = 0 then 'yes' else 'f' end", "region"), ("md5(n_name)", "lower(n_name)", "nation"), ("lower(r_name)", "concat('https://example.org/', cast(r_regionkey as string))", "region"), ("lower(r_name)", "concat('/usr/lib/', cast(r_regionkey as string), 'b')", "region"),
    ("lower(r_name)", "case when r_regionkey % 2 = 0 then '----' else '???' end", "region"), ("lower(r_name)", "'const'", "region"), ("lower(r_name)", "cast(1990 + r_regionkey as string)", "region"), ("lower(r_name)", "concat(cast(10 + r_regionkey as string), '.04.1999')", "region"), ("lower(r_name)", "concat('r', cast(r_regionkey as string))", "region"),
    ("lower(c_mktsegment)", "lower(substr(c_mktsegment, 1, 3))", "customer"), ("lower(p_type)", "concat('k', cast(length(p_type) as string))", "part"), ("cast(2000 + r_regionkey as string)", "concat('x', cast(r_regionkey as string))", "region"),
]


def _noisy(spark, sf_dir):
    out = None
    for i, (left, right, name) in enumerate(_NOISY):
        one = K.table(spark, sf_dir, name).select(F.lit(i).cast("long").alias("cand"), F.expr(left).alias("l"), F.expr(right).alias("r")).distinct()
        out = one if out is None else out.union(one)
    return out


_NOISY_SQL = "np AS (" + " UNION ALL ".join(f"SELECT DISTINCT CAST({i} AS BIGINT) AS cand, {a.replace(' as string', ' AS VARCHAR')} AS l, {b.replace(' as string', ' AS VARCHAR')} AS r FROM {t}" for i, (a, b, t) in enumerate(_NOISY)) + ")"


def _each(test: str, how: str) -> str:
    return "bool_and(" + f" {how} ".join("(" + test.replace("V", s) + ")" for s in ("l", "r")) + ")"


_DATE_SQL = r"(regexp_matches(V, '^(19|20)\d{2}$') OR regexp_matches(V, '^(?:\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?|\d{4}[./-]\d{1,2}[./-]\d{1,2})$'))"
_RULES_SQL = [
    ("identity", "bool_and(l = r)"), ("int->int", _each(r"regexp_matches(V, '^-?\d+(?:[.,]\d+)?$')", "AND")), ("hex_pair", _each("regexp_matches(V, '^(?:#|0x)[0-9a-fA-F]+$')", "AND")), ("placeholder_dominated", _each("V IN ('', '-', '--', '—', 'n/a', 'na', 'null', 'none', '?')", "OR")),
    ("numeric_string", _each(f"NOT {_DATE_SQL} AND regexp_matches(V, '^[+-]?\\d[\\d ,._]*(?:[eE][+-]?\\d+)?$')", "OR")), ("currency_value", _each(r"regexp_matches(V, '[$€£¥₹₩₺₽¢]\s?\d|\d\s?[$€£¥₹₩₺₽¢]')", "OR")),
    ("number_dominated", _each(f"NOT {_DATE_SQL} AND length(regexp_replace(V, '[^a-z]', '', 'g')) > 0 AND length(regexp_replace(V, '[^0-9]', '', 'g')) > length(regexp_replace(V, '[^a-z]', '', 'g'))", "OR")),
    ("boolean_pair", _each("V IN ('true','false','yes','no','on','off','0','1','t','f','y','n')", "OR")), ("uuid_pair", _each("regexp_matches(V, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9a-f]{32}$')", "OR")),
    ("url_or_path", _each(r"regexp_matches(V, '^https?://') OR regexp_matches(V, '^(?:/[\w.-]+)+/?$')", "OR")), ("repeated_char", _each(r"regexp_matches(V, '^(-{3,}|\?{3,})$')", "OR")), ("constant_pair", "count(DISTINCT l) = 1 OR count(DISTINCT r) = 1"),
]
_REASONS_SQL = f"WITH {_NOISY_SQL}, q AS (SELECT cand, CASE {' '.join(f'WHEN {c} THEN {chr(39)}{n}{chr(39)}' for n, c in _RULES_SQL)} END AS reason FROM np GROUP BY cand)"


@query(_REASONS_SQL + " SELECT cand, reason FROM q")
def noise_rules(spark, sf_dir):
    return C.noise_reasons(_noisy(spark, sf_dir))


@query(_REASONS_SQL + " SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason")
def noise_reasons(spark, sf_dir):
    return C.noise_counts(_noisy(spark, sf_dir))


# ---- synthesis

PAIRS = COARSE + """, sp AS (SELECT a.cand AS ci, b.cand AS cj, count(*) AS shared_pairs FROM cp a JOIN cp b USING (l, r) WHERE a.cand < b.cand GROUP BY ALL
), sl AS (SELECT a.cand AS ci, b.cand AS cj, count(*) AS shared_lefts FROM (SELECT DISTINCT cand, l FROM cp) a JOIN (SELECT DISTINCT cand, l FROM cp) b USING (l) WHERE a.cand < b.cand GROUP BY ALL
), ov AS (SELECT ci, cj, coalesce(shared_pairs, 0) AS shared_pairs, coalesce(shared_lefts, 0) AS shared_lefts FROM sl FULL JOIN sp USING (ci, cj)
), edges AS (SELECT * FROM ov WHERE shared_pairs > 3 OR shared_lefts > 3
), sz AS (SELECT cand, count(*) AS n FROM cp GROUP BY cand
)"""
SCORES = """, met AS (SELECT e.ci, e.cj, a.l AS l1, a.r AS r1, bool_or({same_r}) AS hit, bool_or(NOT ({same_r})) AS clash
  FROM edges e JOIN cp a ON a.cand = e.ci JOIN cp b ON b.cand = e.cj AND ({same_l}) GROUP BY ALL
), es AS (SELECT e.ci, e.cj, coalesce(count(l1) FILTER (hit), 0) / least(any_value(x.n), any_value(y.n)) AS w_pos, -count(DISTINCT CASE WHEN clash THEN l1 END) / least(any_value(x.n), any_value(y.n)) AS w_neg
  FROM edges e LEFT JOIN met USING (ci, cj) JOIN sz x ON x.cand = e.ci JOIN sz y ON y.cand = e.cj GROUP BY e.ci, e.cj
)"""
EXACT = PAIRS + SCORES.format(same_l="a.l = b.l", same_r="a.r = b.r")
_CLOSE = "(a.{0} = b.{0} OR (least(length(a.{0}) // 5, length(b.{0}) // 5, 10) > 0 AND levenshtein(a.{0}, b.{0}) <= least(length(a.{0}) // 5, length(b.{0}) // 5, 10)))"
EDIT = PAIRS + SCORES.format(same_l=_CLOSE.format("l"), same_r=_CLOSE.format("r"))
ROOTS = """, links AS (SELECT ci AS a, cj AS b FROM es WHERE w_pos >= 0.85 UNION SELECT cj, ci FROM es WHERE w_pos >= 0.85
), reach(v, w) AS (SELECT cand, cand FROM cands UNION SELECT r.v, k.b FROM reach r JOIN links k ON r.w = k.a
), roots AS (SELECT v, min(w) AS root FROM reach GROUP BY v
)"""


def _coarse(spark, sf_dir):
    cands = _cands(spark, sf_dir, K.COARSE)
    return cands, checkpointed(C.explode_pairs(cands))


def _scores(spark, sf_dir, matcher=None):
    cands, pairs = _coarse(spark, sf_dir)
    return cands, pairs, checkpointed(S.edge_scores(pairs, checkpointed(S.overlap_edges(pairs, 3)), matcher))


@query(f"WITH {COARSE} SELECT l, r, string_agg(cand, ',' ORDER BY cand) AS cands FROM cp GROUP BY ALL")
def inverted_index(spark, sf_dir):
    return S.inverted_index(_coarse(spark, sf_dir)[1]).select("l", "r", F.array_join(F.col("cands").cast("array<string>"), ",").alias("cands"))


@query(f"WITH {PAIRS} SELECT ci, cj, shared_pairs, shared_lefts FROM edges")
def overlap_edges(spark, sf_dir):
    return S.overlap_edges(_coarse(spark, sf_dir)[1], 3)


@query(f"""WITH {COARSE}, bl AS (SELECT l FROM cp GROUP BY l HAVING count(DISTINCT cand) <= 20), bp AS (SELECT l, r FROM cp GROUP BY ALL HAVING count(*) <= 20),
p AS (SELECT a.cand AS ci, b.cand AS cj FROM cp a JOIN cp b USING (l, r) JOIN bp USING (l, r) WHERE a.cand < b.cand GROUP BY ALL HAVING count(*) > 0)
SELECT ci, cj FROM p UNION SELECT a.cand, b.cand FROM cp a JOIN cp b USING (l) JOIN bl USING (l) WHERE a.cand < b.cand""")
def overlap_edges_capped(spark, sf_dir):
    return S.overlap_edges(_coarse(spark, sf_dir)[1], 0, 20).select("ci", "cj")


@query(f"WITH {EXACT} SELECT ci, cj, round(w_pos, 9) AS w_pos, round(w_neg, 9) + 0.0 AS w_neg FROM es")
def edge_scores(spark, sf_dir):
    return _scores(spark, sf_dir)[2].select("ci", "cj", r9("w_pos", "w_pos"), (F.round("w_neg", 9) + 0.0).alias("w_neg"))


@query(f"WITH {EDIT} SELECT ci, cj, round(w_pos, 9) AS w_pos, round(w_neg, 9) + 0.0 AS w_neg FROM es")
def edge_scores_edit(spark, sf_dir):
    return _scores(spark, sf_dir, S.edit_matcher)[2].select("ci", "cj", r9("w_pos", "w_pos"), (F.round("w_neg", 9) + 0.0).alias("w_neg"))


# every two values of candidates are compared once: a small vocabulary of names
_VALUES = PAIRS + ", nv AS (SELECT t, {norm} AS x FROM (SELECT DISTINCT l AS t FROM cp UNION SELECT DISTINCT r FROM cp))"
_BY_VALUE = """, met AS (SELECT e.ci, e.cj, a.l AS l1, a.r AS r1, bool_or(vr.ok) AS hit, bool_or(NOT vr.ok) AS clash
  FROM edges e JOIN cp a ON a.cand = e.ci JOIN cp b ON b.cand = e.cj JOIN vm vl ON vl.p = a.l AND vl.q = b.l AND vl.ok JOIN vm vr ON vr.p = a.r AND vr.q = b.r GROUP BY ALL
)""" + SCORES[SCORES.index(", es AS"):]
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(V, e' \t')), '\(.*?\)', '', 'g'), '([a-z])\.([a-z])', '\1\2', 'g'), '([a-z])\.([a-z])', '\1\2', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_NG = "CASE WHEN V = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(V) - 1, 1) + 1), lambda i: substr(V, i, 2))) END"
_JAC = "CASE WHEN len(list_distinct({0} || {1})) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct({0} || {1})) END"
#: Jaro and Jaro-Winkler of the pairs jp(x, y), a character a step: the first free equal character in reach is taken.
_JARO = """, jr(x, y, i, free, ma) AS (SELECT x, y, 0, y, '' FROM jp WHERE x <> y AND x <> '' AND y <> '' UNION ALL
  SELECT x, y, i + 1, CASE WHEN spot > 0 THEN substr(free, 1, lo + spot - 1) || chr(1) || substr(free, lo + spot + 1) ELSE free END, CASE WHEN spot > 0 THEN ma || ch ELSE ma END
  FROM (SELECT *, CASE WHEN hi > lo THEN strpos(substr(free, lo + 1, hi - lo), ch) ELSE 0 END AS spot
    FROM (SELECT *, substr(x, i + 1, 1) AS ch, greatest(0, i - greatest(greatest(length(x), length(y)) // 2 - 1, 0)) AS lo, least(length(y), i + greatest(greatest(length(x), length(y)) // 2 - 1, 0) + 1) AS hi FROM jr WHERE i < length(x)))
), jm AS (SELECT x, y, length(ma) AS m, ma, array_to_string(list_transform(list_filter(range(1, length(y) + 1), lambda k: substr(free, k, 1) = chr(1)), lambda k: substr(y, k, 1)), '') AS mb FROM jr WHERE i = length(x)
), jv AS (SELECT x, y, m, len(list_filter(range(1, m + 1), lambda k: substr(ma, k, 1) <> substr(mb, k, 1))) AS moved FROM jm
), js AS (SELECT jp.x, jp.y, CASE WHEN jp.x = jp.y THEN 1.0::DOUBLE WHEN coalesce(m, 0) = 0 THEN 0.0::DOUBLE ELSE (m / length(jp.x) + m / length(jp.y) + (m - moved / 2) / m) / 3 END AS jaro FROM jp LEFT JOIN jv ON jv.x = jp.x AND jv.y = jp.y
), jw AS (SELECT x, y, jaro, jaro + CAST(CASE WHEN length(x) < 1 OR length(y) < 1 OR substr(x, 1, 1) <> substr(y, 1, 1) THEN 0 WHEN length(x) < 2 OR length(y) < 2 OR substr(x, 2, 1) <> substr(y, 2, 1) THEN 1 WHEN length(x) < 3 OR length(y) < 3 OR substr(x, 3, 1) <> substr(y, 3, 1) THEN 2
  WHEN length(x) < 4 OR length(y) < 4 OR substr(x, 4, 1) <> substr(y, 4, 1) THEN 3 ELSE 4 END AS DOUBLE) * 0.1::DOUBLE * (1 - jaro) AS winkler FROM js)"""
_NAMED = _VALUES.replace("{norm}", _NORM.replace("V", "t"))
_SCORED = " SELECT ci, cj, round(w_pos, 9) AS w_pos, round(w_neg, 9) + 0.0 AS w_neg FROM es"


@query(f"WITH {_NAMED}, ng AS (SELECT t, {_NG.replace('V', 'x')} AS c FROM nv), vm AS (SELECT a.t AS p, b.t AS q, {_JAC.format('a.c', 'b.c')} >= 0.5 AS ok FROM ng a, ng b){_BY_VALUE}{_SCORED}")
def edge_scores_jaccard(spark, sf_dir):
    return _scores(spark, sf_dir, S.jaccard_matcher)[2].select("ci", "cj", r9("w_pos", "w_pos"), (F.round("w_neg", 9) + 0.0).alias("w_neg"))


@query(f"WITH RECURSIVE {_NAMED}, jp AS (SELECT DISTINCT a.x, b.x AS y FROM nv a, nv b){_JARO}, vm AS (SELECT a.t AS p, b.t AS q, a.t <> '' AND b.t <> '' AND winkler >= 0.85 AS ok FROM nv a, nv b, jw WHERE jw.x = a.x AND jw.y = b.x){_BY_VALUE}{_SCORED}")
def edge_scores_jw(spark, sf_dir):
    return _scores(spark, sf_dir, J.jaro_winkler_match)[2].select("ci", "cj", r9("w_pos", "w_pos"), (F.round("w_neg", 9) + 0.0).alias("w_neg"))


@query(f"WITH {EXACT} SELECT count(*) AS edges, count(*) FILTER (w_pos >= 0.5) AS positive, count(*) FILTER (w_neg < 0) AS negative, count(*) FILTER (w_neg < -0.2) AS blocking FROM es")
def edge_report(spark, sf_dir):
    return S.edge_report(_scores(spark, sf_dir)[2], 0.5)


@query(f"WITH {EXACT} SELECT ci, cj, round(w_neg, 9) AS w_neg FROM es WHERE w_neg < 0")
def negative_edges(spark, sf_dir):
    return S.negative_edges(_scores(spark, sf_dir)[2]).select("ci", "cj", r9("w_neg", "w_neg"))


@query(f"WITH RECURSIVE {EXACT}{ROOTS} SELECT v, root FROM roots")
def components(spark, sf_dir):
    cands, _, scores = _scores(spark, sf_dir)
    return S.candidate_components(scores, cands)


def _maps(spark, sf_dir, theta_edge=0.85):
    cands, pairs = _coarse(spark, sf_dir)
    parts = checkpointed(S.partition_pairs(pairs, cands, 3, theta_edge=theta_edge))
    return cands, pairs, parts, checkpointed(S.mappings(parts, pairs))


@query()
def greedy_partition(spark, sf_dir):
    """Coded and plain fragments share edges at this threshold, so that conflicts block merges."""
    return _maps(spark, sf_dir, 0.5)[2]


# with the default threshold no conflict blocks a merge inside a component, so that partitions are components
_TAIL = """, mp AS (SELECT root AS partition, l, r, count(*) AS support FROM roots JOIN cp ON cp.cand = v GROUP BY ALL
), maps AS (SELECT partition, count(*) AS size, (SELECT count(*) FROM roots WHERE root = partition) AS num_source_tables FROM mp GROUP BY partition
), res AS (SELECT partition, l, max(r) AS r FROM mp GROUP BY ALL
), maj AS (SELECT partition, l, r, support FROM mp QUALIFY row_number() OVER (PARTITION BY partition, l ORDER BY support DESC, r) = 1
)"""
MAPS = EXACT + ROOTS + _TAIL
M = "WITH RECURSIVE " + MAPS
# resolution sees all candidates of a column pair as one mapping: there the two codings of regions conflict
GROUPED = COARSE + ", roots AS (SELECT cand AS v, CAST(left_col * 1000 + right_col AS BIGINT) AS root FROM cands)" + _TAIL
G = "WITH " + GROUPED


def _grouped(spark, sf_dir):
    cands, pairs = _coarse(spark, sf_dir)
    parts = cands.select("cand", (F.col("left_col") * 1000 + F.col("right_col")).cast("long").alias("partition"))
    return cands, pairs, parts, checkpointed(S.mappings(parts, pairs))


@query(f"{M} SELECT partition, l, r FROM mp")
def synthesize(spark, sf_dir):
    return R.exploded(_maps(spark, sf_dir)[3])


@query(f"{M} SELECT count(*) AS mappings, count(*) FILTER (num_source_tables = 1) AS singletons, CAST(min(size) AS INTEGER) AS min_size, round(avg(size), 9) AS mean_size, CAST(max(size) AS INTEGER) AS max_size FROM maps")
def synthesis_report(spark, sf_dir):
    return S.report(_maps(spark, sf_dir)[3]).withColumn("mean_size", F.round("mean_size", 9))


@query(f"""{M}, tp AS (SELECT *, row_number() OVER (ORDER BY size DESC, partition) AS rank FROM maps QUALIFY rank <= 5), sm AS (SELECT partition, string_agg(l || '>' || r, '|' ORDER BY l, r) AS sample FROM (SELECT * FROM mp QUALIFY row_number() OVER (PARTITION BY partition ORDER BY l, r) <= 3) GROUP BY partition)
SELECT CAST(rank AS INTEGER) AS rank, partition, CAST(size AS INTEGER) AS size, CAST(num_source_tables AS INTEGER) AS num_source_tables, sample FROM tp JOIN sm USING (partition)""")
def synthesis_top(spark, sf_dir):
    return _sampled(S.top(_maps(spark, sf_dir)[3]))


@query(f"{G} SELECT partition, l, string_agg(r, '|' ORDER BY r) AS rights FROM mp GROUP BY ALL HAVING count(*) > 1")
def find_conflicts(spark, sf_dir):
    return R.find_conflicts(R.exploded(_grouped(spark, sf_dir)[3])).select("partition", "l", F.array_join("rights", "|").alias("rights"))


@query(f"{G} SELECT partition, l, r FROM res")
def resolve_conflicts(spark, sf_dir):
    return R.resolve(R.exploded(_grouped(spark, sf_dir)[3]))


@query(f"""{G}, n AS (SELECT partition, count(*) AS k FROM res GROUP BY partition)
SELECT count(*) AS mappings, count(*) FILTER (size > k) AS with_conflicts, CAST(sum(size - k) AS BIGINT) AS removed, CAST(sum(k) AS BIGINT) AS kept FROM n JOIN maps USING (partition)""")
def resolution_report(spark, sf_dir):
    rows = R.exploded(_grouped(spark, sf_dir)[3])
    return R.report(R.nested(R.resolve(rows), rows))


@query(f"{G} SELECT partition, l, r, support FROM mp")
def pair_support(spark, sf_dir):
    _, pairs, parts, _ = _grouped(spark, sf_dir)
    return R.pair_support(parts, pairs)


@query(f"{G} SELECT partition, l, r, support FROM maj")
def majority_vote(spark, sf_dir):
    _, pairs, parts, maps = _grouped(spark, sf_dir)
    return R.majority(R.exploded(maps), R.pair_support(parts, pairs))


@query(f"""{G}, n AS (SELECT partition, count(*) AS k FROM maj GROUP BY partition)
SELECT count(*) AS mappings, count(*) FILTER (size > k) AS with_conflicts, CAST(sum(size - k) AS BIGINT) AS removed, CAST(sum(k) AS BIGINT) AS kept FROM n JOIN maps USING (partition)""")
def majority_report(spark, sf_dir):
    _, pairs, parts, maps = _grouped(spark, sf_dir)
    rows = R.exploded(maps)
    return R.report(R.nested(R.majority(rows, R.pair_support(parts, pairs)), rows))


@query(f"""{G}, cf AS (SELECT partition, l FROM mp GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS lefts, (SELECT count(*) FROM cf) AS conflicting, count(a.r) AS kept_a, count(b.r) AS kept_b, count(*) FILTER (a.r IS DISTINCT FROM b.r) AS disagreements FROM res a FULL JOIN maj b USING (partition, l)""")
def resolver_compare(spark, sf_dir):
    _, pairs, parts, maps = _grouped(spark, sf_dir)
    rows = R.exploded(maps)
    return R.compare(rows, R.resolve(rows), R.majority(rows, R.pair_support(parts, pairs)))


CONF = GROUPED + """, th AS (SELECT root AS partition, l, r, avg(theta) AS avg_theta FROM roots JOIN cp ON cp.cand = v JOIN cands c ON c.cand = v GROUP BY ALL
), conf AS (SELECT m.*, res.r IS NOT NULL AS survived, greatest(0.0, least(1.0, 0.5 * support / max(support) OVER (PARTITION BY partition) + 0.3 * greatest(0.0, least(1.0, (avg_theta - 0.95) / 0.05))
  + 0.2 * CASE WHEN res.r IS NOT NULL THEN 1.0 ELSE 0.3 END)) AS raw FROM mp m JOIN th USING (partition, l, r) LEFT JOIN res USING (partition, l, r)
)"""


def _confidence(spark, sf_dir):
    cands, pairs, parts, maps = _grouped(spark, sf_dir)
    rows = R.exploded(maps)
    return R.confidence(rows, parts, cands, pairs, R.resolve(rows))


@query(f"WITH {CONF} SELECT partition, l, r, support, survived, round(round(raw, 9), 4) AS confidence FROM conf")
def confidence(spark, sf_dir):
    return _confidence(spark, sf_dir).select("partition", "l", "r", "support", "survived", "confidence")


@query(f"""WITH {CONF}, k AS (SELECT *, round(round(raw, 9), 4) AS c FROM conf)
SELECT partition, count(*) AS size, round(avg(c), 4) AS avg_confidence, min(c) AS min_confidence, max(c) AS max_confidence, md5(string_agg(l || '>' || r || CASE WHEN survived THEN '+' ELSE '-' END || support, '|' ORDER BY c DESC, l, r)) AS digest FROM k GROUP BY partition""")
def scored_mappings(spark, sf_dir):
    each = F.transform("scored_pairs", lambda p: F.concat(p["l"], F.lit(">"), p["r"], F.when(p["survived_conflict"], "+").otherwise("-"), p["support_count"].cast("string")))
    return R.scored_mappings(_confidence(spark, sf_dir)).select("partition", "size", "avg_confidence", "min_confidence", "max_confidence", F.md5(F.array_join(each, "|")).alias("digest"))


_SUMMARY = f"WITH {CONF}, s AS (SELECT partition, count(*) AS size, round(avg(round(round(raw, 9), 4)), 4) AS avg_confidence, min(round(round(raw, 9), 4)) AS min_confidence, max(round(round(raw, 9), 4)) AS max_confidence FROM conf GROUP BY partition)"


@query(f"{_SUMMARY} SELECT partition, size, avg_confidence, min_confidence, max_confidence FROM s")
def confidence_summary(spark, sf_dir):
    return R.confidence_summary(_confidence(spark, sf_dir))


@query(f"{_SUMMARY} SELECT CASE WHEN avg_confidence >= 0.8 THEN 'high' WHEN avg_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS mappings FROM s GROUP BY ALL")
def confidence_report(spark, sf_dir):
    return R.confidence_bands(R.confidence_summary(_confidence(spark, sf_dir)))


@query(f"""{G}, sets AS (SELECT partition, string_agg(l || '>' || r, '|' ORDER BY l, r) AS s, count(*) AS n FROM mp GROUP BY partition),
und AS (SELECT partition, string_agg(a || '>' || b, '|' ORDER BY a, b) AS s FROM (SELECT DISTINCT partition, least(l, r) AS a, greatest(l, r) AS b FROM mp) GROUP BY partition)
SELECT count(*) AS mappings, CAST(sum(n) AS BIGINT) AS pairs, count(DISTINCT s) AS distinct_sets, (SELECT count(DISTINCT s) FROM und) AS distinct_undirected FROM sets""")
def dedup_mappings(spark, sf_dir):
    return R.distinct_mappings(_grouped(spark, sf_dir)[3])


def _sampled(df):
    return df.withColumn("sample", F.array_join(F.transform("sample", lambda p: F.concat(p["l"], F.lit(">"), p["r"])), "|"))


@query("""WITH p AS (SELECT n_nationkey % 6 AS partition, lower(n_name) AS l, CASE WHEN n_nationkey = 2 THEN repeat('long name ', 9) ELSE 'k' || n_nationkey END AS r FROM nation UNION SELECT 9, lower(r_name), 'r' || r_regionkey FROM region WHERE r_regionkey < 2 UNION SELECT 8, lower(c), 's' || c FROM (SELECT DISTINCT c_mktsegment AS c FROM customer)),
z AS (SELECT partition, count(*) AS size, bool_and(length(l) < 35 AND length(r) < 35) AS short FROM p GROUP BY partition HAVING count(*) BETWEEN 3 AND 8 AND short)
SELECT CAST(partition AS BIGINT) AS partition, CAST(size AS INTEGER) AS size FROM z ORDER BY partition LIMIT 8""")
def show_mappings(spark, sf_dir):
    nation, region, customer = (K.table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    r = F.when(F.col("n_nationkey") == 2, F.repeat(F.lit("long name "), 9)).otherwise(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")))
    p = nation.select((F.col("n_nationkey") % 6).cast("long").alias("partition"), F.lower("n_name").alias("l"), r.alias("r"))
    p = p.union(region.where("r_regionkey < 2").select(F.lit(9).cast("long"), F.lower("r_name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))
    p = p.union(customer.select("c_mktsegment").distinct().select(F.lit(8).cast("long"), F.lower("c_mktsegment"), F.concat(F.lit("s"), "c_mktsegment")))
    return R.preview(R.nested(p, p)).select("partition", "size")


# ---- baselines

_TWO = f"""{K.sql(K.COARSE)}, two AS (SELECT table_idx, table_idx % 7 AS domain, lower(trim(c0)) AS l, lower(trim(c1)) AS r FROM wide)"""


def _first_columns(spark, sf_dir):
    w = K.wide(spark, sf_dir, K.COARSE)
    cols = w.groupBy("table_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "c0", "c1"))).alias("s"))
    tables = checkpointed(cols).select("table_idx", F.array(F.transform("s", lambda x: x["c0"]), F.transform("s", lambda x: x["c1"])).alias("columns"), (F.col("table_idx") % 7).alias("domain"))
    return checkpointed(B.first_columns(tables))


_BY = "count(DISTINCT table_idx) AS num_source_tables, count(DISTINCT l || '>' || r) AS size, md5(string_agg(DISTINCT l || '>' || r, '|' ORDER BY l || '>' || r)) AS digest"


def _digest(df):
    joined = F.array_join(F.array_sort(F.transform("pairs", lambda p: F.concat(p["l"], F.lit(">"), p["r"]))), "|")
    return df.select("group_id", "num_source_tables", F.col("size").cast("long").alias("size"), F.md5(joined).alias("digest"))


@query(f"WITH {_TWO} SELECT CAST(domain AS VARCHAR) || '_ncols_2' AS group_id, {_BY} FROM two GROUP BY domain")
def union_domain(spark, sf_dir):
    return _digest(B.union_domain(_first_columns(spark, sf_dir)))


@query(f"WITH {_TWO} SELECT 'ncols_2' AS group_id, {_BY} FROM two")
def union_web(spark, sf_dir):
    return _digest(B.union_web(_first_columns(spark, sf_dir)))


_CC = f"""WITH RECURSIVE {_TWO}, p AS (SELECT DISTINCT table_idx AS t, l, r FROM two), n AS (SELECT t, count(*) AS n FROM p GROUP BY t),
ed AS (SELECT a.t AS a, b.t AS b FROM p a JOIN p b USING (l, r) JOIN n x ON x.t = a.t JOIN n y ON y.t = b.t WHERE a.t <> b.t GROUP BY ALL HAVING count(*) / least(any_value(x.n), any_value(y.n)) >= 0.8),
reach(v, w) AS (SELECT t, t FROM n UNION SELECT r.v, e.b FROM reach r JOIN ed e ON r.w = e.a), roots AS (SELECT v, min(w) AS root FROM reach GROUP BY v)"""


@query(f"{_CC} SELECT CAST(root AS VARCHAR) AS group_id, {_BY.replace('table_idx', 't')} FROM roots JOIN p ON t = v GROUP BY root")
def schema_cc(spark, sf_dir):
    return _digest(B.schema_cc(_first_columns(spark, sf_dir), 0.8))


_OWN = GROUPED[len(K.sql(K.COARSE)) :].replace("roots", "own_roots")  # the corpus is there already
@query(f"""{_CC}{_OWN}, own AS (SELECT size, num_source_tables AS n FROM maps), d AS (SELECT count(DISTINCT l || '>' || r) AS size, count(DISTINCT table_idx) AS n FROM two GROUP BY domain), w AS (SELECT count(DISTINCT l || '>' || r) AS size, count(DISTINCT table_idx) AS n FROM two),
c AS (SELECT count(DISTINCT l || '>' || r) AS size, count(DISTINCT t) AS n FROM roots JOIN p ON t = v GROUP BY root),
u AS (SELECT 'UnionDomain' AS method, size, n FROM d UNION ALL SELECT 'UnionWeb', size, n FROM w UNION ALL SELECT 'SchemaCC', size, n FROM c UNION ALL SELECT 'Synthesis', size, n FROM own)
SELECT method, count(*) AS mappings, CAST(sum(size) AS BIGINT) AS pairs, CAST(max(size) AS INTEGER) AS largest, round(avg(size), 9) AS mean_size, count(*) FILTER (n > 1) AS multi_table FROM u GROUP BY method""")
def baseline_report(spark, sf_dir):
    rows = _first_columns(spark, sf_dir)
    return B.report(B.union_domain(rows), B.union_web(rows), B.schema_cc(rows, 0.8), B.of_mappings(_grouped(spark, sf_dir)[3])).withColumn("mean_size", F.round("mean_size", 9))


# ---- evaluation

GOLD = """gold AS (SELECT lower(n_name) AS l, lower(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT lower(n_name), 'x' || lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0
  UNION ALL SELECT lower(r_name), 'nowhere' FROM region UNION ALL SELECT lower(a.n_name), lower(b.n_name) FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey)"""
UND = "g AS (SELECT DISTINCT least(l, r) AS a, greatest(l, r) AS b FROM gold WHERE l <> r AND l <> '' AND r <> '')"


def _gold(spark, sf_dir):
    nation, region = K.table(spark, sf_dir, "nation"), K.table(spark, sf_dir, "region")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    plain = both.select(F.lower("n_name").alias("l"), F.lower("r_name").alias("r"))
    noisy = both.where("n_nationkey % 5 = 0").select(F.lower("n_name"), F.concat(F.lit("x"), F.lower("r_name")))
    nxt = nation.select(F.lower("n_name").alias("a"), (F.col("n_nationkey") + 1).alias("k")).join(nation.select(F.lower("n_name").alias("b"), F.col("n_nationkey").alias("k")), "k").select("a", "b")
    return plain.union(noisy).union(region.select(F.lower("r_name"), F.lit("nowhere"))).union(nxt)


@query(f"""{M}, {GOLD}, {UND}, p AS (SELECT DISTINCT least(l, r) AS a, greatest(l, r) AS b FROM res WHERE l <> r), cv AS (SELECT DISTINCT value AS v FROM cells), gv AS (SELECT a AS v FROM g UNION SELECT b FROM g),
k AS (SELECT a, b, bool_or(s = 'g') AS g, bool_or(s = 'p') AS p FROM (SELECT *, 'g' AS s FROM g UNION ALL SELECT *, 'p' FROM p) GROUP BY ALL),
t AS (SELECT count(*) FILTER (g) AS n_g, count(*) FILTER (p) AS n_p, count(*) FILTER (g AND p) AS n_p_g,
  count(*) FILTER (g AND a IN (SELECT v FROM cv) AND b IN (SELECT v FROM cv)) AS n_ach, count(*) FILTER (g AND p AND a IN (SELECT v FROM cv) AND b IN (SELECT v FROM cv)) AS n_p_ach,
  count(*) FILTER (p AND a IN (SELECT v FROM gv) AND b IN (SELECT v FROM gv)) AS n_sc, count(*) FILTER (p AND g AND a IN (SELECT v FROM gv) AND b IN (SELECT v FROM gv)) AS n_sc_g,
  count(*) FILTER (p AND g AND a IN (SELECT v FROM gv) AND b IN (SELECT v FROM gv) AND a IN (SELECT v FROM cv) AND b IN (SELECT v FROM cv)) AS n_sc_ach FROM k),
cov AS (SELECT DISTINCT least(lower(n_name), lower(r_name)) AS a, greatest(lower(n_name), lower(r_name)) AS b FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 > 0),
tc AS (SELECT count(*) AS n_cov, count(*) FILTER (p) AS n_p_cov FROM cov LEFT JOIN k USING (a, b)),
sc AS (SELECT n_sc_ach / n_sc AS sp, n_sc_ach / n_ach AS sr FROM t)
SELECT n_g, n_p, n_p_g, n_ach, n_p_ach, n_sc, n_sc_g, n_cov, n_p_cov, round(n_p_cov / n_cov, 9) AS covered_recall, round(2 * sp * sr / (sp + sr), 9) AS scoped_f1, round(n_p_g / n_p, 9) AS precision, round(n_p_g / n_g, 9) AS recall, round(2 * (n_p_g / n_p) * (n_p_g / n_g) / (n_p_g / n_p + n_p_g / n_g), 9) AS f1,
  round(n_p_ach / n_ach, 9) AS achievable_recall, round(n_sc_g / n_sc, 9) AS scoped_precision FROM t, tc, sc""")
def benchmark_eval(spark, sf_dir):
    rows = R.exploded(_maps(spark, sf_dir)[3])
    nation, region = K.table(spark, sf_dir, "nation"), K.table(spark, sf_dir, "region")
    covered = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 3 > 0").select(F.lower("n_name").alias("l"), F.lower("r_name").alias("r"))
    out = E.evaluate(_gold(spark, sf_dir), R.resolve(rows), K.cells(spark, sf_dir, K.COARSE), covered)
    return out.select("n_g", "n_p", "n_p_g", "n_ach", "n_p_ach", "n_sc", "n_sc_g", "n_cov", "n_p_cov", *[r9(c, c) for c in ("precision", "recall", "f1", "achievable_recall", "scoped_precision", "covered_recall", "scoped_f1")])


_COVER = f"""WITH {K.sql()}, {GOLD}, {UND}, rows_ AS (SELECT DISTINCT table_idx, row_idx, value AS v FROM cells WHERE value IN (SELECT a FROM g UNION SELECT b FROM g)),
met AS (SELECT x.table_idx, a, b FROM g JOIN rows_ x ON x.v = a JOIN rows_ y ON y.v = b AND y.table_idx = x.table_idx AND y.row_idx = x.row_idx)"""


@query(f"""{_COVER} SELECT a, b, CASE WHEN (a, b) IN (SELECT (a, b) FROM met) THEN 'covered' WHEN a IN (SELECT v FROM rows_) AND b IN (SELECT v FROM rows_) THEN 'split' ELSE 'absent' END AS status FROM g""")
def gold_cover(spark, sf_dir):
    return E.coverage(_gold(spark, sf_dir), checkpointed(K.cells(spark, sf_dir)))


@query(f"{_COVER} SELECT table_idx, count(DISTINCT (a, b)) AS pairs FROM met GROUP BY table_idx")
def cover_tables(spark, sf_dir):
    return E.cover_tables(_gold(spark, sf_dir), K.cells(spark, sf_dir))


@query(f"""WITH {K.sql(K.COARSE)}, cl AS (SELECT table_idx, col_idx, list(value ORDER BY row_idx) AS c FROM cells GROUP BY ALL),
t AS (SELECT table_idx, md5(CAST(to_json(list(c ORDER BY col_idx)) AS VARCHAR)) AS key FROM cl GROUP BY table_idx), cov AS (SELECT * FROM t WHERE table_idx % 5 = 0),
f AS (SELECT t.*, row_number() OVER (ORDER BY key, table_idx) AS i FROM t WHERE key NOT IN (SELECT key FROM cov))
SELECT table_idx, key, 'cover' AS source FROM cov UNION ALL SELECT table_idx, key, 'filler' FROM f WHERE i <= greatest(0, 20 - (SELECT count(*) FROM cov))""")
def covered_sample(spark, sf_dir):
    tables = checkpointed(E.table_keys(L.to_tables(K.cells(spark, sf_dir, K.COARSE))))
    return E.covered_sample(tables.where("table_idx % 5 = 0"), tables, 20)


# ---- scalar functions and matchers

WORDS = "('NATION_1 (old name)'), ('U.S.A.'), ('  Two\tWords '), ('a-b,c.'), ('The Republic of Korea'), ('korea republic'), ('New York City'), ('nyc'), ('')"
TEXTS = f"""texts AS (SELECT DISTINCT p_name AS t FROM part UNION SELECT n_name FROM nation UNION SELECT * FROM (VALUES {WORDS}) UNION SELECT split_part(p_name, ' ', 2) || ' of ' || split_part(p_name, ' ', 1) FROM part)"""
NORMED = TEXTS + ", nt AS (SELECT t, " + _NORM.replace("V", "t") + " AS s FROM texts)"
PAIRED = NORMED + ", pr AS (SELECT a.t AS a, b.t AS b, a.s AS x, b.s AS y FROM nt a, nt b WHERE a.t < b.t)"


def _texts(spark, sf_dir):
    part, nation = K.table(spark, sf_dir, "part"), K.table(spark, sf_dir, "nation")
    fixed = spark.createDataFrame([(x,) for x in ("NATION_1 (old name)", "U.S.A.", "  Two\tWords ", "a-b,c.", "The Republic of Korea", "korea republic", "New York City", "nyc", "")], "t string")
    names = part.select("p_name").distinct()
    swapped = names.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" of "), F.split_part("p_name", F.lit(" "), F.lit(1))))
    return names.select(F.col("p_name").alias("t")).union(nation.select("n_name")).union(fixed).union(swapped).distinct()


def _text_pairs(spark, sf_dir):
    t = _texts(spark, sf_dir)
    t = checkpointed(t)
    return t.toDF("a").join(F.broadcast(t.toDF("b")), F.col("a") < F.col("b"))  # a fixed vocabulary of names


@query(f"WITH {TEXTS} SELECT t, regexp_replace(trim(lower(t), e' \\t'), '\\s+', ' ', 'g') AS v FROM texts")
def clean_value(spark, sf_dir):
    return _texts(spark, sf_dir).select("t", T.clean_value(F.col("t")).alias("v"))


@query(f"WITH {NORMED} SELECT t, s FROM nt")
def normalize(spark, sf_dir):
    return _texts(spark, sf_dir).select("t", T.normalize(F.col("t")).alias("s"))


@query(f"WITH {K.sql()}, v AS (SELECT DISTINCT value FROM cells UNION SELECT CAST(l_quantity AS VARCHAR) FROM lineitem UNION SELECT '#' || lower(l_returnflag) FROM lineitem) SELECT value, ({NOISE}) AS noise FROM v")
def noise_value(spark, sf_dir):
    li = K.table(spark, sf_dir, "lineitem")
    v = K.cells(spark, sf_dir).select("value").union(li.select(F.col("l_quantity").cast("string"))).union(li.select(F.concat(F.lit("#"), F.lower("l_returnflag")))).distinct()
    return v.select("value", T.is_noise_value(F.col("value")).alias("noise"))


_LIM = "least(length({0}) // 5, length({1}) // 5, 10)"
_APX = "({0} = {1} OR (" + _LIM + " > 0 AND levenshtein({0}, {1}) <= " + _LIM + "))"


@query(f"WITH {PAIRED} SELECT a, b, {_APX.format('a', 'b')} AS raw, {_APX.format('x', 'y')} AS normalised FROM pr")
def approx_match(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _text_pairs(spark, sf_dir).select("a", "b", T.approx_match(a, b).alias("raw"), T.edit_distance_match(a, b).alias("normalised"))


_STOP = "('of','the','a','an','and','or','in','at','to','for')"
_TOK = f"list_distinct(list_filter(string_split(V, ' '), lambda w: w <> '' AND w NOT IN {_STOP}))"
_INI = f"array_to_string(list_transform(list_filter(string_split(V, ' '), lambda w: w <> '' AND w NOT IN {_STOP}), lambda w: w[1]), '')"
STRATEGY = PAIRED + f""", st AS (SELECT *, {_TOK.replace('V', 'x')} AS tx, {_TOK.replace('V', 'y')} AS ty, {_INI.replace('V', 'x')} AS ix, {_INI.replace('V', 'y')} AS iy FROM pr),
ms AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 'empty' WHEN x = y THEN 'exact' WHEN {_APX.format('x', 'y')} THEN 'edit_distance'
  WHEN len(tx) > 0 AND len(ty) > 0 AND len(list_intersect(tx, ty)) / len(list_distinct(tx || ty)) >= 0.8 THEN 'token_set'
  WHEN (x = iy AND length(x) >= 2) OR (y = ix AND length(y) >= 2) THEN 'abbreviation' ELSE 'no_match' END AS strategy FROM st)"""


@query(f"WITH {STRATEGY} SELECT a, b, strategy, CAST(CASE strategy WHEN 'exact' THEN 1.0 WHEN 'edit_distance' THEN 0.8 WHEN 'token_set' THEN 0.7 WHEN 'abbreviation' THEN 0.6 ELSE 0.0 END AS DOUBLE) AS score FROM ms")
def enhanced_match(spark, sf_dir):
    s = _text_pairs(spark, sf_dir).withColumn("strategy", T.match_strategy(F.col("a"), F.col("b")))
    return s.withColumn("score", T.strategy_score(F.col("strategy")))


_WG = "list_distinct(list_filter(string_split(V, ' '), lambda w: w <> ''))"


@query(f"""WITH {PAIRED}, ng AS (SELECT a, b, {_NG.replace('V', 'x')} AS cx, {_NG.replace('V', 'y')} AS cy, {_WG.replace('V', 'x')} AS wx, {_WG.replace('V', 'y')} AS wy FROM pr)
SELECT a, b, round({_JAC.format('cx', 'cy')}, 9) AS chars, round({_JAC.format('wx', 'wy')}, 9) AS words, greatest({_JAC.format('cx', 'cy')}, {_JAC.format('wx', 'wy')}) >= 0.5 AS matched FROM ng""")
def jaccard(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _text_pairs(spark, sf_dir).select("a", "b", r9(T.char_jaccard(a, b), "chars"), r9(T.word_jaccard(a, b), "words"), (T.jaccard_similarity(a, b) >= 0.5).alias("matched"))


_JP = "jp AS (SELECT a AS x, b AS y FROM pr UNION SELECT x, y FROM pr)"


@query(f"WITH RECURSIVE {PAIRED}, {_JP}{_JARO} SELECT a, b, round(u.jaro, 9) AS jaro, round(u.winkler, 9) AS jaro_winkler, a <> '' AND b <> '' AND w.winkler >= 0.85 AS matched FROM pr JOIN jw u ON u.x = a AND u.y = b JOIN jw w ON w.x = pr.x AND w.y = pr.y")
def jaro_winkler(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _text_pairs(spark, sf_dir).select("a", "b", r9(J.jaro(a, b), "jaro"), r9(J.jaro_winkler(a, b), "jaro_winkler"), J.jaro_winkler_match(a, b).alias("matched"))


@query(f"""WITH RECURSIVE {STRATEGY.replace('), ms AS', '), ms0 AS')}, {_JP}{_JARO}, mk AS (SELECT st.x = st.y AS exact, {_APX.format('st.x', 'st.y')} AS edit, len(tx) > 0 AND len(ty) > 0 AND len(list_intersect(tx, ty)) / greatest(len(list_distinct(tx || ty)), 1) >= 0.8 AS token_set,
  (st.x = iy AND length(st.x) >= 2) OR (st.y = ix AND length(st.y) >= 2) AS abbreviation, greatest({_JAC.format(_NG.replace('V', 'st.x'), _NG.replace('V', 'st.y'))}, {_JAC.format(_WG.replace('V', 'st.x'), _WG.replace('V', 'st.y'))}) >= 0.5 AS jaccard, a <> '' AND b <> '' AND winkler >= 0.85 AS jaro_winkler FROM st JOIN jw ON jw.x = st.x AND jw.y = st.y)
SELECT count(*) AS pairs, {', '.join(f'count(*) FILTER ({m}) AS {m}' for m in ('exact', 'edit', 'token_set', 'abbreviation', 'jaccard', 'jaro_winkler'))} FROM mk""")
def matcher_compare(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    methods = {"exact": T.exact_match(a, b), "edit": T.edit_distance_match(a, b), "token_set": T.token_set_match(a, b), "abbreviation": T.abbreviation_match(a, b), "jaccard": T.jaccard_similarity(a, b) >= 0.5, "jaro_winkler": J.jaro_winkler_match(a, b)}
    marks = _text_pairs(spark, sf_dir).select(*[m.alias(k) for k, m in methods.items()])
    return marks.agg(F.count("*").alias("pairs"), *[F.count_if(F.col(k)).alias(k) for k in methods])


_SYN = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in Y.BUILT_IN) + ") AS s(a, b) UNION ALL SELECT DISTINCT lower(n_name), lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0)"
_CLOSED = f"{_SYN}, both_ AS (SELECT a, b FROM syn UNION SELECT b, a FROM syn), reach(v, w) AS (SELECT a, a FROM both_ UNION SELECT r.v, k.b FROM reach r JOIN both_ k ON r.w = k.a), canon AS (SELECT v AS value, min(w) AS canonical FROM reach GROUP BY v)"


def _synonyms(spark, sf_dir):
    nation, region = K.table(spark, sf_dir, "nation"), K.table(spark, sf_dir, "region")
    extra = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 4 = 0").select(F.lower("n_name").alias("a"), F.lower("r_name").alias("b"))
    return Y.synonyms(Y.pairs(spark, extra))


@query(f"WITH RECURSIVE {_CLOSED} SELECT value, canonical FROM canon")
def synonyms(spark, sf_dir):
    return _synonyms(spark, sf_dir)


@query(f"""WITH RECURSIVE {PAIRS}, {_CLOSED}, cc AS (SELECT cand, l, r, coalesce(x.canonical, l) AS cl, coalesce(y.canonical, r) AS cr FROM cp LEFT JOIN canon x ON x.value = l LEFT JOIN canon y ON y.value = r),
com AS (SELECT e.ci, e.cj, a.l, a.r FROM edges e JOIN cp a ON a.cand = e.ci JOIN cp b ON b.cand = e.cj AND a.l = b.l AND a.r = b.r),
bo AS (SELECT e.ci, e.cj, count(*) AS boost FROM edges e JOIN cc a ON a.cand = e.ci JOIN cc b ON b.cand = e.cj AND a.cl = b.cl AND a.cr = b.cr
  WHERE NOT EXISTS (SELECT 1 FROM com WHERE com.ci = e.ci AND com.cj = e.cj AND com.l = a.l AND com.r = a.r) AND NOT EXISTS (SELECT 1 FROM com WHERE com.ci = e.ci AND com.cj = e.cj AND com.l = b.l AND com.r = b.r) GROUP BY ALL)
SELECT ci, cj, coalesce(boost, 0) AS boost FROM edges LEFT JOIN bo USING (ci, cj)""")
def synonym_boost(spark, sf_dir):
    _, pairs = _coarse(spark, sf_dir)
    return Y.boost(pairs, checkpointed(S.overlap_edges(pairs, 3)), checkpointed(_synonyms(spark, sf_dir)))


# ---- loaders and wiki filters on tables as they are read

_NESTED = f"""{K.sql(K.COARSE)}, raw AS (SELECT table_idx, 0 AS c, row_idx, upper(c0) || '  ' AS v FROM wide UNION ALL SELECT table_idx, 1, row_idx, c1 FROM wide UNION ALL SELECT table_idx, 2, row_idx, CAST(row_idx AS VARCHAR) FROM wide
  UNION ALL SELECT table_idx, 3, row_idx, 'same' FROM wide UNION ALL SELECT table_idx, 4, row_idx, CASE WHEN row_idx % 3 > 0 THEN '-' ELSE c2 END FROM wide UNION ALL SELECT table_idx, 5, row_idx, c2 FROM wide)"""


def _raw_tables(spark, sf_dir):
    w = K.wide(spark, sf_dir, K.COARSE)
    s = w.groupBy("table_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "c0", "c1", "c2"))).alias("s"))
    cols = [lambda x: F.concat(F.upper(x["c0"]), F.lit("  ")), lambda x: x["c1"], lambda x: x["row_idx"].cast("string"), lambda x: F.lit("same"), lambda x: F.when(x["row_idx"] % 3 > 0, "-").otherwise(x["c2"]), lambda x: x["c2"]]
    return checkpointed(s.select("table_idx", F.array(*[F.transform("s", f) for f in cols]).alias("columns")))


def _as_file(spark, lines):
    """Lines as one text file's path in the shared folder; the corpus of these queries is small."""
    path = f"{shared_folder(spark)}/lines"
    lines.coalesce(1).write.text(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))
    return files[0].getPath().toString()


@query(f"""WITH {_NESTED}, k AS (SELECT table_idx, c, row_idx, regexp_replace(lower(trim(v)), '\\s+', ' ', 'g') AS v FROM raw), d AS (SELECT table_idx, c FROM k GROUP BY ALL HAVING count(DISTINCT nullif(v, '')) >= 2)
SELECT table_idx, CAST((SELECT count(*) FROM d WHERE d.table_idx = k.table_idx AND d.c < k.c) AS INTEGER) AS col_idx, count(*) AS n, md5(string_agg(v, '|' ORDER BY row_idx)) AS digest FROM k JOIN d USING (table_idx, c) GROUP BY table_idx, c""")
def load_corpus(spark, sf_dir):
    """Through the loader, from JSON lines among which some are no tables; columns are numbered as they were kept."""
    header = F.transform("columns", lambda c: F.concat(F.array(F.lit("Head")), c))
    lines = F.to_json(F.struct(F.col("table_idx").alias("id"), header.alias("relation"), F.lit("RELATION").alias("tableType"), F.lit(True).alias("hasHeader"), F.lit(0).alias("headerRowIndex")))
    tables = L.load_corpus(spark, _as_file(spark, _raw_tables(spark, sf_dir).select(F.explode(F.array(lines, F.lit(""), F.lit("{broken"), F.lit('{"relation": [["a", "b"]], "tableType": "ENTITY"}'))).alias("value"))))
    cols = tables.select(F.get_json_object("meta", "$.id").cast("long").alias("table_idx"), F.posexplode("columns").alias("place", "v"))
    return cols.select("table_idx", F.col("place").alias("col_idx"), F.size("v").cast("long").alias("n"), F.md5(F.array_join("v", "|")).alias("digest"))


@query(f"""WITH {_NESTED}, two AS (SELECT table_idx, CASE WHEN table_idx % 5 > 0 THEN CAST(table_idx % 5 AS VARCHAR) ELSE 'unknown' END AS domain, lower(trim(max(CASE WHEN c = 0 THEN v END))) AS l, lower(trim(max(CASE WHEN c = 1 THEN v END))) AS r FROM raw WHERE c < 2 GROUP BY table_idx, row_idx)
SELECT domain || '_ncols_6' AS group_id, count(DISTINCT table_idx) AS num_source_tables, count(DISTINCT l || '>' || r) AS size FROM two GROUP BY domain""")
def load_raw(spark, sf_dir):
    """Raw JSON lines with a page's id (every fifth without), and the baseline over them."""
    page = F.when(F.col("table_idx") % 5 > 0, F.col("table_idx") % 5)
    lines = F.to_json(F.struct(F.col("columns").alias("relation"), page.alias("pgId")))
    tables = L.load_raw_jsonl(spark, _as_file(spark, _raw_tables(spark, sf_dir).select(F.explode(F.array(lines, F.lit("  "))).alias("value"))))
    return B.union_domain(B.first_columns(tables)).select("group_id", "num_source_tables", F.col("size").cast("long").alias("size"))


@query(f"""WITH {_NESTED}, k AS (SELECT table_idx, c, row_idx, CASE WHEN lower(trim(v)) IN ('', '?', '—', '-', 'total', 'null', 'none', 'unknown', 'x') THEN '' ELSE trim(v) END AS v FROM raw),
t AS (SELECT table_idx, c, count(*) AS n, max(k) AS top FROM (SELECT table_idx, c, v, count(*) AS k FROM k WHERE v <> '' GROUP BY ALL) GROUP BY ALL),
s AS (SELECT table_idx, c, count(*) AS n_all, count(*) FILTER (v <> '') AS n_full, count(DISTINCT nullif(v, '')) AS n_d, count(*) FILTER (lower(v) NOT IN ('', 'n/a', 'na', 'null', 'none', '-', '—', '–', '?', 'unknown')) AS n_v,
  count(*) FILTER (lower(v) NOT IN ('', 'n/a', 'na', 'null', 'none', '-', '—', '–', '?', 'unknown') AND regexp_matches(v, '\\d')) AS n_dig,
  bool_and(try_cast(v AS BIGINT) IS NOT NULL) AND max(try_cast(v AS BIGINT)) - min(try_cast(v AS BIGINT)) + 1 = count(*) AS run FROM k GROUP BY ALL)
SELECT table_idx, CAST(c AS INTEGER) AS col_idx FROM s JOIN t USING (table_idx, c) WHERE n_full >= 3 AND top / n_full <= 0.7 AND NOT coalesce(run, false) AND n_d >= 2 AND 1 - n_v / n_all < 0.5 AND n_v > 0 AND n_dig / n_v < 0.5""")
def wiki_column_filter(spark, sf_dir):
    cols = _raw_tables(spark, sf_dir).select("table_idx", F.posexplode(F.transform("columns", lambda c: F.transform(c, T.wiki_clean))).alias("col_idx", "vals"))
    return cols.where(L.wiki_column_kept(F.col("vals"))).select("table_idx", "col_idx")


# ---- exploration of a cell store

STORE = f"""{K.sql()}, store AS (SELECT table_idx AS tableid, col_idx AS colid, row_idx AS rowid, '''' || value || '''' AS term, CASE WHEN row_idx % 11 = 0 THEN NULL WHEN row_idx % 13 = 0 THEN ' ' ELSE value END AS tokenized FROM cells)"""


def _store(spark, sf_dir):
    c = K.cells(spark, sf_dir)
    token = F.when(F.col("row_idx") % 11 == 0, F.lit(None)).when(F.col("row_idx") % 13 == 0, " ").otherwise(F.col("value"))
    return checkpointed(c).select(F.col("table_idx").alias("tableid"), F.col("col_idx").alias("colid"), F.col("row_idx").alias("rowid"), F.concat(F.lit("'"), "value", F.lit("'")).alias("term"), token.alias("tokenized"))


@query(f"WITH {STORE} SELECT tableid, count(*) AS tokens FROM store GROUP BY tableid")
def cells_tokens(spark, sf_dir):
    return X.tokens_per_table(_store(spark, sf_dir))


@query(f"WITH {STORE} SELECT tableid, count(*) AS tokens, count(DISTINCT rowid) AS rows, count(DISTINCT colid) AS cols FROM store GROUP BY tableid")
def cells_shape(spark, sf_dir):
    return X.table_shapes(_store(spark, sf_dir))


@query(f"""WITH {STORE} SELECT tableid, count(*) AS total_rows, count(*) FILTER (tokenized IS NULL OR trim(tokenized) = '') AS null_tokens, count(*) FILTER (regexp_matches(tokenized, '^[0-9]+$')) AS numeric_tokens,
count(*) FILTER (tokenized IS NOT NULL AND trim(tokenized) <> '' AND NOT regexp_matches(tokenized, '^[0-9]+$')) AS string_tokens FROM store GROUP BY tableid""")
def cells_token_classes(spark, sf_dir):
    return X.token_classes(_store(spark, sf_dir))


_PIVOT = ", ".join(f"max(CASE WHEN colid = {k} THEN tokenized END) AS col_{k}" for k in range(8))


@query(f"WITH {STORE} SELECT tableid, rowid, {_PIVOT} FROM store GROUP BY ALL")
def cells_pivot(spark, sf_dir):
    return X.pivot(_store(spark, sf_dir), list(range(8)))


@query(f"WITH {STORE} SELECT tableid, rowid, {_PIVOT.rpartition(', ')[0]} FROM store GROUP BY ALL")
def cells_pivot_dynamic(spark, sf_dir):
    return X.pivot_all(_store(spark, sf_dir))


@query(f"WITH {STORE} SELECT tableid, count(*) AS tokens FROM store GROUP BY tableid HAVING count(*) BETWEEN 150 AND 800 ORDER BY tokens DESC, tableid LIMIT 5")
def cells_medium_tables(spark, sf_dir):
    return X.medium_tables(_store(spark, sf_dir))


@query(f"WITH {STORE} SELECT rowid, colid, term, tokenized FROM store WHERE tableid = 7 ORDER BY rowid, colid LIMIT 100")
def cells_listing(spark, sf_dir):
    return X.listing(_store(spark, sf_dir), 7)


@query(f"""WITH {STORE} SELECT 'null' AS kind, tableid, colid, rowid FROM store WHERE tokenized IS NULL OR trim(tokenized) = '' UNION ALL SELECT 'numeric', tableid, colid, rowid FROM store WHERE regexp_matches(tokenized, '^[0-9]+$')
UNION ALL SELECT 'string', tableid, colid, rowid FROM store WHERE tokenized IS NOT NULL AND trim(tokenized) <> '' AND NOT regexp_matches(tokenized, '^[0-9]+$')""")
def cells_predicates(spark, sf_dir):
    s = _store(spark, sf_dir)
    pick = lambda df, k: df.select(F.lit(k).alias("kind"), "tableid", "colid", "rowid")
    return pick(X.null_cells(s), "null").union(pick(X.numeric_cells(s), "numeric")).union(pick(X.string_cells(s), "string"))


@query(f"WITH {STORE} SELECT tableid, min(rowid) AS header_row FROM store WHERE contains(lower(tokenized), 'asia') OR contains(lower(tokenized), 'widget') GROUP BY tableid")
def header_row(spark, sf_dir):
    return X.header_rows(_store(spark, sf_dir), ["asia", "widget"])


@query(f"WITH {STORE} SELECT tableid, max(rowid) AS header_row FROM store WHERE tokenized IS NOT NULL AND lower(trim(tokenized)) NOT IN ('', 'null', 'none', 'nan', 'n/a', 'na', '-') GROUP BY tableid")
def last_full_row(spark, sf_dir):
    return X.last_full_row(_store(spark, sf_dir))


@query(f"""WITH {STORE}, f AS (SELECT * FROM store WHERE tokenized IS NOT NULL AND lower(trim(tokenized)) NOT IN ('', 'null', 'none', 'nan', 'n/a', 'na', '-'))
SELECT tableid, colid, rowid, CASE WHEN lower(trim(tokenized)) NOT IN ('', 'null', 'none', 'nan', 'n/a', 'na', '-') THEN tokenized END AS tokenized FROM store
JOIN (SELECT DISTINCT tableid, rowid FROM f) USING (tableid, rowid) JOIN (SELECT DISTINCT tableid, colid FROM f) USING (tableid, colid)""")
def without_null_rows(spark, sf_dir):
    return X.without_nulls(_store(spark, sf_dir)).select("tableid", "colid", "rowid", "tokenized")


@query(f"""WITH {STORE}, st AS (SELECT tableid, colid, rowid, trim(term, '''') AS val FROM store), cs AS (SELECT tableid, colid FROM st GROUP BY ALL HAVING count(DISTINCT nullif(val, '')) >= 2 AND count(*) FILTER (val <> '' AND NOT regexp_matches(val, '^-?[0-9]+([.,][0-9]+)?$')) > 0
  AND count(*) FILTER (val <> '' AND NOT regexp_matches(val, '^(#|0x)[0-9a-fA-F]+$')) > 0 AND count(*) FILTER (val <> '' AND lower(val) NOT IN ('-','--','n/a','na','null','none','?')) > 0),
tb AS (SELECT tableid FROM cs GROUP BY tableid HAVING count(*) >= 2 ORDER BY tableid DESC LIMIT 30)
SELECT tableid, colid, rowid, val FROM st WHERE (tableid, colid) IN (SELECT (tableid, colid) FROM cs) AND tableid IN (SELECT tableid FROM tb)""")
def server_side_sample(spark, sf_dir):
    return X.server_side_sample(_store(spark, sf_dir), 30, F.desc("tableid"))


# ---- views of a results server

@query(f"""WITH {_NESTED}, t AS (SELECT table_idx, count(*) AS num_rows FROM wide GROUP BY table_idx ORDER BY table_idx LIMIT 4), u AS (SELECT table_idx, c FROM raw WHERE c < 3 GROUP BY ALL HAVING count(*) FILTER (v <> '') >= 2 AND count(*) FILTER (v <> '') = count(DISTINCT nullif(v, '')))
SELECT table_idx, CAST(6 AS INTEGER) AS num_cols, CAST(num_rows AS INTEGER) AS num_rows, CAST((SELECT min(c) FROM u WHERE u.table_idx = t.table_idx) AS INTEGER) AS hint FROM t""")
def raw_tables_view(spark, sf_dir):
    return V.raw_tables(_raw_tables(spark, sf_dir))


@query(f"""WITH {CANDS} SELECT count(DISTINCT table_idx) AS tables, count(*) FILTER (score >= 0.3) AS columns_after, count(*) FILTER (score < 0.3) AS columns_removed, (SELECT count(*) FROM cands) AS candidates, count(*) AS columns_before FROM scored""")
def step1(spark, sf_dir):
    return V.extraction(H.rebuild(_scored(spark, sf_dir)), _cands(spark, sf_dir))


@query(f"""WITH {COLUMNS}, f AS (SELECT CASE WHEN score >= 0.3 THEN 'kept' ELSE 'removed' END AS kind, table_idx, col_idx, round(score, 9) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY score >= 0.3 ORDER BY table_idx, col_idx) <= 3)
SELECT kind, table_idx, col_idx, score, (SELECT string_agg(value, '|' ORDER BY row_idx) FROM (SELECT row_idx, value FROM cells c WHERE c.table_idx = f.table_idx AND c.col_idx = f.col_idx ORDER BY row_idx LIMIT 5)) AS examples FROM f""")
def step1_columns(spark, sf_dir):
    found = V.kept_examples(_scored(spark, sf_dir), K.cells(spark, sf_dir))
    return found.select("kind", "table_idx", "col_idx", r9("score", "score"), F.array_join("examples", "|").alias("examples"))


@query(f"WITH {CANDS} SELECT cand, round(any_value(theta), 9) AS theta, string_agg(l || '>' || r, '|' ORDER BY pos) AS sample FROM cp JOIN cands USING (cand) WHERE cand < 5 AND pos < 3 GROUP BY cand")
def step1_candidates(spark, sf_dir):
    return _sampled(V.candidate_examples(_cands(spark, sf_dir))).select("cand", r9("theta", "theta"), "sample")


_LOST = "lo AS (SELECT m.partition, m.size - s.k AS removed, s.k AS size FROM maps m JOIN (SELECT partition, count(*) AS k FROM res GROUP BY partition) s USING (partition))"


@query(f"{G}, {_LOST} SELECT count(*) AS total_mappings, count(*) FILTER (removed > 0) AS mappings_with_conflicts, CAST(sum(removed) AS BIGINT) AS total_pairs_removed FROM lo")
def step3_totals(spark, sf_dir):
    rows = R.exploded(_grouped(spark, sf_dir)[3])
    return V.resolution(R.nested(R.resolve(rows), rows))


@query(f"""{G}, {_LOST}, f AS (SELECT * FROM lo ORDER BY size DESC, partition LIMIT 5), sm AS (SELECT partition, string_agg(l || '>' || r, '|' ORDER BY l, r) AS sample FROM (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY partition ORDER BY l, r) <= 3) GROUP BY partition)
SELECT partition, CAST(size AS INTEGER) AS size, CAST(removed AS BIGINT) AS num_conflicts_removed, sample FROM f JOIN sm USING (partition)""")
def step3_largest(spark, sf_dir):
    rows = R.exploded(_grouped(spark, sf_dir)[3])
    return _sampled(V.resolved_largest(R.nested(R.resolve(rows), rows)))


@query(f"{M} SELECT count(*) AS total, count(*) FILTER (num_source_tables = 1) AS singletons, count(*) FILTER (num_source_tables <> 1) AS multi, round(avg(size), 1) AS avg_pairs FROM maps")
def step2(spark, sf_dir):
    return V.synthesis(_maps(spark, sf_dir)[3])


@query(f"{M} SELECT partition, CAST(size AS INTEGER) AS size, CAST(num_source_tables AS INTEGER) AS num_source_tables FROM maps ORDER BY size DESC, partition LIMIT 6")
def step2_largest(spark, sf_dir):
    return V.largest(_maps(spark, sf_dir)[3]).select("partition", "size", "num_source_tables")


@query(f"""{G}, gone AS (SELECT partition, l, r FROM mp EXCEPT SELECT partition, l, r FROM res)
SELECT partition, l, r FROM gone WHERE partition IN (SELECT DISTINCT partition FROM gone ORDER BY partition LIMIT 4)""")
def step3(spark, sf_dir):
    rows = R.exploded(_grouped(spark, sf_dir)[3])
    return V.conflict_examples(rows, R.resolve(rows))
