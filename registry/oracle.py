"""The same results as SQL over the given tables."""

from __future__ import annotations

from registry.streams import HARD, LENGTH, LINE_ORDER, MEASURES, PER_BATCH, WIDTH

L, B = LENGTH, PER_BATCH
_U = "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, event_id, value > 200 AS is_anomaly, [value] AS x FROM events"
_M = (
    f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS idx, {', '.join(LINE_ORDER)}, "
    f"l_quantity >= 49 AND l_discount >= 0.09 AS is_anomaly, [{', '.join(MEASURES)}] AS x FROM lineitem"
)
_RAREST = "(SELECT label FROM embeddings GROUP BY label ORDER BY count(*), label::VARCHAR LIMIT 1)"
_E = (
    "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, vec_id, "
    f"label = {_RAREST} AS is_anomaly, embedding::DOUBLE[] AS x FROM embeddings"
)
_D = """SELECT row_number() OVER (ORDER BY src_ord, ts, event_id) - 1 AS idx, src_ord, event_id, is_anomaly, x FROM (
  SELECT 0 AS src_ord, ts, event_id, value > 200 AS is_anomaly, [value] AS x FROM events WHERE event_type = 'view'
  UNION ALL SELECT 1, ts, event_id, value > 200, [value * 2] FROM events WHERE event_type = 'click')"""
ROWS = {"U": _U, "M": _M, "E": _E, "D": _D}


def r6(expression: str) -> str:
    return f"(CASE WHEN round({expression}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expression}, 6) END)"


def big(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c.split('.')[-1]}" for c in columns)


def cells(stream: str, init: str = "n") -> str:
    """CTEs up to scaled cells of the initialization rows and their subsets."""
    d = WIDTH[stream]
    return f"""WITH rows AS MATERIALIZED ({ROWS[stream]}),
size AS (SELECT n, {init} AS n0 FROM (SELECT count(*) AS n FROM rows)),
allcells AS (SELECT idx, unnest(range({d})) AS dim, unnest(x) AS v FROM rows),
lim AS (SELECT dim, min(v) AS mn, max(v) AS mx FROM allcells, size WHERE idx < n0 GROUP BY dim),
scaled AS MATERIALIZED (SELECT idx // {L} AS w, idx % {L} AS step, dim,
  CASE WHEN mx = mn THEN 0 ELSE (v - mn) / (mx - mn) END AS v
  FROM allcells JOIN lim USING (dim), size WHERE idx < (n0 // {L}) * {L}),
wins AS MATERIALIZED (SELECT idx // {L} AS w, bool_or(is_anomaly) AS is_anomaly, count_if(is_anomaly) AS anomalous_rows
  FROM rows, size WHERE idx < (n0 // {L}) * {L} GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY w) - 1 AS r,
  count(*) OVER (PARTITION BY is_anomaly) AS m FROM wins),
subs AS MATERIALIZED (SELECT w, is_anomaly, r, unnest(CASE WHEN is_anomaly THEN
    CASE WHEN m < 2 THEN ['va', 'ta'] WHEN r < m // 2 THEN ['va'] ELSE ['ta'] END
  WHEN r < m // 10 * 5 THEN ['sn'] WHEN r < m // 10 * 8 THEN ['vn1'] WHEN r < m // 10 * 9 THEN ['vn2'] ELSE ['tn'] END) AS subset
  FROM ranked)"""


def errors(stream: str, init: str = "n") -> str:
    return f"""{cells(stream, init)},
prof AS MATERIALIZED (SELECT step, dim, avg(v) AS mean FROM scaled JOIN subs USING (w) WHERE subset = 'sn' GROUP BY step, dim),
err AS MATERIALIZED (SELECT w, step, dim, abs(v - mean) AS e FROM scaled JOIN prof USING (step, dim))"""


def model(stream: str, init: str = "n") -> str:
    spread = "var_pop(a.e)" if WIDTH[stream] == 1 else "covar_samp(a.e, b.e)"
    return f"""{errors(stream, init)},
vn1 AS MATERIALIZED (SELECT err.* FROM err JOIN subs USING (w) WHERE subset = 'vn1'),
mu AS MATERIALIZED (SELECT dim, avg(e) AS mu FROM vn1 GROUP BY dim),
sig AS MATERIALIZED (SELECT a.dim AS i, b.dim AS j, {spread} AS sigma FROM vn1 a JOIN vn1 b USING (w, step) GROUP BY 1, 2)"""


def quadratic(source: str) -> str:
    return f"""SELECT a.w, a.step, sqrt(greatest(sum((a.e - ma.mu) * sig.sigma * (b.e - mb.mu)), 0)) AS score
  FROM {source} a JOIN {source} b USING (w, step) JOIN sig ON sig.i = a.dim AND sig.j = b.dim
  JOIN mu ma ON ma.dim = a.dim JOIN mu mb ON mb.dim = b.dim GROUP BY a.w, a.step"""


def points(stream: str, init: str = "n") -> str:
    return f"{model(stream, init)},\npts AS MATERIALIZED ({quadratic('err')})"


def pools(stream: str, init: str = "n") -> str:
    return f"""{points(stream, init)},
pool AS MATERIALIZED (SELECT CASE WHEN subset = 'va' AND rows.is_anomaly THEN 'abnormal' ELSE 'normal' END AS pool, score
  FROM pts JOIN subs USING (w) JOIN rows ON rows.idx = pts.w * {L} + pts.step WHERE subset IN ('vn2', 'va'))"""


def candidates(stream: str, init: str = "n") -> str:
    return f"""{pools(stream, init)},
med AS (SELECT quantile_cont(score, 0.5) FILTER (WHERE pool = 'normal') AS lo,
  quantile_cont(score, 0.5) FILTER (WHERE pool = 'abnormal') AS hi FROM pool),
cand AS MATERIALIZED (SELECT i, lo + i * (hi - lo) / 20 AS candidate FROM med, range(20) AS t(i)),
evals AS MATERIALIZED (SELECT i, candidate, tp, na - tp AS missed, fa AS false_alarms, CASE WHEN tp = 0 THEN 0 ELSE
    1.25 * (tp / na) * (tp / (tp + fa)) / (0.25 * (tp / na) + tp / (tp + fa)) END AS f FROM (
  SELECT i, candidate, count_if(pool = 'abnormal' AND score > candidate) AS tp, count_if(pool = 'abnormal') AS na,
    count_if(pool = 'normal' AND score > candidate) AS fa FROM cand, pool GROUP BY i, candidate)),
best AS (SELECT CASE WHEN (SELECT count(*) FROM subs WHERE subset = 'va') < {B}
    THEN (SELECT 2 * max(score) FROM pool WHERE pool = 'normal')
    ELSE (SELECT CASE WHEN f > 0 THEN candidate ELSE 0 END FROM evals ORDER BY f DESC, i LIMIT 1) END AS threshold)"""


def flagged(stream: str, hard: int = 1) -> str:
    return f"""{candidates(stream)},
flag AS MATERIALIZED (SELECT w, max(score) AS score_max, count_if(score > threshold) AS n_over,
    count_if(score > threshold) >= {hard} AS flagged FROM pts, best GROUP BY w),
dec AS MATERIALIZED (SELECT flag.*, wins.is_anomaly, w // {B} AS batch FROM flag JOIN wins USING (w))"""


# 60 % of the windows initialize, the rest is online
INIT60 = f"(n // {L}) * 6 // 10 * {L}"


def online(stream: str, hard: int = 1) -> str:
    return f"""{candidates(stream, INIT60)},
orows AS MATERIALIZED (SELECT (idx - n0) // {L} AS w, (idx - n0) % {L} AS step, is_anomaly, x FROM rows, size
  WHERE idx >= n0 AND idx - n0 < (n - n0) // {L * B} * {L * B}),
ocells AS (SELECT w, step, unnest(range({WIDTH[stream]})) AS dim, unnest(x) AS v FROM orows),
olim AS (SELECT w, dim, min(v) AS mn, max(v) AS mx FROM ocells GROUP BY w, dim),
oerr AS MATERIALIZED (SELECT w, step, dim, abs(CASE WHEN mx = mn THEN 0 ELSE (v - mn) / (mx - mn) END - mean) AS e
  FROM ocells JOIN olim USING (w, dim) JOIN prof USING (step, dim)),
opts AS MATERIALIZED ({quadratic('oerr')}),
dec AS MATERIALIZED (SELECT w, w // {B} AS batch, score_max, n_over, n_over >= {hard} AS flagged, is_anomaly FROM (
  SELECT w, max(score) AS score_max, count_if(score > threshold) AS n_over FROM opts, best GROUP BY w)
  JOIN (SELECT w, bool_or(is_anomaly) AS is_anomaly FROM orows GROUP BY w) USING (w))"""


ROC = """SELECT score, sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER () AS fpr,
  sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () AS tpr FROM (
  SELECT score_max AS score, count_if(is_anomaly) AS pos, count_if(NOT is_anomaly) AS neg FROM dec GROUP BY 1)"""
AUC = """SELECT (sum(CASE WHEN is_anomaly THEN rk END) - max(p) * (max(p) + 1) / 2) / (max(p) * max(q)) AS auc FROM (
  SELECT is_anomaly, rank() OVER (ORDER BY score_max) + (count(*) OVER (PARTITION BY score_max) - 1) / 2 AS rk,
    count_if(is_anomaly) OVER () AS p, count_if(NOT is_anomaly) OVER () AS q FROM dec)"""
ROUTES = (
    "is_anomaly AS to_anom_buf, is_anomaly AS to_anom_err, flagged AND NOT is_anomaly AS to_norm_buf, "
    "NOT is_anomaly AS to_norm_err"
)


def due(capacity: int) -> str:
    return f"""SELECT {big('batch', 'normal_fill', 'anomalous_fill')}, normal_fill >= {capacity * B} AND anomalous_fill > 0 AS due FROM (
  SELECT batch, sum(a) OVER (ORDER BY batch) AS normal_fill, sum(b) OVER (ORDER BY batch) AS anomalous_fill FROM (
    SELECT batch, count_if(flagged AND NOT is_anomaly) AS a, count_if(is_anomaly) AS b FROM dec GROUP BY batch))"""


def profile_of(stream: str) -> str:
    return f"""SELECT '{stream}' AS stream, {WIDTH[stream]}::BIGINT AS dimensions, count(*) AS instances,
  {r6('avg(is_anomaly::INT) * 100')} AS anomaly_percent FROM ({ROWS[stream]})"""


def sql() -> dict[str, str]:
    n_rows = "(SELECT count(*) FROM rows)"
    out: dict[str, str] = {}
    u = f"WITH rows AS ({ROWS['U']})"
    out["with_index"] = f"SELECT idx, event_id FROM ({ROWS['U']})"
    out["with_index_lineitem"] = f"SELECT idx, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM ({ROWS['M']})"
    out["downsample"] = f"SELECT idx // 8 AS idx, event_id FROM ({ROWS['U']}) WHERE idx % 8 = 0"
    out["slice_rows"] = f"{u} SELECT idx - 60 AS idx, event_id FROM rows WHERE idx >= 60 AND idx < {n_rows} - 36"
    out["trim_to_multiple"] = f"{u} SELECT idx, event_id FROM rows WHERE idx < {n_rows} // {L * B} * {L * B}"
    out["read_init"] = f"{u}, size AS (SELECT count(*) AS n FROM rows) SELECT idx, event_id FROM rows, size WHERE idx < {INIT60}"
    out["read_online"] = (
        f"{u}, size AS (SELECT count(*) AS n FROM rows) SELECT idx - {INIT60} AS idx, event_id FROM rows, size WHERE idx >= {INIT60}"
    )
    out["filter_eq"] = "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, event_id FROM events WHERE event_type = 'view'"
    out["select_ordinals"] = "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS label FROM lineitem"
    out["select_kinds"] = "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus AS label FROM lineitem"
    out["parse_column_kinds"] = """SELECT p_partkey, CAST(ord - 1 AS BIGINT) AS ord, trim(split_part(entry, ': ', 1)) AS name,
  split_part(entry, ': ', 2) AS kind FROM (SELECT p_partkey, unnest(parts) AS entry, unnest(range(1, len(parts) + 1)) AS ord FROM (
    SELECT p_partkey, string_split(p_name || ': symbolic. ' || p_brand || ': ' || p_type || '. size: continuous.', '.') AS parts FROM part))
  WHERE contains(entry, ': ')"""
    out["zip_columns"] = """SELECT CAST(coalesce(a.idx, b.idx) AS BIGINT) AS idx, a.value AS value, b.user_id FROM
  (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value FROM events WHERE event_type = 'view') a
  FULL JOIN (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, user_id FROM events WHERE event_type = 'click') b
  ON a.idx = b.idx"""
    out["ordered_union"] = f"SELECT idx, CAST(src_ord AS BIGINT) AS src_ord, event_id, x[1] AS value FROM ({ROWS['D']})"
    out["canonical_label"] = """SELECT event_id, (CASE event_type WHEN 'view' THEN 'normal.' WHEN 'click' THEN 'normal'
  ELSE event_type END) NOT IN ('normal', 'normal.') AS is_anomaly FROM events"""
    out["minority_as_anomaly"] = (
        f"SELECT vec_id, CASE WHEN label = {_RAREST} THEN 'anomaly.' ELSE 'normal.' END AS label FROM embeddings"
    )
    out["assign_windows"] = f"{u} SELECT idx, idx // {L} AS w, idx % {L} AS step FROM rows WHERE idx < {n_rows} // {L} * {L}"
    out["assign_batches"] = f"{cells('U')} SELECT w, w // {B} AS batch, w % {B} AS pos FROM wins"
    raw_m = f"WITH rows AS ({ROWS['M']})"
    out["collect_windows"] = f"""{raw_m} SELECT idx // {L} AS w, idx % {L} AS step,
  {', '.join(f'x[{i + 1}] AS x{i}' for i in range(4))}, is_anomaly FROM rows WHERE idx < {n_rows} // {L} * {L}"""
    out["keyed_windows"] = f"""SELECT user_id, idx // {L} AS w, idx % {L} AS step, value, is_anomaly FROM (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value, value > 200 AS is_anomaly,
    count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE idx < n // {L} * {L}"""
    out["window_label"] = f"{cells('M')} SELECT w, is_anomaly, CAST(anomalous_rows AS BIGINT) AS anomalous_rows FROM wins"
    out["partition_normal_anomalous"] = f"{cells('U')} SELECT idx, wins.is_anomaly AS win_anomaly FROM rows JOIN wins ON w = idx // {L}"
    out["attach_expert_labels"] = f"""SELECT w, coalesce(bool_or(event_type = 'error'), false) AS is_anomaly FROM (
  SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // {L} AS w, event_type, count(*) OVER () AS n FROM events)
  WHERE w < n // {L} GROUP BY w"""
    wide = ", ".join(f"max(v) FILTER (WHERE dim = {i}) AS c{i}" for i in range(4))
    rounded = ", ".join(f"{r6(f'c{i}')} AS x{i}" for i in range(4))
    out["minmax_global"] = f"{cells('M')} SELECT w, step, {rounded} FROM (SELECT w, step, {wide} FROM scaled GROUP BY w, step)"
    out["minmax_window"] = f"""{cells('M')}, z AS (SELECT w, step, dim, coalesce((v - mn) / nullif(mx - mn, 0), 0) AS v FROM (
    SELECT idx // {L} AS w, idx % {L} AS step, dim, v, min(v) OVER (PARTITION BY idx // {L}, dim) AS mn,
      max(v) OVER (PARTITION BY idx // {L}, dim) AS mx FROM allcells, size WHERE idx < n // {L} * {L}))
  SELECT w, step, {rounded} FROM (SELECT w, step, {wide} FROM z GROUP BY w, step)"""
    out["split_subsets"] = f"{cells('M')} SELECT w, subset FROM subs"
    out["split_report"] = f"""{cells('M')} SELECT subset, count(*) AS windows, count(*) * {L} AS rows FROM subs GROUP BY subset"""
    out["align_row_labels"] = f"""{cells('U')} SELECT w, idx % {L} AS step, rows.is_anomaly FROM subs JOIN rows ON idx // {L} = w
  WHERE subset = 'va'"""
    out["reverse_batches"] = f"""{cells('U')}, s AS (SELECT w, count(*) OVER () - 1 - r AS q, count(*) OVER () AS m FROM subs WHERE subset = 'sn')
  SELECT w, q // {B} AS batch, q % {B} AS pos FROM s WHERE q // {B} < m // {B}"""
    out["profile_model"] = f"{errors('M')} SELECT step, {big('dim')}, {r6('mean')} AS mean FROM prof"
    out["abs_error"] = f"{errors('M')} SELECT w, step, {big('dim')}, {r6('e')} AS e FROM err"
    out["mse"] = f"{errors('M')} SELECT subset, {r6('avg(e * e)')} AS mse FROM err JOIN subs USING (w) GROUP BY subset"
    out["fit_mu"] = f"{model('M')} SELECT {big('dim')}, {r6('mu')} AS mu FROM mu"
    sigma = f"SELECT {big('i', 'j')}, {r6('sigma')} AS sigma FROM sig"
    out["fit_sigma_univariate"] = f"{model('U')} {sigma}"
    out["fit_sigma_multivariate"] = f"{model('M')} {sigma}"
    out["fit_sigma_wide"] = f"{model('E')} {sigma}"
    point_rows = f"SELECT w, step, {r6('score')} AS score FROM pts"
    out["score_points_univariate"] = f"{points('U')} {point_rows}"
    out["score_points_multivariate"] = f"{points('M')} {point_rows}"
    out["score_points_wide"] = f"{points('E')} {point_rows}"
    out["score_windows"] = f"{points('M')} SELECT w, {r6('max(score)')} AS score_max FROM pts GROUP BY w"
    out["flag_windows"] = f"{flagged('M', HARD)} SELECT w, {big('n_over')}, flagged FROM dec"
    out["score_pools"] = f"{pools('U')} SELECT pool, {r6('score')} AS score FROM pool"
    out["threshold_fallback"] = f"{pools('U')} SELECT {r6('2 * max(score)')} AS threshold FROM pool WHERE pool = 'normal'"
    out["threshold_candidates"] = f"{candidates('M')} SELECT {big('i')}, {r6('candidate')} AS candidate FROM cand"
    out["evaluate_threshold"] = f"""{candidates('M')} SELECT {big('i', 'tp', 'missed', 'false_alarms')}, {r6('candidate')} AS candidate,
  {r6('f')} AS f FROM evals"""
    out["best_threshold"] = f"{candidates('M')} SELECT {r6('threshold')} AS threshold FROM best"
    out["route_window"] = f"{flagged('M', HARD)} SELECT w, {ROUTES} FROM dec"
    out["update_due"] = f"{flagged('M')} {due(4)}"
    buffer = f"{cells('M')}, buf AS (SELECT w, r, m FROM ranked WHERE is_anomaly)"
    out["oversample_by_doubling"] = f"""{buffer}, rep AS (SELECT min(p) AS copies FROM (SELECT (1::BIGINT << k) AS p FROM range(40) AS t(k)), size
    WHERE p * (SELECT count(*) FROM buf) >= n // {L})
  SELECT w, CAST(copy * m + r AS BIGINT) AS rank FROM buf, (SELECT unnest(range(copies)) AS copy FROM rep)"""
    out["truncate_to_batches"] = f"{buffer} SELECT w, r AS rank FROM buf WHERE r < m // {B} * {B}"
    out["buffer_train_val"] = f"""{buffer} SELECT w, r AS rank, r // {B} AS batch, CASE WHEN r // {B} < m // {B} - 1 THEN 'train' ELSE 'val' END AS role
  FROM buf WHERE r < m // {B} * {B}"""
    out["roc_curve"] = f"{flagged('M')} SELECT {r6('score')} AS score, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM ({ROC})"
    out["auc"] = f"{flagged('U')} SELECT {r6('auc')} AS auc FROM ({AUC})"
    out["auc_lineitem"] = f"{flagged('M')} SELECT {r6('auc')} AS auc FROM ({AUC})"
    out["confusion"] = f"{flagged('M', HARD)} SELECT flagged, is_anomaly, count(*) AS windows FROM dec GROUP BY ALL"
    out["dataset_profile"] = " UNION ALL ".join(profile_of(s) for s in "UMED")
    out["check_nulls"] = f"""SELECT count(*) AS rows, CAST(count_if(x IS NULL OR list_bool_or(list_transform(x, lambda v: v IS NULL OR isnan(v))))
  AS BIGINT) AS bad_rows FROM ({ROWS['M']})"""
    out["window_scores"] = f"{flagged('U')} SELECT w, is_anomaly, {r6('score_max')} AS score_max FROM dec"
    out["prepare_power"] = """SELECT a.idx, a.value, b.event_type AS label FROM (
    SELECT idx // 8 - 60 AS idx, value FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value, count(*) OVER () AS n FROM events)
    WHERE idx % 8 = 0 AND idx // 8 >= 60 AND idx // 8 < (n + 7) // 8 - 36) a
  JOIN (SELECT idx // 8 - 60 AS idx, event_type FROM (
      SELECT row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS idx, event_type, count(*) OVER () AS n FROM events)
    WHERE idx % 8 = 0 AND idx // 8 >= 60 AND idx // 8 < (n + 7) // 8 - 36) b ON a.idx = b.idx"""
    service = "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value, props AS label FROM events WHERE event_type"
    out["prepare_services"] = f"""SELECT 'view' AS series, * FROM ({service} = 'view') UNION ALL
  SELECT 'click', * FROM ({service} = 'click') UNION ALL
  SELECT 'viewclick', idx, value, label FROM (SELECT row_number() OVER (ORDER BY event_type DESC, ts, event_id) - 1 AS idx, value, props AS label
    FROM events WHERE event_type IN ('view', 'click'))"""
    out["prepare_forest"] = f"""SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS idx, l_quantity, l_extendedprice, l_discount, l_tax,
  CASE WHEN l_returnflag = (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) THEN 'anomaly.' ELSE 'normal.' END AS label
  FROM lineitem"""
    for name, stream in (("replay_fixed", "U"), ("replay_fixed_lineitem", "M")):
        out[name] = f"{online(stream, HARD)} SELECT {big('w', 'batch', 'n_over')}, {r6('score_max')} AS score_max, flagged, is_anomaly FROM dec"
    out["replay_fixed_auc"] = f"{online('M')} SELECT {r6('auc')} AS auc FROM ({AUC})"
    out["replay_adaptive_rows"] = out["stream_adaptive_rows"] = f"{online('U')} SELECT {big('w', 'batch')}, is_anomaly FROM dec"
    out["run_log_rows"] = f"""{online('M')}, found(metric, value) AS (
    SELECT 'updates', 0.0::DOUBLE UNION ALL SELECT 'batches', count(DISTINCT batch) FROM dec
    UNION ALL SELECT 'auc', {r6('auc')} FROM ({AUC}) UNION ALL SELECT 'seconds', NULL)
  SELECT 'night' AS run, metric, value FROM found"""
    out["replay_with_labels"] = f"""{online('U', HARD)} SELECT {big('w', 'batch', 'n_over')}, {r6('score_max')} AS score_max, flagged,
  verdict AS is_anomaly FROM dec JOIN (SELECT w, bool_or(x[1] > 220) AS verdict FROM orows GROUP BY w) USING (w)"""
    out["row_report"] = f"""SELECT count(*) AS rows, CAST(count_if(len(x) != 4) AS BIGINT) AS wrong_width,
  CAST(count_if(list_bool_or(list_transform(x, lambda v: v IS NULL OR isnan(v)))) AS BIGINT) AS bad_features,
  CAST(count_if(is_anomaly IS NULL) AS BIGINT) AS unlabelled FROM ({ROWS['M']})"""
    out["to_vector"] = " UNION ALL ".join(
        f"SELECT l_orderkey, l_partkey, l_suppkey, {i}::BIGINT AS dim, {r6(f'{c}::DOUBLE')} AS value FROM lineitem" for i, c in enumerate(MEASURES)
    )
    out["read_series_back"] = f"""{raw_m} SELECT idx, {', '.join(f'x[{i + 1}] AS f{i}' for i in range(4))}, is_anomaly FROM rows"""
    out["load_model_scores"] = out["window_scores"]
    out["stream_windows"] = f"""{u} SELECT idx // {L} AS w, idx % {L} AS step, x[1] AS value, is_anomaly FROM rows
  WHERE idx < {n_rows} // {L} * {L}"""
    out["stream_keyed_windows"] = out["keyed_windows"]
    out["stream_scores"] = out["replay_fixed"]
    out["stream_keyed_state"] = out["keyed_windows"]
    out["stream_positions"] = out["replay_fixed"]
    out["stream_late_verdicts"] = f"""{online('U', HARD)} SELECT {big('w', 'batch', 'n_over')}, {r6('score_max')} AS score_max, flagged,
  verdict AND w % 5 <= 3 AS is_anomaly FROM dec JOIN (SELECT w, bool_or(x[1] > 220) AS verdict FROM orows GROUP BY w) USING (w)"""
    out["refresh_error_model"] = f"""{model('M')} SELECT {big('i', 'j')}, {r6('mu')} AS mu, {r6('sigma')} AS sigma FROM sig JOIN mu ON mu.dim = sig.i WHERE i <= j"""
    # A file's rows are late by the watermark of the micro-batch before it: the latest time two files ago, less the delay.
    late = """WITH ends AS (SELECT min(epoch_us(ts) // 1000000) AS first, max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) + 1 AS span FROM events),
arrived AS (SELECT event_id, ts, user_id, value, span // 4 AS delay, (epoch_us(ts) // 1000000 - first) * 6 // span
    + CASE WHEN event_id % 7 = 0 THEN 3 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS file FROM events, ends),
marks AS (SELECT file, max(seen) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS behind, max(seen) OVER () AS seen
    FROM (SELECT file, max(ts) AS seen FROM arrived GROUP BY file)),
kept AS (SELECT arrived.*, seen, behind IS NOT NULL AND epoch_ms(ts) <= epoch_ms(behind) - delay * 1000 AS late FROM arrived JOIN marks USING (file))"""
    out["stream_late_rows"] = f"{late} SELECT file AS batch, count(*) AS rows, CAST(count_if(late) AS BIGINT) AS late_rows FROM kept GROUP BY file"
    out["stream_ordered_windows"] = f"""{late} SELECT user_id, i // {L} AS w, i % {L} AS step, value, value > 200 AS is_anomaly FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
    FROM kept WHERE NOT late AND epoch_ms(ts) <= epoch_ms(seen) - delay * 1000) WHERE i < n // {L} * {L}"""
    return out
