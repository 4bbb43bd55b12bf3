"""DuckDB SQL of the factor library's queries, written from the definitions."""

from __future__ import annotations

from itertools import combinations

from bookpulse.operators.figures import CORE
from bookpulse.plans.catalogue import FACTORS, HORIZONS, LABELS, PAIRS, WINDOW_MS
from bookpulse.plans.runs import STAGES

D = "CAST({} AS DOUBLE)".format
_c = D("0.01")
K = "symbol, trading_day, event_time"


def _ms(t: str = "event_time") -> str:
    return f"(({t} // 10000000) * 3600000 + ({t} // 100000 % 100) * 60000 + ({t} // 1000 % 100) * 1000 + {t} % 1000)"


_AUCTION = "(event_time BETWEEN 93000000 AND 113000000 OR event_time BETWEEN 130000000 AND 145700000)"
_V = "(bid_price_1 > 0 AND ask_price_1 > 0 AND ask_price_1 >= bid_price_1)"
_PV = "(prev_bid_price_1 > 0 AND prev_ask_price_1 > 0 AND prev_ask_price_1 >= prev_bid_price_1)"
_MID = "((bid_price_1 + ask_price_1) / 2)"


def _levels() -> str:
    d = f"CASE WHEN event_type = 'error' AND k % 4 = 0 THEN -{_c} ELSE {_c} * (1 + k % 2) END"
    out = []
    for n in range(1, 6):
        v = f"CAST(100 * ((k + {3 * (n - 1)}) % 17) + 10 AS DOUBLE)"
        out += [
            f"round(bid_1 - {D(n - 1)} * {_c}, 2) AS bid_price_{n}", f"round(bid_1 + {d} + {D(n - 1)} * {_c}, 2) AS ask_price_{n}",
            (f"CASE WHEN k % 29 <> 0 THEN {v} END" if n == 1 else v) + f" AS bid_volume_{n}", f"CAST(100 * ((event_id + {2 * (n - 1)}) % 13) + 5 AS DOUBLE) AS ask_volume_{n}",
        ]
    return ", ".join(out)


def _oir(depth: int) -> str:
    b, a = ("(" + " + ".join(f"coalesce({s}_volume_{k}, 0.0::DOUBLE)" for k in range(1, depth + 1)) + ")" for s in ("bid", "ask"))
    return f"CASE WHEN {b} + {a} > 0 THEN ({b} - {a}) / ({b} + {a}) END"


def _pressure(side: str) -> str:
    terms = []
    for k in range(1, 6):
        dist = f"({_MID} - bid_price_{k})" if side == "bid" else f"(ask_price_{k} - {_MID})"
        terms.append(f"CASE WHEN {side}_volume_{k} > 0 AND {dist} > 0 THEN {side}_volume_{k} / {dist} ELSE 0.0::DOUBLE END")
    return "(" + " + ".join(terms) + ")"


_PB, _PA = _pressure("bid"), _pressure("ask")
_SLOPE = f"CASE WHEN {_V} AND {_PB} + {_PA} > 0 THEN ({_PB} - {_PA}) / ({_PB} + {_PA}) END"
_ARM = "CASE WHEN {} THEN {} ELSE 0.0 END".format
_OFI = (
    f"CASE WHEN {_V} AND {_PV} THEN ({_ARM('bid_price_1 >= prev_bid_price_1', 'bid_volume_1')} - {_ARM('bid_price_1 <= prev_bid_price_1', 'prev_bid_volume_1')})"
    f" - ({_ARM('ask_price_1 <= prev_ask_price_1', 'ask_volume_1')} - {_ARM('ask_price_1 >= prev_ask_price_1', 'prev_ask_volume_1')}) END"
)
_VOI = f"CASE WHEN {_V} AND {_PV} AND bid_price_1 = prev_bid_price_1 AND ask_price_1 = prev_ask_price_1 THEN (bid_volume_1 - prev_bid_volume_1) - (ask_volume_1 - prev_ask_volume_1) END"
_LAG = ", ".join(f"lag({f}_1) OVER w AS prev_{f}_1" for f in ("bid_price", "ask_price", "bid_volume", "ask_volume"))


def _labels() -> str:
    out = "labelled0 AS (SELECT *, " + _ms() + f" AS t, CASE WHEN {_V} THEN {_MID} END AS p FROM fac2)"
    names = "*"
    for i, h in enumerate(HORIZONS):
        names = (
            f", labelled{i + 1} AS (SELECT a.*, b.t AS label_time_ms_{h}ms, b.p AS label_price_{h}ms, CASE WHEN a.p > 0 AND b.p > 0 THEN b.p / a.p - 1 END AS fwd_ret_{h}ms"
            f" FROM labelled{i} a ASOF LEFT JOIN labelled0 b ON a.symbol = b.symbol AND a.trading_day = b.trading_day AND b.t >= a.t + {h})"
        )
        out += names
    return out


def _long(source: str, pairs, left: str, right: str, keys: str = "trading_day, event_time, symbol") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{a}' AS {left}, '{b}' AS {right}, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)


def _corr(x: str, y: str) -> str:
    return f"round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 12)"


def _raw(source: str, by: str) -> str:
    return (
        f"SELECT {by}, count(*) AS n_obs, max(dx) AS x_n_unique, max(dy) AS y_n_unique, {_corr('rx', 'ry')} AS corr FROM (SELECT {by},"
        f" rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry,"
        f" dense_rank() OVER (PARTITION BY {by} ORDER BY x) AS dx, dense_rank() OVER (PARTITION BY {by} ORDER BY y) AS dy FROM {source}) GROUP BY {by}"
    )


def _reason(least: str, x: str, y: str, nan: str) -> str:
    return (
        f"CASE WHEN n_obs IS NULL THEN 'missing_pair_values' WHEN n_obs < {least} THEN 'below_min_cross_section' WHEN x_n_unique <= 1 AND y_n_unique <= 1 THEN 'both_constant'"
        f" WHEN x_n_unique <= 1 THEN '{x}_constant' WHEN y_n_unique <= 1 THEN '{y}_constant' WHEN corr IS NULL THEN '{nan}' END"
    )


def _values(pairs, left: str, right: str) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + f") v({left}, {right})"


_FP = list(combinations(FACTORS, 2))
_JUDGED = "SELECT *, invalid_reason IS NULL AS is_valid, CASE WHEN invalid_reason IS NULL THEN corr END AS {v} FROM (SELECT *, {r} AS invalid_reason FROM {t})".format
_FAM = "regexp_replace({}, '_[0-9].*$', '')".format

CTES = f"""
t AS (SELECT event_id, ts, event_type, lpad(CAST(user_id % 40 AS VARCHAR), 6, '0') AS symbol, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS trading_day,
  CAST(hour(ts) AS BIGINT) AS hh, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS se, CAST(millisecond(ts) % 1000 AS BIGINT) AS mss,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  round({D(10)} + {D('user_id % 40')} * {D('0.5')} + {D('CAST(floor(value) AS BIGINT) % 3')} * {_c}, 2) AS bid_1 FROM events),
snap AS MATERIALIZED (SELECT symbol, substr(CAST(trading_day AS VARCHAR), 1, 6) AS source_month, trading_day, hh * 10000000 AS event_time, {_levels()}
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trading_day, hh ORDER BY ts DESC, event_id DESC) AS rn FROM t) WHERE rn = 1),
trade AS (SELECT symbol, trading_day, hh * 10000000 + mi * 100000 + se * 1000 + mss AS event_time, event_id AS deal_id, CASE WHEN k % 50 = 0 THEN 0.0::DOUBLE ELSE bid_1 END AS price,
  CAST(k AS DOUBLE) AS volume, CASE WHEN event_type IN ('view', 'purchase') THEN 0 WHEN event_type IN ('click', 'signup') THEN 1 ELSE -11 END AS side FROM t),
lagged AS (SELECT *, {_LAG} FROM snap WINDOW w AS (PARTITION BY symbol, trading_day ORDER BY event_time)),
fac AS (SELECT *, CASE WHEN {_V} AND bid_volume_1 + ask_volume_1 > 0 THEN (bid_price_1 * ask_volume_1 + ask_price_1 * bid_volume_1) / (bid_volume_1 + ask_volume_1) END AS micro_price_1,
  CASE WHEN {_V} AND {_MID} > 0 THEN (ask_price_1 - bid_price_1) / {_MID} END AS relative_spread_1, {_oir(1)} AS oir_1, {_oir(5)} AS oir_5, {_SLOPE} AS book_slope_5, {_VOI} AS voi_1, {_OFI} AS ofi_1 FROM lagged),
clean AS (SELECT * FROM trade WHERE price > 0 AND volume > 0 AND side IN (0, 1)),
imb AS (SELECT symbol, trading_day, bucket_ms, CASE WHEN v0 + v1 > 0 THEN (v0 - v1) / (v1 + v0) END AS trade_imbalance_3s FROM
  (SELECT symbol, trading_day, CAST(ceil({_ms()} / {D(WINDOW_MS)}) AS BIGINT) * {WINDOW_MS} AS bucket_ms, sum(CASE WHEN side = 0 THEN volume ELSE 0 END) AS v0, sum(CASE WHEN side = 1 THEN volume ELSE 0 END) AS v1
   FROM clean WHERE {_AUCTION} GROUP BY ALL)),
fac2 AS (SELECT fac.*, trade_imbalance_3s FROM fac LEFT JOIN imb ON fac.symbol = imb.symbol AND fac.trading_day = imb.trading_day AND {_ms()} = bucket_ms),
{_labels()},
panel AS MATERIALIZED (SELECT trading_day, event_time, symbol, source_month, {', '.join([*FACTORS, *LABELS])} FROM labelled{len(HORIZONS)}),
auction AS (SELECT * FROM panel WHERE {_AUCTION}),
long AS ({_long('auction', PAIRS, 'factor', 'label')}),
raw AS ({_raw('long', 'trading_day, event_time, factor, label')}),
full_raw AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT trading_day, event_time FROM auction) k CROSS JOIN {_values(PAIRS, 'factor', 'label')} LEFT JOIN raw USING (trading_day, event_time, factor, label)),
ts AS ({_JUDGED(v='rank_ic', r=_reason('10', 'factor', 'label', 'nan_rank_ic'), t='full_raw')}),
ord AS MATERIALIZED (SELECT *, CAST(least(greatest(floor((ordinal - 1) * 5 / n::DOUBLE) + 1, 1), 5) AS INTEGER) AS group_id FROM (SELECT *, max(dd) OVER (PARTITION BY trading_day, event_time, factor, label) AS n_unique FROM
  (SELECT *, count(*) OVER (PARTITION BY trading_day, event_time, factor, label) AS n, dense_rank() OVER (PARTITION BY trading_day, event_time, factor, label ORDER BY x) AS dd,
   row_number() OVER (PARTITION BY trading_day, event_time, factor, label ORDER BY x, symbol) AS ordinal FROM long)) WHERE n >= 10 AND n_unique > 1),
gret AS MATERIALIZED (SELECT trading_day, event_time, factor, label, group_id, avg(y) AS group_mean_ret, count(*) AS group_n_obs, max(n) AS cross_section_n_obs, max(n_unique) AS factor_n_unique, 5 AS num_groups, 10 AS min_group_cross_section FROM ord GROUP BY ALL),
gsum AS (SELECT factor, label, group_id, avg(group_mean_ret) AS mean_ret, stddev_samp(group_mean_ret) AS std_ret, count(group_mean_ret) AS time_points, avg(CASE WHEN group_mean_ret > 0 THEN 1.0 WHEN group_mean_ret <= 0 THEN 0.0 END) AS positive_ratio,
  avg(group_n_obs) AS avg_group_size, avg(cross_section_n_obs) AS avg_cross_section, max(num_groups) AS num_groups, max(min_group_cross_section) AS min_group_cross_section FROM gret GROUP BY ALL),
gspread AS (SELECT b.trading_day, b.event_time, b.factor, b.label, b.group_mean_ret AS bottom_ret, a.group_mean_ret AS top_ret, a.group_mean_ret - b.group_mean_ret AS top_minus_bottom
  FROM gret b JOIN gret a USING (trading_day, event_time, factor, label) WHERE b.group_id = 1 AND a.group_id = 5),
flong AS ({_long('auction', _FP, 'factor_left', 'factor_right')}),
fraw AS (SELECT * FROM (SELECT DISTINCT trading_day, event_time FROM auction) k CROSS JOIN {_values(_FP, 'factor_left', 'factor_right')} LEFT JOIN ({_raw('flong', 'trading_day, event_time, factor_left, factor_right')}) USING (trading_day, event_time, factor_left, factor_right)),
fts AS MATERIALIZED ({_JUDGED(v='factor_corr', r=_reason('10', 'left_factor', 'right_factor', 'nan_factor_corr'), t='fraw')})
"""


def _counts(reasons: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE invalid_reason = '{r}') AS groups_{r}" for r in reasons.split())


_R = "below_min_cross_section factor_constant label_constant both_constant missing_pair_values nan_rank_ic"
_POS = "avg(CASE WHEN {0} > 0 THEN 1.0 WHEN {0} <= 0 THEN 0.0 END)".format
_ICIR = "CASE WHEN rank_ic_std > 0 THEN rank_ic_mean / rank_ic_std END AS icir"
_T = "CASE WHEN {s} > 0 AND {n} > 1 THEN {m} / ({s} / sqrt({n})) END".format
_TIC = _T(s="rank_ic_std", n="time_points", m="rank_ic_mean") + " AS t_stat"


def _summary(source: str, by: str) -> str:
    b = f"{by}, " if by else ""
    return (
        f"SELECT *, groups_valid / groups_total AS valid_ratio, groups_total - groups_valid AS groups_invalid, {_ICIR}, {_TIC} FROM (SELECT {b}factor, label, count(*) AS groups_total, count(*) FILTER (WHERE is_valid) AS groups_valid, {_counts(_R)},"
        f" avg(rank_ic) AS rank_ic_mean, stddev_samp(rank_ic) AS rank_ic_std, count(rank_ic) AS time_points, {_POS('rank_ic')} AS positive_ratio, avg(n_obs) FILTER (WHERE is_valid) AS avg_cross_section FROM {source} GROUP BY ALL)"
    )


def _session(monthly: bool) -> str:
    m = "substr(CAST(trading_day AS VARCHAR), 1, 6) AS month, " if monthly else ""
    return (
        f"SELECT *, groups_valid / groups_total AS valid_ratio, {_ICIR}, {_TIC} FROM (SELECT {m}CASE WHEN event_time <= 113000000 THEN 'am' ELSE 'pm' END AS session, factor, label, count(*) AS groups_total, count(*) FILTER (WHERE is_valid) AS groups_valid,"
        f" count(*) FILTER (WHERE NOT is_valid) AS groups_invalid, count(rank_ic) AS time_points, avg(rank_ic) AS rank_ic_mean, stddev_samp(rank_ic) AS rank_ic_std, {_POS('rank_ic')} AS positive_ratio, avg(n_obs) FILTER (WHERE is_valid) AS avg_cross_section FROM ts WHERE {_AUCTION} GROUP BY ALL)"
    )


def _reasons(by: str, extra: str) -> str:
    return (
        f"SELECT *, groups_valid / groups_total AS valid_ratio FROM (SELECT factor, label{by}, count(*) AS groups_total, count(*) FILTER (WHERE is_valid) AS groups_valid, count(*) FILTER (WHERE NOT is_valid) AS groups_invalid, {_counts(_R)},"
        f" avg(n_obs) FILTER (WHERE is_valid) AS avg_n_obs, avg(rank_ic) AS rank_ic_mean, {extra} FROM ts GROUP BY ALL)"
    )


def _coverage(keys: str, extremes: bool) -> str:
    k = f"{keys}, " if keys else ""
    cells = " UNION ALL ".join(f"SELECT {k}'{c}' AS \"column\", '{'label' if c in LABELS else 'factor'}' AS column_type, {c} AS v FROM panel" for c in [*FACTORS, *LABELS])
    more = ", min(v) AS value_min, max(v) AS value_max" if extremes else ""
    return (
        f"SELECT *, non_null_rows / total_rows AS coverage_ratio FROM (SELECT {k}\"column\", column_type, count(*) AS total_rows, count(v) AS non_null_rows, count(*) - count(v) AS null_rows,"
        f" count(DISTINCT v) + CASE WHEN count(v) < count(*) THEN 1 ELSE 0 END AS n_unique, avg(v) AS value_mean, stddev_samp(v) AS value_std{more} FROM ({cells}) GROUP BY ALL)"
    )


_FSUM = (
    "SELECT *, groups_valid / groups_total AS valid_ratio, groups_total - groups_valid AS groups_invalid FROM (SELECT factor_left, factor_right, count(*) AS groups_total, count(*) FILTER (WHERE is_valid) AS groups_valid, "
    + _counts("below_min_cross_section both_constant left_factor_constant right_factor_constant missing_pair_values nan_factor_corr")
    + ", avg(factor_corr) AS factor_corr_mean, stddev_samp(factor_corr) AS factor_corr_std, count(factor_corr) AS time_points, avg(abs(factor_corr)) AS factor_corr_abs_mean, avg(n_obs) FILTER (WHERE is_valid) AS avg_cross_section FROM fts GROUP BY ALL)"
)
_ICC = (
    f"SELECT factor_left, factor_right, label, coalesce(n, 0) AS overlap_time_points, CASE WHEN n > 1 THEN c END AS ic_corr, abs(CASE WHEN n > 1 THEN c END) AS ic_corr_abs FROM {_values(_FP, 'factor_left', 'factor_right')}"
    f" CROSS JOIN (VALUES {', '.join(f'({chr(39)}{y}{chr(39)})' for y in LABELS)}) l(label) LEFT JOIN (SELECT a.factor AS factor_left, b.factor AS factor_right, a.label, count(*) AS n, {_corr('a.rank_ic', 'b.rank_ic')} AS c"
    " FROM ts a JOIN ts b ON a.trading_day = b.trading_day AND a.event_time = b.event_time AND a.label = b.label AND a.factor < b.factor WHERE a.rank_ic IS NOT NULL AND b.rank_ic IS NOT NULL GROUP BY ALL) USING (factor_left, factor_right, label)"
)
_POWER = f"SELECT factor, avg(abs(rank_ic_mean)) AS avg_abs_rank_ic_mean, max(abs(rank_ic_mean)) AS max_abs_rank_ic_mean, avg(valid_ratio) AS avg_valid_ratio FROM ({_summary('ts', '')}) GROUP BY factor"
_REC = f"""
SELECT *, CASE WHEN recommended_keep = 'keep_both' THEN NULL WHEN recommended_keep = factor_left THEN factor_right ELSE factor_left END AS recommended_drop,
  CASE WHEN NOT likely_redundant THEN CASE WHEN same_family THEN 'same_family_but_distinct_in_current_sample' ELSE 'retain_both' END
       WHEN high_factor_corr AND high_ic_corr THEN 'high_factor_and_ic_correlation' ELSE 'same_family_with_material_correlation' END AS reason
FROM (SELECT *, CASE WHEN NOT likely_redundant THEN 'keep_both' WHEN round(left_avg_abs_rank_ic_mean, 9) > round(right_avg_abs_rank_ic_mean, 9) THEN factor_left WHEN round(left_avg_abs_rank_ic_mean, 9) < round(right_avg_abs_rank_ic_mean, 9) THEN factor_right
       WHEN left_max_abs_rank_ic_mean > right_max_abs_rank_ic_mean THEN factor_left WHEN left_max_abs_rank_ic_mean < right_max_abs_rank_ic_mean THEN factor_right
       WHEN left_avg_valid_ratio >= right_avg_valid_ratio THEN factor_left ELSE factor_right END AS recommended_keep
FROM (SELECT *, (high_factor_corr AND high_ic_corr) OR (same_family AND factor_corr_abs_mean >= 0.65 AND ic_corr_abs_mean >= 0.6) AS likely_redundant
FROM (SELECT f.*, ic_corr_mean, ic_corr_abs_mean, ic_corr_abs_max, min_overlap_time_points, max_overlap_time_points,
  l.avg_abs_rank_ic_mean AS left_avg_abs_rank_ic_mean, l.max_abs_rank_ic_mean AS left_max_abs_rank_ic_mean, l.avg_valid_ratio AS left_avg_valid_ratio,
  r.avg_abs_rank_ic_mean AS right_avg_abs_rank_ic_mean, r.max_abs_rank_ic_mean AS right_max_abs_rank_ic_mean, r.avg_valid_ratio AS right_avg_valid_ratio,
  {_FAM('factor_left')} AS factor_family_left, {_FAM('factor_right')} AS factor_family_right, {_FAM('factor_left')} = {_FAM('factor_right')} AS same_family, factor_corr_abs_mean >= 0.8 AS high_factor_corr, ic_corr_abs_mean >= 0.8 AS high_ic_corr
FROM ({_FSUM}) f LEFT JOIN (SELECT factor_left, factor_right, avg(ic_corr) AS ic_corr_mean, avg(ic_corr_abs) AS ic_corr_abs_mean, max(ic_corr_abs) AS ic_corr_abs_max, min(overlap_time_points) AS min_overlap_time_points, max(overlap_time_points) AS max_overlap_time_points FROM ({_ICC}) GROUP BY ALL) c USING (factor_left, factor_right)
LEFT JOIN ({_POWER}) l ON f.factor_left = l.factor LEFT JOIN ({_POWER}) r ON f.factor_right = r.factor)))
"""
_CELL = "greatest(coalesce(factor_corr_abs_mean, 0), coalesce(ic_corr_abs_mean, 0))"
_MATRIX = (
    "SELECT a AS factor, " + ", ".join(f"max(CASE WHEN b = '{f}' THEN v END) AS {f}" for f in FACTORS)
    + f" FROM (SELECT factor_left AS a, factor_right AS b, {_CELL} AS v FROM ({_REC}) UNION ALL SELECT factor_right, factor_left, {_CELL} FROM ({_REC}) UNION ALL SELECT f, f, 1.0 FROM (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in FACTORS)}) q(f)) GROUP BY a"
)
_FIELDS = ("rank_ic", "n_obs", "factor_n_unique", "label_n_unique", "is_valid", "invalid_reason")
_TSL = "trading_day, event_time, factor, label, rank_ic, n_obs, x_n_unique AS factor_n_unique, y_n_unique AS label_n_unique, is_valid, invalid_reason"
_WIDE = "SELECT trading_day, event_time, " + ", ".join(f"max(CASE WHEN factor = '{f}' AND label = '{y}' THEN {c} END) AS {c}__{f}__{y}" for f, y in PAIRS for c in _FIELDS) + f" FROM (SELECT {_TSL} FROM ts) GROUP BY ALL"
_SW = f"swept AS ({_JUDGED(v='rank_ic', r=_reason('min_cross_section', 'factor', 'label', 'nan_rank_ic'), t='(SELECT * FROM full_raw CROSS JOIN (VALUES (8), (10), (15), (20)) m(min_cross_section))')})"
_MONO = f"""
SELECT o.*, top_minus_bottom_mean, top_minus_bottom_std, spread_time_points, positive_spread_ratio,
  CASE WHEN top_minus_bottom_mean > 0 THEN 'positive' WHEN top_minus_bottom_mean < 0 THEN 'negative' WHEN top_minus_bottom_mean = 0 THEN 'flat' END AS top_bottom_spread_sign,
  {_T(s='top_minus_bottom_std', n='spread_time_points', m='top_minus_bottom_mean')} AS top_minus_bottom_t_stat, groups_observed = num_groups AS has_complete_group_grid
FROM (SELECT factor, label, count(*) AS groups_observed, max(num_groups) AS num_groups, coalesce(bool_and(step >= 0), true) AS is_monotonic_non_decreasing, {_corr('rx', 'ry')} AS spearman_group_ret_corr
  FROM (SELECT *, mean_ret - lag(mean_ret) OVER (PARTITION BY factor, label ORDER BY group_id) AS step, rank() OVER (PARTITION BY factor, label ORDER BY group_id) AS rx,
    rank() OVER (PARTITION BY factor, label ORDER BY mean_ret) + (count(*) OVER (PARTITION BY factor, label, mean_ret) - 1) / 2.0 AS ry FROM gsum) GROUP BY ALL) o
LEFT JOIN (SELECT factor, label, avg(top_minus_bottom) AS top_minus_bottom_mean, stddev_samp(top_minus_bottom) AS top_minus_bottom_std, count(*) AS spread_time_points, {_POS('top_minus_bottom')} AS positive_spread_ratio FROM gspread GROUP BY ALL) s USING (factor, label)
"""
_PREV = ", ".join(f"prev_{f}_1" for f in ("bid_price", "ask_price", "bid_volume", "ask_volume"))
_LAB = ", ".join(f"{p}_{h}ms" for h in HORIZONS for p in ("label_time_ms", "label_price", "fwd_ret"))

_FINAL = {
    **{k: f"SELECT {K}, {c} FROM fac" for k, c in {"micro_price": "micro_price_1", "relative_spread": "relative_spread_1", "oir_1": "oir_1", "oir_5": "oir_5", "book_slope_5": "book_slope_5", "voi_1": "voi_1", "ofi_1": "ofi_1"}.items()},
    "event_time_ms": f"SELECT deal_id, {_ms()} AS event_time_ms FROM trade",
    "book_lag": f"SELECT {K}, {_PREV} FROM lagged",
    "snapshot_factors": f"SELECT {K}, {', '.join(f for f in FACTORS if f != 'trade_imbalance_3s')} FROM fac",
    "auction_filter": f"SELECT {K} FROM snap WHERE {_AUCTION}",
    "session_label": f"SELECT {K}, CASE WHEN event_time BETWEEN 93000000 AND 113000000 THEN 'am' WHEN event_time BETWEEN 130000000 AND 145700000 THEN 'pm' ELSE 'off_session' END AS session FROM snap",
    "trade_filter": f"SELECT {K}, deal_id, volume, side FROM clean",
    "trade_bucket": f"SELECT deal_id, CAST(ceil({_ms()} / {D(WINDOW_MS)}) AS BIGINT) * {WINDOW_MS} AS bucket_ms FROM trade",
    "trade_imbalance": "SELECT * FROM imb",
    "trade_factor_join": f"SELECT {K}, trade_imbalance_3s FROM fac2",
    "label_base_price": f"SELECT {K}, CASE WHEN {_V} THEN {_MID} END AS base_price FROM snap",
    "forward_label": f"SELECT {K}, {_LAB} FROM labelled{len(HORIZONS)}",
    "panel": "SELECT * FROM panel",
    "average_rank": "SELECT trading_day, event_time, symbol, rank() OVER (PARTITION BY trading_day, event_time ORDER BY oir_1) + (count(*) OVER (PARTITION BY trading_day, event_time, oir_1) - 1) / 2.0::DOUBLE AS average_rank FROM fac WHERE oir_1 IS NOT NULL",
    "rank_ic_pair": f"SELECT trading_day, event_time, factor, label, n_obs, x_n_unique, y_n_unique, corr FROM raw WHERE factor = 'oir_1' AND label = 'fwd_ret_{HORIZONS[0]}ms'",
    "rank_ic_timeseries_long": f"SELECT {_TSL} FROM ts",
    "rank_ic_timeseries": _WIDE,
    "rank_ic_summary": _summary("ts", ""),
    "rank_ic_monthly": _summary("(SELECT *, substr(CAST(trading_day AS VARCHAR), 1, 6) AS month FROM ts)", "month"),
    "rank_ic_sweep": _summary(f"(WITH {_SW} SELECT * FROM swept)", "min_cross_section"),
    "ordinal_rank": "SELECT trading_day, event_time, symbol, factor, label, ordinal, n AS cross_section_n_obs FROM ord",
    "group_id": "SELECT trading_day, event_time, symbol, factor, label, group_id FROM ord",
    "group_returns": "SELECT * FROM gret",
    "group_summary": f"SELECT *, {_T(s='std_ret', n='time_points', m='mean_ret')} AS t_stat FROM gsum",
    "group_spread": "SELECT * FROM gspread",
    "group_monotonicity": _MONO,
    "column_coverage": _coverage("", True),
    "symbol_coverage": _coverage("source_month, symbol", False),
    "pair_reason": _reasons("", "stddev_samp(rank_ic) AS rank_ic_std"),
    "event_time_reason": _reasons(", event_time", "min(n_obs) FILTER (WHERE is_valid) AS min_n_obs, max(n_obs) FILTER (WHERE is_valid) AS max_n_obs"),
    "session_summary": _session(False),
    "month_session_summary": _session(True),
    "stability": f"SELECT *, max_segment_rank_ic - min_segment_rank_ic AS segment_ic_range FROM (SELECT factor, label, count(DISTINCT month) AS months_observed, count(DISTINCT session) AS sessions_observed, avg(rank_ic_mean) AS avg_segment_rank_ic, min(rank_ic_mean) AS min_segment_rank_ic, max(rank_ic_mean) AS max_segment_rank_ic, {_POS('rank_ic_mean')} AS positive_segment_ratio, avg(valid_ratio) AS avg_segment_valid_ratio, min(valid_ratio) AS min_segment_valid_ratio, min(time_points) AS min_segment_time_points FROM ({_session(True)}) GROUP BY ALL)",
    "factor_corr_timeseries": "SELECT trading_day, event_time, factor_left, factor_right, factor_corr, n_obs, x_n_unique AS left_factor_n_unique, y_n_unique AS right_factor_n_unique, is_valid, invalid_reason FROM fts",
    "factor_corr_summary": _FSUM,
    "ic_corr_summary": _ICC,
    "factor_strength": _POWER,
    "ic_pair_rollup": f"SELECT factor_left, factor_right, avg(ic_corr) AS ic_corr_mean, avg(ic_corr_abs) AS ic_corr_abs_mean, max(ic_corr_abs) AS ic_corr_abs_max, min(overlap_time_points) AS min_overlap_time_points, max(overlap_time_points) AS max_overlap_time_points FROM ({_ICC}) GROUP BY ALL",
    "redundancy_recommendation": _REC,
    "fig_redundancy_matrix": _MATRIX,
    "fig_coverage_validity": f"SELECT c.\"column\" AS factor, coverage_ratio, valid_ratio FROM ({_coverage('', True)}) c JOIN ({_summary('ts', '')}) s ON c.\"column\" = s.factor AND s.label = 'fwd_ret_{min(HORIZONS)}ms'",
    "fig_core_monotonicity": f"SELECT g.factor, label, group_id, mean_ret * 10000 AS mean_ret_bps, positive_spread_ratio FROM gsum g JOIN (SELECT factor, positive_spread_ratio FROM ({_MONO}) WHERE label = 'fwd_ret_{min(HORIZONS)}ms') USING (factor) WHERE factor IN {CORE}",
    "fig_core_rank_ic": "SELECT factor, " + ", ".join(f"max(CASE WHEN label = '{y}' THEN rank_ic_mean END) AS {y}" for y in LABELS) + f" FROM ({_summary('ts', '')}) WHERE factor IN {CORE} GROUP BY factor",
    "fig_single_value": f"SELECT factor, label, valid_ratio FROM ({_summary('ts', '')}) WHERE factor IN {CORE[:2]}",
    "fig_rank_ic": "SELECT factor, " + ", ".join(f"max(CASE WHEN label = '{y}' THEN rank_ic_mean END) AS {y}" for y in LABELS) + f" FROM ({_summary('ts', '')}) GROUP BY factor",
    "fig_monotonicity": f"SELECT factor, group_id, mean_ret * 10000 AS mean_ret_bps FROM gsum WHERE label = 'fwd_ret_{min(HORIZONS)}ms'",
    "zfill_symbol": "SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey * 7 AS VARCHAR)) < 6 THEN lpad(CAST(o_orderkey * 7 AS VARCHAR), 6, '0') ELSE CAST(o_orderkey * 7 AS VARCHAR) END AS symbol FROM orders",
    "month_slice": "SELECT substr(CAST(trading_day AS VARCHAR), 1, 6) AS month, count(*) AS rows FROM snap GROUP BY 1",
    "factor_family": " UNION ALL ".join(f"SELECT '{f}' AS factor, " + _FAM(f"'{f}'") + f" AS family, count({f}) AS non_null_rows FROM panel" for f in FACTORS),
    "lineitem_rank_ic": "SELECT * FROM (" + _raw("(" + _long("(SELECT CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS ship_month, * FROM lineitem)", [(f, "l_extendedprice") for f in ("l_quantity", "l_discount", "l_tax")], "factor", "label", "ship_month") + ")", "ship_month, factor, label") + ")",
}

_FINAL |= {
    "asof_next_quote": f"SELECT deal_id, t.symbol, t.trading_day, deal_ms, quote_ms, mid FROM (SELECT *, {_ms()} AS deal_ms FROM trade) t ASOF LEFT JOIN"
    f" (SELECT symbol, trading_day, {_ms()} AS quote_ms, CASE WHEN {_V} THEN {_MID} END AS mid FROM snap) q ON t.symbol = q.symbol AND t.trading_day = q.trading_day AND q.quote_ms >= t.deal_ms",
    **{f"store_{name}": _FINAL[name] for name in ("rank_ic_summary", "rank_ic_monthly", "group_summary", "column_coverage")},
}
_PLACED = (
    "(SELECT *, CAST(least(greatest(floor((ordinal - 1) * 5 / n::DOUBLE) + 1, 1), 5) AS INTEGER) AS group_id FROM (SELECT ship_month, l_orderkey, l_linenumber, l_quantity, l_discount,"
    " row_number() OVER (PARTITION BY ship_month ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS ordinal, count(*) OVER (PARTITION BY ship_month) AS n"
    " FROM (SELECT CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS ship_month, * FROM lineitem) WHERE l_extendedprice IS NOT NULL) WHERE n >= 10)"
)
_FINAL |= {
    "lineitem_ordinal_groups": f"SELECT ship_month, l_orderkey, l_linenumber, ordinal, n, group_id FROM {_PLACED}",
    "lineitem_group_returns": f"SELECT ship_month, group_id, avg(l_discount) AS mean_discount, avg(l_quantity) AS mean_quantity, count(*) AS group_n_obs, max(n) AS cross_section_n_obs FROM {_PLACED} GROUP BY ALL",
}


# ---- sources, checks and stages -------------------------------------------------------------------------------

_ZFILL = "CASE WHEN length(CAST({0} AS VARCHAR)) < 6 THEN lpad(CAST({0} AS VARCHAR), 6, '0') ELSE CAST({0} AS VARCHAR) END".format
_SECU = "CASE WHEN deal_id % 5 = 0 THEN 1000000 + CAST(symbol AS BIGINT) ELSE CAST(symbol AS BIGINT) END"
_INGEST_TRADE = (
    f"SELECT {_ZFILL('secu_code')} AS symbol, '202401' AS source_month, * FROM (SELECT {_SECU} AS secu_code, trading_day, event_time, 2 * deal_id AS buy_id, CASE WHEN deal_id % 3 <> 0 THEN 2 * deal_id + 1 END AS sell_id,"
    " deal_id, price, volume, side, CAST(deal_id % 7 AS INTEGER) AS channel, deal_id + 10 AS biz_index FROM trade)"
)
_INGEST_ORDER = (
    f"SELECT {_ZFILL('o_orderkey * 37')} AS symbol, '202401' AS source_month, CAST(o_orderkey * 37 AS BIGINT) AS secu_code, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS trading_day, CAST(93000000 + o_orderkey % 1000 AS BIGINT) AS event_time,"
    " CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_custkey AS DOUBLE) AS volume, CAST(o_orderkey % 3 AS INTEGER) AS order_type, CAST(o_orderkey % 7 AS INTEGER) AS channel, CAST(o_orderkey + 10 AS BIGINT) AS biz_index,"
    " CAST(2 * o_orderkey AS BIGINT) AS db_order_id, CAST(NULL AS DOUBLE) AS last_price FROM orders"
)


def _ingest_snapshot() -> str:
    k = "(event_time // 10000000 + trading_day)"
    figures = "deal_num volume turnover total_deal_num total_volume total_turnover total_bid_volume total_ask_volume weight_bid_price weight_ask_price".split()
    cells = [f"CASE WHEN {k} % 5 <> 0 THEN CAST({k} + {i} AS DOUBLE) END AS {name}" for i, name in enumerate(figures)]
    for n in range(1, 11):
        cells += [f"{f}_{n}" if n <= 5 else f"CAST(NULL AS DOUBLE) AS {f}_{n}" for f in ("ask_price", "ask_volume", "bid_price", "bid_volume")]
        cells += [f"CAST({n} AS DOUBLE) AS bid_order_{n}", f"CAST({-n} AS DOUBLE) AS ask_order_{n}"]
    return f"SELECT symbol, '202401' AS source_month, CAST(symbol AS BIGINT) AS secu_code, trading_day, event_time, 3000 AS tick_time_diff, bid_price_1 AS last_price, {', '.join(cells)} FROM snap"


def _rows(columns: str, *rows: tuple) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") q({columns})"


_PAIR_PRODUCT = "factor_n_unique is_valid invalid_reason label_n_unique n_obs rank_ic".split()
_MISSING = ", ".join(sorted(f"{p}__{f}__{y}" for f, y in (("oir_1", "fwd_ret_30000ms"), ("voi_1", "fwd_ret_3000ms"), ("voi_1", "fwd_ret_30000ms")) for p in _PAIR_PRODUCT if (p, f, y) != ("rank_ic", "voi_1", "fwd_ret_30000ms")))
_SCHEMA_CHECKS = [
    ("V1", "two depths", "ask_price_1,ask_price_2,ask_volume_1,ask_volume_2,bid_price_1,bid_price_2,bid_volume_1,bid_volume_2,event_time,symbol,trading_day"),
    ("V2", "whole", "None"), ("V2", "column missing", "SchemaError: missing columns: ask_volume_1"), ("V2", "not numeric", "SchemaError: not numeric: ask_volume_1"),
    ("V3", "whole", "None"), ("V3", "columns missing", "SchemaError: missing columns: price, side"), ("V3", "not numeric", "SchemaError: not numeric: side"),
    ("V4", "quotes", "None"), ("V4", "quote missing", "SchemaError: missing columns: bid_price_1"), ("V4", "price missing", "SchemaError: missing columns: last_price"),
    ("V5", "repeated", "[3000, 30000]"), ("V5", "none", "ValueError: horizons have to be positive, one at least"), ("V5", "zero", "ValueError: horizons have to be positive, one at least"),
    ("V6", "inferred", "(['oir_1', 'voi_1'], ['fwd_ret_3000ms'])"), ("V6", "no label", "SchemaError: a factor and a label column are needed"),
    ("V7", "index missing", "SchemaError: missing columns: symbol"), ("V7", "chosen", "(['voi_1'], ['fwd_ret_3000ms'])"),
    ("V8", "one", "ValueError: a cross-section needs two rows at least"), ("V8", "repeated", "[8, 10]"),
    ("V9", "whole", "(['oir_1'], ['fwd_ret_3000ms'])"), ("V9", "field missing", "SchemaError: missing columns: is_valid__oir_1__fwd_ret_3000ms"), ("V10", "product", f"SchemaError: missing columns: {_MISSING}"),
    ("V11", "raised", "10"), ("V11", "one group", "ValueError: two groups at least are needed"),
    ("V12", "three", "[('a', 'b'), ('a', 'c'), ('b', 'c')]"), ("V12", "one", "SchemaError: two factors at least are needed"), ("V13", "no pair", "SchemaError: no rank_ic__factor__label column"),
]

_FINAL |= {
    "ingest_snapshot": _ingest_snapshot(),
    "ingest_order": _INGEST_ORDER,
    "ingest_trade": _INGEST_TRADE,
    "csv_discovery": "SELECT side, files, (SELECT count(*) FROM trade JOIN (VALUES (0, 1), (1, 2), (-11, 3)) k(side, place) USING (side) WHERE place <= files) AS rows FROM (VALUES (0, 1), (1, 2), (-11, 3)) q(side, files)",
    "ingest_jobs": "SELECT * FROM (WITH m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders)),"
    " j AS (SELECT 'all' AS plan, 2 * k + p AS place, dataset, month FROM m, (VALUES (0, 'trade'), (1, 'order')) q(p, dataset) UNION ALL SELECT 'chosen', n - 1 - k, 'order', month FROM m WHERE k >= n - 2)"
    " SELECT plan, CAST(place AS INTEGER) AS place, dataset, month, 'raw/' || dataset || '/' || month AS source, 'out/' || dataset || '/month=' || month AS target FROM j)",
    "idempotent_stage": "SELECT place, step, built, count(*) AS rows, count(DISTINCT event_type) AS types FROM events JOIN (VALUES (0, 'first', 1, 2, 2), (1, 'again', 1, 2, 2), (2, 'other parameter', 2, 3, 2), (3, 'more input', 3, 3, 1),"
    " (4, 'failing', 4, 3, 1), (5, 'again', 4, 3, 1), (6, 'forced', 5, 3, 1)) q(place, step, built, k, half) ON event_id % k = 0 AND event_id % half = 0 GROUP BY ALL",
    **{
        f"{name}_file_checks": f"SELECT trading_day, CASE WHEN trading_day = (SELECT min(trading_day) FROM {table}) THEN 'missing columns: {missing}' ELSE 'not numeric: {text}' END AS problem, count(*) AS rows, 1 AS files"
        f" FROM {table} WHERE trading_day IN (SELECT unnest([min(trading_day), max(trading_day)]) FROM {table}) GROUP BY ALL"
        for name, table, missing, text in (
            ("snapshot", "snap", "ask_volume_1", "bid_price_2"), ("trade", "trade", "volume", "price"), ("panel", "panel", LABELS[0], FACTORS[0]),
            ("series", "(SELECT DISTINCT trading_day, event_time FROM auction)", f"rank_ic__{PAIRS[0][0]}__{PAIRS[0][1]}", f"n_obs__{FACTORS[1]}__{LABELS[1]}"),
        )
    },
    "drifted_columns": "SELECT side, 'price' AS \"column\", 'string' AS type, 'double' AS usual, count(*) AS rows FROM trade WHERE side = 1 GROUP BY ALL",
    "read_many_files": "SELECT source_month, count(*) AS rows FROM snap GROUP BY 1",
    "unpaired_trades": "SELECT DISTINCT symbol, source_month FROM snap WHERE symbol <= '000002'",
    "schema_checks": _rows("item, \"case\", said", *_SCHEMA_CHECKS),
    "stage_factors": f"SELECT {K}, {', '.join(FACTORS)} FROM fac2",
}
_FINAL |= {name: _FINAL[same] for name, (_, same) in STAGES.items()}

# Columns of the driver's tables that the queries use: enough to tell which results are doubles.
_TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP",
    "lineitem": "l_orderkey BIGINT, l_linenumber INTEGER, l_shipdate TIMESTAMP, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_extendedprice DOUBLE",
}


def oracles(digits: int = 6) -> dict[str, str]:
    """SQL of every query, doubles rounded as the queries' are (their last digits depend on the order of a sum)."""
    import duckdb

    con = duckdb.connect()
    for name, columns in _TABLES.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
    out = {}
    for name, final in _FINAL.items():
        sql = f"WITH {CTES} {final}"
        columns = [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]
        out[name] = "SELECT " + ", ".join(f'round("{c}", {digits}) AS "{c}"' if t == "DOUBLE" else f'"{c}"' for c, t in columns) + f" FROM ({sql})"
    con.close()
    return out
