"""Independent SQL for the registered queries, in the dialect of the checking engine.

Written from the meaning of each query, not from the Spark plan: neighbour counts are
self joins here, folds are ``ntile`` and the schedule is a recursive query.
"""

from __future__ import annotations

from gtdlens.schemas import FORM_VOCABULARY

KIND = """CASE event_type WHEN 'click' THEN 'MTT-NLH' WHEN 'view' THEN 'MTT-PLO4'
    WHEN 'purchase' THEN 'MTT-PLO5' WHEN 'signup' THEN 'MTT-PLO6' ELSE 'CASH' END"""


def _pick(index: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


CLASS = "Micro", "Low", "Medium", "High"
DAYS = "Domingo", "Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado"


def _tournaments(source: str) -> str:
    """CTE ``t`` over a CTE ``src(match_id, day, hour, kind, g, k, amount)``."""
    return f"""src AS ({source}),
first AS (
    SELECT match_id, kind AS match_type_detail_name,
        {_pick('g % 4', *CLASS)} AS class_match,
        day AS start_date_local, CAST(hour AS INT) AS start_hour_local,
        {_pick('dayofweek(day)', *DAYS)} AS day_of_week_local,
        {_pick('g % 5', 'KO', 'Mystery Bounty', 'Progressive KO', 'Regular', 'Regular')} AS ko_type,
        {_pick('match_id % 4', '-', '10%', '15% Flat', '20%')} AS mtt_pool_allocation_description,
        CAST(k % 12 + 1 AS INT) AS level_reject,
        {_pick('match_id % 3', 'Hyper', 'Turbo', 'Standard - no ante')} AS estrutura_blinds,
        CAST(60 * (g % 10 + 1) AS INT) AS mtt_blind_up_time_sec,
        CAST((k % 3) / 10.0 AS DOUBLE) AS earlybird,
        k % 2 = 0 AS has_rebuy, g % 3 = 0 AS has_addon,
        CAST(1 + k % 20 AS DOUBLE) AS mtt_customer_buy_in,
        CAST(20 + 2 * (g % 100) AS DOUBLE) AS gtd,
        CAST(round(CAST(amount AS DECIMAL(18,2)) + 5 * (1 + k % 20), 2) AS DOUBLE) AS collected
    FROM src
),
t AS (
    SELECT *, CAST(level_reject * mtt_blind_up_time_sec AS INT) AS late_registration_time,
        CASE WHEN has_rebuy THEN mtt_customer_buy_in ELSE 0 END AS mtt_customer_rebuy,
        CASE WHEN has_addon THEN 2 * mtt_customer_buy_in ELSE 0 END AS mtt_customer_addon,
        CAST(CAST(collected AS DECIMAL(18,2)) - CAST(gtd AS DECIMAL(18,2)) AS DOUBLE) AS mtt_result,
        least(CAST(CAST(collected AS DECIMAL(18,2)) - CAST(gtd AS DECIMAL(18,2)) AS DOUBLE), 0) AS overlay,
        collected < gtd AS has_overlay,
        round((CAST(collected AS DECIMAL(18,2)) - CAST(gtd AS DECIMAL(18,2))) / mtt_customer_buy_in, 6)
            AS normalized_mtt_result,
        round(collected / mtt_customer_buy_in, 6) AS normalized_collected,
        round(gtd / mtt_customer_buy_in, 6) AS buyin_gtd_rate
    FROM first
)"""


T = _tournaments(
    f"""SELECT event_id AS match_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, {KIND} AS kind,
        user_id AS g, CAST(json_extract_string(props, '$.k') AS INT) AS k, value AS amount FROM events"""
)
YEARLY = _tournaments(
    """SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS day, o_custkey % 24 AS hour,
        'MTT-NLH' AS kind, o_custkey AS g, o_orderkey % 100 AS k, o_totalprice % 500 AS amount FROM orders"""
)
SCORED = f"""{T},
s AS (
    SELECT *, CAST(CAST(collected AS DECIMAL(18,2)) + (match_id * 7) % 61 - 30 AS DOUBLE) AS prediction,
        CAST(CAST(collected AS DECIMAL(18,2)) + (match_id * 7) % 61 - 30 AS DOUBLE) - gtd AS result_pred,
        CAST(CAST(collected AS DECIMAL(18,2)) + (match_id * 7) % 61 - 30 AS DOUBLE) - gtd < 0 AS has_overlay_pred
    FROM t
)"""

SLOTS = """slot AS (
    SELECT start_date_local AS d, start_hour_local AS h, count(*) AS n
    FROM t WHERE match_type_detail_name = 'MTT-NLH' AND class_match IN ('Micro', 'Low')
    GROUP BY 1, 2
),
band AS (
    SELECT a.d, a.h, a.n, CAST(sum(b.n) AS BIGINT) AS near
    FROM slot a LEFT JOIN slot b ON b.d = a.d AND abs(b.h - a.h) <= 1
    GROUP BY 1, 2, 3
)"""

EXTRACT_COLUMNS = """match_id, start_date_local, start_hour_local, day_of_week_local, ko_type,
    mtt_pool_allocation_description, CAST(level_reject AS INT) AS level_reject, estrutura_blinds,
    mtt_blind_up_time_sec, late_registration_time, earlybird, has_rebuy, has_addon,
    mtt_customer_buy_in, mtt_customer_rebuy, mtt_customer_addon, gtd, has_overlay, overlay,
    mtt_result, collected, normalized_mtt_result, normalized_collected, buyin_gtd_rate,
    n AS same_hour_game, near AS one_hour_window_game"""

EXTRACT = f"""{T}, {SLOTS},
x AS (
    SELECT {EXTRACT_COLUMNS} FROM t LEFT JOIN band ON d = start_date_local AND h = start_hour_local
    WHERE match_type_detail_name = 'MTT-NLH' AND class_match IN ('Micro', 'Low')
      AND start_date_local BETWEEN DATE '2023-01-01' AND DATE '2024-12-31'
)"""

PRODUCTS = f"""p AS (
    SELECT event_id AS id_match, {KIND} AS kind, {_pick('user_id % 4', *CLASS)} AS class_match,
        CAST(user_id + 2 AS INT) AS total_players, ts,
        CAST((k % 10) * 25.5 AS DOUBLE) AS gtd, CAST(value AS DECIMAL(18,6)) AS v,
        CAST(CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN -(k * 1.25)
             WHEN event_id % 3 = 1 THEN 0 ELSE k * 0.5 END AS DOUBLE) AS overlay,
        '00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':00' AS duration,
        CASE WHEN user_id % 2 = 0 THEN 113 ELSE 7 END AS grand_union,
        {_pick('event_id % 8', 'HG', 'LIVE', 'PVD', 'PVT', 'CLASS', 'OPEN', 'MAIN')} AS name_match
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
),
ds AS (
    SELECT DISTINCT l_orderkey AS id,
        CAST(CASE l_returnflag WHEN 'A' THEN 5.5 WHEN 'N' THEN 11 ELSE 22 END AS DOUBLE) AS price,
        CAST(CASE l_linestatus WHEN 'F' THEN 0 ELSE 11 END AS DOUBLE) AS rebuy
    FROM lineitem
)"""


def _priced(where: str, start: bool) -> str:
    days = "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"
    return f"""WITH {PRODUCTS}
SELECT DISTINCT id_match, kind AS match_type_detail_name, class_match, total_players,
    price AS buyin_price, rebuy AS rebuy_price, price AS addon_price,
    {'ts AS date_start_time_match_utc_local,' if start else ''}
    {_pick('dayofweek(ts)', *days)} AS day_of_week,
    CASE hour(ts) // 6 WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon' WHEN 3 THEN 'evening'
         ELSE 'dawn' END AS period,
    CAST(round(CAST(gtd AS DECIMAL(18,6))) AS INT) AS gtd_match,
    CAST(round(v, 2) AS DOUBLE) AS buyin_earned,
    CAST(round(CAST(v / 2 AS DECIMAL(18,6)), 2) AS DOUBLE) AS rebuy_earned,
    CAST(round(CAST(v / 3 AS DECIMAL(18,6)), 2) AS DOUBLE) AS addon_earned,
    overlay AS overlay_match,
    CASE WHEN gtd <> 0 THEN abs(overlay / gtd * 100) ELSE 0 END AS overlay_perc,
    CASE WHEN overlay < 0 THEN 0 WHEN overlay = 0 THEN 1 ELSE overlay END AS overlay_match_bi,
    duration AS duration_match
FROM p JOIN ds ON id = id_match
WHERE duration > '00:05:00' AND {where}"""


SAME = "kind LIKE 'MTT-PLO5%' AND class_match = 'Low' AND dayofweek(ts) = 5 AND hour(ts) BETWEEN 6 AND 11"

CONSTRAINED = """start_hour_local, day_of_week_local, ko_type, mtt_pool_allocation_description,
    estrutura_blinds, mtt_blind_up_time_sec AS time_blind_match_mtt, earlybird, has_rebuy, has_addon,
    mtt_customer_buy_in, mtt_customer_rebuy, mtt_customer_addon, gtd, has_overlay, overlay,
    mtt_result, collected, gtd / mtt_customer_buy_in AS buyin_gtd_rate"""
COMPUTED = """mtt_result / mtt_customer_buy_in AS normalized_result,
    collected / mtt_customer_buy_in AS normalized_collected"""
STORED = "normalized_mtt_result AS normalized_result, normalized_collected"
CATEGORIES = (
    "start_hour_local", "day_of_week_local", "ko_type", "mtt_pool_allocation_description",
    "estrutura_blinds",
)


def _vocabulary(source: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS col, CAST({c} AS VARCHAR) AS value, "
        + (f"CAST({c} AS DOUBLE)" if c == "start_hour_local" else "CAST(NULL AS DOUBLE)")
        + f" AS num FROM {source}"
        for c in CATEGORIES
    )
    return f"""SELECT col AS "column", value,
        CAST(row_number() OVER (PARTITION BY col ORDER BY num, value) - 1 AS INT) AS position,
        col || '_' || value AS feature_name FROM ({parts})"""


# The values that occur in the extract, by column.
EXTRACT_VALUES = {
    "start_hour_local": [str(h) for h in range(24)],
    "day_of_week_local": FORM_VOCABULARY["day_of_week_local"],
    "ko_type": FORM_VOCABULARY["ko_type"],
    "mtt_pool_allocation_description": ["-", "10%", "15% Flat", "20%"],
    "estrutura_blinds": ["Hyper", "Standard - no ante", "Turbo"],
}


def _flags(values: dict[str, list[str]]) -> str:
    return ", ".join(
        f"CASE WHEN CAST({c} AS VARCHAR) = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{c}_{v}\""
        for c, vs in values.items()
        for v in vs
    )


PARTIAL = {"ko_type": ["KO", "Regular"], "estrutura_blinds": ["Hyper", "Turbo - no ante"]}


FORMS = f"""f AS (
    SELECT event_id AS scenario_id, CAST(ts AS DATE) AS day, k % 27 - 0.5 AS hour,
        {_pick('k % 8', *DAYS, 'Feriado')} AS day_of_week_local,
        {_pick('user_id % 4', 'KO', 'Mystery Bounty', 'Progressive KO', 'Regular')} AS ko_type,
        {_pick('event_id % 8', *FORM_VOCABULARY['mtt_pool_allocation_description'])} AS mtt_pool_allocation_description,
        {_pick('event_id % 5', *FORM_VOCABULARY['estrutura_blinds'])} AS estrutura_blinds,
        CAST(k % 12 + 1 AS DOUBLE) AS level_reject,
        CAST(60 * (user_id % 10 + 1) AS DOUBLE) AS mtt_blind_up_time_sec,
        CAST((k % 3) / 10.0 AS DOUBLE) AS earlybird, k % 2 = 0 AS has_rebuy, user_id % 3 = 0 AS has_addon,
        CAST(k % 20 AS DOUBLE) AS buy_in, CAST(20 + 2 * (user_id % 100) AS DOUBLE) AS gtd
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""


def _form() -> str:
    def text(value: str) -> str:
        return f"coalesce({value}, false)"

    flags = [f'{text(f"floor(hour) = {h}")} AS start_hour_local_{h}' for h in range(24)]
    flags += [
        f"""{text(f"{c} = '{v}'")} AS "{c}_{v}\""""
        for c, vs in FORM_VOCABULARY.items()
        if c != "start_hour_local"
        for v in vs
    ]
    return f"""WITH {T}, {SLOTS}, {FORMS},
g AS (
    SELECT scenario_id, CAST(coalesce(sum(n) FILTER (WHERE h = floor(hour)), 0) AS BIGINT) AS own,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS near
    FROM f LEFT JOIN slot ON d = day AND abs(h - floor(hour)) <= 1 AND floor(hour) BETWEEN 0 AND 23
    GROUP BY 1
)
SELECT f.scenario_id, level_reject, mtt_blind_up_time_sec,
    level_reject * mtt_blind_up_time_sec AS late_registration_time, earlybird, has_rebuy, has_addon,
    buy_in AS mtt_customer_buy_in, buy_in AS mtt_customer_rebuy, 2 * buy_in AS mtt_customer_addon, gtd,
    gtd / nullif(buy_in, 0) AS buyin_gtd_rate, own AS same_hour_game, near AS one_hour_window_game,
    {', '.join(flags)}
FROM f JOIN g ON g.scenario_id = f.scenario_id"""


SCHEDULE = """steps AS (
    SELECT 0 AS i, DATE '1996-01-30' AS v
    UNION ALL
    SELECT i + 1, CAST(v + INTERVAL 1 MONTH AS DATE) FROM steps
    WHERE CAST(v + INTERVAL 1 MONTH AS DATE) <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)
),
w AS (
    SELECT CAST(i AS INT) AS window_id, CAST(v - INTERVAL 11 MONTH AS DATE) AS train_start,
        CAST(v - INTERVAL 1 DAY AS DATE) AS train_end, v AS valid_start,
        CAST(v + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS valid_end
    FROM steps
)"""

REPORT = """n AS (SELECT
    count(*) FILTER (WHERE a = 0) AS s0, count(*) FILTER (WHERE a = 1) AS s1,
    count(*) FILTER (WHERE p = 0) AS c0, count(*) FILTER (WHERE p = 1) AS c1,
    count(*) FILTER (WHERE a = 0 AND p = 0) AS h0, count(*) FILTER (WHERE a = 1 AND p = 1) AS h1
    FROM ap),
m AS (SELECT s0, s1, h0, h1,
    coalesce(h0 / nullif(c0, 0), 0) AS p0, coalesce(h1 / nullif(c1, 0), 0) AS p1,
    coalesce(h0 / nullif(s0, 0), 0) AS r0, coalesce(h1 / nullif(s1, 0), 0) AS r1,
    coalesce(2 * h0 / nullif(s0 + c0, 0), 0) AS f0, coalesce(2 * h1 / nullif(s1 + c1, 0), 0) AS f1 FROM n)
SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM (
    SELECT '0' AS label, p0 AS "precision", r0 AS recall, f0 AS f1, s0 AS support FROM m
    UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
    UNION ALL SELECT 'accuracy', NULL, NULL, (h0 + h1) / (s0 + s1), s0 + s1 FROM m
    UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m
    UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
        (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m
)"""


def _box(series: str, value: str, source: str) -> str:
    return f"""SELECT '{series}' AS series, round(avg(e), 6) AS mean, round(any_value(q[2]), 6) AS median,
    round(any_value(q[1]), 6) AS q1, round(any_value(q[3]), 6) AS q3,
    round(least(min(e) FILTER (WHERE e >= q[1] - 1.5 * (q[3] - q[1])), any_value(q[1])), 6) AS whisker_low,
    round(greatest(max(e) FILTER (WHERE e <= q[3] + 1.5 * (q[3] - q[1])), any_value(q[3])), 6) AS whisker_high
FROM (SELECT {value} AS e FROM {source}),
     (SELECT quantile_cont({value}, [0.25, 0.5, 0.75]) AS q FROM {source})"""


ERROR_COLUMNS = """abs(collected - prediction) AS absolute_difference,
    (collected - prediction) * (collected - prediction) AS squared_difference,
    (collected - prediction) / nullif(collected, 0) * 100 AS error_percentage,
    abs((collected - prediction) / nullif(collected, 0) * 100) AS absolute_error_percentage"""
SCALED = f"""{SCORED},
e AS (SELECT match_id, {ERROR_COLUMNS} FROM s),
z AS (
    SELECT *, 100.0 * (absolute_error_percentage - lo) / nullif(hi - lo, 0) AS normalised_error
    FROM e, (SELECT min(absolute_error_percentage) AS lo, max(absolute_error_percentage) AS hi FROM e)
)"""
FOLD = "CAST(CAST(concat('0x', substr(md5('42:' || {id}), 1, 8)) AS BIGINT) % {k} AS INT)"
FOLDS = f"""{SCORED},
k AS (
    SELECT *, {FOLD.format(id='match_id', k=10)} AS fold, has_overlay::INT AS a, has_overlay_pred::INT AS p FROM s
),
per AS (
    SELECT fold, avg(abs(collected - prediction)) AS mae,
        avg((collected - prediction) * (collected - prediction)) AS mse,
        coalesce(2 * count(*) FILTER (WHERE a = 0 AND p = 0)
            / nullif(count(*) FILTER (WHERE a = 0) + count(*) FILTER (WHERE p = 0), 0), 0) AS f1
    FROM k GROUP BY fold
)"""


TRAINED = """tr AS (SELECT * FROM t WHERE match_type_detail_name = 'MTT-NLH')"""
LONG_WINDOWS = """steps AS (
    SELECT 0 AS i, CAST(min(CAST(o_orderdate AS DATE)) + INTERVAL 33 MONTH AS DATE) AS v FROM orders
    UNION ALL
    SELECT i + 1, CAST(v + INTERVAL 12 MONTH AS DATE) FROM steps
    WHERE CAST(v + INTERVAL 12 MONTH AS DATE) < (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)
),
w AS (
    SELECT CAST(i AS INT) AS window_id, v AS valid_start,
        CAST(v + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS valid_end,
        CAST(CAST(v - INTERVAL 33 MONTH AS DATE) AS VARCHAR) || '_to_'
            || CAST(CAST(v + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS period
    FROM steps
)"""
# The same schedule from the first month that has 11 before it.
MONTHLY = SCHEDULE.replace(
    "DATE '1996-01-30' AS v", "CAST(min(CAST(o_orderdate AS DATE)) + INTERVAL 11 MONTH AS DATE) AS v FROM orders"
)
NUMBERS = (
    "level_reject", "mtt_blind_up_time_sec", "late_registration_time", "earlybird", "has_rebuy",
    "has_addon", "mtt_customer_buy_in", "mtt_customer_rebuy", "mtt_customer_addon", "gtd",
    "buyin_gtd_rate", "same_hour_game", "one_hour_window_game",
)


def _draw(name: str, low: float, high: float, whole: bool = False, i: str = "i", log: bool = False) -> str:
    u = f"CAST(concat('0x', substr(md5('42:' || {i} || ':{name}'), 1, 13)) AS BIGINT) / pow(16, 13)"
    if log:
        return f"round(exp(ln({low}) + {u} * (ln({high}) - ln({low}))), 6) AS {name}"
    value = f"floor({low} + {u} * ({high} - {low} + 1))" if whole else f"{low} + {u} * ({high} - {low})"
    return f"round(CAST({value} AS DOUBLE), 6) AS {name}"


LARGE = (
    ("n_estimators", 50, 200, True, False),
    ("max_depth", 3, 20, True, False),
    ("learning_rate", 0.01, 0.8, False, False),
    ("subsample", 0.5, 1.0, False, False),
    ("colsample_bytree", 0.5, 1.0, False, False),
    ("gamma", 0.0, 5.0, False, False),
    ("min_child_weight", 1, 10, True, False),
    ("reg_alpha", 1e-5, 10.0, False, True),
    ("reg_lambda", 1e-5, 10.0, False, True),
)


def statements() -> dict[str, str]:
    extract = f"WITH {EXTRACT} SELECT * FROM x"
    classifier = _priced(
        "kind LIKE 'MTT%' AND v > 0 AND grand_union = 113 "
        "AND name_match NOT IN ('HG', 'LIVE', 'PVD', 'PVT', 'CLASS')",
        start=False,
    )
    return {
        "regressor_extract": extract,
        "regressor_extract_selfjoin": extract,
        "regressor_extract_sql": extract,
        "hour_slot_counts": f"""WITH {T}, {SLOTS}
            SELECT d AS start_date_local, h AS start_hour_local, n AS same_hour_game FROM slot""",
        "hour_band_counts": f"""WITH {T}, {SLOTS}
            SELECT d AS start_date_local, h AS start_hour_local, n AS same_hour_game,
                near AS one_hour_window_game FROM band""",
        "classifier_extract": classifier,
        "exact_matches": _priced(f"{SAME} AND price = 5.5 AND rebuy = 0 AND gtd = 153", start=True),
        "similar_matches": _priced(
            f"{SAME} AND price BETWEEN 1 AND 25 AND rebuy BETWEEN 0 AND 15 AND gtd BETWEEN 1 AND 200",
            start=True,
        ),
        "constrained_extract_a": f"""WITH {T} SELECT match_id, level_reject, {CONSTRAINED}, {STORED} FROM t
            WHERE match_type_detail_name = 'MTT-NLH' AND class_match IN ('Micro', 'Low')
              AND gtd BETWEEN 30 AND 58000 AND gtd / nullif(mtt_customer_buy_in, 0) BETWEEN 33 AND 7833
              AND start_date_local <= DATE '2024-10-19'""",
        "constrained_extract_b": f"""WITH {T} SELECT match_id, {CONSTRAINED}, {COMPUTED} FROM t
            WHERE match_type_detail_name = 'MTT-NLH' AND mtt_customer_buy_in > 0""",
        "constrained_extract_c": f"""WITH {T} SELECT match_id, level_reject, {CONSTRAINED}, {COMPUTED} FROM t
            WHERE match_type_detail_name = 'MTT-NLH' AND mtt_customer_buy_in > 0
              AND gtd BETWEEN 30 AND 58000 AND gtd / mtt_customer_buy_in BETWEEN 33 AND 1593""",
        "csv_round_trip": f"""WITH {SCORED} SELECT match_id, start_date_local, ko_type, gtd, collected,
            prediction, result_pred, has_overlay_pred FROM s""",
        "scenario_features": _form(),
        "onehot_vocabulary": f"WITH {T} {_vocabulary('t')}",
        "onehot_strict": f"WITH {EXTRACT} SELECT match_id, gtd, {_flags(EXTRACT_VALUES)} FROM x",
        "onehot_lenient": f"""WITH {EXTRACT} SELECT match_id, start_hour_local, day_of_week_local,
            mtt_pool_allocation_description, gtd, {_flags(PARTIAL)} FROM x""",
        "aligned_features": f"""WITH {EXTRACT} SELECT match_id, {_flags({'ko_type': ['Regular']})},
            0.0::DOUBLE AS "ko_type_Satellite", {_flags({'ko_type': ['KO']})}, gtd FROM x""",
        "feature_label_split": f"""WITH {EXTRACT} SELECT * EXCLUDE (start_date_local, has_overlay, overlay,
            mtt_result, collected, normalized_mtt_result, normalized_collected), collected AS label FROM x""",
        "kfold_contiguous": f"""WITH {T} SELECT match_id, collected,
            CAST(ntile(10) OVER (ORDER BY match_id) - 1 AS INT) AS fold FROM t""",
        "kfold_shuffled": f"""WITH {T} SELECT match_id, collected,
            CAST(ntile(7) OVER (ORDER BY md5('42:' || match_id)) - 1 AS INT) AS fold FROM t""",
        "kfold_hashed": f"""WITH {T} SELECT match_id, collected, {FOLD.format(id='match_id', k=10)} AS fold FROM t""",
        "rolling_schedule": f"""WITH RECURSIVE {SCHEDULE}, o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
            SELECT *, CAST(train_start AS VARCHAR) || '_to_' || CAST(valid_end AS VARCHAR) AS label,
                (SELECT count(*) FROM o WHERE d BETWEEN train_start AND train_end) AS train_rows,
                (SELECT count(*) FROM o WHERE d BETWEEN valid_start AND valid_end) AS valid_rows FROM w""",
        "rolling_assignment": f"""WITH RECURSIVE {SCHEDULE},
            o AS (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS start_date_local FROM orders)
            SELECT match_id, start_date_local, window_id, 'train' AS role FROM o, w
            WHERE start_date_local BETWEEN train_start AND train_end
            UNION ALL SELECT match_id, start_date_local, window_id, 'valid' FROM o, w
            WHERE start_date_local BETWEEN valid_start AND valid_end""",
        "score_flags": f"""WITH {SCORED} SELECT match_id, gtd, mtt_result, prediction,
            round(result_pred, 6) AS result_pred, has_overlay_pred,
            round(abs(collected - prediction), 6) AS abs_error_collected,
            round(abs(mtt_result - result_pred), 6) AS abs_error_result,
            CASE WHEN has_overlay_pred THEN 'PREVISÃO DE PREJUIZO' ELSE 'PREVISÃO DE LUCRO' END
                AS outcome_text FROM s""",
        "kept_tournaments": f"WITH {SCORED} SELECT match_id, mtt_result FROM s WHERE NOT has_overlay_pred",
        "caught_overlays": f"""WITH {SCORED} SELECT match_id, mtt_result FROM s
            WHERE has_overlay AND has_overlay_pred""",
        "daily_result_gap": f"""WITH {SCORED},
            a AS (SELECT start_date_local AS d, sum(mtt_result) AS x FROM s GROUP BY 1),
            b AS (SELECT start_date_local AS d, sum(mtt_result) AS y FROM s WHERE NOT has_overlay_pred GROUP BY 1)
            SELECT a.d AS start_date_local, round(x, 2) AS actual_result, round(y, 2) AS predicted_result,
                round(x - y, 2) AS dif FROM a LEFT JOIN b ON b.d = a.d""",
        "daily_result_gap_total": f"""WITH {SCORED},
            a AS (SELECT start_date_local AS d, sum(mtt_result) AS x FROM s GROUP BY 1),
            b AS (SELECT start_date_local AS d, sum(mtt_result) AS y FROM s WHERE NOT has_overlay_pred GROUP BY 1)
            SELECT round(coalesce(sum(x - y), 0), 2) AS dif_total FROM a LEFT JOIN b ON b.d = a.d""",
        "daily_profit_breakdown": f"""WITH {SCORED},
            a AS (SELECT start_date_local AS d,
                coalesce(sum(mtt_result) FILTER (WHERE has_overlay), 0) AS oa,
                coalesce(sum(mtt_result) FILTER (WHERE has_overlay AND has_overlay_pred), 0) AS op,
                coalesce(sum(mtt_result) FILTER (WHERE NOT has_overlay), 0) AS pa,
                coalesce(sum(mtt_result) FILTER (WHERE NOT has_overlay AND NOT has_overlay_pred), 0) AS pp
                FROM s GROUP BY 1),
            b AS (SELECT start_date_local AS d, sum(mtt_result) AS y FROM s WHERE NOT has_overlay_pred GROUP BY 1)
            SELECT a.d AS start_date_local, round(oa, 2) AS total_overlay_actual,
                round(op, 2) AS total_overlay_pred, round(pa, 2) AS profit_actual, round(pp, 2) AS profit_pred,
                round(oa - op, 2) AS dif_overlay, round(pa - pp, 2) AS dif_profit,
                round(y, 2) AS profit_dif_total FROM a LEFT JOIN b ON b.d = a.d""",
        "confusion_matrix": f"""WITH {SCORED}, l AS (SELECT unnest([0, 1]) AS v)
            SELECT a.v AS actual, p.v AS predicted, count(s.match_id) AS rows
            FROM l a CROSS JOIN l p LEFT JOIN s ON s.has_overlay::INT = a.v AND s.has_overlay_pred::INT = p.v
            GROUP BY 1, 2""",
        "classification_report": f"""WITH {SCORED},
            ap AS (SELECT has_overlay::INT AS a, has_overlay_pred::INT AS p FROM s), {REPORT}""",
        "label_report": f"WITH ap AS (SELECT quality AS a, toxic AS p FROM labels), {REPORT}",
        "error_table": f"""WITH {SCORED} SELECT match_id, collected, prediction,
            round(COLUMNS(* EXCLUDE (match_id, collected, prediction)), 6) FROM (
                SELECT match_id, collected, prediction, {ERROR_COLUMNS} FROM s)""",
        "error_summary": f"""WITH {SCORED} {_box('collected', 'abs(collected - prediction)', 's')}
            UNION ALL {_box('mtt_result', 'abs(mtt_result - result_pred)', 's')}""",
        "value_boxplot": _box("value", "value", "events"),
        "normalised_error": f"""WITH {SCALED} SELECT match_id,
            round(absolute_error_percentage, 6) AS absolute_error_percentage,
            round(normalised_error, 6) AS normalised_error FROM z""",
        "normalised_error_summary": f"""WITH {SCALED} SELECT
            round(avg(absolute_difference), 6) AS mean_abs_error,
            round(median(absolute_difference), 6) AS median_abs_error,
            round(avg(normalised_error), 6) AS mean_normalised_error,
            round(median(normalised_error), 6) AS median_normalised_error FROM z""",
        "fold_metrics": f"""WITH {FOLDS} SELECT fold, round(mae, 6) AS mae, round(mse, 6) AS mse,
            round(f1, 6) AS f1 FROM per""",
        "cv_objectives": f"""WITH {FOLDS} SELECT round(avg(mae), 6) AS mean_mae, round(avg(mse), 6) AS mean_mse,
            round(avg(f1), 6) AS mean_f1,
            (SELECT round(1 - sum((collected - prediction) ** 2) / (var_pop(collected) * count(*)), 6) FROM k)
                AS pooled_r2,
            (SELECT round(median(abs(collected - prediction)), 6) FROM k) AS pooled_median_ae FROM per""",
        "chart_long": f"""WITH {SCORED} SELECT match_id, 'collected' AS series, collected AS value FROM s
            UNION ALL SELECT match_id, 'prediction', prediction FROM s""",
        "importance_ranked": f"""WITH {T}, u AS (
            SELECT 'ko_type_' || ko_type AS f FROM t UNION ALL SELECT 'class_match_' || class_match FROM t
            UNION ALL SELECT 'estrutura_blinds_' || estrutura_blinds FROM t)
            SELECT f AS "Feature Importance", count(*) / (SELECT count(*) FROM t) AS "Value"
            FROM u GROUP BY f ORDER BY 2 DESC, 1""",
        "best_trial": f"""WITH {SCORED} SELECT start_hour_local AS trial_id,
            round(avg(abs(collected - prediction)), 6) AS score FROM s GROUP BY 1 ORDER BY 2, 1 LIMIT 1""",
        "smote_class_counts": """WITH c AS (SELECT count(*) FILTER (WHERE label = 0) AS few,
                count(*) FILTER (WHERE label <> 0) AS many FROM embeddings)
            SELECT 1.0::DOUBLE AS label, false AS synthetic, few AS rows FROM c
            UNION ALL SELECT 0.0, false, many FROM c
            UNION ALL SELECT CASE WHEN few < many THEN 1.0 ELSE 0.0 END, true, abs(many - few) FROM c
                WHERE few <> many""",
        "nearest_neighbours": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance
                FROM e a JOIN e b ON a.vec_id <> b.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS n FROM d)
            SELECT vec_id, CAST(n - 1 AS INT) AS place, neighbour, round(distance, 6) AS distance
            FROM r WHERE n <= 5""",
        "score_consistency": f"""WITH {T}, {TRAINED} SELECT match_id, gtd, collected,
            true AS same_after_reload, true AS result_follows, true AS flag_follows FROM tr""",
        "classifier_consistency": f"""SELECT id_match, overlay_match_bi, true AS is_class, true AS text_follows
            FROM ({classifier})""",
        "importance_features": f"""WITH {T}, {TRAINED} SELECT feature_name AS feature, 1.0::DOUBLE AS total
            FROM ({_vocabulary('tr')}) UNION ALL SELECT unnest({list(NUMBERS)}), 1.0""",
        "cv_oof_rows": f"""WITH {T}, {TRAINED} SELECT match_id, {FOLD.format(id='match_id', k=3)} AS fold,
            collected AS actual FROM tr""",
        "cv_oof_ten_rows": f"""WITH {T}, {TRAINED} SELECT match_id, {FOLD.format(id='match_id', k=10)} AS fold,
            collected AS actual FROM tr""",
        "temporal_cv_monthly_rows": f"""WITH RECURSIVE {YEARLY}, {MONTHLY}
            SELECT window_id, match_id, start_date_local, collected AS actual FROM t, w
            WHERE start_date_local BETWEEN valid_start AND valid_end""",
        "temporal_cv_rows": f"""WITH RECURSIVE {YEARLY}, {LONG_WINDOWS}
            SELECT window_id, match_id, start_date_local, collected AS actual FROM t, w
            WHERE start_date_local BETWEEN valid_start AND valid_end""",
        "window_tuning_rows": f"""WITH RECURSIVE {YEARLY}, {LONG_WINDOWS}
            SELECT window_id, period, match_id, collected AS actual FROM t, w
            WHERE start_date_local BETWEEN valid_start AND valid_end""",
        "search_trials": f"""SELECT i AS trial_id, {_draw('n_estimators', 2, 4, True)},
            {_draw('max_depth', 2, 3, True)}, {_draw('learning_rate', 0.1, 0.5)},
            {_draw('subsample', 0.5, 1.0)}, {_draw('colsample_bytree', 0.5, 1.0)}, true AS is_scored
            FROM range(3) r(i)""",
        "staged_search": f"""SELECT i AS trial_id, {_draw('n_estimators', 2, 4, True)},
            {_draw('max_depth', 2, 3, True, 'i // 5')}, {_draw('learning_rate', 0.1, 0.5, i='i // 5')},
            {_draw('subsample', 0.5, 1.0, i='i // 5')}, {_draw('colsample_bytree', 0.5, 1.0, i='i // 5')},
            true AS is_scored FROM range(40) r(i)""",
        "large_space_draws": f"""SELECT c_custkey AS trial_id, {', '.join(
            _draw(name, low, high, whole, 'c_custkey', log) for name, low, high, whole, log in LARGE
        )} FROM customer""",
    }
