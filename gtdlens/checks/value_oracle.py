"""Independent SQL for the value queries: trees of one split by aggregation, lookups by plain joins."""

from __future__ import annotations

from gtdlens.checks.oracle import (
    CATEGORIES, EXTRACT_COLUMNS, FOLD, FORMS, PRODUCTS, REPORT, SAME, SCORED, SLOTS, T, YEARLY, _pick, _priced,
)

ODD = f"""{T},
o AS (SELECT * REPLACE (CAST(CASE WHEN match_id % 97 = 0 THEN -1 WHEN match_id % 89 = 0 THEN 24
    WHEN match_id % 83 = 0 THEN NULL ELSE start_hour_local END AS INT) AS start_hour_local) FROM t),
{SLOTS.replace("FROM t WHERE", "FROM o WHERE")}"""


def _odd(period: str) -> str:
    return f"""WITH {ODD} SELECT {EXTRACT_COLUMNS} FROM o
        LEFT JOIN band ON d = start_date_local AND h = start_hour_local
        WHERE match_type_detail_name = 'MTT-NLH' AND class_match IN ('Micro', 'Low'){period}"""


MONTH = f"{T}, r AS (SELECT match_id, collected, gtd, {', '.join(CATEGORIES)} FROM t WHERE match_type_detail_name = 'MTT-NLH')"


def _split(columns, rows: str, train: str, label: str, groups: str = "0") -> str:
    """CTEs ``best(g, col, value, yes, no)``: for each training group the flag with the least variance left.

    ``train`` holds (g, row columns); a flag is a (column, value) pair.
    """
    long = " UNION ALL ".join(
        f"SELECT g, {i} AS place, '{c}' AS col, CAST({c} AS VARCHAR) AS value, {label} AS y FROM {train}"
        for i, c in enumerate(columns)
    )
    return f"""flag AS (SELECT g, place, col, value, count(*) AS n1, sum(y) AS s1 FROM ({long}) GROUP BY ALL),
whole AS (SELECT g, count(*) AS n, sum({label}) AS s FROM {train} GROUP BY g),
gain AS (
    SELECT g, place, col, value, s1 / n1 AS yes, (s - s1) / (n - n1) AS no,
        s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) AS left_over
    FROM flag JOIN whole USING (g) WHERE n > n1
),
best AS (
    SELECT * FROM gain QUALIFY row_number() OVER (PARTITION BY g ORDER BY left_over DESC, place, value) = 1
)"""


def _hit(columns, row: str = "r") -> str:
    return "CASE col " + " ".join(f"WHEN '{c}' THEN CAST({row}.{c} AS VARCHAR)" for c in columns) + " END = value"


REGRESSOR = _split(CATEGORIES, "r", "train", "collected")
PREDICTED = f"CASE WHEN {_hit(CATEGORIES)} THEN yes ELSE no END"
ALL_ROWS = f"{MONTH}, train AS (SELECT 0 AS g, * FROM r), {REGRESSOR}"


def _folds(k: int) -> str:
    fold = FOLD.format(id="match_id", k=k)
    return f"""{MONTH}, k AS (SELECT *, {fold} AS fold FROM r), f AS (SELECT DISTINCT fold AS g FROM k),
train AS (SELECT g, k.* FROM k JOIN f ON fold <> g), {REGRESSOR},
oof AS (SELECT match_id, fold, collected, {PREDICTED.replace("r.", "k.")} AS prediction FROM k JOIN best ON g = fold)"""


CLASSIFIED = ("match_type_detail_name", "class_match", "day_of_week", "period")
EXTRACTED = _priced(
    "kind LIKE 'MTT%' AND v > 0 AND grand_union = 113 "
    "AND name_match NOT IN ('HG', 'LIVE', 'PVD', 'PVT', 'CLASS')",
    start=False,
)

CLASS_FOLDS = f"""r AS ({EXTRACTED}),
k AS (SELECT *, {FOLD.format(id="id_match", k=5)} AS fold FROM r WHERE overlay_match_bi IN (0, 1)),
f AS (SELECT DISTINCT fold AS g FROM k),
train AS (SELECT g, k.* FROM k JOIN f ON fold <> g),
{_split(CLASSIFIED, "k", "train", "(2 * overlay_match_bi - 1)")},
oof AS (
    SELECT id_match, buyin_price, rebuy_price, fold, overlay_match_bi::DOUBLE AS actual,
        CASE WHEN CASE WHEN {_hit(CLASSIFIED, "k")} THEN yes ELSE no END > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction
    FROM k JOIN best ON g = fold
)"""

WINDOWS = """span AS (SELECT min(start_date_local) AS lo, max(start_date_local) AS hi FROM t),
steps AS (
    SELECT 0 AS i, CAST(lo + INTERVAL 11 MONTH AS DATE) AS v FROM span
    UNION ALL
    SELECT i + 1, CAST(v + INTERVAL 1 MONTH AS DATE) FROM steps, span WHERE CAST(v + INTERVAL 1 MONTH AS DATE) <= hi
),
w AS (
    SELECT CAST(i AS INT) AS g, CAST(v - INTERVAL 11 MONTH AS DATE) AS ts, CAST(v - INTERVAL 1 DAY AS DATE) AS te,
        v AS vs, CAST(v + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS ve FROM steps
)"""


def _windowed(keep: str) -> str:
    return f"""{YEARLY}, {WINDOWS}, r AS (SELECT match_id, start_date_local, collected, {', '.join(c for c in CATEGORIES)} FROM t),
train AS (SELECT g, r.* FROM r JOIN w ON start_date_local BETWEEN ts AND te WHERE {keep}),
{REGRESSOR},
scored AS (
    SELECT g, ts, ve, match_id, collected, {PREDICTED} AS prediction
    FROM r JOIN w ON start_date_local BETWEEN vs AND ve JOIN best USING (g) WHERE {keep}
)"""


def _batch(slack: str) -> str:
    days = "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"
    price = _pick("c_custkey % 3", "5.5", "11", "22")
    return f"""WITH {PRODUCTS},
wanted AS (
    SELECT c_custkey AS scenario_id, CASE WHEN c_custkey % 3 = 0 THEN 'MTT-PLO5' ELSE 'MTT' END AS type,
        {_pick('c_custkey % 4', 'Micro', 'Low', 'Medium', 'High')} AS class,
        {_pick('(c_custkey // 4) % 7', *days)} AS day, CAST({price} AS DOUBLE) AS paid,
        {_pick('(c_custkey // 28) % 4', 'dawn', 'morning', 'afternoon', 'evening')} AS part,
        CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 11 END AS again, (c_custkey % 10) * 25.5 AS promised
    FROM customer
),
q AS (
    SELECT *, {_pick('dayofweek(ts)', *days)} AS day, CASE hour(ts) // 6 WHEN 1 THEN 'morning'
        WHEN 2 THEN 'afternoon' WHEN 3 THEN 'evening' ELSE 'dawn' END AS part
    FROM p WHERE duration > '00:05:00'
)
SELECT scenario_id, id_match, price AS buyin_price, CAST(rebuy AS DOUBLE) AS rebuy_price,
    CAST(round(CAST(gtd AS DECIMAL(18,6))) AS INT) AS gtd_match, q.day AS day_of_week, q.part AS period
FROM wanted JOIN q ON class_match = class AND q.day = wanted.day AND q.part = wanted.part AND starts_with(kind, type)
JOIN ds ON id = id_match
WHERE {slack}"""


def statements() -> dict[str, str]:
    gap = f"""{SCORED}, m AS (SELECT * FROM s WHERE match_id % 50 <> 0)"""
    return {
        "odd_hours_short_period": _odd(" AND start_date_local BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
        "odd_hours_long_period": _odd(""),
        "odd_hours_open_period": _odd(""),
        "daily_gap_missing_days": f"""WITH {gap},
            a AS (SELECT start_date_local AS d, sum(mtt_result) AS x FROM m GROUP BY 1),
            b AS (SELECT start_date_local AS d, sum(mtt_result) AS y FROM m WHERE NOT has_overlay_pred GROUP BY 1)
            SELECT a.d AS start_date_local, round(x, 2) AS actual_result, round(y, 2) AS predicted_result,
                round(x - y, 2) AS dif FROM a LEFT JOIN b ON b.d = a.d""",
        "batch_exact_matches": _batch("price = paid AND rebuy = again AND gtd = promised"),
        "batch_similar_matches": _batch(
            "abs(price - paid) <= 6 AND abs(rebuy - again) <= 6 AND abs(gtd - promised) <= 26"
        ),
        "stored_exact_matches": _priced(f"{SAME} AND price = 5.5 AND rebuy = 0 AND gtd = 153", start=True),
        "stored_similar_matches": _priced(
            f"{SAME} AND price BETWEEN 1 AND 25 AND rebuy BETWEEN 0 AND 15 AND gtd BETWEEN 1 AND 200", start=True
        ),
        "stored_lookup_empty": f"""SELECT c_custkey AS scenario_id, c_custkey NOT IN (SELECT scenario_id FROM (
            {_batch("abs(price - paid) <= 6 AND abs(rebuy - again) <= 6 AND abs(gtd - promised) <= 26")})) AS is_empty
            FROM customer""",
        "dictionary_flags": f"""WITH {YEARLY},
            span AS (SELECT min(start_date_local) AS lo, max(start_date_local) AS hi FROM t),
            v AS (SELECT * FROM t, span WHERE start_date_local <= lo + CAST((hi - lo) // 2 AS INT)),
            a AS (SELECT ko_type, row_number() OVER (ORDER BY ko_type) - 1 AS i FROM (SELECT DISTINCT ko_type FROM v)),
            b AS (SELECT start_hour_local, row_number() OVER (ORDER BY start_hour_local) - 1
                + (SELECT count(*) FROM a) AS j FROM (SELECT DISTINCT start_hour_local FROM v)),
            c AS (SELECT match_id, row_number() OVER (ORDER BY 'serie ' || match_id) - 1
                + (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS k FROM v)
            SELECT match_id, concat_ws(',', i, j, k) AS flags FROM t LEFT JOIN a USING (ko_type)
            LEFT JOIN b USING (start_hour_local) LEFT JOIN c USING (match_id)""",
        "class_error_quantiles": f"""WITH {SCORED},
            e AS (SELECT class_match, {FOLD.format(id="match_id", k=10)} AS fold, abs(collected - prediction * 1.5) AS e FROM s)
            SELECT class_match, fold, round(quantile_cont(e, 0.25), 6) AS q1, round(median(e), 6) AS median,
                round(quantile_cont(e, 0.75), 6) AS q3 FROM e GROUP BY ALL""",
        "stump_class_folds": f"WITH {CLASS_FOLDS} SELECT * FROM oof",
        "stump_class_report": f"""WITH {CLASS_FOLDS}, ap AS (SELECT actual AS a, prediction AS p FROM oof), {REPORT}""",
        "stump_class_importances": f"""WITH {CLASS_FOLDS}, vocabulary AS ({" UNION ".join(
            f"SELECT '{c}' AS col, {c} AS value FROM r" for c in CLASSIFIED)})
            SELECT v.col || '_' || v.value AS "Feature Importance",
                CASE WHEN v.col = best.col AND v.value = best.value THEN 1.0 ELSE 0.0 END::DOUBLE AS "Value"
            FROM vocabulary v, best WHERE g = 4""",
        "stump_class_search": f"""WITH {CLASS_FOLDS}, per AS (SELECT fold,
                coalesce(2 * count(*) FILTER (WHERE actual = 0 AND prediction = 0)
                    / nullif(count(*) FILTER (WHERE actual = 0) + count(*) FILTER (WHERE prediction = 0), 0), 0) AS f1
                FROM oof GROUP BY fold)
            SELECT trial_id, round(avg(f1), 6) AS score, trial_id = 0 AS best
            FROM per, (SELECT unnest([0, 1]) AS trial_id) GROUP BY trial_id""",
        "typed_scores": f"""WITH {ALL_ROWS}, {FORMS},
            z AS (SELECT * REPLACE (CASE WHEN floor(hour) BETWEEN 0 AND 23 THEN CAST(floor(hour) AS INT) END AS hour) FROM f),
            y AS (SELECT *, hour AS start_hour_local FROM z)
            SELECT scenario_id, gtd, round({PREDICTED.replace("r.", "y.")}, 6) AS prediction,
                round({PREDICTED.replace("r.", "y.")} - gtd, 6) AS result_pred,
                {PREDICTED.replace("r.", "y.")} - gtd < 0 AS has_overlay_pred FROM y, best""",
        "stump_scores": f"""WITH {ALL_ROWS} SELECT match_id, round({PREDICTED}, 6) AS prediction,
            round({PREDICTED} - gtd, 6) AS result_pred, {PREDICTED} - gtd < 0 AS has_overlay_pred FROM r, best""",
        "stump_importances": f"""WITH {ALL_ROWS} SELECT DISTINCT flag.col || '_' || flag.value AS feature,
            CASE WHEN flag.col = best.col AND flag.value = best.value THEN 1.0 ELSE 0.0 END::DOUBLE AS value
            FROM flag, best""",
        "stump_out_of_fold": f"""WITH {_folds(5)} SELECT match_id, fold, collected AS actual,
            round(prediction, 6) AS prediction FROM oof""",
        "stump_search": f"""WITH {ALL_ROWS} SELECT match_id, round({PREDICTED}, 6) AS prediction,
            (WITH {_folds(5)} SELECT round(median(abs(collected - prediction)), 6) FROM oof) AS score FROM r, best""",
        "stump_classes": f"""WITH r AS ({EXTRACTED}),
            train AS (SELECT 0 AS g, * FROM r WHERE overlay_match_bi IN (0, 1)),
            {_split(CLASSIFIED, "r", "train", "(2 * overlay_match_bi - 1)")}
            SELECT id_match, buyin_price, rebuy_price,
                CASE WHEN CASE WHEN {_hit(CLASSIFIED)} THEN yes ELSE no END > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction,
                CASE WHEN CASE WHEN {_hit(CLASSIFIED)} THEN yes ELSE no END > 0 THEN 'PREVISÃO DE LUCRO'
                    ELSE 'PREVISÃO DE PREJUIZO' END AS outcome_text FROM r, best""",
        "stump_monthly_windows": f"""WITH RECURSIVE {_windowed("true")} SELECT g AS window_id, g AS fold, match_id,
            collected AS actual, round(prediction + 1e-8, 6) AS prediction FROM scored""",
        "stump_window_models": f"""WITH RECURSIVE {_windowed("true")} SELECT g AS window_id,
            CAST(ts AS VARCHAR) || '_to_' || CAST(ve AS VARCHAR) AS period, match_id, collected AS actual,
            round(prediction + 1e-8, 6) AS prediction FROM scored""",
        "stump_all_window_models": f"""WITH RECURSIVE {_windowed("true")} SELECT g AS window_id,
            CAST(ts AS VARCHAR) || '_to_' || CAST(ve AS VARCHAR) AS period, match_id, collected AS actual,
            round(prediction + 1e-8, 6) AS prediction FROM scored""",
        "csv_scored": f"""WITH {T}, r AS (SELECT * FROM t WHERE match_type_detail_name = 'MTT-NLH'),
            train AS (SELECT 0 AS g, * FROM r), {REGRESSOR}
            SELECT match_id, start_date_local, ko_type, gtd, collected, NULL::DOUBLE AS earlybird,
                round({PREDICTED}, 6) AS prediction, round({PREDICTED} - gtd, 6) AS result_pred,
                {PREDICTED} - gtd < 0 AS has_overlay_pred FROM r, best""",
        "days_from_text": """SELECT o_orderkey, CASE WHEN o_orderkey % 40 <> 0 THEN CAST(o_orderdate AS DATE) END AS day
            FROM orders""",
    }
