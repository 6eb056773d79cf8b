-- The regressor extract as a SQL text: the table comes in as {tournaments},
-- the period as :init_date and :end_date. Whether the slots are broadcast follows
-- from their size when the query runs.
WITH played AS (
    SELECT *
    FROM {tournaments}
    WHERE match_type_detail_name = 'MTT-NLH'
      AND class_match IN ('Micro', 'Low')
      AND start_date_local BETWEEN CAST(:init_date AS DATE) AND CAST(:end_date AS DATE)
),
slots AS (
    SELECT CAST(start_date_local AS DATE) AS slot_date,
           start_hour_local AS slot_hour,
           COUNT(*) AS same_hour_game,
           SUM(COUNT(*)) OVER (
               PARTITION BY CAST(start_date_local AS DATE) ORDER BY start_hour_local
               RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING
           ) AS one_hour_window_game
    FROM played
    GROUP BY CAST(start_date_local AS DATE), start_hour_local
)
SELECT match_id, start_date_local, start_hour_local, day_of_week_local, ko_type,
       mtt_pool_allocation_description,
       CAST(ROUND(CAST(level_reject AS DECIMAL(18, 6)), 0) AS INT) AS level_reject,
       estrutura_blinds, mtt_blind_up_time_sec, late_registration_time, earlybird,
       has_rebuy, has_addon, mtt_customer_buy_in, mtt_customer_rebuy, mtt_customer_addon,
       gtd, has_overlay, overlay, mtt_result, collected,
       normalized_mtt_result, normalized_collected, buyin_gtd_rate,
       same_hour_game, one_hour_window_game
FROM played
LEFT JOIN slots ON CAST(start_date_local AS DATE) = slot_date AND start_hour_local = slot_hour
