"""The same queries as SQL text for DuckDB, used only to check results.

Shared steps are common table expressions; a query is the chain of those it needs plus a
final SELECT. Rates, being ratios of counts, are rounded here in whole numbers, half up,
so that they do not hang on the last bit of a division.
"""

from __future__ import annotations

import re

from liftspark.functions import texts
from liftspark.plans.catalog import AS_OF, BACKLOG_HORIZON, CAP, CHECKED, CUTOFF, FRESH_AS_OF, HORIZON, PAGE, STALE

NOW = f"TIMESTAMP '{AS_OF}'"


def ratio(part: str, whole: str, digits: int = 6, empty: str = "0.0") -> str:
    scale = 10**digits
    return (
        f"CASE WHEN {whole} > 0 THEN CAST((2 * CAST({part} AS BIGINT) * {scale} + {whole}) "
        f"// (2 * {whole}) AS DOUBLE) / {scale} ELSE {empty} END"
    )


def pick(index: str, labels: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(labels))
    return f"CASE {index} {whens} END"


def clipped(count: str) -> str:
    return f"LEAST(CAST({ratio(count, 'view_count')} AS DOUBLE), CAST(1 AS DOUBLE))"


def fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', round({value}, {digits}))"


def fill(template: str, *values: str) -> str:
    """SQL concatenation of a %s template and its values."""
    pieces = template.split("%s")
    out = []
    for i, piece in enumerate(pieces):
        if piece:
            out.append("'" + piece.replace("'", "''") + "'")
        if i < len(values):
            out.append(f"CAST({values[i]} AS VARCHAR)")
    return "(" + " || ".join(out) + ")"


RATES = {
    "like_rate": "like_count",
    "save_rate": "save_count",
    "share_rate": "share_count",
    "click_rate": "click_to_product",
    "cart_rate": "add_to_cart",
}
RAW_RATES = ", ".join(f"{ratio(c, 'GREATEST(view_count, 1)')} AS {r}" for r, c in RATES.items())
CLEAN_RATES = ", ".join(f"{clipped(c)} AS {r}" for r, c in RATES.items())
LIFTS = "p10_demand_lift, p50_demand_lift, p90_demand_lift"
SCORE = "round(save_rate * 2 + share_rate * 3 + click_rate * 5, 6)"
PLATFORM = pick("user_id % 3", ("tiktok", "instagram", "youtube"))
TIER = pick("(user_id // 7) % 5", ("nano", "micro", "mid", "macro", "mega"))
CATEGORY = pick(
    "p_partkey % 8",
    ("apparel", "beauty", "electronics", "home", "fitness", "food", "toys", "accessories"),
)
VIDEO = "printf('vid_%06d', user_id)"
SKU = "printf('SKU-%06d', p_partkey)"


def projected(stock: str = "current_stock") -> str:
    return (
        f"CAST({stock} AS DOUBLE) / NULLIF(baseline_daily_demand"
        " * GREATEST(p90_demand_lift, CAST(0.01 AS DOUBLE)), 0)"
    )


def video_mart_tail(source: str) -> str:
    """Latest row of each video in ``source`` with the features the marts read."""
    return f"""
    SELECT r.*, COALESCE(s.avg_sens, CAST(1 AS DOUBLE)) AS sku_viral_sensitivity,
           COALESCE(s.max_sens, CAST(1 AS DOUBLE)) AS sku_viral_sensitivity_max
    FROM (SELECT *, lead(hours_since_post) OVER w IS NULL AS newest,
                 CAST(sum(views_delta_1h) OVER w3 AS BIGINT) AS views_velocity_3h,
                 CAST(sum(saves_delta_1h) OVER w3 AS BIGINT) AS saves_velocity_3h,
                 CAST(sum(shares_delta_1h) OVER w3 AS BIGINT) AS shares_velocity_3h,
                 views_delta_1h - COALESCE(lag(views_delta_1h) OVER w, 0) AS views_acceleration,
                 {SCORE} AS engagement_score
          FROM {source}
          WINDOW w AS (PARTITION BY video_id ORDER BY hours_since_post),
                 w3 AS (PARTITION BY video_id ORDER BY hours_since_post
                        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) r
    LEFT JOIN sensitivity s ON s.video_id = r.video_id
    WHERE newest"""


def lifts(source: str, score: str = "engagement_score") -> str:
    return f"""
    SELECT *, GREATEST(p50_demand_lift * 0.4, 0.02::DOUBLE) AS p10_demand_lift,
           GREATEST(p50_demand_lift * 2.2, 0.2::DOUBLE) AS p90_demand_lift
    FROM (SELECT *, GREATEST({score} * sku_viral_sensitivity * 10.0::DOUBLE
                             + CAST(is_on_foryou AS INTEGER) * 0.5::DOUBLE, 0.1::DOUBLE)
                    AS p50_demand_lift
          FROM {source})"""


VIDEO_TIER = (
    "CASE WHEN p90_demand_lift >= 3 THEN 'CRITICAL' WHEN p90_demand_lift >= 2 THEN 'WARNING' "
    "WHEN p90_demand_lift >= 1.5 THEN 'WATCH' ELSE 'NORMAL' END"
)
QUANTITY = (
    "GREATEST(CAST(ceil(baseline_daily_demand * p90_demand_lift"
    " * (supplier_lead_time_days + 3)) AS BIGINT) - current_stock, 1)"
)
ALERT_ID = (
    "'alert_20240201_000000_' || substr(sha256(sku_id || '|' || '20240201_000000'), 1, 32)"
)
DAYS = fixed("days_of_cover", 1)
P90 = fixed("p90_demand_lift", 2)
STOCK = "format('{:,}', current_stock)"
REASON = "CASE " + " ".join(
    f"WHEN {condition} THEN {fill(texts.REASON_TEXTS[name], *values)}"
    for name, condition, values in (
        (
            "critical",
            "risk_tier = 'CRITICAL'",
            (P90, "'3.0'", DAYS, "'7'", "supplier_lead_time_days"),
        ),
        ("warning", "risk_tier = 'WARNING'", (P90, "'2.0'", DAYS)),
        ("elevated", "p90_demand_lift >= 2", (P90, DAYS)),
        ("watch", "risk_tier = 'WATCH'", (P90, "'1.5'")),
        ("comfortable", "p90_demand_lift >= 1.5", (P90, DAYS)),
        ("quiet", "TRUE", (P90,)),
    )
) + " END"

CTES = {
    "activity": """
    SELECT user_id, date_trunc('hour', ts) AS hour, event_type, value,
           CAST(round(value * 100) AS BIGINT) AS cents,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
    FROM events""",
    "hourly": """
    SELECT user_id, hour,
           CAST(COALESCE(sum(floor(value) * 10) FILTER (event_type = 'view'), 0) AS BIGINT) AS views,
           CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS saves,
           CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS shares,
           CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS clicks,
           CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS carts,
           CAST(count(*) FILTER (value > 50) AS BIGINT) AS likes,
           CAST(count(*) FILTER (value > 100) AS BIGINT) AS comments,
           CAST(COALESCE(sum(cents) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS cents
    FROM activity GROUP BY user_id, hour""",
    "posts": """
    SELECT user_id, min(hour) AS posted_at,
           CAST(date_diff('hour', min(hour), max(hour)) // 24 + 1 AS BIGINT) AS days,
           CAST(sum(cents) AS BIGINT) AS total, CAST(sum(views) AS BIGINT) AS total_views
    FROM hourly GROUP BY user_id""",
    "labels_24h": f"""
    SELECT p.user_id, {ratio("early * days", "total", 4, "NULL")} AS demand_lift_24h
    FROM posts p
    LEFT JOIN (SELECT h.user_id, CAST(sum(h.cents) AS BIGINT) AS early
               FROM hourly h JOIN posts q ON q.user_id = h.user_id
               WHERE h.hour < q.posted_at + INTERVAL 24 HOUR GROUP BY h.user_id) e
           ON e.user_id = p.user_id""",
    "tags": """
    SELECT DISTINCT a.user_id, p.p_partkey
    FROM activity a JOIN part p ON p.p_partkey = a.k + 100 * (a.user_id % 20)""",
    "bridge": f"""
    SELECT {VIDEO} AS video_id, {SKU} AS sku_id, {PLATFORM} AS platform, posted_at
    FROM tags JOIN posts USING (user_id)""",
    "tag_lists": f"""
    SELECT user_id, '["' || string_agg({SKU}, '","' ORDER BY {SKU}) || '"]' AS sku_ids_json
    FROM tags GROUP BY user_id""",
    "raw_videos": f"""
    SELECT {VIDEO} AS video_id, {PLATFORM} AS platform, 'cr_' || (user_id % 50) AS creator_id,
           {TIER} AS creator_tier, posted_at,
           CAST(10 + user_id % 171 AS INTEGER) AS video_duration_s,
           user_id % 10 < 6 AS has_link_in_bio,
           COALESCE(sku_ids_json, '[]') AS sku_ids_json,
           CASE WHEN user_id % 2 = 0 THEN '["US"]' ELSE '["US","GB"]' END AS region_codes_json,
           total_views >= 8000 AS is_viral
    FROM posts LEFT JOIN tag_lists USING (user_id)""",
    "counted": """
    SELECT h.user_id, h.hour AS snapshot_at, p.posted_at,
           CAST(date_diff('hour', p.posted_at, h.hour) AS INTEGER) AS hours_since_post,
           views AS views_delta_1h, saves AS saves_delta_1h, shares AS shares_delta_1h,
           CAST(sum(views) OVER w AS BIGINT) AS view_count,
           CAST(sum(likes) OVER w AS BIGINT) AS like_count,
           CAST(sum(comments) OVER w AS BIGINT) AS comment_count,
           CAST(sum(shares) OVER w AS BIGINT) AS share_count,
           CAST(sum(saves) OVER w AS BIGINT) AS save_count,
           CAST(sum(clicks) OVER w AS BIGINT) AS click_to_product,
           CAST(sum(carts) OVER w AS BIGINT) AS add_to_cart
    FROM hourly h JOIN posts p ON p.user_id = h.user_id
    WINDOW w AS (PARTITION BY h.user_id ORDER BY h.hour)""",
    "raw_events": f"""
    SELECT printf('evt_%s_%s_h%02d', strftime(c.posted_at, '%Y%m%d'), v.video_id,
                  hours_since_post) AS event_id,
           v.video_id, c.posted_at, snapshot_at, hours_since_post, v.platform, v.creator_id,
           v.creator_tier, v.sku_ids_json, v.video_duration_s, v.has_link_in_bio, view_count,
           like_count, comment_count, share_count, save_count, click_to_product, add_to_cart,
           {RAW_RATES}, views_delta_1h, saves_delta_1h, shares_delta_1h,
           {ratio("saves_delta_1h", "views_delta_1h")} AS save_velocity,
           c.user_id % 5 = 0 AS is_on_foryou,
           CASE WHEN c.user_id % 7 = 0 THEN CAST(1 + c.user_id % 50 AS INTEGER) END
               AS trending_rank,
           v.region_codes_json, l.demand_lift_24h, view_count >= 8000 AS is_viral
    FROM counted c
    JOIN raw_videos v ON v.video_id = printf('vid_%06d', c.user_id)
    JOIN labels_24h l ON l.user_id = c.user_id""",
    "clean": f"SELECT * REPLACE ({CLEAN_RATES}) FROM raw_events",
    "skus": f"""
    SELECT *, floor(baseline_daily_demand * supplier_lead_time_days * 1.2::DOUBLE)::INTEGER
              AS reorder_point
    FROM (SELECT {SKU} AS sku_id, p_name AS name, {CATEGORY} AS category,
                 p_retailprice AS unit_price_usd,
                 COALESCE(quantity, 0)::DOUBLE / 100 AS baseline_daily_demand,
                 CAST(p_size * 3 AS INTEGER) AS current_stock,
                 CAST(3 + p_partkey % 28 AS INTEGER) AS supplier_lead_time_days,
                 0.5::DOUBLE + (p_partkey % 41)::DOUBLE / 8 AS viral_sensitivity,
                 TIMESTAMP '2024-01-01' AS created_at,
                 COALESCE(quantity, 0)::BIGINT AS quantity
          FROM part
          LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey)
                 ON l_partkey = p_partkey)""",
    "staged_skus": f"""
    SELECT sku_id, name AS sku_name, category, unit_price_usd, baseline_daily_demand,
           current_stock, supplier_lead_time_days, reorder_point, viral_sensitivity, created_at,
           round(CAST(current_stock AS DOUBLE) / NULLIF(baseline_daily_demand, 0), 2)
               AS days_of_cover,
           CASE WHEN quantity = 0 THEN 'NORMAL'
                WHEN current_stock / baseline_daily_demand < supplier_lead_time_days THEN 'CRITICAL'
                WHEN current_stock / baseline_daily_demand < 2 * supplier_lead_time_days
                     THEN 'WARNING'
                WHEN current_stock / baseline_daily_demand < 30 THEN 'WATCH'
                ELSE 'NORMAL' END AS inventory_risk_tier,
           current_stock <= reorder_point AS is_below_reorder
    FROM skus""",
    "sensitivity": """
    SELECT video_id, avg(viral_sensitivity) AS avg_sens, max(viral_sensitivity) AS max_sens
    FROM bridge JOIN skus USING (sku_id) GROUP BY video_id""",
    "latest": video_mart_tail("clean"),
    "latest_before": video_mart_tail(
        f"(SELECT * FROM clean WHERE snapshot_at < TIMESTAMP '{CUTOFF}')"
    ),
    "lifted": lifts("latest"),
    "lifted_before": lifts("latest_before"),
    "signal": """
    SELECT sku_id, count(DISTINCT video_id) AS active_video_count,
           max(view_count) AS max_view_count, max(engagement_score) AS max_engagement_score,
           sum(CAST(round(engagement_score * 1000000) AS BIGINT))::DOUBLE / count(*) / 1000000
               AS avg_engagement_score,
           max(engagement_score * sku_viral_sensitivity / 0.20::DOUBLE) AS demand_pressure_proxy,
           bool_or(is_viral) AS has_viral_video
    FROM bridge JOIN latest USING (video_id) GROUP BY sku_id""",
    "inventory": f"""
    SELECT s.* EXCLUDE (created_at), COALESCE(active_video_count, 0) AS active_video_count,
           COALESCE(max_view_count, 0) AS max_view_count,
           COALESCE(max_engagement_score, 0) AS max_engagement_score,
           COALESCE(avg_engagement_score, 0) AS avg_engagement_score,
           COALESCE(demand_pressure_proxy, 0) AS demand_pressure_proxy,
           COALESCE(has_viral_video, FALSE) AS has_viral_video,
           round(CAST(CASE inventory_risk_tier
                 WHEN 'CRITICAL' THEN 4 WHEN 'WARNING' THEN 3 WHEN 'WATCH' THEN 2 ELSE 1 END
                 AS DOUBLE) * (1 + COALESCE(demand_pressure_proxy, 0)), 3) AS urgency_score,
           {NOW} AS refreshed_at
    FROM staged_skus s LEFT JOIN signal USING (sku_id)""",
    "sku_lifts": f"""
    SELECT sku_id, max(p10_demand_lift) AS p10_demand_lift,
           max(p50_demand_lift) AS p50_demand_lift, max(p90_demand_lift) AS p90_demand_lift
    FROM bridge JOIN lifted USING (video_id) GROUP BY sku_id""",
    "risk": f"""
    SELECT * EXCLUDE (refreshed_at, urgency_score), urgency_score,
           CASE WHEN p90_demand_lift >= 3 AND projected_stockout_days
                     < GREATEST(7, supplier_lead_time_days) THEN 'CRITICAL'
                WHEN p90_demand_lift >= 2 AND projected_stockout_days
                     < GREATEST(14, supplier_lead_time_days + 2) THEN 'WARNING'
                WHEN p90_demand_lift >= 1.5 AND projected_stockout_days < 30 THEN 'WATCH'
                ELSE 'NORMAL' END AS ml_risk_tier,
           CAST(NULL AS VARCHAR) AS latest_alert_id, CAST(NULL AS VARCHAR) AS alert_status,
           refreshed_at
    FROM (SELECT *, {projected()} AS projected_stockout_days
          FROM (SELECT i.*, COALESCE(p10_demand_lift, 1) AS p10_demand_lift,
                       COALESCE(p50_demand_lift, 1) AS p50_demand_lift,
                       COALESCE(p90_demand_lift, 1) AS p90_demand_lift
                FROM inventory i LEFT JOIN sku_lifts USING (sku_id)))""",
    "best_videos": """
    SELECT sku_id, string_agg(video_id, ',' ORDER BY n) AS top_video_ids
    FROM (SELECT sku_id, video_id, row_number() OVER (PARTITION BY sku_id
                 ORDER BY p90_demand_lift DESC, video_id) AS n
          FROM bridge JOIN lifted USING (video_id))
    WHERE n <= 5 GROUP BY sku_id""",
    "triaged": f"""
    SELECT *, {REASON} AS reasoning,
           CASE risk_tier WHEN 'CRITICAL' THEN 'draft_purchase_order'
                WHEN 'WARNING' THEN 'draft_alert' WHEN 'WATCH' THEN 'log_and_recheck'
                ELSE 'none' END AS action_type,
           risk_tier IN ('CRITICAL', 'WARNING') AS should_continue
    FROM (SELECT *, CASE
              WHEN p90_demand_lift >= 3 AND days_of_cover
                   < GREATEST(7, supplier_lead_time_days) THEN 'CRITICAL'
              WHEN p90_demand_lift >= 2 THEN CASE WHEN days_of_cover
                   < GREATEST(14, supplier_lead_time_days + 2) THEN 'WARNING' ELSE 'WATCH' END
              WHEN days_of_cover < 30 THEN 'WATCH' ELSE 'NORMAL' END AS risk_tier
          FROM (SELECT * EXCLUDE (days_of_cover),
                       COALESCE({projected()}, 9999::DOUBLE) AS days_of_cover
                FROM risk WHERE p90_demand_lift >= 1.5))""",
    "drafted": f"""
    SELECT *, {ALERT_ID} AS alert_id,
           {fill(texts.SUMMARY_TEXT, "sku_id", "sku_name",
                 "CASE WHEN p90_demand_lift >= 3 THEN 'extreme' ELSE 'significant' END",
                 fixed("p90_demand_lift", 1), STOCK, DAYS,
                 "CASE WHEN days_of_cover < supplier_lead_time_days THEN 'dangerously low'"
                 " ELSE 'below comfortable levels' END",
                 "supplier_lead_time_days")} AS investigation_summary,
           CASE risk_tier WHEN 'CRITICAL' THEN
           {fill(texts.PO_TEXT, "sku_id", "sku_name", "format('{:,}', quantity)",
                 "format('{:,.2f}', round(quantity * unit_price_usd, 2))", STOCK, DAYS, P90,
                 "supplier_lead_time_days")}
           ELSE {fill(texts.ALERT_TEXT, "sku_id", "sku_name", P90, STOCK, DAYS,
                      "active_video_count")} END AS action_draft
    FROM (SELECT *, {QUANTITY} AS quantity FROM triaged WHERE should_continue)""",
    "alerts": f"""
    SELECT alert_id, sku_id, risk_tier, {LIFTS}, investigation_summary, action_draft,
           'PENDING' AS status, CAST(NULL AS TIMESTAMP) AS approved_at,
           CAST(NULL AS VARCHAR) AS approved_by, {NOW} AS created_at, {NOW} AS updated_at
    FROM drafted""",
    "taken": f"""
    SELECT 'd1_' || sku_id AS decision_id, alert_id,
           CASE risk_tier WHEN 'CRITICAL' THEN 'approve' ELSE 'dismiss' END AS decision,
           'ops_manager' AS decided_by, {NOW} + INTERVAL 1 HOUR AS decided_at FROM alerts
    UNION ALL
    SELECT 'd2_' || sku_id, alert_id, 'dismiss', 'ops_manager', {NOW} + INTERVAL 2 HOUR FROM alerts
    WHERE risk_tier = 'CRITICAL' AND p90_demand_lift >= 4
    UNION ALL
    SELECT 'd3_' || sku_id, 'alert_none_' || sku_id, 'approve', 'ops_manager',
           {NOW} + INTERVAL 3 HOUR
    FROM triaged WHERE risk_tier = 'WATCH'""",
    "decided": """
    SELECT t.*, CASE WHEN a.alert_id IS NULL THEN 'not_found'
                     WHEN a.status = 'PENDING' AND row_number() OVER
                          (PARTITION BY t.alert_id ORDER BY decided_at, decision_id) = 1
                     THEN 'success' ELSE 'not_pending' END AS outcome
    FROM taken t LEFT JOIN alerts a ON a.alert_id = t.alert_id""",
    "reviewed": """
    SELECT a.* REPLACE (
        CASE decision WHEN 'approve' THEN 'APPROVED' WHEN 'dismiss' THEN 'DISMISSED'
             ELSE status END AS status,
        CASE decision WHEN 'approve' THEN decided_at END AS approved_at,
        CASE decision WHEN 'approve' THEN decided_by END AS approved_by,
        COALESCE(decided_at, updated_at) AS updated_at)
    FROM alerts a LEFT JOIN decided d ON d.alert_id = a.alert_id AND d.outcome = 'success'""",
    "timed": f"""
    SELECT sku_id, risk_tier, p90_demand_lift,
           {NOW} + to_hours(supplier_lead_time_days % 6) AS created_at
    FROM triaged WHERE should_continue""",
    "history": f"""
    SELECT sku_id, {NOW} - to_hours(current_stock % 7) AS created_at FROM triaged
    UNION ALL
    SELECT sku_id, {NOW} - to_hours(supplier_lead_time_days % 11) FROM triaged""",
}
QUEUE = """
    SELECT alert_id, a.sku_id, sku_name, category, unit_price_usd, days_of_cover,
           inventory_risk_tier, current_stock, supplier_lead_time_days, active_video_count,
           has_viral_video, risk_tier AS alert_risk_tier, a.p90_demand_lift, a.p50_demand_lift,
           a.p10_demand_lift, investigation_summary, action_draft, status, approved_at,
           approved_by, CASE risk_tier WHEN 'CRITICAL' THEN 1 WHEN 'WARNING' THEN 2
           WHEN 'WATCH' THEN 3 ELSE 4 END AS sort_order, created_at, updated_at
    FROM {alerts} a LEFT JOIN risk r ON r.sku_id = a.sku_id"""
AGE = """CASE WHEN hours_since_post < 1 THEN '< 1 hour'
    WHEN hours_since_post < 24 THEN hours_since_post || ' hours'
    ELSE CAST(hours_since_post / 24 AS INTEGER) || ' days' END"""
BADGE = """CASE WHEN engagement_score >= 0.2 THEN 'MEGA' WHEN engagement_score >= 0.1 THEN 'HIGH'
    WHEN engagement_score >= 0.05 THEN 'MODERATE' ELSE 'LOW' END"""
CODES = """
    CASE creator_tier WHEN 'nano' THEN 0 WHEN 'mid' THEN 2 WHEN 'macro' THEN 3 WHEN 'mega' THEN 4
         ELSE 1 END AS creator_tier_encoded,
    CASE platform WHEN 'instagram' THEN 1 WHEN 'youtube' THEN 2 ELSE 0 END AS platform_encoded"""
HOURS = """
    hour(snapshot_at) AS snapshot_hour_of_day, dayofweek(snapshot_at) AS snapshot_day_of_week,
    hour(posted_at) AS posted_hour_of_day, dayofweek(posted_at) AS posted_day_of_week"""
PENDING = "CAST(NULL AS DOUBLE) AS {0}"
VELOCITY = """
    CAST(sum(views_delta_1h) OVER w AS BIGINT) AS views_velocity_3h,
    CAST(sum(saves_delta_1h) OVER w AS BIGINT) AS saves_velocity_3h,
    CAST(sum(shares_delta_1h) OVER w AS BIGINT) AS shares_velocity_3h"""
PREVIOUS = "lag(views_delta_1h) OVER (PARTITION BY video_id ORDER BY hours_since_post)"
BY_VIDEO = """WINDOW w AS (PARTITION BY video_id ORDER BY hours_since_post
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


def _millionths(value: str) -> str:
    return f"CAST(round({value} * 1000000) AS BIGINT)"


def _percent(rate: str) -> str:
    return f"{ratio(_millionths(rate), '10000', 2)} AS {rate}_pct"


def _trending() -> str:
    tail = f"p50_demand_lift, p90_demand_lift, {VIDEO_TIER} AS risk_tier_predicted"
    return f"""
    SELECT video_id, platform, creator_id, creator_tier, sku_ids_json, view_count AS total_views,
           {_percent("save_rate")}, {_percent("share_rate")}, {_percent("click_rate")},
           {_percent("cart_rate")},
           {ratio(_millionths("engagement_score"), "1000000", 4)} AS engagement_score, {BADGE} AS engagement_tier,
           views_velocity_3h, views_acceleration, CAST(is_on_foryou AS INTEGER) AS is_on_foryou,
           {AGE} AS age_label, hours_since_post AS hours_observed, posted_at,
           snapshot_at AS last_snapshot_at, is_viral, {tail},
           row_number() OVER (ORDER BY engagement_score DESC, video_id) AS rank,
           {NOW} AS mart_refreshed_at
    FROM (SELECT *, engagement_score AS s FROM lifted)
    QUALIFY row_number() OVER (ORDER BY s DESC, video_id) <= 50"""


_RANKED = _trending()
_EVENT_RULES = (
    [
        ("platform", "platform IN ('tiktok', 'instagram', 'youtube')"),
        ("creator_tier", "creator_tier IN ('nano', 'micro', 'mid', 'macro', 'mega')"),
        ("hours_since_post", "hours_since_post >= 0"),
        ("sku_ids", "sku_ids_json <> '[]'"),
    ]
    + [
        (c, f"{c} >= 0")
        for c in (
            "view_count like_count comment_count share_count save_count click_to_product"
            " add_to_cart"
        ).split()
    ]
    + [
        (c, f"{c} >= 0 AND {c} <= 1")
        for c in "save_rate share_rate click_rate cart_rate like_rate".split()
    ]
    + [(c, f"{c} >= 0") for c in "views_delta_1h saves_delta_1h shares_delta_1h save_velocity".split()]
    + [("snapshot_after_post", "snapshot_at >= posted_at")]
)
_CATEGORIES = (
    "('apparel', 'beauty', 'electronics', 'home', 'fitness', 'food', 'toys', 'accessories')"
)
_RISK_TIERS = "('CRITICAL', 'WARNING', 'WATCH', 'NORMAL')"
_VIDEO_RULES = [
    ("platform", "platform IN ('tiktok', 'instagram', 'youtube')"),
    ("creator_tier", "creator_tier IN ('nano', 'micro', 'mid', 'macro', 'mega')"),
    ("video_duration_s", "video_duration_s BETWEEN 1 AND 600"),
    ("sku_ids", "sku_ids_json <> '[]'"),
]
_SKU_RULES = [
    ("category", f"category IN {_CATEGORIES}"),
    ("unit_price_usd", "unit_price_usd > 0"),
    ("baseline_daily_demand", "baseline_daily_demand > 0"),
    ("current_stock", "current_stock >= 0"),
    ("supplier_lead_time_days", "supplier_lead_time_days BETWEEN 1 AND 90"),
    ("reorder_point", "reorder_point >= 0"),
    ("viral_sensitivity", "viral_sensitivity BETWEEN 0 AND 5"),
]


def _reasons(rules) -> str:
    cases = ", ".join(f"CASE WHEN NOT ({ok}) THEN '{name}' END" for name, ok in rules)
    return f"concat_ws(',', {cases})"


def _all_good(rules) -> str:
    return " AND ".join(f"({ok})" for _, ok in rules)


def _check(table: str, check: str, column: str, severity: str, failures: str) -> str:
    return f"""
    SELECT '{table}' AS table_name, '{check}' AS "check", '{column}' AS column_name,
           '{severity}' AS severity, n AS failures,
           CASE WHEN n > 0 THEN '{severity}' ELSE 'pass' END AS status
    FROM ({failures})"""


def _repeated(table: str, column: str) -> str:
    return f"""SELECT count(*) AS n FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL
               GROUP BY {column} HAVING count(*) > 1)"""


_DQ = " UNION ALL ".join(
    [_check("engagement_events", "unique", "event_id", "error", _repeated("raw_events", "event_id"))]
    + [
        _check(
            "engagement_events",
            "not_null",
            c,
            "error",
            f"SELECT count(*) AS n FROM raw_events WHERE {c} IS NULL",
        )
        for c in ("event_id", "video_id", "view_count", "trending_rank", "demand_lift_24h")
    ]
    + [
        _check(
            "engagement_events",
            "accepted_values",
            c,
            "warn",
            f"SELECT count(*) AS n FROM raw_events WHERE {c} NOT IN {values}",
        )
        for c, values in (
            ("platform", "('tiktok', 'instagram', 'youtube')"),
            ("creator_tier", "('nano', 'micro', 'mid', 'macro', 'mega')"),
        )
    ]
    + [
        _check("sku_catalog", "unique", c, "error", _repeated("staged_skus", c))
        for c in ("sku_id", "sku_name")
    ]
    + [
        _check(
            "sku_catalog",
            "not_null",
            c,
            "error",
            f"SELECT count(*) AS n FROM staged_skus WHERE {c} IS NULL",
        )
        for c in ("sku_id", "sku_name", "days_of_cover")
    ]
    + [
        _check(
            "sku_catalog",
            "accepted_values",
            c,
            "warn",
            f"SELECT count(*) AS n FROM staged_skus WHERE {c} NOT IN {values}",
        )
        for c, values in (("category", _CATEGORIES), ("inventory_risk_tier", _RISK_TIERS))
    ]
)

_ISO = "COALESCE(strftime({0}, '%Y-%m-%dT%H:%M:%SZ'), '') AS {0}"

SELECTS = {
    "stg_events": f"SELECT *, {NOW} AS _loaded_at FROM raw_events",
    "stg_skus": "SELECT * FROM staged_skus",
    "clean_rates": "SELECT event_id, like_rate, save_rate, share_rate, click_rate, cart_rate FROM clean",
    "hourly_deltas": """
    SELECT event_id, views_delta_1h, saves_delta_1h, shares_delta_1h, save_velocity
    FROM raw_events""",
    "velocity_3h": f"""
    SELECT event_id, {VELOCITY}, views_delta_1h - COALESCE({PREVIOUS}, 0) AS views_acceleration,
           {SCORE} AS engagement_score
    FROM clean {BY_VIDEO}""",
    "enriched": f"""
    SELECT event_id, like_rate, save_rate, share_rate, click_rate, cart_rate, {VELOCITY},
           COALESCE(views_delta_1h - {PREVIOUS}, 0) AS views_acceleration,
           {SCORE} AS engagement_score
    FROM clean {BY_VIDEO}""",
    "enrich_summary": """
    SELECT count(*) AS total_rows, count(DISTINCT video_id) AS n_videos,
           count(*) FILTER (is_viral) AS viral_rows
    FROM raw_events""",
    "features": f"""
    SELECT c.* EXCLUDE (region_codes_json), {VELOCITY},
           views_delta_1h - COALESCE(lag(views_delta_1h) OVER
               (PARTITION BY c.video_id ORDER BY hours_since_post), 0) AS views_acceleration,
           {SCORE} AS engagement_score, {CODES},
           COALESCE(avg_sens, 1) AS sku_viral_sensitivity,
           COALESCE(max_sens, 1) AS sku_viral_sensitivity_max, {HOURS},
           CAST(is_on_foryou AS INTEGER) AS is_on_foryou_int,
           CAST(has_link_in_bio AS INTEGER) AS has_link_in_bio_int
    FROM clean c LEFT JOIN sensitivity s ON s.video_id = c.video_id
    {BY_VIDEO.replace("PARTITION BY video_id", "PARTITION BY c.video_id")}""",
    "sku_sensitivity": """
    SELECT video_id, avg_sens AS avg_sku_viral_sensitivity, max_sens AS max_sku_viral_sensitivity
    FROM sensitivity""",
    "latest_snapshot": """
    SELECT video_id, event_id, snapshot_at, hours_since_post, view_count FROM raw_events e
    WHERE hours_since_post = (SELECT max(hours_since_post) FROM raw_events x
                              WHERE x.video_id = e.video_id)""",
    "scored_videos": f"""
    SELECT video_id, event_id AS latest_event_id, posted_at, snapshot_at AS last_snapshot_at,
           hours_since_post, hours_since_post AS hours_observed, view_count, platform, creator_id,
           creator_tier, sku_ids_json, {CODES}, video_duration_s,
           CAST(has_link_in_bio AS INTEGER) AS has_link_in_bio, save_rate, share_rate, click_rate,
           cart_rate, like_rate, views_velocity_3h, saves_velocity_3h, shares_velocity_3h,
           views_acceleration, views_delta_1h, saves_delta_1h, shares_delta_1h, save_velocity,
           engagement_score, CAST(is_on_foryou AS INTEGER) AS is_on_foryou,
           COALESCE(trending_rank, -1) AS trending_rank, sku_viral_sensitivity,
           sku_viral_sensitivity_max, {HOURS}, demand_lift_24h, is_viral,
           {PENDING.format("p10_demand_lift")}, {PENDING.format("p50_demand_lift")},
           {PENDING.format("p90_demand_lift")}, CAST(NULL AS VARCHAR) AS risk_tier_predicted,
           {NOW} AS mart_refreshed_at
    FROM latest""",
    "trending_top50": _RANKED,
    "trending_page": f"""
    SELECT rank, video_id, total_views, engagement_score, engagement_tier, age_label
    FROM ({_RANKED}) WHERE rank <= {PAGE}""",
    "trending_display": f"""
    SELECT rank, video_id, upper(platform) AS platform,
           upper(creator_tier[1]) || creator_tier[2:] AS creator, total_views,
           {fixed("p50_demand_lift", 2)} || 'x' AS p50_text,
           {fixed("p90_demand_lift", 2)} || 'x' AS p90_text,
           risk_tier_predicted AS tier, sku_ids_json
    FROM ({_RANKED})""",
    "sku_signal": "SELECT * FROM signal",
    "sku_inventory": "SELECT * FROM inventory",
    "video_lift_rule": f"SELECT video_id, {LIFTS} FROM lifted",
    "video_lift_parity": f"SELECT video_id, {LIFTS} FROM ({lifts('latest', '0.0::DOUBLE')})",
    "video_tier": f"SELECT video_id, p90_demand_lift, {VIDEO_TIER} AS risk_tier_predicted FROM lifted",
    "score_new": f"""
    SELECT video_id, event_id AS latest_event_id, {LIFTS}, {VIDEO_TIER} AS risk_tier_predicted
    FROM lifted WHERE event_id NOT IN (SELECT event_id FROM lifted_before)""",
    "attach_predictions": f"""
    SELECT l.video_id, l.event_id AS latest_event_id, b.p10_demand_lift, b.p50_demand_lift,
           b.p90_demand_lift, b.risk_tier_predicted
    FROM latest l LEFT JOIN (SELECT *, {VIDEO_TIER} AS risk_tier_predicted FROM lifted_before) b
         ON b.event_id = l.event_id""",
    "sku_lift": f"SELECT sku_id, {LIFTS} FROM sku_lifts",
    "sku_risk_mart": "SELECT * FROM risk",
    "sku_risk_filtered": """
    SELECT * FROM risk WHERE category = 'beauty' AND ml_risk_tier = 'CRITICAL'""",
    "sku_risk_alerted": """
    SELECT r.sku_id, r.ml_risk_tier, a.alert_id AS latest_alert_id, a.status AS alert_status
    FROM risk r LEFT JOIN reviewed a ON a.sku_id = r.sku_id""",
    "threat_flags": """
    SELECT sku_id, upper(category[1]) || category[2:] AS category, days_of_cover, ml_risk_tier,
           COALESCE(days_of_cover < supplier_lead_time_days, FALSE) AS is_threatened
    FROM risk""",
    "top_videos_per_sku": "SELECT * FROM best_videos",
    "at_risk": f"""
    SELECT sku_id, sku_name, category, current_stock, baseline_daily_demand,
           supplier_lead_time_days, unit_price_usd, {LIFTS}, active_video_count,
           max_engagement_score, COALESCE(top_video_ids, '') AS top_video_ids
    FROM risk LEFT JOIN best_videos USING (sku_id) WHERE p90_demand_lift >= 1.5""",
    "triage": """
    SELECT sku_id, risk_tier, action_type, reasoning, should_continue, days_of_cover
    FROM triaged""",
    "triage_summary": """
    SELECT count(*) AS total_skus, count(*) FILTER (risk_tier = 'CRITICAL') AS critical,
           count(*) FILTER (risk_tier = 'WARNING') AS warning
    FROM triaged""",
    "order_quantity": f"""
    SELECT sku_id, {QUANTITY} AS recommended_quantity,
           round({QUANTITY} * unit_price_usd, 2) AS estimated_cost_usd
    FROM risk""",
    "drafts": f"""
    SELECT sku_id, investigation_summary,
           {fill(texts.CONFIDENCE_TEXT, fixed("p10_demand_lift", 1), fixed("p90_demand_lift", 1),
                 fixed("p50_demand_lift", 1))} AS confidence_assessment,
           {fill(texts.FACTOR_TEXTS["lift"], P90)} || chr(10) ||
           {fill(texts.FACTOR_TEXTS["cover"], DAYS, "supplier_lead_time_days")} || chr(10) ||
           {fill(texts.FACTOR_TEXTS["videos"], "active_video_count")} || chr(10) ||
           {fill(texts.FACTOR_TEXTS["score"], fixed("max_engagement_score", 4))} || chr(10) ||
           {fill(texts.FACTOR_TEXTS["tier"], "risk_tier", "reasoning")} AS key_factors,
           '{texts.HISTORY_TEXT}' AS historical_comparison, action_draft,
           CASE risk_tier WHEN 'CRITICAL' THEN '{texts.PO_URGENCY}'
                ELSE '{texts.ALERT_URGENCY}' END AS urgency_note,
           CASE risk_tier WHEN 'CRITICAL' THEN quantity END AS recommended_quantity,
           CASE risk_tier WHEN 'CRITICAL' THEN round(quantity * unit_price_usd, 2) END
               AS estimated_cost_usd,
           {fill(texts.NOTICE_TEXT, "CASE risk_tier WHEN 'CRITICAL' THEN '🔴' ELSE '🟠' END",
                 "risk_tier", "sku_id", "sku_name", P90, STOCK, DAYS, "alert_id")} AS notification
    FROM drafted""",
    "alerts_new": "SELECT * FROM alerts",
    "alert_queue": QUEUE.format(alerts="alerts"),
    "alert_list": f"""
    SELECT * REPLACE ({_ISO.format("approved_at")}, {_ISO.format("created_at")},
                      {_ISO.format("updated_at")})
    FROM ({QUEUE.format(alerts="reviewed")})
    WHERE status = 'DISMISSED' AND alert_risk_tier = 'WARNING'""",
    "alert_counts": """
    SELECT count(*) FILTER (status = 'PENDING') AS pending,
           count(*) FILTER (status = 'APPROVED') AS approved
    FROM reviewed""",
    "decisions": """
    SELECT alert_id, sku_id, status, approved_at, approved_by, updated_at FROM reviewed""",
    "decision_outcomes": "SELECT decision_id, alert_id, decision, outcome FROM decided",
    "cooldown": """
    SELECT * FROM timed t
    WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.sku_id = t.sku_id
                      AND h.created_at <= t.created_at
                      AND h.created_at > t.created_at - INTERVAL 4 HOUR)""",
    "cap_per_hour": f"""
    SELECT * FROM timed
    QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', created_at)
        ORDER BY CASE risk_tier WHEN 'CRITICAL' THEN 1 ELSE 2 END, p90_demand_lift DESC, sku_id)
        <= {CAP}""",
    "bridge_explode": "SELECT * FROM bridge",
    "next_hour": f"""
    SELECT video_id, CAST(max(hours_since_post) + 1 AS INTEGER) AS next_hour FROM raw_events
    GROUP BY video_id HAVING max(hours_since_post) + 1 < {HORIZON}""",
    "due_snapshots": f"""
    SELECT event_id, e.video_id, hours_since_post, view_count FROM raw_events e
    LEFT JOIN (SELECT video_id, max(hours_since_post) AS reached FROM raw_events
               WHERE snapshot_at < TIMESTAMP '{CUTOFF}' GROUP BY video_id) s
           ON s.video_id = e.video_id
    WHERE snapshot_at >= TIMESTAMP '{CUTOFF}'
      AND hours_since_post = COALESCE(reached, -1) + 1 AND hours_since_post < {HORIZON}""",
    "upserted": """
    SELECT * EXCLUDE (quantity) REPLACE (
        CASE WHEN current_stock <= reorder_point
             THEN CAST(GREATEST(current_stock - CAST(baseline_daily_demand AS INTEGER), 0) AS INTEGER)
             ELSE current_stock END AS current_stock)
    FROM skus""",
    "row_counts": """
    SELECT 'sku_catalog' AS table_name, count(*) AS n FROM skus
    UNION ALL SELECT 'video_metadata', count(*) FROM raw_videos
    UNION ALL SELECT 'video_sku_bridge', count(*) FROM bridge
    UNION ALL SELECT 'engagement_events', count(*) FROM raw_events""",
    "encoded_lists": """
    SELECT video_id, sku_ids_json, region_codes_json FROM raw_videos""",
    "viral_share": """
    SELECT count(*) AS total, count(*) FILTER (is_viral) AS viral,
           round(avg(CAST(is_viral AS INTEGER)) * 100, 1) AS viral_pct
    FROM raw_videos""",
    "deplete": """
    SELECT sku_id, CAST(GREATEST(current_stock - CAST(baseline_daily_demand AS INTEGER), 0)
                        AS INTEGER) AS current_stock
    FROM skus""",
    "drift": """
    SELECT sku_id, round(baseline_daily_demand * (0.95::DOUBLE + 0.10::DOUBLE * (CAST('0x' ||
               substr(sha256(sku_id || '|42'), 1, 8) AS BIGINT)::DOUBLE / 4294967296)), 1)
               AS baseline_daily_demand
    FROM skus""",
    "dq_report": _DQ,
    "dq_freshness": f"""
    SELECT 'freshness' AS "check", 'snapshot_at' AS column_name, age_seconds,
           CASE WHEN age_seconds > 72 * 3600 THEN 'error' WHEN age_seconds > 24 * 3600 THEN 'warn'
                ELSE 'pass' END AS status
    FROM (SELECT date_diff('second', max(snapshot_at), TIMESTAMP '{FRESH_AS_OF}') AS age_seconds
          FROM raw_events)""",
    "quarantine_events": f"""
    SELECT event_id, {_reasons(_EVENT_RULES)} AS reasons FROM raw_events
    WHERE NOT ({_all_good(_EVENT_RULES)})""",
    "valid_events": f"""
    SELECT event_id, video_id, save_rate, like_rate FROM raw_events
    WHERE {_all_good(_EVENT_RULES)}""",
    "quarantine_skus": f"""
    SELECT sku_id, {_reasons(_SKU_RULES)} AS reasons FROM skus
    WHERE NOT ({_all_good(_SKU_RULES)})""",
    "lift_label": f"""
    SELECT printf('vid_%06d', user_id) AS video_id, demand_lift_24h FROM labels_24h""",
    "eval_metrics": f"""
    SELECT {", ".join(
        f"round(avg(GREATEST({a} * (y - {q}), ({a} - 1) * (y - {q}))), 4) AS {q}_pinball_loss, "
        f"round(avg(CAST(y <= {q} AS INTEGER)), 4) AS {q}_coverage"
        for q, a in (("p10", "0.1::DOUBLE"), ("p50", "0.5::DOUBLE"), ("p90", "0.9::DOUBLE")))},
           round(avg(abs(y - p50)), 4) AS p50_mae,
           round(COALESCE(avg(abs((y - p50) / y)) FILTER (y <> 0), 0), 4) AS p50_mape,
           round(avg(p90 - p10), 4) AS mean_interval_width,
           round(median(p90 - p10), 4) AS median_interval_width
    FROM (SELECT demand_lift_24h AS y, p10_demand_lift AS p10, p50_demand_lift AS p50,
                 p90_demand_lift AS p90 FROM lifted WHERE demand_lift_24h IS NOT NULL)""",
}

SELECTS["stream_hourly"] = f"""
    SELECT {VIDEO} AS video_id, hour, CAST(views AS BIGINT) AS views,
           CAST(saves AS BIGINT) AS saves, CAST(shares AS BIGINT) AS shares,
           CAST(clicks AS BIGINT) AS clicks, CAST(carts AS BIGINT) AS carts
    FROM hourly"""
SELECTS["stream_velocity"] = f"""
    SELECT {VIDEO} AS video_id, hour + to_hours(later) AS hour,
           CAST(sum(views) AS BIGINT) AS views_velocity_3h,
           CAST(sum(saves) AS BIGINT) AS saves_velocity_3h,
           CAST(sum(shares) AS BIGINT) AS shares_velocity_3h
    FROM (SELECT *, unnest([0, 1, 2]) AS later FROM hourly) GROUP BY ALL"""
_MORE_TESTS = {
    "engagement_events": (
        "raw_events",
        "event_id",
        "event_id video_id hours_since_post platform creator_tier view_count",
        "platform creator_tier",
    ),
    "sku_catalog": ("skus", "sku_id", "sku_id baseline_daily_demand", ""),
    "video_metadata": ("raw_videos", "video_id", "video_id platform", ""),
    "video_sku_bridge": ("bridge", "", "video_id sku_id", ""),
    "agent_alerts": ("alerts", "alert_id", "alert_id", ""),
    "stg_engagement_events": (
        "raw_events",
        "event_id",
        "event_id video_id hours_since_post platform creator_tier view_count save_rate is_viral",
        "platform creator_tier",
    ),
    "stg_sku_catalog": (
        "staged_skus",
        "sku_id",
        "sku_id sku_name category days_of_cover inventory_risk_tier viral_sensitivity",
        "category inventory_risk_tier",
    ),
    "int_engagement_features": (
        f"({SELECTS['features']})",
        "event_id",
        "event_id video_id hours_since_post views_velocity_3h engagement_score"
        " creator_tier_encoded platform_encoded",
        "creator_tier_encoded platform_encoded",
    ),
    "int_sku_inventory": (
        "inventory",
        "sku_id",
        "sku_id inventory_risk_tier urgency_score days_of_cover",
        "inventory_risk_tier",
    ),
    "mart_scored_videos": (
        f"({SELECTS['scored_videos']})",
        "video_id",
        "video_id platform engagement_score hours_observed sku_viral_sensitivity",
        "platform",
    ),
    "mart_sku_risk": (
        "risk",
        "sku_id",
        "sku_id inventory_risk_tier urgency_score days_of_cover",
        "inventory_risk_tier",
    ),
    "mart_trending_videos": (f"({_RANKED})", "video_id rank", "video_id engagement_score rank", ""),
}
_ACCEPTED = {
    "platform": "('tiktok', 'instagram', 'youtube')",
    "creator_tier": "('nano', 'micro', 'mid', 'macro', 'mega')",
    "category": _CATEGORIES,
    "inventory_risk_tier": _RISK_TIERS,
    "creator_tier_encoded": "(0, 1, 2, 3, 4)",
    "platform_encoded": "(0, 1, 2)",
}
def _checks_of(tests: dict) -> str:
    return " UNION ALL ".join(
        _check(name, check, c, severity, failures)
        for name, (source, unique, present, accepted) in tests.items()
        for check, severity, columns, sql in (
            ("unique", "error", unique, lambda c, t: _repeated(t, c)),
            ("not_null", "error", present, lambda c, t: f"SELECT count(*) AS n FROM {t} WHERE {c} IS NULL"),
            (
                "accepted_values",
                "warn",
                accepted,
                lambda c, t: f"SELECT count(*) AS n FROM {t} WHERE {c} NOT IN {_ACCEPTED[c]}",
            ),
        )
        for c in columns.split()
        for failures in [sql(c, source)]
    )


SELECTS["dq_suite"] = _checks_of(_MORE_TESTS)
CTES["arrived_events"] = f"""
    SELECT event_id, video_id, hours_since_post, creator_tier,
           CASE WHEN hours_since_post % 13 <> 5 OR snapshot_at >= TIMESTAMP '{CUTOFF}' THEN view_count END AS view_count,
           CASE WHEN hours_since_post % 11 = 3
                     AND NOT (hours_since_post % 13 = 5 AND snapshot_at >= TIMESTAMP '{CUTOFF}')
                THEN 'other' ELSE platform END AS platform
    FROM raw_events
    UNION ALL
    SELECT event_id, video_id, hours_since_post, creator_tier, view_count, platform
    FROM raw_events WHERE hours_since_post % 19 = 4 AND snapshot_at < TIMESTAMP '{CUTOFF}'"""
SELECTS["dq_incremental"] = _checks_of(
    {n: _MORE_TESTS[n] for n in CHECKED} | {"engagement_events": ("arrived_events", *_MORE_TESTS["engagement_events"][1:])}
)
SELECTS["quarantine_videos"] = f"""
    SELECT video_id, {_reasons(_VIDEO_RULES)} AS reasons FROM raw_videos
    WHERE NOT ({_all_good(_VIDEO_RULES)})"""
SELECTS["event_keys"] = "SELECT event_id, video_id, hours_since_post FROM raw_events"
SELECTS["view_read"] = "SELECT event_id, platform, view_count FROM raw_events"
SELECTS["alerts_empty_defaults"] = f"""
    SELECT 'a_' || sku_id AS alert_id, sku_id, inventory_risk_tier AS risk_tier,
           {PENDING.format("p10_demand_lift")}, {PENDING.format("p50_demand_lift")},
           {PENDING.format("p90_demand_lift")}, CAST(NULL AS VARCHAR) AS investigation_summary,
           CAST(NULL AS VARCHAR) AS action_draft, 'PENDING' AS status,
           CAST(NULL AS TIMESTAMP) AS approved_at, CAST(NULL AS VARCHAR) AS approved_by,
           {NOW} AS created_at, {NOW} AS updated_at
    FROM staged_skus"""
_BEFORE, _GAP = f"snapshot_at < TIMESTAMP '{CUTOFF}'", "hours_since_post % 7 = 3"
SELECTS["ingest_backlog"] = f"""
    SELECT event_id, video_id, hours_since_post,
           CASE WHEN {_BEFORE} AND NOT ({_GAP}) AND hours_since_post % 11 = 0
                THEN view_count + 1000 ELSE view_count END AS view_count,
           CASE WHEN hours_since_post >= {BACKLOG_HORIZON} THEN 'beyond_horizon' ELSE 'stored' END
               AS reason
    FROM raw_events
    WHERE NOT ({_BEFORE}) OR NOT ({_GAP}) OR CAST(right(video_id, 1) AS INTEGER) % 2 = 0
    UNION ALL
    SELECT event_id || tag, video_id, NULL, view_count, 'no_hour'
    FROM raw_events JOIN (VALUES ('_a', 13), ('_b', 17)) t(tag, n) ON hours_since_post % n = 5"""
SELECTS["ingest_progress"] = f"""
    SELECT video_id, max(hours_since_post) AS max_hour, count(*) AS stored_hours,
           max(hours_since_post) + 1 - count(*) AS missing_hours,
           max(hours_since_post) >= {BACKLOG_HORIZON - 1} AS is_finished
    FROM ({SELECTS["ingest_backlog"]}) WHERE reason = 'stored' GROUP BY video_id"""
SELECTS["ingest_gaps"] = f"""
    SELECT video_id, min(hour) AS from_hour, max(hour) AS to_hour
    FROM (SELECT video_id, hour, hour - row_number() OVER (PARTITION BY video_id ORDER BY hour) AS run
          FROM (SELECT video_id, unnest(range(0, max(hours_since_post) + 1)) AS hour
                FROM raw_events WHERE {_BEFORE} AND NOT ({_GAP}) GROUP BY video_id) r
          ANTI JOIN (SELECT video_id, hours_since_post AS hour FROM raw_events
                     WHERE {_BEFORE} AND NOT ({_GAP})) USING (video_id, hour))
    GROUP BY video_id, run"""
SELECTS["sku_sales_24h"] = f"""
    SELECT b.video_id, b.sku_id, count(ts) AS n_sales,
           CAST(COALESCE(sum(CAST(round(value * 100) AS BIGINT)), 0) AS BIGINT) AS amount
    FROM bridge b LEFT JOIN (
        SELECT printf('SKU-%06d', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 100 * (user_id % 20))
               AS sku_id, ts, value
        FROM events WHERE event_type = 'purchase') s
        ON s.sku_id = b.sku_id AND ts >= posted_at AND ts < posted_at + INTERVAL 24 HOUR
    GROUP BY b.video_id, b.sku_id"""
SELECTS["stored_upsert"] = """
    SELECT * REPLACE (CASE WHEN is_viral THEN 1 ELSE video_duration_s END AS video_duration_s,
                      CASE WHEN right(video_id, 1) NOT IN ('7', '9') THEN posted_at END AS posted_at)
    FROM raw_videos"""
SELECTS["sku_incremental"] = "SELECT r.*, b.top_video_ids FROM risk r LEFT JOIN best_videos b USING (sku_id)"
SELECTS["alerts_rerun"] = SELECTS["alerts_new"]
SELECTS["stored_review"] = SELECTS["decisions"]
SELECTS["cap_with_history"] = f"""
    SELECT t.sku_id, risk_tier, p90_demand_lift, created_at, 'a_' || t.sku_id AS alert_id,
           CASE WHEN row_number() OVER (PARTITION BY date_trunc('hour', created_at)
                     ORDER BY CASE risk_tier WHEN 'CRITICAL' THEN 1 ELSE 2 END,
                              p90_demand_lift DESC, t.sku_id) + COALESCE(used, 0) <= {4 * CAP}
                THEN 'PENDING' ELSE 'SUPPRESSED' END AS status
    FROM timed t LEFT JOIN (SELECT date_trunc('hour', created_at + INTERVAL 3 HOUR) AS hour,
                                   count(*) AS used FROM history GROUP BY 1) h
         ON h.hour = date_trunc('hour', created_at)"""
_DRAW = "CAST('0x' || substr(sha256(video_id || '|42'), 1, 8) AS BIGINT)::DOUBLE / 4294967296"
SELECTS["train_split"] = f"""
    SELECT video_id, CASE WHEN {_DRAW} < 0.8::DOUBLE THEN 'train' ELSE 'valid' END AS part
    FROM latest WHERE demand_lift_24h IS NOT NULL"""
_FEATURES = (
    "save_velocity share_rate cart_rate like_rate click_rate views_delta_1h saves_delta_1h"
    " shares_delta_1h hours_since_post is_on_foryou has_link_in_bio video_duration_s"
    " creator_tier_encoded sku_viral_sensitivity platform_encoded"
).split()
SELECTS["feature_rows"] = f"""
    SELECT video_id, {", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(_FEATURES))}
    FROM ({SELECTS["scored_videos"]})"""
SELECTS["tree_predict"] = """
    SELECT video_id, GREATEST(l[1], 0) AS p10_demand_lift, GREATEST(l[2], 0) AS p50_demand_lift,
           GREATEST(l[3], 0) AS p90_demand_lift
    FROM (SELECT video_id, list_sort([
        0.5::DOUBLE + CASE WHEN hours_since_post <= 300 THEN 0.25 ELSE -0.25 END::DOUBLE
                    + CASE WHEN save_velocity <= 0.05::DOUBLE THEN 0.125 ELSE 0.5 END::DOUBLE,
        0.75::DOUBLE + CASE WHEN like_rate <= 0.03::DOUBLE THEN -0.5 ELSE 0.25 END::DOUBLE
                     + CASE WHEN views_delta_1h <= 100 THEN 0 ELSE 1.5 END::DOUBLE,
        1.0::DOUBLE + CASE WHEN CAST(is_on_foryou AS INTEGER) <= 0.5 THEN -1.25 ELSE 2 END::DOUBLE
                    + CASE WHEN hours_since_post <= 500 THEN 0.5 ELSE 0.125 END::DOUBLE]) AS l
          FROM latest)"""
SELECTS["model_lift"] = f"""
    SELECT *, {VIDEO_TIER} AS risk_tier_predicted FROM ({SELECTS["tree_predict"]})"""
SELECTS["model_metrics"] = SELECTS["eval_metrics"].replace(
    "FROM lifted", f"FROM ({SELECTS['tree_predict']}) JOIN latest USING (video_id)"
).replace("demand_lift_24h IS NOT NULL)", f"demand_lift_24h IS NOT NULL AND NOT ({_DRAW} < 0.8::DOUBLE))")
SELECTS["fit_quality"] = f"""
    SELECT TRUE AS is_ordered, {", ".join(f"TRUE AS {q}_near_or_below_constant, TRUE AS {q}_covers"
                                          for q in ("p10", "p50", "p90"))}"""
SELECTS["stream_cooldown"] = f"""
    , cycles AS (
        SELECT printf('SKU-%06d', k + 100 * (user_id % 20)) AS sku_id, hour AS cycle,
               max(value) AS p90_demand_lift
        FROM activity WHERE event_type = 'purchase' GROUP BY ALL),
    following AS (
        SELECT a.sku_id, a.cycle, min(b.cycle) AS next_cycle
        FROM cycles a LEFT JOIN cycles b
             ON b.sku_id = a.sku_id AND b.cycle >= a.cycle + INTERVAL 4 HOUR
        GROUP BY a.sku_id, a.cycle),
    passed AS (
        SELECT sku_id, min(cycle) AS cycle FROM cycles GROUP BY sku_id
        UNION ALL
        SELECT p.sku_id, f.next_cycle FROM passed p
        JOIN following f ON f.sku_id = p.sku_id AND f.cycle = p.cycle
        WHERE f.next_cycle IS NOT NULL)
    SELECT sku_id, cycle, p90_demand_lift FROM passed JOIN cycles USING (sku_id, cycle)"""
SELECTS["stream_ingest"] = "SELECT * FROM raw_events"
SELECTS["stream_distinct"] = f"""
    SELECT event_id, video_id, hours_since_post, view_count,
           CASE WHEN hours_since_post >= {BACKLOG_HORIZON} THEN 'beyond_horizon'
                WHEN snapshot_at < TIMESTAMP '{STALE}' AND hours_since_post % 29 = 7 THEN 'late'
                ELSE 'stored' END AS reason
    FROM raw_events"""
SELECTS["stream_refresh"] = SELECTS["scored_videos"]


def _with_steps(select: str) -> str:
    """Prefix the SELECT with the steps it reaches, in order of definition."""
    needed: set[str] = set()
    queue = [select]
    while queue:
        words = set(re.findall(r"[a-z_0-9]+", queue.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            queue.append(CTES[name])
    steps = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    if select.lstrip().startswith(","):  # goes on with steps of its own, one of them recursive
        return f"WITH RECURSIVE {steps}{select}"
    return f"WITH {steps}\n{select}" if steps else select


def statements() -> dict[str, str]:
    return {name: _with_steps(select) for name, select in SELECTS.items()}
