"""The same queries as plain SQL over the raw tables, to check the operators against."""

from __future__ import annotations

VIEWS = {
    "facts": """
        facts AS (
          SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id, o.o_orderdate AS order_ts,
                 o.o_orderpriority AS traffic, c.c_mktsegment AS weather,
                 l.restaurant_id, l.items, l.eta_minutes, l.basket_value, l.discount_pct, l.distance_km,
                 (o.o_orderstatus = 'P')::INT AS cancelled, (o.o_orderstatus <> 'P')::INT AS delivered,
                 CASE WHEN o.o_orderstatus = 'P' THEN 0 ELSE floor(o.o_totalprice * 1e2 + 0.5)::BIGINT END AS paid
          FROM orders o
          LEFT JOIN customer c ON c.c_custkey = o.o_custkey
          LEFT JOIN (
            SELECT l_orderkey, min(l_suppkey) AS restaurant_id, count(*) AS items, max(l_quantity) AS eta_minutes,
                   sum(floor(l_extendedprice * 1e2 + 0.5)::BIGINT)::DOUBLE / 1e2 AS basket_value,
                   avg(floor(l_discount * 1e2 + 0.5)::BIGINT) / 1e2 AS discount_pct,
                   avg(floor(l_tax * 1e2 + 0.5)::BIGINT) AS distance_km
            FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)""",
    "places": """
        places AS (
          SELECT s_suppkey AS restaurant_id, r_name AS cuisine, s_acctbal AS rating
          FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey)""",
    "attempts": """
        attempts AS (
          SELECT event_id AS order_id, ts AS order_ts, extract(hour FROM ts)::BIGINT AS hour,
                 (event_type = 'error')::INT AS cancelled, (event_type = 'purchase')::INT AS delivered,
                 CASE WHEN event_type = 'purchase' THEN floor(value * 1e2 + 0.5)::BIGINT ELSE 0 END AS paid
          FROM events WHERE event_type IN ('purchase', 'error'))""",
    "sessions": """
        sessions AS (
          SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, user_id, min(ts) AS browse_ts,
                 bool_or(event_type = 'view') AS saw, bool_or(event_type = 'click') AS clicked,
                 bool_or(event_type = 'signup') AS joined,
                 bool_or(event_type = 'purchase')::INT AS converted,
                 (bool_or(event_type = 'purchase') AND bool_or(event_type = 'error'))::INT AS cancelled,
                 sum(CASE WHEN event_type = 'purchase' THEN floor(value * 1e2 + 0.5)::BIGINT ELSE 0 END) AS paid,
                 CASE user_id % 2 WHEN 0 THEN 'Control' ELSE 'Treatment' END AS variant
          FROM events GROUP BY ALL)""",
    "goods": """
        goods AS (
          SELECT p_partkey AS product_id, p_retailprice AS price0, d.demand0,
                 p_retailprice * CASE p_partkey % 4 WHEN 0 THEN 0.10::DOUBLE WHEN 1 THEN 0.13::DOUBLE
                                                    WHEN 2 THEN 0.45::DOUBLE ELSE 1.10::DOUBLE END AS cost
          FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS demand0 FROM lineitem GROUP BY 1) d
            ON l_partkey = p_partkey)""",
}
VIEWS["daily"] = (
    VIEWS["facts"]
    + """,
        daily AS (
          SELECT order_ts::DATE AS date, count(*) AS orders, sum(paid)::DOUBLE / 1e2 AS gmv, sum(paid) AS paid,
                 avg(cancelled) * 1e2 AS cancellation_rate, avg(eta_minutes) AS avg_eta
          FROM facts GROUP BY 1)"""
)
VIEWS["card"] = (
    VIEWS["facts"]
    + ","
    + VIEWS["places"]
    + """,
        card AS (
          SELECT restaurant_id, cuisine, any_value(rating) AS rating, count(order_id) AS orders,
                 sum(paid)::DOUBLE / 1e2 AS gmv, avg(cancelled) * 1e2 AS cancellation_rate, avg(eta_minutes) AS avg_eta
          FROM facts JOIN places USING (restaurant_id) GROUP BY 1, 2),
        status AS (
          SELECT *, CASE WHEN cancellation_rate >= (SELECT quantile_cont(cancellation_rate, 0.9) FROM card)
                           OR avg_eta >= (SELECT quantile_cont(avg_eta, 0.9) FROM card)
                         THEN 'Needs attention' ELSE 'Healthy' END AS status
          FROM card)"""
)
VIEWS["shoppers"] = (
    VIEWS["facts"]
    + """,
        shoppers AS (
          SELECT user_id, count(*) AS n, sum(paid) AS paid, max(order_ts) AS last_order
          FROM facts WHERE delivered = 1 GROUP BY 1),
        labelled AS (
          SELECT *, CASE WHEN n = 1 THEN 'New / one-time' WHEN n <= 3 THEN 'Repeat'
                         WHEN paid >= (SELECT median(paid) FROM shoppers) THEN 'Loyal high-value'
                         ELSE 'Occasional' END AS segment
          FROM shoppers)"""
)
VIEWS["funnel"] = """
        stages(position, stage, label) AS (
          VALUES (0, 'view', 'View'), (1, 'click', 'Click'), (2, 'signup', 'Sign-up'), (3, 'purchase', 'Purchase')),
        reached AS (
          SELECT position, stage, label, count(DISTINCT (user_id, ts::DATE)) AS sessions
          FROM stages LEFT JOIN events ON event_type = stage {where} GROUP BY ALL),
        funnel AS (
          SELECT position, stage, label, sessions,
                 CASE WHEN position = 0 THEN 1e2
                      ELSE sessions::DOUBLE / lag(sessions) OVER (ORDER BY position) * 1e2 END AS conversion,
                 sessions::DOUBLE / first(sessions) OVER (ORDER BY position) * 1e2 AS overall_conversion
          FROM reached)"""
VIEWS["arms"] = (
    VIEWS["sessions"]
    + """,
        arms AS (
          SELECT {by} sum((variant = 'Control')::INT)::DOUBLE AS nc, sum((variant = 'Treatment')::INT)::DOUBLE AS nt,
                 sum(converted) FILTER (variant = 'Control')::DOUBLE AS xc,
                 sum(converted) FILTER (variant = 'Treatment')::DOUBLE AS xt,
                 sum(cancelled) FILTER (variant = 'Control')::DOUBLE AS kc,
                 sum(cancelled) FILTER (variant = 'Treatment')::DOUBLE AS kt,
                 sum(paid) FILTER (variant = 'Control')::DOUBLE / 1e2 AS gc,
                 sum(paid) FILTER (variant = 'Treatment')::DOUBLE / 1e2 AS gt
          FROM sessions {join} {group}),
        tested AS (
          SELECT *, xc / nc AS pc, xt / nt AS pt, (xc + xt) / (nc + nt) AS pool,
                 (xt / nt / (xc / nc) - 1) * 1e2 AS lift_pct,
                 (xt / nt - xc / nc) / sqrt(pool * (1 - pool) * (1 / nc + 1 / nt)) AS z,
                 abs(z) / sqrt(2::DOUBLE) AS u, 1 / (1 + 0.3275911::DOUBLE * u) AS t,
                 t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE
                   + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-u * u) AS p_value
          FROM arms)"""
)
ONE_ARM = VIEWS["arms"].format(by="", join="", group="")
CHANNEL_ARMS = VIEWS["arms"].format(
    by="c_mktsegment AS acquisition_channel,", join="JOIN customer ON c_custkey = user_id", group="GROUP BY 1"
)


def _with(*parts: str) -> str:
    """A query (the last part) behind common table expressions, by name or as text."""
    *views, body = parts
    return "WITH " + ", ".join(VIEWS.get(v, v) for v in views) + body


def _snapshot(where: str, tag: str) -> str:
    return f"""
        SELECT count(*) AS {tag}orders, coalesce(sum(paid * delivered), 0)::DOUBLE / 1e2 AS {tag}gmv,
               coalesce(sum(paid * delivered)::DOUBLE / 1e2 / nullif(sum(delivered), 0), 0) AS {tag}aov,
               sum(cancelled)::DOUBLE / nullif(count(*), 0) * 1e2 AS {tag}cancel,
               sum(delivered)::DOUBLE / nullif(count(*), 0) * 1e2 AS {tag}delivery,
               coalesce(sum(delivered * coalesce(eta_minutes <= 45, false)::INT)::DOUBLE
                        / nullif(sum(delivered), 0) * 1e2, 0) AS {tag}sla
        FROM facts CROSS JOIN span WHERE {where}"""


def _span(days: int) -> str:
    return f"""
        edge AS (SELECT min(order_ts)::DATE AS d0, max(order_ts)::DATE AS d1 FROM facts),
        span AS (SELECT greatest(d0, d1 - {days - 1}) AS a, d1 AS b,
                        (greatest(d0, d1 - {days - 1}) - (d1 - greatest(d0, d1 - {days - 1}) + 1)::INT)::DATE AS p
                 FROM edge)"""


SNAPSHOT = ("orders", "gmv", "aov", "cancel", "delivery", "sla")
NOW = "order_ts::DATE BETWEEN a AND b"
BEFORE = "order_ts::DATE >= p AND order_ts::DATE < a"
ASIA = " AND traffic = '1-URGENT' AND restaurant_id IN (SELECT restaurant_id FROM places WHERE cuisine = 'ASIA')"


def _comparison(days: int, extra: str = "") -> str:
    changes = ", ".join(
        [f"({k} / nullif(prev_{k}, 0) - 1) * 1e2 AS {k}_delta_pct" for k in ("orders::DOUBLE", "gmv", "aov")]
        + [f"{k} - prev_{k} AS {k}_delta_pp" for k in ("cancel", "delivery", "sla")]
    ).replace("orders::DOUBLE / nullif(prev_orders::DOUBLE, 0)", "orders::DOUBLE / nullif(prev_orders, 0)")
    changes = changes.replace("orders::DOUBLE_delta_pct", "orders_delta_pct")
    kept = ", ".join(f"CASE WHEN n > 0 THEN prev_{k} END AS prev_{k}" for k in SNAPSHOT)
    return _with(
        "facts", "places", _span(days),
        f"""
        SELECT *, {changes}
        FROM ({_snapshot(NOW + extra, "")})
        CROSS JOIN (SELECT {kept} FROM (SELECT *, prev_orders AS n FROM ({_snapshot(BEFORE + extra, "prev_")})))""",
    )


def _cohort(start: str, number: str, names: tuple[str, str, str]) -> str:
    return _with(
        "facts",
        f"""
        SELECT c AS {names[0]}, ({number})::BIGINT AS {names[1]}, count(DISTINCT user_id) AS {names[2]}
        FROM (SELECT user_id, date_trunc('{start}', order_ts)::TIMESTAMP AS m,
                     date_trunc('{start}', min(order_ts) OVER (PARTITION BY user_id))::TIMESTAMP AS c
              FROM facts WHERE delivered = 1)
        GROUP BY 1, 2""",
    )


MONTHS = "datediff('month', c, m)"
ORDER_STEPS = "('session_start', -8), ('menu_view', -6), ('add_to_cart', -4), ('checkout', -2), ('order', 0)"
BROWSE_STEPS = """('session_start', 0, true), ('menu_view', 3, saw), ('add_to_cart', 6, saw AND clicked),
               ('checkout', 9, saw AND clicked AND joined)"""
ORDER_EVENTS = f"""
        SELECT 'S' || lpad(order_id::VARCHAR, greatest(7, length(order_id::VARCHAR))::INT, '0') AS session_id, user_id,
               order_ts + to_minutes(minutes) AS event_ts, event_name, restaurant_id, cuisine, traffic
        FROM facts LEFT JOIN places USING (restaurant_id), (VALUES {ORDER_STEPS}) s(event_name, minutes)"""
BROWSE_EVENTS = f"""
        SELECT 'B' || session_id AS session_id, user_id, browse_ts + to_minutes(minutes) AS event_ts, event_name,
               user_id AS restaurant_id, cuisine, NULL::VARCHAR AS traffic
        FROM sessions LEFT JOIN places ON restaurant_id = user_id,
             LATERAL (VALUES {BROWSE_STEPS}) s(event_name, minutes, reached)
        WHERE reached"""
GRID = """
        grid AS (
          SELECT product_id, demand0, price0, cost, i, cost / (1 - 0.2::DOUBLE) AS floor_price,
                 price0 * (1 + 0.2::DOUBLE) AS high, price0 * (1 - 0.2::DOUBLE) AS low,
                 CASE WHEN i = 40 THEN high ELSE low + i * ((high - low) / 4e1) END AS raw
          FROM goods, range(41) steps(i)),
        priced AS (
          SELECT product_id, cost, floor_price, CASE WHEN high < floor_price THEN floor_price ELSE raw END AS price,
                 demand0 * pow(greatest(price / price0, 0.05::DOUBLE), -1.15::DOUBLE) AS demand
          FROM grid WHERE raw >= floor_price OR (i = 0 AND high < floor_price))"""
FEATURES = """
        feats AS (
          SELECT order_id, eta_minutes, cancelled, coalesce(distance_km, -1)::DOUBLE AS distance_km,
                 coalesce(items, -1)::DOUBLE AS items, coalesce(basket_value, -1)::DOUBLE AS basket_value,
                 0::DOUBLE AS hour, (isodow(order_ts) > 5)::INT::DOUBLE AS weekend,
                 (list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], traffic) - 1)::DOUBLE
                   AS traffic,
                 (list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], weather) - 1)::DOUBLE
                   AS weather
          FROM facts),
        digests AS (
          SELECT order_id, cancelled, eta_minutes, ('0x' || substr(md5('42:' || order_id), 1, 15))::BIGINT AS h FROM feats)"""

ORACLE: dict[str, str] = {
    "kpi_summary": _with(
        "facts",
        """
        SELECT count(*) AS orders, sum(delivered)::BIGINT AS delivered_orders,
               round((1e2 * avg(delivered))::DECIMAL(28, 6), 2)::DOUBLE AS delivery_rate_pct,
               round((1e2 * avg(cancelled))::DECIMAL(28, 6), 2)::DOUBLE AS cancellation_rate_pct,
               round(avg(eta_minutes)::DECIMAL(28, 6), 2)::DOUBLE AS avg_eta_minutes,
               round((sum(paid)::DOUBLE / 1e2 / count(*))::DECIMAL(28, 6), 2)::DOUBLE AS revenue_per_order,
               sum(paid)::DOUBLE / 1e2 AS total_revenue
        FROM facts""",
    ),
    "daily_kpis": _with(
        "facts",
        """
        SELECT date_trunc('day', order_ts)::TIMESTAMP AS order_date, count(*) AS orders,
               sum(paid)::DOUBLE / 1e2 AS gmv,
               sum(paid)::DOUBLE / 1e2 / nullif(sum(delivered), 0) AS aov,
               avg(cancelled) * 1e2 AS cancellation_rate_pct, avg(delivered) * 1e2 AS delivery_rate_pct,
               avg((delivered = 1 AND coalesce(eta_minutes <= 45, false))::INT) * 1e2 AS sla_45_pct
        FROM facts GROUP BY 1""",
    ),
    "repeat_customer_rate": _with(
        "facts",
        """
        SELECT sum((n > 1)::INT)::DOUBLE / count(*) * 1e2 AS repeat_customer_rate_pct
        FROM (SELECT count(*) AS n FROM facts WHERE delivered = 1 GROUP BY user_id)""",
    ),
    "rolling_7d_orders": _with(
        "daily",
        """
        SELECT date::TIMESTAMP AS order_date, orders,
               avg(orders) OVER (ORDER BY date ROWS 6 PRECEDING) AS rolling_7d_orders
        FROM daily""",
    ),
    "daily_trends_7d": _with(
        "daily",
        """
        SELECT date, orders, gmv, cancellation_rate, avg_eta, avg(orders) OVER w AS orders_7d,
               avg(paid) OVER w / 1e2 AS gmv_7d, round(avg(cancellation_rate) OVER w, 6) AS cancel_7d,
               round(avg(avg_eta) OVER w, 6) AS eta_7d
        FROM daily WINDOW w AS (ORDER BY date ROWS 6 PRECEDING)""",
    ),
    "peak_and_worst_day": _with(
        "daily",
        """
        (SELECT 'peak_demand' AS kind, date, orders::DOUBLE AS value FROM daily ORDER BY orders DESC, date LIMIT 1)
        UNION ALL
        (SELECT 'worst_cancellation', date, cancellation_rate FROM daily ORDER BY cancellation_rate DESC, date LIMIT 1)
        """,
    ),
    "peak_hour_demand": _with(
        "attempts",
        """
        SELECT hour AS order_hour, count(*) AS orders, sum(paid)::DOUBLE / 1e2 / nullif(sum(delivered), 0) AS aov
        FROM attempts GROUP BY 1""",
    ),
    "hourly_demand": _with(
        "attempts",
        """
        SELECT hour, count(*) AS orders, sum(paid)::DOUBLE / 1e2 AS gmv,
               row_number() OVER (ORDER BY count(*) DESC, hour) = 1 AS is_peak
        FROM attempts GROUP BY 1""",
    ),
    "period_snapshot": _with("facts", _span(30), _snapshot(NOW, "")),
    "period_snapshot_full": _with("facts", _span(30), _snapshot("true", "")),
    "period_over_period": _comparison(30),
    "period_over_period_scoped": _comparison(90, ASIA),
    "filter_values": """
        SELECT 'cuisine' AS dimension, r_name AS value
        FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey)
        UNION SELECT 'traffic', o_orderpriority FROM orders""",
    "restaurant_scorecard_sql": _with(
        "facts",
        """
        SELECT restaurant_id, count(*) AS orders, sum(paid)::DOUBLE / 1e2 AS gmv,
               avg(delivered) * 1e2 AS delivery_rate_pct,
               avg((delivered = 1 AND coalesce(eta_minutes <= 45, false))::INT) * 1e2 AS sla_45_pct,
               avg(eta_minutes) AS avg_eta_minutes, avg(cancelled) * 1e2 AS cancellation_rate_pct
        FROM facts GROUP BY restaurant_id""",
    ),
    "restaurant_performance": _with(
        "card",
        """
        SELECT restaurant_id, cuisine, round(rating::DECIMAL(28, 6), 2)::DOUBLE AS rating, orders,
               round(avg_eta::DECIMAL(28, 6), 2)::DOUBLE AS avg_eta,
               round(cancellation_rate::DECIMAL(28, 6), 2)::DOUBLE AS cancellation_pct, gmv AS revenue
        FROM card""",
    ),
    "top3_restaurants_by_cuisine": _with(
        "card",
        """
        SELECT cuisine, restaurant_id, gmv,
               row_number() OVER (PARTITION BY cuisine ORDER BY gmv DESC, restaurant_id) AS rn
        FROM card QUALIFY rn < 4""",
    ),
    "restaurant_status": _with("card", " SELECT * FROM status"),
    "restaurant_top30": _with(
        "card",
        """
        SELECT restaurant_id, cuisine, orders, round(gmv::DECIMAL(28, 6), 0)::DOUBLE AS gmv,
               round(avg_eta::DECIMAL(28, 6), 1)::DOUBLE AS avg_eta,
               round(cancellation_rate::DECIMAL(28, 6), 1)::DOUBLE AS cancellation_rate, rating, status
        FROM (SELECT * FROM status ORDER BY status.gmv DESC, restaurant_id LIMIT 30)""",
    ),
    "top_n_restaurants": _with(
        "facts",
        """
        SELECT restaurant_id, sum(paid)::DOUBLE / 1e2 AS gmv FROM facts
        GROUP BY 1 ORDER BY gmv DESC, restaurant_id LIMIT 10""",
    ),
    "rfm_segments": _with(
        "shoppers",
        """
        SELECT user_id, last_order, n AS frequency, paid::DOUBLE / 1e2 AS monetary,
               r AS recency_score, f AS frequency_score, m AS monetary_score,
               CASE WHEN least(f, m) > 3 THEN 'Champions' WHEN least(f, m) > 2 THEN 'Loyal'
                    WHEN r < 3 THEN 'At Risk' ELSE 'Standard' END AS segment
        FROM (SELECT *, ntile(5) OVER (ORDER BY last_order, user_id)::BIGINT AS r,
                     ntile(5) OVER (ORDER BY n, user_id)::BIGINT AS f,
                     ntile(5) OVER (ORDER BY paid, user_id)::BIGINT AS m
              FROM shoppers)""",
    ),
    "behavioral_segments": _with(
        "shoppers", " SELECT segment, count(*) AS customers FROM labelled GROUP BY 1"
    ),
    "customer_segments": _with(
        "shoppers",
        " SELECT user_id, n AS orders, paid::DOUBLE / 1e2 AS revenue, last_order, segment FROM labelled",
    ),
    "customers_with_3plus_orders": """
        SELECT o_custkey AS user_id, count(*) AS orders FROM orders GROUP BY 1 HAVING orders > 2""",
    "cohort_retention": _cohort("month", MONTHS, ("cohort_month", "month_number", "active_users")),
    "cohort_retention_carry": _cohort("month", MONTHS, ("cohort_month", "month_number", "retained_customers")),
    "cohort_by_week": _cohort("week", "datediff('day', c, m) // 7", ("cohort_week", "week_number", "active_users")),
    "cohort_activity": _with(
        "facts", _span(90),
        """
        SELECT strftime(c, '%Y-%m') AS cohort, strftime(order_ts, '%Y-%m') AS order_month,
               count(DISTINCT user_id) AS customers
        FROM (SELECT user_id, order_ts, min(order_ts) OVER (PARTITION BY user_id) AS c
              FROM facts, span WHERE delivered = 1 AND order_ts::DATE BETWEEN a AND b)
        GROUP BY 1, 2""",
    ),
    "retention_by_segment": _with(
        "facts",
        """
        SELECT weather AS segment, c AS cohort_month, datediff('month', c, m)::BIGINT AS month_number,
               count(DISTINCT user_id) AS active_users, any_value(s) AS cohort_size,
               active_users::DOUBLE / cohort_size * 1e2 AS retention_pct
        FROM (SELECT *, count(DISTINCT user_id) OVER (PARTITION BY weather, c) AS s
              FROM (SELECT user_id, weather, date_trunc('month', order_ts)::TIMESTAMP AS m,
                           date_trunc('month', min(order_ts) OVER (PARTITION BY user_id))::TIMESTAMP AS c
                    FROM facts WHERE delivered = 1))
        GROUP BY 1, 2, 3""",
    ),
    "event_funnel": _with(
        VIEWS["funnel"].format(where=""),
        """
        SELECT position::INT AS position, stage, sessions, conversion, 1e2 - conversion AS drop_off, overall_conversion
        FROM funnel""",
    ),
    "event_funnel_scoped": _with(
        VIEWS["funnel"].format(where="AND ts::DATE BETWEEN '2024-01-08' AND '2024-01-14'"),
        """
        SELECT position::INT AS position, stage, sessions, conversion, 1e2 - conversion AS drop_off, overall_conversion
        FROM funnel""",
    ),
    "funnel_display": _with(
        VIEWS["funnel"].format(where=""),
        """
        SELECT position::INT AS position, label AS stage, sessions, round(conversion, 1) AS conversion,
               round(1e2 - conversion, 1) AS drop_off, round(overall_conversion, 1) AS overall_conversion
        FROM funnel""",
    ),
    "largest_leak": _with(
        VIEWS["funnel"].format(where=""),
        """
        SELECT stage, sessions, conversion, 1e2 - conversion AS drop_off
        FROM funnel WHERE position > 0 ORDER BY conversion, position LIMIT 1""",
    ),
    "order_journey_events": _with("facts", "places", ORDER_EVENTS),
    "browse_session_events": _with("sessions", "places", BROWSE_EVENTS),
    "journey_union": _with("facts", "sessions", "places", f"{ORDER_EVENTS} UNION ALL {BROWSE_EVENTS}"),
    "cancellation_by_hour": _with(
        "attempts",
        " SELECT hour, avg(cancelled) * 1e2 AS cancellation_rate, count(*) AS orders FROM attempts GROUP BY 1",
    ),
    "cancellation_by_traffic": _with(
        "facts",
        " SELECT traffic, avg(cancelled) * 1e2 AS cancellation_rate, count(*) AS orders FROM facts GROUP BY 1",
    ),
    "cancellation_by_restaurant": _with(
        "facts",
        """
        SELECT restaurant_id, avg(cancelled) * 1e2 AS cancellation_rate, count(*) AS orders
        FROM facts GROUP BY 1""",
    ),
    "worst_cancellation_segment": _with(
        "facts",
        """
        SELECT traffic, avg(cancelled) * 1e2 AS cancellation_rate, count(*) AS orders
        FROM facts GROUP BY 1 ORDER BY cancellation_rate DESC, traffic LIMIT 1""",
    ),
    "severity_impact_rank": _with(
        "facts",
        """
        SELECT restaurant_id, count(*) AS orders, avg(cancelled) * 1e2 AS cancellation_rate,
               sum(cancelled)::BIGINT AS cancelled_orders,
               sum(cancelled)::DOUBLE / sum(sum(cancelled)) OVER () * 1e2 AS share_of_cancellations_pct
        FROM facts GROUP BY 1""",
    ),
    "experiment_summary": _with(
        "sessions",
        """
        SELECT variant, count(*) AS sessions, sum(converted)::BIGINT AS conversions,
               sum(paid)::DOUBLE / 1e2 AS gmv, sum(cancelled)::BIGINT AS cancellations,
               sum(converted)::DOUBLE / count(*) AS conversion_rate,
               sum(cancelled)::DOUBLE / nullif(sum(converted), 0) AS cancel_rate
        FROM sessions GROUP BY 1""",
    ),
    "experiment_display": _with(
        "sessions",
        """
        SELECT variant AS "Variant", count(*) AS "Sessions", sum(converted)::BIGINT AS "Conversions",
               sum(paid)::DOUBLE / 1e2 AS "GMV", sum(cancelled)::BIGINT AS "Cancellations",
               round((sum(converted)::DOUBLE / count(*) * 1e2)::DECIMAL(28, 6), 2)::DOUBLE AS "Conversion %",
               round((sum(cancelled)::DOUBLE / nullif(sum(converted), 0) * 1e2)::DECIMAL(28, 6), 2)::DOUBLE
                 AS "Cancel %"
        FROM sessions GROUP BY 1""",
    ),
    "experiment_readout": _with(
        ONE_ARM,
        """
        SELECT pc, pt, lift_pct, round(z, 6) AS z, round(p_value, 6) AS p_value, gt / nt AS gmv_per_session,
               CASE WHEN p_value < 0.05 AND lift_pct > 0 THEN 'Strong evidence to test rollout'
                    ELSE 'Do not roll out yet' END AS decision
        FROM tested""",
    ),
    "experiment_by_segment": _with(
        CHANNEL_ARMS,
        """
        SELECT acquisition_channel, pc, pt, lift_pct, round(z, 6) AS z, round(p_value, 6) AS p_value,
               gt / nt AS gmv_per_session, round(least(1, p_value * count(*) OVER ()), 6) AS p_adjusted,
               CASE WHEN p_value * count(*) OVER () < 0.05 AND lift_pct > 0 THEN 'Strong evidence to test rollout'
                    ELSE 'Do not roll out yet' END AS decision
        FROM tested""",
    ),
    "experiment_guardrails": _with(
        ONE_ARM,
        """
        SELECT 'cancel_rate' AS guardrail, kc / xc AS control, kt / xt AS treatment,
               kt / xt - kc / xc AS difference, kt / xt > kc / xc AS deteriorated FROM arms
        UNION ALL
        SELECT 'gmv_per_session', gc / nc, gt / nt, gt / nt - gc / nc, gt / nt < gc / nc FROM arms""",
    ),
    "experiment_ci": _with(
        ONE_ARM,
        """
        SELECT pc, pt, pt - pc AS difference, round(pt - pc - m, 6) AS ci_low, round(pt - pc + m, 6) AS ci_high
        FROM (SELECT *, 1.959963984540054::DOUBLE * sqrt(pc * (1 - pc) / nc + pt * (1 - pt) / nt) AS m FROM tested)""",
    ),
    "experiment_power": _with(
        CHANNEL_ARMS,
        """
        SELECT acquisition_channel, nc::BIGINT AS control_sessions, nt::BIGINT AS treatment_sessions, pc,
               ceil(pow(1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE, 2)
                    * (pc * (1 - pc) + least(1, pc + 0.02::DOUBLE) * (1 - least(1, pc + 0.02::DOUBLE)))
                    / (0.02::DOUBLE * 0.02::DOUBLE))::BIGINT AS required_per_variant,
               least(nc, nt) >= required_per_variant AS powered
        FROM tested""",
    ),
    "price_grid": _with(
        "goods", GRID,
        """
        SELECT product_id, round(price, 4) AS price, round(demand, 4) AS demand,
               round(price * demand, 4) AS revenue, round((price - cost) * demand, 4) AS contribution
        FROM priced""",
    ),
    "optimize_price": _with(
        "goods", GRID,
        """
        SELECT product_id, round(price, 4) AS recommended_price, round(demand, 4) AS expected_demand,
               round(price * demand, 4) AS expected_revenue, round((price - cost) * demand, 4) AS expected_contribution
        FROM priced QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY (price - cost) * demand DESC, price) = 1
        """,
    ),
    "order_time_features": _with(
        "attempts",
        """
        SELECT order_id, hour::INT AS hour, (isodow(order_ts) > 5)::INT AS weekend,
               (hour IN (12, 13, 14, 19, 20, 21, 22))::INT AS peak
        FROM attempts""",
    ),
    "surge_pricing": _with(
        "facts",
        """
        SELECT order_id, 0::INT AS hour, (isodow(order_ts) > 5)::INT AS weekend, 0::INT AS peak,
               round(surge, 4) AS surge, round((basket_value * surge)::DECIMAL(28, 6), 2)::DOUBLE AS listed_price,
               CASE WHEN delivered = 1
                    THEN round((basket_value * surge * (1 - discount_pct))::DECIMAL(28, 6), 2)::DOUBLE
                    ELSE 0 END AS revenue
        FROM (SELECT *, 1 + 0.07::DOUBLE * (traffic = '1-URGENT')::INT + 0.05::DOUBLE * (weather = 'MACHINERY')::INT
                     AS surge FROM facts)""",
    ),
    "eta_penalties": _with(
        "facts",
        """
        SELECT order_id, t AS traffic_penalty, w AS weather_penalty,
               round(8 + 3.1::DOUBLE * distance_km + 0.45::DOUBLE * t + 0.35::DOUBLE * w, 6) AS travel,
               round(1 / (1 + exp((48 - eta_minutes) / 8)), 6) AS cancel_prob
        FROM (SELECT *, (CASE traffic WHEN '1-URGENT' THEN 16 WHEN '2-HIGH' THEN 7 ELSE 0 END)::INT AS t,
                     (CASE weather WHEN 'MACHINERY' THEN 9 WHEN 'BUILDING' THEN 3 ELSE 0 END)::INT AS w FROM facts)""",
    ),
    "invariant_violations": _with(
        "facts", "sessions", "places",
        """
        SELECT 'delivered_is_not_cancelled' AS "check", count(*) AS "rows",
               sum((delivered = cancelled)::INT)::BIGINT AS violations FROM facts
        UNION ALL SELECT 'revenue_only_when_delivered', count(*), sum((delivered = 0 AND paid <> 0)::INT)::BIGINT
                  FROM facts
        UNION ALL SELECT 'cancelled_only_when_converted', count(*), sum((cancelled > converted)::INT)::BIGINT
                  FROM sessions
        UNION ALL SELECT 'one_row_per_restaurant', count(*), count(*) - count(DISTINCT restaurant_id) FROM places""",
    ),
    "validate_order_features": _with(
        "facts",
        """
        SELECT order_id, concat_ws(',',
                 CASE WHEN distance_km > 0 AND distance_km <= 30 THEN NULL ELSE 'distance_km' END,
                 CASE WHEN items BETWEEN 1 AND 20 THEN NULL ELSE 'items' END,
                 CASE WHEN basket_value > 0 THEN NULL ELSE 'basket_value' END) AS violations
        FROM facts""",
    ),
    "validate_pricing_inputs": _with(
        "goods",
        """
        SELECT product_id, concat_ws(',', CASE WHEN price0 > 0 THEN NULL ELSE 'reference_price' END,
                 CASE WHEN demand0 > 0 THEN NULL ELSE 'base_demand' END,
                 CASE WHEN cost > 0 THEN NULL ELSE 'unit_cost' END) AS violations
        FROM goods""",
    ),
    "grain_check": """
        SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "join_fanout": """
        SELECT (SELECT count(*) FROM orders) AS rows_before,
               (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS rows_after,
               (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS unmatched,
               (SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS fans_out""",
    "wow_growth": _with(
        "facts",
        """,
        weeks AS (SELECT date_trunc('week', order_ts)::TIMESTAMP AS week, count(*) AS orders, sum(paid) AS paid
                  FROM facts GROUP BY 1)
        SELECT n.week, n.orders, n.paid::DOUBLE / 1e2 AS gmv,
               (n.orders::DOUBLE / nullif(b.orders, 0) - 1) * 1e2 AS orders_wow_pct,
               (n.paid::DOUBLE / 1e2 / nullif(b.paid::DOUBLE / 1e2, 0) - 1) * 1e2 AS gmv_wow_pct
        FROM weeks n LEFT JOIN weeks b ON b.week = n.week - INTERVAL 7 DAY""",
    ),
    "gmv_contribution": _with(
        "facts",
        """
        SELECT traffic, sum(paid)::DOUBLE / 1e2 AS gmv,
               sum(paid)::DOUBLE / (SELECT sum(paid) FROM facts)::DOUBLE * 1e2 AS share_pct
        FROM facts GROUP BY 1""",
    ),
    "rate_change_contribution": _with(
        "facts", _span(90),
        f""",
        seg AS (
          SELECT traffic, count(*) FILTER ({NOW}) AS orders, count(*) FILTER ({BEFORE}) AS prev_orders,
                 count(*) FILTER ({NOW} AND cancelled = 1) AS cancelled_orders,
                 count(*) FILTER ({BEFORE} AND cancelled = 1) AS prev_cancelled_orders
          FROM facts, span WHERE order_ts::DATE BETWEEN p AND b GROUP BY 1),
        tot AS (SELECT sum(orders)::DOUBLE AS n1, sum(prev_orders)::DOUBLE AS n0 FROM seg),
        parts AS (
          SELECT seg.*, (cancelled_orders / n1 - prev_cancelled_orders / n0) * 1e2 AS c,
                 (orders / n1 - prev_orders / n0) * 1e2
                   * coalesce(prev_cancelled_orders::DOUBLE / nullif(prev_orders, 0),
                              cancelled_orders::DOUBLE / nullif(orders, 0)) AS m
          FROM seg, tot)
        SELECT traffic, orders, prev_orders, cancelled_orders, prev_cancelled_orders,
               round(c, 6) AS contribution_pp, round(m, 6) AS mix_pp, round(c - m, 6) AS rate_pp
        FROM parts""",
    ),
    "gmv_decomposition": _with(
        "facts", _span(90),
        f""",
        t AS (SELECT sum(paid) FILTER ({NOW})::DOUBLE / 1e2 AS gmv,
                     sum(paid) FILTER ({BEFORE})::DOUBLE / 1e2 AS prev_gmv,
                     sum(delivered) FILTER ({NOW})::DOUBLE AS d1, sum(delivered) FILTER ({BEFORE})::DOUBLE AS d0
              FROM facts, span)
        SELECT gmv, prev_gmv, gmv - prev_gmv AS gmv_change, round((d1 - d0) * (prev_gmv / d0), 6) AS volume_effect,
               round(d1 * (gmv / d1 - prev_gmv / d0), 6) AS aov_effect
        FROM t""",
    ),
    "adhoc_sql": _with(
        "facts", "places",
        """
        SELECT cuisine, count(*) AS orders, count(DISTINCT user_id) AS customers
        FROM facts JOIN places USING (restaurant_id) WHERE eta_minutes <= 45 GROUP BY 1""",
    ),
    "model_features": _with("facts", FEATURES, " SELECT * FROM feats"),
    "train_test_split": _with(
        "facts", FEATURES,
        """
        SELECT order_id, cancelled, row_number() OVER (ORDER BY h) <= ceil(count(*) OVER () * 2 / 1e1) AS is_test
        FROM digests""",
    ),
    "train_test_split_stratified": _with(
        "facts", FEATURES,
        """
        SELECT order_id, cancelled, row_number() OVER (PARTITION BY cancelled ORDER BY h)
                 <= round(count(*) OVER (PARTITION BY cancelled) * 2 / 1e1) AS is_test
        FROM digests""",
    ),
}

# Labels that hang on traffic and weather, the test rows of a stratified split, and the AUC of the risk as a sum of ranks.
RISK = """
        risky AS (
          SELECT order_id, ('0x' || substr(md5('42:' || order_id), 1, 15))::BIGINT AS h,
                 0.05::DOUBLE + 0.036::DOUBLE * (CASE traffic WHEN '2-HIGH' THEN 7 WHEN '1-URGENT' THEN 16 ELSE 0 END
                   + CASE weather WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 9 ELSE 0 END) AS risk,
                 (('0x' || substr(md5('7:' || order_id), 1, 15))::BIGINT::DOUBLE / 1152921504606846976::DOUBLE < risk)::INT
                   AS cancelled
          FROM facts),
        tested AS (
          SELECT * FROM risky QUALIFY row_number() OVER (PARTITION BY cancelled ORDER BY h)
                                      <= round_even(count(*) OVER (PARTITION BY cancelled) * 2 / 1e1, 0)),
        ranked AS (
          SELECT cancelled, 2 * (rank() OVER (ORDER BY risk) - 1) + count(*) OVER (PARTITION BY risk) + 1 AS twice FROM tested)"""
SCORED = """
        SELECT order_id, true AS in_range, true AS near, row_number() OVER (ORDER BY h) <= ceil(count(*) OVER () * 2 / 1e1) AS is_test
        FROM digests"""
ORACLE |= {
    "eta_model_metrics": _with(
        "facts", FEATURES,
        """
        SELECT 'eta_mae' AS metric, ceil(count(*) * 2 / 1e1)::BIGINT AS test_rows, true AS sound
        FROM digests WHERE eta_minutes IS NOT NULL""",
    ),
    "cancel_model_metrics": _with(
        "facts", RISK,
        """
        SELECT 'cancel_auc' AS metric, count(*) AS test_rows, true AS sound,
               (sum(twice) FILTER (cancelled = 1) - sum(cancelled) * (sum(cancelled) + 1))::DOUBLE
                 / (2 * sum(cancelled) * (count(*) - sum(cancelled)))::DOUBLE AS known_auc
        FROM ranked""",
    ),
    "score_eta": _with("facts", FEATURES, SCORED),
    "score_cancellation_risk": _with("facts", FEATURES, SCORED),
    "score_validated": "SELECT *, violations = '' AS scored FROM (" + ORACLE["validate_order_features"] + ")",
    "model_round_trip": "SELECT o_orderkey AS order_id, true AS same FROM orders",
    "model_registry": _with(
        "facts",
        """
        SELECT name AS "table", ceil((n - fewer * last) * 2 / 1e1)::BIGINT AS test_rows, fitted
        FROM (SELECT count(eta_minutes) AS n FROM facts),
             (SELECT (eta_minutes IS NOT NULL)::INT AS last FROM facts ORDER BY order_id DESC LIMIT 1),
             (VALUES ('first', true, 0), ('same rows in another order', false, 0), ('one row less', true, 1),
                     ('one value changed', true, 0), ('first again', false, 0)) t(name, fitted, fewer)""",
    ),
    "csv_quarantine": """
        SELECT o_orderkey AS order_id, NOT (o_orderkey % 50 = 1 OR o_orderkey % 70 = 2 OR o_orderkey % 90 = 3) AS loaded
        FROM orders""",
    "orders_by_channel": _with(
        "facts",
        """
        SELECT weather AS acquisition_channel, count(*) AS orders, sum(paid)::DOUBLE / 1e2 AS gmv FROM facts GROUP BY 1""",
    ),
    "active_users_7d": """
        SELECT day, count(DISTINCT user_id) AS active_users
        FROM (SELECT DISTINCT ts::DATE AS day FROM events) d JOIN events ON ts::DATE BETWEEN day - 6 AND day GROUP BY 1""",
    "optional_tables": """
        SELECT name, name IN ('orders', 'restaurants') AS present,
               CASE name WHEN 'orders' THEN (SELECT count(*) FROM orders)
                         WHEN 'restaurants' THEN (SELECT count(*) FROM supplier) END AS rows
        FROM (VALUES ('users'), ('restaurants'), ('riders'), ('orders'), ('events'), ('experiments')) t(name)""",
    "replaced_table": """
        SELECT o_orderpriority AS traffic, count(*) AS orders,
               nullif(count(*) FILTER (o_orderstatus <> 'P'), 0) AS first_reader FROM orders GROUP BY 1""",
    "replaced_view": "SELECT o_orderpriority AS traffic, count(*) AS orders FROM orders GROUP BY 1",
}

ORACLE["funnel_from_bitmaps"] = ORACLE["event_funnel_scoped"]
ORACLE["daily_kpis_rolled_up"] = ORACLE["daily_kpis_bucketed"] = ORACLE["daily_kpis"]
ORACLE["kpi_summary_rolled_up"] = ORACLE["kpi_summary"]
ORACLE["csv_round_trip"] = ORACLE["restaurant_performance"]
ORACLE["metrics_json"] = ORACLE["kpi_summary"]


def _journey_funnel(events: str, where: str) -> tuple[str, str]:
    """Views and body of the five-stage funnel over an event query."""
    return (
        f"journey AS ({events})",
        f""",
        steps(position, stage) AS (SELECT row_number() OVER () - 1, s FROM (VALUES {ORDER_STEPS}) v(s, minutes)),
        counted AS (
          SELECT position, stage, count(DISTINCT session_id) AS sessions
          FROM steps LEFT JOIN journey ON event_name = stage AND {where} GROUP BY ALL)
        SELECT position::INT AS position, stage, sessions,
               CASE WHEN position = 0 OR sessions + lag(sessions) OVER w = 0 THEN 1e2
                    ELSE sessions::DOUBLE / nullif(lag(sessions) OVER w, 0) * 1e2 END AS conversion,
               1e2 - conversion AS drop_off,
               sessions::DOUBLE / nullif(first(sessions) OVER w, 0) * 1e2 AS overall_conversion
        FROM counted WINDOW w AS (ORDER BY position)""",
    )


ORACLE["events_by_day"] = _with(
    "sessions", "places", *_journey_funnel(BROWSE_EVENTS, "event_ts::DATE BETWEEN '2024-01-08' AND '2024-01-14'")
)
ORACLE["journey_funnel"] = _with(
    "facts",
    "sessions",
    "places",
    *_journey_funnel(
        f"{ORDER_EVENTS} UNION ALL {BROWSE_EVENTS}",
        "event_ts::DATE BETWEEN '2000-01-01' AND '2000-12-31' AND cuisine = 'ASIA' AND traffic = '1-URGENT'",
    ),
)
