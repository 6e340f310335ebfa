"""DuckDB SQL that states, independently of Spark, what every registered query must return."""

from __future__ import annotations

WEEK = "1995-07-17"  # Monday of the report week
AS_OF = "1997-01-01 12:00:00"

# The nine source tables read from the star schema.
SOURCES = """
src_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'created' END AS order_status,
    o_orderdate AS purchase_timestamp,
    CASE WHEN o_orderstatus = 'F' THEN first_ship END AS delivered_timestamp,
    o_orderdate + to_days(10 + 5 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS estimated_delivery
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) AS s
    ON o_orderkey = l_orderkey),
src_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS BIGINT) AS order_item_id,
    CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
    l_extendedprice AS price,
    CAST(l_quantity AS INTEGER) * (1 + CAST(round(l_tax * 100) AS INTEGER)) * 0.25::DOUBLE AS freight_value
  FROM lineitem),
src_geo AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS zip,
    -33 + c_nationkey * 1.4::DOUBLE + (c_custkey % 10) * 0.01::DOUBLE AS lat,
    -70 + c_nationkey * 1.3::DOUBLE + (c_custkey % 7) * 0.01::DOUBLE AS lng
  FROM customer WHERE c_nationkey <> 24),
src_sellers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, CAST(s_nationkey AS VARCHAR) AS seller_zip_code_prefix,
    'N' || s_nationkey AS seller_state FROM supplier),
src_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_nationkey AS VARCHAR) AS customer_zip_code_prefix,
    'N' || c_nationkey AS customer_state FROM customer),
src_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
    CASE WHEN p_type <> 'STANDARD' THEN lower(p_type) END AS category_name FROM part)
"""

FACTS = (
    SOURCES
    + """,
first_items AS (
  SELECT order_id,
    first(product_id ORDER BY order_item_id, product_id, seller_id, price, freight_value)
      FILTER (product_id IS NOT NULL) AS product_id,
    first(seller_id ORDER BY order_item_id, product_id, seller_id, price, freight_value)
      FILTER (seller_id IS NOT NULL) AS seller_id,
    first(price ORDER BY order_item_id, product_id, seller_id, price, freight_value)
      FILTER (price IS NOT NULL) AS price,
    first(freight_value ORDER BY order_item_id, product_id, seller_id, price, freight_value)
      FILTER (freight_value IS NOT NULL) AS freight_value
  FROM src_items GROUP BY order_id),
payments AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS payment_value
  FROM lineitem GROUP BY 1),
reviews AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, max(1 + CAST(l_quantity AS BIGINT) % 5) AS review_score
  FROM lineitem GROUP BY 1),
every_order AS (
  SELECT o.*, product_id, seller_id,
    coalesce(CAST(price AS DECIMAL(18,2)), 0) AS price,
    coalesce(CAST(freight_value AS DECIMAL(18,2)), 0) AS freight_value,
    payment_value, review_score,
    date_diff('microsecond', estimated_delivery, delivered_timestamp) / 86400e6 AS delay_days,
    coalesce(date_diff('microsecond', estimated_delivery, delivered_timestamp) > 0, false) AS is_late,
    category_name, seller_zip_code_prefix, seller_state, customer_zip_code_prefix, customer_state,
    CAST(date_trunc('week', purchase_timestamp) AS DATE) AS week_start
  FROM src_orders o
    LEFT JOIN first_items USING (order_id) LEFT JOIN payments USING (order_id) LEFT JOIN reviews USING (order_id)
    LEFT JOIN src_products USING (product_id) LEFT JOIN src_sellers USING (seller_id)
    LEFT JOIN src_customers USING (customer_id)),
facts AS (SELECT * FROM every_order WHERE order_status = 'delivered')
"""
)


def _vincenty(source: str, keep: str, steps: int = 8) -> str:
    """CTEs of the inverse geodesic iteration over ``source``, one per step."""
    f = "(1 / 298.257223563::DOUBLE)"
    parts = [
        f"""v0 AS (
  SELECT {keep}, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, dl, dl AS lam FROM (
    SELECT {keep}, atan((1 - {f}) * tan(radians(a))) AS u1, atan((1 - {f}) * tan(radians(b))) AS u2,
      radians(abs(x - y)) AS dl FROM {source}))"""
    ]
    circle = """sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss,
      s1 * s2 + c1 * c2 * cos(lam) AS cs"""
    angle = "*, atan2(ss, cs) AS sig, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa"
    middle = "*, 1 - sa * sa AS ca2, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * s1 * s2 / (1 - sa * sa) END AS cm"
    for i in range(steps):
        parts.append(
            f"""v{i + 1} AS (
  SELECT * EXCLUDE (lam, ss, cs, sig, sa, ca2, cm, cc),
    dl + (1 - cc) * {f} * sa * (sig + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM (
    SELECT *, {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS cc FROM (
      SELECT {middle} FROM (SELECT {angle} FROM (SELECT *, {circle} FROM v{i})))))"""
        )
    parts.append(
        f"""lengths AS (
  SELECT {keep}, 6356.752314245 * aa * (sig - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1)
      - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS km FROM (
    SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa,
      uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM (
      SELECT *, ca2 * ((6378.137::DOUBLE / 6356.752314245) ** 2 - 1) AS uu FROM (
        SELECT {middle} FROM (SELECT {angle} FROM (SELECT *, {circle} FROM v{steps}))))))"""
    )
    return ",\n".join(parts)


ENRICHED = (
    FACTS
    + """,
points AS (SELECT zip, unnest(min({'lat': lat, 'lng': lng})) FROM src_geo GROUP BY zip),
pairs AS (
  SELECT p.zip AS sz, q.zip AS cz, p.lat AS a, p.lng AS x, q.lat AS b, q.lng AS y FROM points p CROSS JOIN points q),
"""
    + _vincenty("pairs", "sz, cz")
    + """,
delivered_rate AS (SELECT seller_id, count(*) FILTER (is_late) / count(*) AS rate FROM facts GROUP BY 1),
located AS (
  SELECT e.*, p.lat AS seller_lat, p.lng AS seller_lng, q.lat AS customer_lat, q.lng AS customer_lng,
    km AS distance_km, isodow(purchase_timestamp) - 1 AS day_of_week, month(purchase_timestamp) AS month,
    CASE WHEN km <> 0 THEN CAST(freight_value AS DOUBLE) / km END AS cost_per_km
  FROM every_order e LEFT JOIN points p ON p.zip = seller_zip_code_prefix
    LEFT JOIN points q ON q.zip = customer_zip_code_prefix
    LEFT JOIN lengths ON sz = seller_zip_code_prefix AND cz = customer_zip_code_prefix),
enriched AS (
  SELECT located.*, rate AS seller_historical_delay_rate
  FROM located LEFT JOIN delivered_rate USING (seller_id) WHERE order_status = 'delivered'),
enriched_all AS (
  SELECT located.*, rate AS seller_historical_delay_rate FROM located LEFT JOIN delivered_rate USING (seller_id))
"""
)

SCORE = """round(0.5 * least(coalesce(distance_km, 0) / 2500, 1) + 0.3 * (day_of_week / 6)
  + 0.2 * least(coalesce(seller_historical_delay_rate, 0) * 3, 1), 6)"""

SCORED = (
    ENRICHED
    + f""",
scored AS (SELECT *, {SCORE} AS p, CAST(is_late AS INTEGER) AS label FROM enriched),
scored_all AS (SELECT *, {SCORE} AS p FROM enriched_all),
flagged AS (
  SELECT order_id, seller_id, category_name, seller_state, customer_state, round(distance_km, 3) AS distance_km,
    p AS delay_probability, estimated_delivery,
    CAST(floor(date_diff('microsecond', TIMESTAMP '{AS_OF}', estimated_delivery) / 86400e6) AS BIGINT)
      AS days_until_delivery
  FROM scored_all WHERE order_status IN ('created', 'shipped', 'approved') AND p >= 0.65),
matrix AS (
  SELECT count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
    count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) FILTER (label = 0 AND p < 0.5) AS tn FROM scored)
"""
)

VERSIONS = (
    FACTS
    + """,
versions AS (
  SELECT 'v' || year(purchase_timestamp) AS version, max(purchase_timestamp) AS trained_at,
    round(1 - count(*) FILTER (is_late) / count(*), 6) AS accuracy, 0.65::DOUBLE AS threshold
  FROM facts GROUP BY year(purchase_timestamp) HAVING year(purchase_timestamp) <= 1997),
active AS (SELECT * FROM versions ORDER BY trained_at DESC, version DESC LIMIT 1)
"""
)


def _q(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


CLEAN_COLUMNS = """order_id, customer_id, purchase_timestamp, delivered_timestamp, estimated_delivery, product_id,
  seller_id, CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value,
  CAST(payment_value AS DOUBLE) AS payment_value, review_score, round(delay_days, 6) AS delay_days, is_late,
  category_name, seller_zip_code_prefix, seller_state, customer_zip_code_prefix, customer_state"""

LISTING = """SELECT order_id, seller_id, seller_state, customer_state, category_name, is_late,
  round(delay_days, 6) AS delay_days, CAST(freight_value AS DOUBLE) AS freight_value,
  round(distance_km, 3) AS distance_km, purchase_timestamp, delivered_timestamp FROM enriched"""

DETAILS = """order_id, seller_id, coalesce(seller_state, '') AS seller_state,
  coalesce(customer_state, '') AS customer_state, category_name, is_late, round(delay_days, 6) AS delay_days,
  CAST(freight_value AS DOUBLE) AS freight_value, purchase_timestamp, delivered_timestamp"""

NEWEST = "ORDER BY purchase_timestamp DESC NULLS FIRST, order_id"

COPIED = (
    SOURCES
    + """,
copied AS (
  SELECT order_id, customer_id, order_status, 0 AS copy FROM src_orders
  UNION ALL SELECT order_id, customer_id, CASE order_status WHEN 'created' THEN 'delivered' ELSE 'canceled' END, 1
  FROM src_orders WHERE order_status <> 'delivered'
  UNION ALL SELECT NULL, customer_id, order_status, 1 FROM src_orders WHERE order_status = 'created')
"""
)

TEXT_ORDERS = (
    SOURCES
    + """,
texts AS (
  SELECT order_id, order_status, strftime(purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS bought,
    strftime(delivered_timestamp, '%Y-%m-%d %H:%M:%S') AS delivered FROM src_orders)
"""
)

SELLER_STATS = """SELECT seller_id, min(seller_state) AS seller_state, count(order_id) AS total_orders,
  round(count(*) FILTER (is_late) / count(*), 6) AS delay_rate, round(avg(delay_days), 6) AS avg_delay_days,
  round(CAST(sum(freight_value) AS DOUBLE) / count(*), 6) AS avg_cost
  FROM facts WHERE seller_id IS NOT NULL GROUP BY seller_id"""

SCORECARD = """SELECT seller_id, min(seller_state) AS seller_state, count(is_late) AS total_orders,
  round(count(*) FILTER (is_late) / count(*), 6) AS delay_rate,
  round(avg(delay_days) FILTER (is_late), 6) AS avg_delay_days,
  round(CAST(sum(freight_value) AS DOUBLE) / count(*), 6) AS avg_cost
  FROM facts WHERE seller_id IS NOT NULL GROUP BY seller_id"""

SUMMARY = """SELECT round(100 * count(*) FILTER (NOT is_late) / count(*), 4) AS otif_rate,
  round(avg(delay_days) FILTER (is_late), 4) AS avg_delay_days,
  round(100 * (SELECT count(*) FILTER (order_status = 'delivered') / count(*) FROM src_orders), 4)
    AS fulfillment_rate,
  round(CAST(sum(freight_value) AS DOUBLE) / count(*), 4) AS avg_cost_per_shipment,
  count(*) AS total_shipments, count(*) FILTER (is_late) AS late_shipments,
  round((SELECT first(r ORDER BY week_start DESC) - last(r ORDER BY week_start DESC) FROM (
    SELECT week_start, 100 * count(*) FILTER (NOT is_late) / count(*) AS r FROM facts GROUP BY 1
    ORDER BY 1 DESC LIMIT 2)), 4) AS week_over_week_otif_delta FROM facts"""

PROFILE = f"""SELECT s.*, t.week_start, round(w.r, 6) AS otif_rate FROM ({SELLER_STATS}) s JOIN (
    SELECT seller_id, CAST(unnest(generate_series(max(week_start) - 49, max(week_start), INTERVAL 7 DAY)) AS DATE)
      AS week_start FROM facts WHERE seller_id IS NOT NULL GROUP BY 1) t USING (seller_id)
  LEFT JOIN (SELECT seller_id, week_start, 100 * count(*) FILTER (NOT is_late) / count(*) AS r FROM facts GROUP BY 1, 2) w
    USING (seller_id, week_start)"""

IN_TRANSIT = """SELECT order_id, seller_id, category_name, seller_state, customer_state,
  round(distance_km, 3) AS distance_km, round(seller_historical_delay_rate, 6) AS seller_historical_delay_rate,
  CAST(day_of_week AS BIGINT) AS day_of_week, CAST(month AS BIGINT) AS month,
  CAST(freight_value AS DOUBLE) AS freight_value, CAST(price AS DOUBLE) AS price, estimated_delivery
  FROM enriched_all WHERE delivered_timestamp IS NULL"""

THIS_WEEK = f"purchase_timestamp >= TIMESTAMP '{WEEK}' AND purchase_timestamp < TIMESTAMP '{WEEK}' + INTERVAL 7 DAY"
PRIOR_WEEK = f"purchase_timestamp >= TIMESTAMP '{WEEK}' - INTERVAL 7 DAY AND purchase_timestamp < TIMESTAMP '{WEEK}'"

REPORT_TREND = """SELECT week_start, round(100 * count(*) FILTER (NOT is_late) / count(*), 2) AS otif_rate
  FROM facts WHERE purchase_timestamp >= TIMESTAMP '{week}' - INTERVAL 49 DAY {more} GROUP BY 1"""

REPORT = """round(100 * {hit} / nullif({hit} + {wrong}, 0), 6)"""

DECISION = """SELECT version AS active_version, accuracy AS stored_accuracy, new_rows, recent_rows,
  round(late_rate, 6) AS recent_late_rate, round(abs(accuracy - (1 - late_rate)), 6) AS late_rate_drift,
  CASE WHEN version IS NULL THEN 'no_active_model' WHEN new_rows >= {minimum} THEN 'new_rows'
    WHEN recent_rows = 0 THEN 'no_recent_rows' WHEN abs(accuracy - (1 - late_rate)) > 0.22 THEN 'late_rate_drift'
    WHEN accuracy < 0.78 THEN 'low_accuracy' ELSE 'up_to_date' END AS reason,
  CASE WHEN version IS NULL OR new_rows >= {minimum} THEN true WHEN recent_rows = 0 THEN false
    ELSE abs(accuracy - (1 - late_rate)) > 0.22 OR accuracy < 0.78 END AS retrain
  FROM active, (SELECT count(*) FILTER (purchase_timestamp > (SELECT trained_at FROM active)) AS new_rows,
    count(*) FILTER (recent) AS recent_rows,
    count(*) FILTER (recent AND is_late) / nullif(count(*) FILTER (recent), 0) AS late_rate
    FROM (SELECT *, purchase_timestamp >= TIMESTAMP '1997-06-15' - INTERVAL 30 DAY AS recent FROM facts))"""

REQUESTS = (
    SOURCES
    + """,
requests AS (
  SELECT concat_ws('-', order_id, order_item_id, product_id, seller_id) AS request_id, freight_value * 10 - 20 AS distance_km, CASE WHEN order_item_id <> 3 THEN 'small' END AS category_name,
    order_item_id AS day_of_week, coalesce(CASE WHEN order_item_id <> 2 THEN order_item_id * 2 END, 1) AS month,
    freight_value, price,
    coalesce(CASE WHEN order_item_id <> 5 THEN price / 80000 END, 0.1) AS seller_historical_delay_rate
  FROM src_items),
checked AS (
  SELECT *, concat_ws(',', CASE WHEN distance_km < 0 THEN 'distance_km' END,
    CASE WHEN day_of_week NOT BETWEEN 0 AND 6 THEN 'day_of_week' END,
    CASE WHEN month NOT BETWEEN 1 AND 12 THEN 'month' END,
    CASE WHEN freight_value < 0 THEN 'freight_value' END, CASE WHEN price < 0 THEN 'price' END,
    CASE WHEN seller_historical_delay_rate NOT BETWEEN 0 AND 1 THEN 'seller_historical_delay_rate' END,
    CASE WHEN category_name IS NULL THEN 'category_name' END) AS violations FROM requests)
"""
)

RISK = "CASE WHEN {p} > 0.8 THEN 'high' WHEN {p} >= 0.65 THEN 'medium' ELSE 'low' END"


def _vocab(name: str, column: str, source: str) -> str:
    return f"""{name} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (
  SELECT DISTINCT coalesce({column}, 'unknown') AS v FROM {source}))"""


VOCABS = _vocab("cats", "category_name", "facts") + ",\n" + _vocab("states", "seller_state", "facts")
CODED = """LEFT JOIN cats ON cats.v = coalesce(category_name, 'unknown')
  LEFT JOIN states ON states.v = coalesce(seller_state, 'unknown')"""

LEARNED = """learned AS (
  SELECT * FROM facts WHERE purchase_timestamp >= TIMESTAMP '1997-01-01' AND purchase_timestamp < TIMESTAMP '1997-02-01'
    AND category_name < 'p')"""

ORACLES = {
    "orders_dedup": _q(
        COPIED,
        """SELECT order_id, customer_id, order_status, CAST(copy AS BIGINT) AS copy FROM copied
        WHERE order_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY copy, order_status) = 1""",
    ),
    "order_first_item": _q(FACTS, "SELECT order_id, product_id, seller_id, price, freight_value FROM first_items"),
    "order_payments_sum": _q(FACTS, "SELECT order_id, CAST(payment_value AS DOUBLE) AS payment_value FROM payments"),
    "order_reviews_max": _q(FACTS, "SELECT * FROM reviews"),
    "category_translated": _q(SOURCES, "SELECT * FROM src_products"),
    "shipments_clean": _q(FACTS, f"SELECT {CLEAN_COLUMNS} FROM facts"),
    "all_orders_delay": _q(
        FACTS,
        """SELECT order_id, customer_id, order_status, purchase_timestamp, delivered_timestamp, estimated_delivery,
        seller_id, round(delay_days, 6) AS delay_days, is_late FROM every_order""",
    ),
    "timestamps_coerced": _q(
        SOURCES,
        """SELECT order_id, CASE order_status WHEN 'shipped' THEN purchase_timestamp + INTERVAL 3 HOUR
        WHEN 'delivered' THEN purchase_timestamp END AS order_purchase_timestamp,
        delivered_timestamp AS order_delivered_customer_date FROM src_orders""",
    ),
    "coercion_audit": _q(
        TEXT_ORDERS,
        """SELECT 'order_purchase_timestamp' AS column_name, count(*) FILTER (order_status = 'created')
        AS coerced_to_null FROM texts UNION ALL SELECT 'order_delivered_customer_date', 0""",
    ),
    "clean_audit": _q(
        COPIED,
        """SELECT count(*) AS raw_rows, count(*) FILTER (order_id IS NULL) AS null_key_rows,
        count(order_id) - count(DISTINCT order_id) AS duplicate_rows, count(DISTINCT order_id) AS orders,
        count(*) FILTER (kept AND order_status = 'delivered') AS delivered_orders,
        round(100 * count(*) FILTER (kept AND order_status = 'delivered') / count(DISTINCT order_id), 6)
          AS delivered_pct
        FROM (SELECT *, order_id IS NOT NULL
          AND row_number() OVER (PARTITION BY order_id ORDER BY copy, order_status) = 1 AS kept FROM copied)""",
    ),
    "late_audit": _q(
        FACTS,
        """SELECT count(*) AS delivered_rows, count(*) FILTER (is_late) AS late_rows,
        round(100 * count(*) FILTER (is_late) / count(*), 6) AS late_pct FROM facts""",
    ),
    "rejected_shipments": _q(
        FACTS,
        """SELECT order_id, customer_id, seller_id, 'seller_id' AS reject_reason FROM facts WHERE seller_id IS NULL""",
    ),
    "zip_first_coord": _q(
        ENRICHED,
        "SELECT zip AS zip_code_prefix, round(lat, 6) AS lat, round(lng, 6) AS lng FROM points",
    ),
    "geo_joined": _q(
        ENRICHED,
        """SELECT order_id, round(seller_lat, 6) AS seller_lat, round(seller_lng, 6) AS seller_lng,
        round(customer_lat, 6) AS customer_lat, round(customer_lng, 6) AS customer_lng FROM enriched""",
    ),
    "geodesic_distance": _q(ENRICHED, "SELECT order_id, round(distance_km, 3) AS distance_km FROM enriched"),
    "missing_coord_count": _q(
        ENRICHED,
        """SELECT count(*) FILTER (seller_lat IS NULL OR customer_lat IS NULL) AS missing_rows,
        count(*) FILTER (seller_lat IS NOT NULL AND customer_lat IS NOT NULL) AS located_rows FROM enriched""",
    ),
    "temporal_features": _q(
        FACTS,
        """SELECT order_id, isodow(purchase_timestamp) - 1 AS day_of_week, month(purchase_timestamp) AS month
        FROM facts""",
    ),
    "seller_delay_rate": _q(
        ENRICHED,
        """SELECT order_id, round(rate, 6) AS seller_historical_delay_rate
        FROM facts LEFT JOIN delivered_rate USING (seller_id)""",
    ),
    "seller_past_delay_rate": _q(
        FACTS,
        """SELECT order_id, round(CASE WHEN seller_id IS NOT NULL AND delivered_timestamp IS NOT NULL THEN
          sum(CAST(is_late AS INTEGER)) OVER w / nullif(count(*) OVER w, 0) END, 6) AS seller_past_delay_rate FROM facts
        WINDOW w AS (PARTITION BY seller_id ORDER BY CAST(delivered_timestamp AS DATE)
          RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
    ),
    "cost_per_km": _q(ENRICHED, "SELECT order_id, round(cost_per_km, 6) AS cost_per_km FROM enriched"),
    "shipments_enriched": _q(
        ENRICHED,
        f"""SELECT {CLEAN_COLUMNS}, round(seller_lat, 6) AS seller_lat, round(seller_lng, 6) AS seller_lng,
        round(customer_lat, 6) AS customer_lat, round(customer_lng, 6) AS customer_lng,
        round(distance_km, 3) AS distance_km, round(cost_per_km, 6) AS cost_per_km,
        CAST(day_of_week AS BIGINT) AS day_of_week, CAST(month AS BIGINT) AS month,
        round(seller_historical_delay_rate, 6) AS seller_historical_delay_rate FROM enriched""",
    ),
    "kpi_daily": _q(
        FACTS,
        """SELECT CAST(purchase_timestamp AS DATE) AS date,
        round(count(*) FILTER (NOT is_late) / count(*), 6) AS otif_rate, round(avg(delay_days), 6) AS avg_delay_days,
        1.0::DOUBLE AS fulfillment_rate,
        round(CAST(sum(freight_value) AS DOUBLE) / count(*), 6) AS avg_cost_per_shipment,
        count(order_id) AS total_shipments, CAST(0 AS BIGINT) AS flagged_count FROM facts GROUP BY 1""",
    ),
    "seller_stats": _q(FACTS, SELLER_STATS),
    "load_summary": _q(
        FACTS,
        """SELECT count(*) AS shipments, count(DISTINCT CAST(purchase_timestamp AS DATE)) AS kpi_days,
        count(DISTINCT seller_id) AS sellers FROM facts""",
    ),
    "otif": _q(FACTS, "SELECT round(100 * count(*) FILTER (NOT is_late) / count(*), 6) AS otif_rate FROM facts"),
    "avg_delay_scalar": _q(FACTS, "SELECT round(avg(delay_days) FILTER (is_late), 6) AS avg_delay_days FROM facts"),
    "avg_delay_all": _q(FACTS, "SELECT round(avg(delay_days), 6) AS avg_delay_days FROM facts"),
    "avg_delay_by_seller": _q(
        FACTS,
        """SELECT seller_id, round(avg(delay_days), 6) AS avg_delay_days FROM facts
        WHERE is_late AND seller_id IS NOT NULL GROUP BY 1""",
    ),
    "fulfillment_rate": _q(
        SOURCES,
        """SELECT round(100 * count(*) FILTER (order_status = 'delivered') / count(*), 6) AS fulfillment_rate
        FROM src_orders""",
    ),
    "cost_per_shipment": _q(
        FACTS, "SELECT round(CAST(sum(freight_value) AS DOUBLE) / count(*), 6) AS avg_cost_per_shipment FROM facts"
    ),
    "weekly_otif_trend": _q(
        FACTS,
        """SELECT spine.week_start, round(r, 6) AS otif_rate FROM (
          SELECT CAST(unnest(generate_series(max(week_start) - 77, max(week_start), INTERVAL 7 DAY)) AS DATE)
            AS week_start FROM facts) spine
        LEFT JOIN (SELECT week_start, 100 * count(*) FILTER (NOT is_late) / count(*) AS r FROM facts GROUP BY 1)
          USING (week_start)""",
    ),
    "delay_by_category": _q(
        FACTS,
        """SELECT category_name, round(avg(delay_days) FILTER (is_late), 6) AS avg_delay_days,
        count(*) AS order_count FROM facts WHERE category_name IS NOT NULL GROUP BY 1""",
    ),
    "top10_delay_categories": _q(
        FACTS,
        """SELECT substr(replace(category_name, '_', ' '), 1, 22) AS category, round(d, 2) AS avg_delay_days,
        order_count, CASE WHEN round(d, 2) > 5 THEN 'red' WHEN round(d, 2) >= 2 THEN 'amber' ELSE 'green' END AS band
        FROM (SELECT category_name, avg(delay_days) FILTER (is_late) AS d, count(*) AS order_count
          FROM facts WHERE category_name IS NOT NULL GROUP BY 1)
        WHERE d IS NOT NULL ORDER BY d DESC, category_name LIMIT 10""",
    ),
    "seller_scorecard": _q(FACTS, SCORECARD),
    "seller_scorecard_top": _q(
        FACTS, f"SELECT * FROM ({SCORECARD}) ORDER BY avg_delay_days ASC NULLS LAST, seller_id LIMIT 25"
    ),
    "seller_rate_bands": _q(
        FACTS,
        f"""SELECT CASE WHEN delay_rate > 0.4 THEN 'red' WHEN delay_rate >= 0.2 THEN 'amber' ELSE 'green' END AS band,
        count(*) AS sellers, CAST(sum(total_orders) AS BIGINT) AS orders FROM ({SCORECARD}) GROUP BY 1""",
    ),
    "wow_otif_delta": _q(FACTS, f"SELECT week_over_week_otif_delta FROM ({SUMMARY})"),
    "kpi_summary": _q(FACTS, SUMMARY),
    "kpi_summary_empty": _q(
        FACTS,
        """SELECT 0.0::DOUBLE AS otif_rate, 0.0::DOUBLE AS avg_delay_days,
        round(100 * (SELECT count(*) FILTER (order_status = 'delivered') / count(*) FROM src_orders), 4)
          AS fulfillment_rate, 0.0::DOUBLE AS avg_cost_per_shipment,
        CAST(0 AS BIGINT) AS total_shipments, CAST(0 AS BIGINT) AS late_shipments,
        CAST(NULL AS DOUBLE) AS week_over_week_otif_delta""",
    ),
    "seller_profile": _q(FACTS, PROFILE),
    "seller_profile_one": _q(FACTS, f"SELECT * FROM ({PROFILE}) WHERE seller_id = '7'"),
    "kpi_range_check": _q(
        FACTS,
        f"""UNPIVOT (SELECT count(*) FILTER (NOT otif_rate BETWEEN 0 AND 100) AS otif_rate,
          count(*) FILTER (NOT fulfillment_rate BETWEEN 0 AND 100) AS fulfillment_rate,
          count(*) FILTER (avg_cost_per_shipment < 0) AS avg_cost_per_shipment,
          count(*) FILTER (total_shipments < 0) AS total_shipments,
          count(*) FILTER (late_shipments < 0) AS late_shipments FROM ({SUMMARY}))
        ON COLUMNS(*) INTO NAME column_name VALUE violations""",
    ),
    "kpi_scan": _q(
        ENRICHED,
        """SELECT order_id, seller_id, seller_state, customer_state, round(distance_km, 3) AS distance_km,
        round(delay_days, 6) AS delay_days, is_late, CAST(freight_value AS DOUBLE) AS freight_value, category_name,
        purchase_timestamp, delivered_timestamp FROM enriched""",
    ),
    "all_orders_scan": _q(
        ENRICHED,
        """SELECT order_id, seller_id, seller_state, customer_state, round(distance_km, 3) AS distance_km,
        round(delay_days, 6) AS delay_days, is_late, CAST(freight_value AS DOUBLE) AS freight_value, category_name,
        purchase_timestamp, delivered_timestamp, order_status FROM enriched_all""",
    ),
    "labelled_scan": _q(
        ENRICHED,
        """SELECT order_id, purchase_timestamp, round(distance_km, 3) AS distance_km,
        round(seller_historical_delay_rate, 6) AS seller_historical_delay_rate, day_of_week, month, category_name,
        seller_state, freight_value, price, is_late FROM enriched""",
    ),
    "shipments_late": _q(ENRICHED, f"{LISTING} WHERE is_late"),
    "shipments_by_state": _q(ENRICHED, f"{LISTING} WHERE seller_state = 'N7'"),
    "shipments_date_range": _q(
        ENRICHED,
        f"{LISTING} WHERE purchase_timestamp BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'",
    ),
    "shipments_search": _q(
        ENRICHED, f"{LISTING} WHERE NOT is_late AND (order_id ILIKE '%42%' OR seller_id ILIKE '%42%')"
    ),
    "shipments_category": _q(ENRICHED, f"{LISTING} WHERE is_late AND category_name = 'small'"),
    "shipments_page": _q(
        ENRICHED,
        f"SELECT {DETAILS}, round(distance_km, 3) AS distance_km FROM enriched {NEWEST} LIMIT 50 OFFSET 100",
    ),
    "shipments_page_after": _q(
        ENRICHED,
        f"""SELECT {DETAILS}, round(distance_km, 3) AS distance_km FROM enriched
        WHERE purchase_timestamp < TIMESTAMP '1997-06-01'
          OR (purchase_timestamp = TIMESTAMP '1997-06-01' AND order_id > '5') {NEWEST} LIMIT 50""",
    ),
    "shipments_page_count": _q(
        FACTS,
        "SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM facts WHERE is_late",
    ),
    "seller_shipments_page": _q(
        ENRICHED,
        f"SELECT {DETAILS}, round(distance_km, 3) AS distance_km FROM enriched WHERE seller_id = '7' {NEWEST} LIMIT 20",
    ),
    "shipment_lookup": _q(
        ENRICHED, f"SELECT {DETAILS}, round(distance_km, 3) AS distance_km FROM enriched WHERE order_id = '1'"
    ),
    "shipments_export": _q(
        ENRICHED,
        f"""SELECT * REPLACE (coalesce(seller_state, '') AS seller_state, coalesce(customer_state, '') AS customer_state,
        coalesce(category_name, '') AS category_name) FROM ({LISTING}) WHERE seller_state = 'N3'""",
    ),
    "in_transit": _q(ENRICHED, IN_TRANSIT),
    "report_week_metrics": _q(
        FACTS,
        f"""SELECT round(100 * coalesce((total - late) / nullif(total, 0), 0), 2) AS otif_rate,
        round(coalesce(d, 0), 2) AS avg_delay_days, round(coalesce(c, 0), 2) AS avg_cost,
        round(100 * coalesce((total - late) / nullif(total, 0), 0), 2) AS on_time_share,
        total AS total_shipments, late AS late_count,
        round(100 * (coalesce((total - late) / nullif(total, 0), 0) - (prior - prior_late) / nullif(prior, 0)), 2)
          AS wow_delta
        FROM (SELECT count(*) FILTER ({THIS_WEEK}) AS total, count(*) FILTER (is_late AND {THIS_WEEK}) AS late,
          avg(delay_days) FILTER ({THIS_WEEK}) AS d,
          CAST(sum(freight_value + price) FILTER ({THIS_WEEK}) AS DOUBLE) / nullif(count(*) FILTER ({THIS_WEEK}), 0) AS c,
          count(*) FILTER ({PRIOR_WEEK}) AS prior, count(*) FILTER (is_late AND {PRIOR_WEEK}) AS prior_late FROM facts)""",
    ),
    "report_otif_trend": _q(FACTS, REPORT_TREND.format(week=WEEK, more="")),
    "report_otif_trend_bounded": _q(
        FACTS,
        REPORT_TREND.format(week=WEEK, more=f"AND purchase_timestamp < TIMESTAMP '{WEEK}' + INTERVAL 7 DAY"),
    ),
    "report_critical_sellers": _q(
        FACTS,
        f"""SELECT CASE WHEN length(seller_id) > 16 THEN substr(seller_id, 1, 16) || '…' ELSE seller_id END AS seller_id,
        coalesce(nullif(seller_state, ''), '—') AS state, total, late, round(100 * late / total, 1) AS delay_rate,
        coalesce(round(d, 1), 0) AS avg_delay, coalesce(round(c, 2), 0) AS avg_cost
        FROM (SELECT seller_id, seller_state, count(*) AS total, count(*) FILTER (is_late) AS late,
          avg(delay_days) FILTER (delay_days > 0) AS d, CAST(sum(freight_value + price) AS DOUBLE) / count(*) AS c
          FROM facts WHERE {THIS_WEEK} GROUP BY 1, 2 HAVING count(*) >= 2)
        ORDER BY late / total DESC, seller_id, seller_state LIMIT 5""",
    ),
    "report_flagged": _q(
        FACTS,
        f"""SELECT substr(order_id, 1, 20) AS order_id, substr(seller_id, 1, 14) AS seller_id,
        coalesce(nullif(seller_state, ''), '—') AS seller_state, coalesce(nullif(customer_state, ''), '—') AS cust_state,
        substr(coalesce(nullif(category_name, ''), '—'), 1, 24) AS category, coalesce(round(delay_days, 6), 0) AS delay_days,
        round(CAST(freight_value + price AS DOUBLE), 6) AS total_value
        FROM (SELECT * FROM facts WHERE is_late AND {THIS_WEEK} ORDER BY delay_days DESC NULLS LAST, order_id LIMIT 200)""",
    ),
    "iso_week_label": """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day,
        CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
        CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_end,
        CAST(date_trunc('week', o_orderdate) AS DATE) - 7 AS prior_week,
        strftime(o_orderdate, '%G-W%V') AS iso_week FROM orders""",
    "latest_data_week": _q(
        FACTS,
        """SELECT CAST(d AS DATE) AS date, CAST(date_trunc('week', d) AS DATE) AS week_start,
        CAST(date_trunc('week', d) AS DATE) + 6 AS week_end, strftime(d, '%G-W%V') AS iso_week
        FROM (SELECT max(purchase_timestamp) AS d FROM facts)""",
    ),
    "imputation_stats": _q(
        ENRICHED,
        """SELECT round(median(distance_km), 6) AS distance_median,
        round(avg(seller_historical_delay_rate), 6) AS rate_mean FROM enriched""",
    ),
    "label_vocab": _q(
        FACTS + ",\n" + VOCABS,
        """SELECT 'category_name' AS "column", v AS value, code FROM cats
        UNION ALL SELECT 'seller_state', v, code FROM states""",
    ),
    "feature_matrix": _q(
        ENRICHED + ",\n" + VOCABS,
        f"""SELECT order_id,
        round(coalesce(distance_km, (SELECT median(distance_km) FROM enriched)), 3) AS distance_km,
        round(coalesce(seller_historical_delay_rate, (SELECT avg(seller_historical_delay_rate) FROM enriched)), 6)
          AS seller_historical_delay_rate,
        CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(month AS DOUBLE) AS month,
        CAST(cats.code AS DOUBLE) AS category_encoded, CAST(states.code AS DOUBLE) AS seller_state_encoded,
        CAST(freight_value AS DOUBLE) AS freight_value, CAST(price AS DOUBLE) AS price,
        CAST(is_late AS BIGINT) AS label FROM enriched {CODED}""",
    ),
    "unseen_encoding": _q(
        f"{FACTS},\n{LEARNED},\n{_vocab('cats', 'category_name', 'learned')},\n{_vocab('states', 'seller_state', 'learned')}",
        f"""SELECT order_id, coalesce(cats.code, -1) AS category_encoded, coalesce(states.code, -1) AS seller_state_encoded
        FROM facts {CODED}""",
    ),
    "inference_features": _q(
        ENRICHED + ",\n" + VOCABS,
        f"""SELECT order_id, round(coalesce(distance_km, 0), 3) AS distance_km,
        round(coalesce(seller_historical_delay_rate, 0), 6) AS seller_historical_delay_rate,
        CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(month AS DOUBLE) AS month,
        CAST(coalesce(cats.code, -1) AS DOUBLE) AS category_encoded,
        CAST(coalesce(states.code, -1) AS DOUBLE) AS seller_state_encoded,
        CAST(freight_value AS DOUBLE) AS freight_value, CAST(price AS DOUBLE) AS price
        FROM enriched_all {CODED} WHERE delivered_timestamp IS NULL""",
    ),
    "class_weights": _q(
        FACTS,
        """SELECT CAST(is_late AS BIGINT) AS label, count(*) AS n,
        round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM facts GROUP BY is_late""",
    ),
    "stratified_split": _q(
        FACTS,
        """SELECT order_id, CAST(is_late AS BIGINT) AS label,
        CASE WHEN row_number() OVER (PARTITION BY is_late ORDER BY md5(order_id || '-42'))
          <= round(0.2 * count(*) OVER (PARTITION BY is_late)) THEN 'test' ELSE 'train' END AS part FROM facts""",
    ),
    "holdout_tail": _q(
        FACTS,
        """SELECT order_id, purchase_timestamp, CAST(is_late AS BIGINT) AS label FROM facts
        QUALIFY row_number() OVER (ORDER BY purchase_timestamp DESC, order_id DESC)
          <= greatest(50, CAST(floor((SELECT count(*) FROM facts) * 0.10) AS BIGINT))""",
    ),
    "scored_batch": _q(
        SCORED, "SELECT order_id, p AS delay_probability, p >= 0.5 AS predicted_late FROM scored"
    ),
    "flagged_shipments": _q(SCORED, "SELECT * FROM flagged"),
    "flagged_top": _q(
        SCORED,
        f"""SELECT order_id, p AS delay_probability,
        CAST(floor(date_diff('microsecond', TIMESTAMP '{AS_OF}', estimated_delivery) / 86400e6) AS BIGINT)
          AS days_until_delivery FROM scored_all WHERE delivered_timestamp IS NULL AND p >= 0.65
        ORDER BY p DESC, order_id LIMIT 100""",
    ),
    "alert_stats": _q(
        SCORED,
        """SELECT count(*) AS total_flagged, count(*) FILTER (delay_probability > 0.8) AS high_risk,
        count(*) FILTER (delay_probability BETWEEN 0.65 AND 0.8) AS medium_risk,
        round(coalesce(avg(delay_probability), 0), 6) AS avg_probability FROM flagged""",
    ),
    "risk_levels": _q(SCORED, f"SELECT {RISK.format(p='p')} AS risk_level, count(*) AS n FROM scored GROUP BY 1"),
    "risk_filter": _q(
        SCORED, "SELECT order_id, p AS delay_probability, 'high' AS risk_level FROM scored WHERE p > 0.8"
    ),
    "scored_listing": _q(
        SCORED,
        f"""SELECT {DETAILS}, round(distance_km, 3) AS distance_km, p AS prediction_probability
        FROM scored WHERE is_late {NEWEST} LIMIT 50 OFFSET 50""",
    ),
    "unscored_listing": _q(
        ENRICHED,
        f"""SELECT {DETAILS}, round(distance_km, 3) AS distance_km, CAST(NULL AS DOUBLE) AS prediction_probability
        FROM enriched {NEWEST} LIMIT 10""",
    ),
    "confusion_metrics": _q(
        SCORED,
        """SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
        round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_late,
        round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_late,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_late FROM matrix""",
    ),
    "roc_auc_rank": _q(
        SCORED,
        """SELECT round((sum(r) FILTER (label = 1) - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS roc_auc FROM (
          SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r,
            sum(label) OVER () AS pos, count(*) OVER () AS n FROM scored) GROUP BY pos, n""",
    ),
    "classification_report": _q(
        SCORED,
        """, per_class AS (
          SELECT 'on_time' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS pr, coalesce(tn / nullif(tn + fp, 0), 0) AS re,
            coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1, tn + fp AS support FROM matrix
          UNION ALL SELECT 'late', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
            coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM matrix)
        SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1_score, support FROM per_class
        UNION ALL SELECT 'accuracy', round((tp + tn) / (tp + fp + fn + tn), 6), round((tp + tn) / (tp + fp + fn + tn), 6),
          round((tp + tn) / (tp + fp + fn + tn), 6), tp + fp + fn + tn FROM matrix
        UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6),
          CAST(sum(support) AS BIGINT) FROM per_class
        UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6),
          round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
          CAST(sum(support) AS BIGINT) FROM per_class""",
    ),
    "input_violations": _q(
        REQUESTS, "SELECT request_id, CAST(month AS BIGINT) AS month, violations FROM checked"
    ),
    "scored_requests": _q(
        REQUESTS,
        f"""SELECT request_id, p >= 0.5 AS predicted_late, {RISK.format(p='p')} AS risk_level
        FROM (SELECT request_id, {SCORE} AS p FROM checked WHERE violations = '')""",
    ),
    "active_model": _q(VERSIONS, "SELECT * FROM active"),
    "retrain_trigger": _q(VERSIONS, DECISION.format(minimum=1_000_000_000)),
    "retrain_new_rows": _q(VERSIONS, DECISION.format(minimum=10)),
}

ORACLES["shipments_page_deep"] = _q(
    ENRICHED,
    f"SELECT {DETAILS}, round(distance_km, 3) AS distance_km FROM enriched WHERE NOT is_late {NEWEST} LIMIT 40 OFFSET 280",
)

# Other ways to the same rows.
for _name, _same in {
    "rollup_kpi_summary": "kpi_summary",
    "rollup_scorecard": "seller_scorecard",
    "rollup_weekly_trend": "weekly_otif_trend",
    "rollup_delay_by_category": "delay_by_category",
    "rollup_week_metrics": "report_week_metrics",
    "rollup_critical_sellers": "report_critical_sellers",
    "shipments_page_ranked": "shipments_page",
    "shipments_enriched_bucketed": "shipments_enriched",
}.items():
    ORACLES[_name] = ORACLES[_same]

# Rows without a seller are kept aside by a load.
ORACLES["stored_kpi_daily"] = ORACLES["kpi_daily"].replace("FROM facts GROUP BY 1", "FROM facts WHERE seller_id IS NOT NULL GROUP BY 1")
ORACLES["stored_seller_stats"] = ORACLES["seller_stats"]
ORACLES["stored_search"] = _q(
    FACTS,
    """SELECT order_id, seller_id, purchase_timestamp FROM facts
    WHERE seller_id IS NOT NULL AND NOT is_late AND (order_id ILIKE '%142%' OR seller_id ILIKE '%142%')""",
)
