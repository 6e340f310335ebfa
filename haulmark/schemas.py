"""Column contracts of the source files and of the tables the package writes."""

from __future__ import annotations

# --- Fixed values: file stems and pinned column types of the nine source files. Columns
# --- that are not listed are read as strings. ------------------------------------------
SOURCE_FILES = {
    "orders": "olist_orders_dataset",
    "order_items": "olist_order_items_dataset",
    "products": "olist_products_dataset",
    "sellers": "olist_sellers_dataset",
    "customers": "olist_customers_dataset",
    "geolocation": "olist_geolocation_dataset",
    "order_payments": "olist_order_payments_dataset",
    "order_reviews": "olist_order_reviews_dataset",
    "category_translation": "product_category_name_translation",
}

SOURCE_TYPES = {
    "orders": {"order_id": "string", "customer_id": "string", "order_status": "string"},
    "order_items": {
        "order_id": "string",
        "order_item_id": "bigint",
        "product_id": "string",
        "seller_id": "string",
        "price": "double",
        "freight_value": "double",
    },
    "products": {"product_id": "string", "product_category_name": "string"},
    "sellers": {
        "seller_id": "string",
        "seller_zip_code_prefix": "string",
        "seller_city": "string",
        "seller_state": "string",
    },
    "customers": {
        "customer_id": "string",
        "customer_zip_code_prefix": "string",
        "customer_city": "string",
        "customer_state": "string",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "string",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
        "geolocation_city": "string",
        "geolocation_state": "string",
    },
    "order_payments": {
        "order_id": "string",
        "payment_sequential": "bigint",
        "payment_type": "string",
        "payment_installments": "bigint",
        "payment_value": "double",
    },
    "order_reviews": {"review_id": "string", "order_id": "string", "review_score": "bigint"},
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}

# --- Fixed values: the time columns of an order. -----------------------------------------
ORDER_TIMESTAMPS = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]

# --- Fixed values: canonical names of renamed columns. ----------------------------------
CANONICAL_NAMES = {
    "order_purchase_timestamp": "purchase_timestamp",
    "order_delivered_customer_date": "delivered_timestamp",
    "order_estimated_delivery_date": "estimated_delivery",
    "product_category_name_english": "category_name",
}

# --- Fixed values: target tables as (name, type, nullable). -----------------------------
SHIPMENTS = [
    ("order_id", "string", False),
    ("customer_id", "string", False),
    ("seller_id", "string", False),
    ("product_id", "string", True),
    ("category_name", "string", True),
    ("seller_state", "string", True),
    ("customer_state", "string", True),
    ("purchase_timestamp", "timestamp_ntz", True),
    ("delivered_timestamp", "timestamp_ntz", True),
    ("estimated_delivery", "timestamp_ntz", True),
    ("price", "decimal(18,2)", False),
    ("freight_value", "decimal(18,2)", False),
    ("payment_value", "decimal(18,2)", True),
    ("delay_days", "double", True),
    ("is_late", "boolean", False),
    ("distance_km", "double", True),
    ("cost_per_km", "double", True),
    ("day_of_week", "smallint", True),
    ("month", "smallint", True),
    ("seller_lat", "double", True),
    ("seller_lng", "double", True),
    ("customer_lat", "double", True),
    ("customer_lng", "double", True),
    ("seller_historical_delay_rate", "double", True),
    ("review_score", "smallint", True),
]

REJECTED = [(name, kind, True) for name, kind, _ in SHIPMENTS] + [("reject_reason", "string", True)]

ALL_ORDERS = [
    ("order_id", "string", False),
    ("customer_id", "string", True),
    ("order_status", "string", True),
    ("purchase_timestamp", "timestamp_ntz", True),
    ("delivered_timestamp", "timestamp_ntz", True),
    ("estimated_delivery", "timestamp_ntz", True),
    ("seller_id", "string", True),
    ("delay_days", "double", True),
    ("is_late", "boolean", True),
]

OPEN_SHIPMENTS = [
    ("order_status", "string", True),
    ("purchase_timestamp", "timestamp_ntz", True),
    ("delivered_timestamp", "timestamp_ntz", True),
    *[
        (name, kind, True)
        for name, kind, _ in SHIPMENTS
        if name
        in (
            "order_id", "seller_id", "category_name", "seller_state", "customer_state", "distance_km",
            "seller_historical_delay_rate", "day_of_week", "month", "freight_value", "price", "estimated_delivery",
        )
    ],
]

# What is known of an order so far; every column of a later part merges into it.
_ITEM = "struct<order_item_id:bigint,product_id:string,seller_id:string,price:double,freight_value:double>"
ORDER_STATES = [
    ("order_id", "string", False),
    ("place", "struct<load:int,_file:string,_block:bigint,_line:bigint>", True),
    ("customer_id", "string", True),
    ("order_status", "string", True),
    ("purchase_timestamp", "timestamp_ntz", True),
    ("order_approved_at", "timestamp_ntz", True),
    ("order_delivered_carrier_date", "timestamp_ntz", True),
    ("delivered_timestamp", "timestamp_ntz", True),
    ("estimated_delivery", "timestamp_ntz", True),
    *[(name, _ITEM, True) for name in ("_complete", "_product_id", "_seller_id", "_price", "_freight_value")],
    ("payment_value", "decimal(18,2)", True),
    ("review_score", "smallint", True),
]

# Scores of open shipments: what an alert shows, and the columns a status filter and the months need.
SCORES = [column for column in OPEN_SHIPMENTS if column[0] not in ("seller_historical_delay_rate", "day_of_week", "month", "freight_value", "price")]
SCORES = [*SCORES, ("delay_probability", "double", True)]

KPI_DAILY = [
    ("date", "date", False),
    ("otif_rate", "double", True),
    ("avg_delay_days", "double", True),
    ("fulfillment_rate", "double", True),
    ("avg_cost_per_shipment", "double", True),
    ("total_shipments", "bigint", True),
    ("flagged_count", "bigint", True),
]

SELLER_STATS = [
    ("seller_id", "string", False),
    ("seller_state", "string", True),
    ("total_orders", "bigint", True),
    ("delay_rate", "double", True),
    ("avg_delay_days", "double", True),
    ("avg_cost", "double", True),
]

# --- Fixed values: result layouts. ------------------------------------------------------
KPI_COLUMNS = [
    "order_id",
    "seller_id",
    "seller_state",
    "customer_state",
    "distance_km",
    "delay_days",
    "is_late",
    "freight_value",
    "category_name",
    "purchase_timestamp",
    "delivered_timestamp",
]

IN_TRANSIT_COLUMNS = [
    "order_id",
    "seller_id",
    "category_name",
    "seller_state",
    "customer_state",
    "distance_km",
    "seller_historical_delay_rate",
    "day_of_week",
    "month",
    "freight_value",
    "price",
    "estimated_delivery",
]

FLAGGED_COLUMNS = [
    ("order_id", "string"),
    ("seller_id", "string"),
    ("category_name", "string"),
    ("seller_state", "string"),
    ("customer_state", "string"),
    ("distance_km", "double"),
    ("delay_probability", "double"),
    ("estimated_delivery", "timestamp_ntz"),
    ("days_until_delivery", "bigint"),
]

EXPORT_COLUMNS = [
    "order_id",
    "seller_id",
    "seller_state",
    "customer_state",
    "category_name",
    "is_late",
    "delay_days",
    "freight_value",
    "distance_km",
    "purchase_timestamp",
    "delivered_timestamp",
]

FEATURE_COLUMNS = [
    "distance_km",
    "seller_historical_delay_rate",
    "day_of_week",
    "month",
    "category_encoded",
    "seller_state_encoded",
    "freight_value",
    "price",
]

LABEL_COLUMN = "is_late"
ACTIVE_STATUSES = ["created", "shipped", "approved"]
DEFAULT_THRESHOLD = 0.65

MODEL_RUNS = (
    "run_id string, run_name string, logged_at timestamp_ntz, params map<string,string>,"
    " metrics map<string,double>, importances map<string,double>, artifact_uri string"
)

MODEL_VERSIONS = (
    "version string, trained_at timestamp_ntz, accuracy double, precision_late double,"
    " recall_late double, f1_late double, threshold double, is_active boolean,"
    " storage_path string, notes string"
)
