"""Every registered query over the star-schema tables.

Each entry takes a session and a folder and returns a lazy frame (fitted models aside) over
the whole tables. Parameters such as a week or a page are fixed here so results repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import labels, numbers, times
from haulmark.operators import aggregates, audit, browse, cleaning, enrichment, kpi
from haulmark.operators import evaluation as ev
from haulmark.operators import features as ft
from haulmark.operators import pages, registry, reporting, rollup, scoring
from haulmark.operators.ledger import ORDER_LEDGER
from haulmark.plans import jobs, serving
from haulmark.plans.shipments import FEATURES, enriched_shipments, shipments_with
from haulmark.session import pin_utc
from haulmark.sources import star
from haulmark.sources.bucketed import BucketedSources
from haulmark.staging import stage, staging_root

Query = Callable[[SparkSession, str], DataFrame]

WEEK = "1995-07-19"
AS_OF = "1997-01-01 12:00:00"
SELLER = "7"
THRESHOLD = 0.65


class Tables:
    """The source tables of one folder and the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        pin_utc(spark)
        self.spark = spark
        self.sources = star.StarSources(spark, folder)

    def facts(self, *dimensions: str, delivered: bool = True) -> DataFrame:
        return shipments_with(self.sources, star.ORDINAL, *dimensions, delivered=delivered)

    def enriched(self, delivered: bool = True, features: tuple[str, ...] = FEATURES) -> DataFrame:
        return enriched_shipments(self.sources, star.ORDINAL, delivered, features)

    def all_orders(self) -> DataFrame:
        return cleaning.all_orders(self.sources, star.ORDINAL)

    def orders(self) -> DataFrame:
        return cleaning.unique_orders(self.sources["orders"], star.ORDINAL)

    def located_facts(self) -> DataFrame:
        """Order facts with both coordinates."""
        zips = enrichment.zip_coordinates(self.sources["geolocation"])
        return cleaning.with_dimensions(
            cleaning.order_facts(self.sources, star.ORDINAL),
            sellers=enrichment.located(self.sources["sellers"], zips, "seller"),
            customers=enrichment.located(self.sources["customers"], zips, "customer"),
        )

    def copied_orders(self) -> DataFrame:
        """Orders plus a later, changed copy of every unfinished one and some without a key."""
        raw = self.sources["orders"].withColumn("copy", F.lit(0))
        open_orders = raw.where(F.col("order_status") != "delivered").withColumn("copy", F.lit(1))
        later = F.when(F.col("order_status") == "created", "delivered").otherwise("canceled")
        changed = open_orders.withColumn("order_status", later)
        lost = open_orders.where(F.col("order_status") == "created").withColumn("order_id", F.lit(None).cast("string"))
        return raw.unionByName(changed).unionByName(lost)


def sample_scorer(df: DataFrame) -> DataFrame:
    """A fixed arithmetic score, so that scoring can be repeated in plain SQL."""
    rate = F.coalesce("seller_historical_delay_rate", F.lit(0.0))
    distance = F.least(F.coalesce("distance_km", F.lit(0.0)) / 2500, F.lit(1.0))
    score = 0.5 * distance + 0.3 * (F.col("day_of_week") / 6) + 0.2 * F.least(rate * 3, F.lit(1.0))
    return df.withColumn("delay_probability", F.round(score, 6))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain result types: whole numbers as bigint, amounts as double, doubles rounded."""
    columns = []
    for field in df.schema.fields:
        kind, value = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("byte", "short", "integer"):
            value = value.cast("bigint")
        elif kind.startswith("decimal"):
            value = value.cast("double")
        elif kind == "double":
            value = F.round(value, digits)
        columns.append(value.alias(field.name))
    return df.select(*columns)


REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register ``build`` under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(build(Tables(spark, folder)))

    REGISTRY[build.__name__] = run
    return build


# --- cleaning -----------------------------------------------------------------------------


@query
def orders_dedup(t: Tables) -> DataFrame:
    kept = cleaning.keep_first(cleaning.drop_null_keys(t.copied_orders(), "order_id"), "order_id", ["copy", "order_status"])
    return kept.select("order_id", "customer_id", "order_status", "copy")


@query
def order_first_item(t: Tables) -> DataFrame:
    return cleaning.first_items(t.sources["order_items"])


@query
def order_payments_sum(t: Tables) -> DataFrame:
    return cleaning.payment_totals(t.sources["order_payments"])


@query
def order_reviews_max(t: Tables) -> DataFrame:
    return cleaning.best_reviews(t.sources["order_reviews"])


@query
def category_translated(t: Tables) -> DataFrame:
    return cleaning.english_categories(t.sources["products"], t.sources["category_translation"])


@query
def shipments_clean(t: Tables) -> DataFrame:
    return cleaning.clean_shipments(t.sources, star.ORDINAL).drop("order_status")


@query
def all_orders_delay(t: Tables) -> DataFrame:
    return t.all_orders()


@query
def timestamps_coerced(t: Tables) -> DataFrame:
    return cleaning.parse_timestamps(_text_orders(t)).select(
        "order_id", "order_purchase_timestamp", "order_delivered_customer_date"
    )


def _text_orders(t: Tables) -> DataFrame:
    """Order times as text, with offsets on shipped orders and unreadable text on created ones."""
    bought = F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")
    shown = (
        F.when(F.col("order_status") == "shipped", F.concat(bought, F.lit("-03:00")))
        .when(F.col("order_status") == "created", F.concat(F.lit("n/a "), bought))
        .otherwise(bought)
    )
    return t.sources["orders"].select(
        "order_id",
        shown.alias("order_purchase_timestamp"),
        F.date_format("order_delivered_customer_date", "yyyy-MM-dd HH:mm:ss").alias("order_delivered_customer_date"),
    )


@query
def coercion_audit(t: Tables) -> DataFrame:
    return audit.coercion_audit(_text_orders(t), ["order_purchase_timestamp", "order_delivered_customer_date"])


@query
def clean_audit(t: Tables) -> DataFrame:
    return audit.order_audit(t.copied_orders(), ["copy", "order_status"])


@query
def late_audit(t: Tables) -> DataFrame:
    return audit.late_audit(t.facts())


@query
def rejected_shipments(t: Tables) -> DataFrame:
    return audit.rejected(t.facts()).select("order_id", "customer_id", "seller_id", "reject_reason")


# --- enrichment ---------------------------------------------------------------------------


@query
def zip_first_coord(t: Tables) -> DataFrame:
    return enrichment.zip_coordinates(t.sources["geolocation"])


@query
def geo_joined(t: Tables) -> DataFrame:
    return t.located_facts().select("order_id", *enrichment.COORDINATES)


@query
def geodesic_distance(t: Tables) -> DataFrame:
    return tidy(enrichment.with_distance(t.located_facts()).select("order_id", "distance_km"), 3)


@query
def missing_coord_count(t: Tables) -> DataFrame:
    return audit.missing_coordinates(t.located_facts())


@query
def temporal_features(t: Tables) -> DataFrame:
    return enrichment.with_calendar(t.facts()).select("order_id", "day_of_week", "month")


@query
def seller_delay_rate(t: Tables) -> DataFrame:
    facts = t.facts()
    return enrichment.with_seller_delay_rate(facts).select("order_id", "seller_historical_delay_rate")


@query
def seller_past_delay_rate(t: Tables) -> DataFrame:
    facts = t.facts()
    return enrichment.with_past_delay_rate(facts).select("order_id", "seller_past_delay_rate")


@query
def cost_per_km(t: Tables) -> DataFrame:
    return (
        t.located_facts()
        .transform(enrichment.with_distance)
        .transform(enrichment.with_cost_per_km)
        .select("order_id", "cost_per_km")
    )


@query
def shipments_enriched(t: Tables) -> DataFrame:
    return t.enriched().withColumn("distance_km", F.round("distance_km", 3)).drop("order_status")


# --- maintained aggregates ------------------------------------------------------------------


@query
def kpi_daily(t: Tables) -> DataFrame:
    return aggregates.kpi_daily(t.facts())


@query
def seller_stats(t: Tables) -> DataFrame:
    return aggregates.seller_stats(t.facts("seller"))


@query
def load_summary(t: Tables) -> DataFrame:
    return aggregates.load_summary(t.facts())


# --- indicators -----------------------------------------------------------------------------


@query
def otif(t: Tables) -> DataFrame:
    return kpi.otif(t.facts())


@query
def avg_delay_scalar(t: Tables) -> DataFrame:
    return kpi.avg_delay(t.facts())


@query
def avg_delay_all(t: Tables) -> DataFrame:
    return kpi.avg_delay(t.facts(), only_late=False)


@query
def avg_delay_by_seller(t: Tables) -> DataFrame:
    return kpi.avg_delay(t.facts(), group_by="seller_id")


@query
def fulfillment_rate(t: Tables) -> DataFrame:
    return kpi.fulfillment_rate(t.orders())


@query
def cost_per_shipment(t: Tables) -> DataFrame:
    return kpi.cost_per_shipment(t.facts())


@query
def weekly_otif_trend(t: Tables) -> DataFrame:
    return kpi.weekly_otif_trend(t.facts(), weeks=12)


@query
def delay_by_category(t: Tables) -> DataFrame:
    return kpi.delay_by_category(t.facts("product"))


@query
def top10_delay_categories(t: Tables) -> DataFrame:
    return kpi.top_delay_categories(t.facts("product"))


@query
def seller_scorecard(t: Tables) -> DataFrame:
    return kpi.seller_scorecard(t.facts("seller"))


@query
def seller_scorecard_top(t: Tables) -> DataFrame:
    return kpi.ranked_scorecard(t.facts("seller"), sort_by="avg_delay_days", order="asc", limit=25)


@query
def seller_rate_bands(t: Tables) -> DataFrame:
    card = kpi.seller_scorecard(t.facts("seller"))
    return card.groupBy(labels.delay_rate_band(F.col("delay_rate")).alias("band")).agg(
        F.count(F.lit(1)).alias("sellers"), F.sum("total_orders").alias("orders")
    )


@query
def wow_otif_delta(t: Tables) -> DataFrame:
    return kpi.wow_otif_delta(t.facts())


@query
def kpi_summary(t: Tables) -> DataFrame:
    return kpi.kpi_summary(t.facts(), t.orders())


@query
def kpi_summary_empty(t: Tables) -> DataFrame:
    nothing = F.col("is_late") & ~F.col("is_late")
    return kpi.kpi_summary_or_zero(t.facts().where(nothing), t.orders())


@query
def seller_profile(t: Tables) -> DataFrame:
    facts = stage(t.facts("seller"), "seller-facts")  # read by the figures and by the trend
    return kpi.seller_profile(aggregates.seller_stats(facts), facts)


@query
def seller_profile_one(t: Tables) -> DataFrame:
    facts = stage(browse.of_seller(t.facts("seller"), SELLER), "seller-facts")
    return kpi.seller_profile(aggregates.seller_stats(facts), facts, SELLER)


@query
def kpi_range_check(t: Tables) -> DataFrame:
    return audit.result_violations(kpi.kpi_summary(t.facts(), t.orders()))


# --- listings -------------------------------------------------------------------------------


@query
def kpi_scan(t: Tables) -> DataFrame:
    return browse.kpi_rows(t.enriched(features=("distance",))).withColumn("distance_km", F.round("distance_km", 3))


@query
def all_orders_scan(t: Tables) -> DataFrame:
    return browse.all_order_rows(t.enriched(False, ("distance",))).withColumn("distance_km", F.round("distance_km", 3))


@query
def labelled_scan(t: Tables) -> DataFrame:
    return t.enriched().select(
        "order_id",
        "purchase_timestamp",
        F.round("distance_km", 3).alias("distance_km"),
        F.round("seller_historical_delay_rate", 6).alias("seller_historical_delay_rate"),
        "day_of_week",
        "month",
        "category_name",
        "seller_state",
        "freight_value",
        "price",
        "is_late",
    )


@query
def shipments_late(t: Tables) -> DataFrame:
    return browse.filter_shipments(_listing(t), status="late")


def _listing(t: Tables) -> DataFrame:
    return t.enriched(features=("distance",)).select(
        "order_id",
        "seller_id",
        "seller_state",
        "customer_state",
        "category_name",
        "is_late",
        "delay_days",
        "freight_value",
        F.round("distance_km", 3).alias("distance_km"),
        "purchase_timestamp",
        "delivered_timestamp",
    )


@query
def shipments_by_state(t: Tables) -> DataFrame:
    return browse.filter_shipments(_listing(t), state="n7")


@query
def shipments_date_range(t: Tables) -> DataFrame:
    return browse.filter_shipments(_listing(t), date_from="1996-01-01", date_to="1996-03-31")


@query
def shipments_search(t: Tables) -> DataFrame:
    return browse.filter_shipments(_listing(t), status="on_time", search="42")


@query
def shipments_category(t: Tables) -> DataFrame:
    return browse.filter_shipments(_listing(t), category="small", is_late=True)


@query
def shipments_page(t: Tables) -> DataFrame:
    return browse.details(browse.page_of(_listing(t), page=3, size=50))


@query
def shipments_page_after(t: Tables) -> DataFrame:
    return browse.details(browse.page_after(_listing(t), "1997-06-01", "5", size=50))


@query
def shipments_page_count(t: Tables) -> DataFrame:
    return browse.page_totals(browse.filter_shipments(_listing(t), status="late"), 50)


@query
def seller_shipments_page(t: Tables) -> DataFrame:
    return browse.details(browse.page_of(browse.of_seller(_listing(t), SELLER), page=1, size=20))


@query
def shipment_lookup(t: Tables) -> DataFrame:
    return browse.details(browse.one_order(_listing(t), "1"))


@query
def shipments_export(t: Tables) -> DataFrame:
    return browse.export_rows(browse.filter_shipments(_listing(t), state="N3"))


@query
def in_transit(t: Tables) -> DataFrame:
    return browse.in_transit(t.enriched(delivered=False)).withColumn("distance_km", F.round("distance_km", 3))


@query
def shipments_page_ranked(t: Tables) -> DataFrame:
    return browse.details(pages.ranked_page(_listing(t), page=3, size=50))


@query
def shipments_page_deep(t: Tables) -> DataFrame:
    on_time = browse.filter_shipments(_listing(t), status="on_time")
    return browse.details(pages.ranked_page(on_time, page=8, size=40))


# --- figures from sums ----------------------------------------------------------------------


def _sums(t: Tables) -> rollup.Sums:
    return rollup.of_rows(t.facts("product", "seller"))


@query
def rollup_kpi_summary(t: Tables) -> DataFrame:
    orders = rollup.of_rows(t.orders(), ORDER_LEDGER)
    return rollup.kpi_summary(_sums(t), orders("status"))


@query
def rollup_scorecard(t: Tables) -> DataFrame:
    return rollup.seller_scorecard(_sums(t))


@query
def rollup_weekly_trend(t: Tables) -> DataFrame:
    return rollup.weekly_otif_trend(_sums(t), weeks=12)


@query
def rollup_delay_by_category(t: Tables) -> DataFrame:
    return rollup.delay_by_category(_sums(t))


@query
def rollup_week_metrics(t: Tables) -> DataFrame:
    return rollup.week_metrics(_sums(t), WEEK)


@query
def rollup_critical_sellers(t: Tables) -> DataFrame:
    return rollup.critical_sellers(_sums(t), WEEK)


@query
def shipments_enriched_bucketed(t: Tables) -> DataFrame:
    """The enriched shipments from sources staged in buckets by order."""
    sources = BucketedSources(t.spark, t.sources)
    rows = enriched_shipments(sources, star.ORDINAL)
    return rows.withColumn("distance_km", F.round("distance_km", 3)).drop("order_status")


# --- stored tables ----------------------------------------------------------------------------


def _loaded(t: Tables) -> str:
    """Folder of tables that two loads made: one with many rows that are wrong, then one that replaces them."""
    rows = stage(t.facts("product", "seller", "customer"), "facts")
    wrong = rows.where((F.pmod(F.hash("order_id"), F.lit(3)) > 0) & F.col("seller_id").isNotNull()).withColumns({
        "seller_id": F.when(F.col("is_late"), F.col("seller_id")).otherwise("another"),
        "seller_state": F.lit("N0"),
        "purchase_timestamp": (F.col("purchase_timestamp") + F.make_dt_interval(days=F.lit(9))).cast("timestamp_ntz"),
        "delay_days": F.col("delay_days") + 0.25,
        "freight_value": F.col("freight_value") + 1,
    })
    root = f"{staging_root(t.spark)}/haulmark/{t.spark.sparkContext.applicationId}/loads-{uuid.uuid4().hex}"
    for batch in (wrong, rows):
        jobs.load(t.spark, batch, root, AS_OF, unique=True)
    return root


@query
def stored_kpi_daily(t: Tables) -> DataFrame:
    return jobs.kpi_daily_table(t.spark, _loaded(t)).read().drop("updated_at")


@query
def stored_seller_stats(t: Tables) -> DataFrame:
    return jobs.seller_stats_table(t.spark, _loaded(t)).read().drop("updated_at")


@query
def stored_search(t: Tables) -> DataFrame:
    return serving.shipments_search(t.spark, _loaded(t), "142", is_late=False).select("order_id", "seller_id", "purchase_timestamp")


# --- weekly report --------------------------------------------------------------------------


@query
def report_week_metrics(t: Tables) -> DataFrame:
    return reporting.week_metrics(t.facts(), WEEK)


@query
def report_otif_trend(t: Tables) -> DataFrame:
    return reporting.week_otif_trend(t.facts(), WEEK)


@query
def report_otif_trend_bounded(t: Tables) -> DataFrame:
    return reporting.week_otif_trend(t.facts(), WEEK, weeks=8, bounded=True)


@query
def report_critical_sellers(t: Tables) -> DataFrame:
    return reporting.critical_sellers(t.facts("seller"), WEEK)


@query
def report_flagged(t: Tables) -> DataFrame:
    return reporting.late_of_week(t.facts("product", "seller", "customer"), WEEK)


@query
def iso_week_label(t: Tables) -> DataFrame:
    days = t.orders().select(F.to_date("purchase_timestamp").alias("day")).distinct()
    day = F.col("day")
    monday = times.week_start(day)
    return days.select(
        "day",
        monday.alias("week_start"),
        times.week_end(monday).alias("week_end"),
        times.prior_week(monday).alias("prior_week"),
        times.iso_week_label(day).alias("iso_week"),
    )


@query
def latest_data_week(t: Tables) -> DataFrame:
    return reporting.latest_data_date(aggregates.kpi_daily(t.facts()))


# --- features and evaluation ----------------------------------------------------------------


@query
def imputation_stats(t: Tables) -> DataFrame:
    return ft.imputation_stats(t.enriched())


@query
def label_vocab(t: Tables) -> DataFrame:
    return ft.vocabularies(t.facts("product", "seller"))


@query
def feature_matrix(t: Tables) -> DataFrame:
    rows = stage(t.enriched())
    matrix = ft.feature_matrix(rows, ft.Imputation.fit(rows), ft.vocabularies(rows), "order_id")
    return matrix.withColumn("distance_km", F.round("distance_km", 3))


@query
def unseen_encoding(t: Tables) -> DataFrame:
    """Codes learned from January 1997, applied to all delivered orders."""
    rows = stage(t.facts("product", "seller"))
    learned = browse.within(rows, "1997-01-01", "1997-02-01").where(F.col("category_name") < "p")
    coded = ft.encode(rows, ft.vocabularies(learned))
    return coded.select("order_id", "category_encoded", "seller_state_encoded")


@query
def inference_features(t: Tables) -> DataFrame:
    """Scoring inputs of undelivered orders with defaults in place of missing values."""
    rows = t.enriched(delivered=False)
    vocab = ft.vocabularies(t.facts("product", "seller"))
    matrix = ft.inference_matrix(browse.in_transit(rows), vocab)
    return matrix.select("order_id", "features.*").withColumn("distance_km", F.round("distance_km", 3))


def _labelled(t: Tables) -> DataFrame:
    """Narrow labelled rows, written once because the splits read them several times."""
    return stage(_labels(t))


def _labels(t: Tables) -> DataFrame:
    return t.facts().select("order_id", "purchase_timestamp", "is_late", F.col("is_late").cast("int").alias("label"))


@query
def class_weights(t: Tables) -> DataFrame:
    return ft.class_weights(_labels(t))


@query
def stratified_split(t: Tables) -> DataFrame:
    train, test = ev.stratified_split(_labelled(t), "label", "order_id")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("order_id", "label", "part")


@query
def holdout_tail(t: Tables) -> DataFrame:
    _, newest = ev.holdout_split(_labelled(t))
    return newest.select("order_id", "purchase_timestamp", "label")


def _scored(t: Tables) -> DataFrame:
    return sample_scorer(t.enriched()).withColumn("label", F.col("is_late").cast("int"))


@query
def scored_batch(t: Tables) -> DataFrame:
    scored = scoring.predict_batch(t.enriched(), sample_scorer, 0.5)
    return scored.select("order_id", "delay_probability", "predicted_late")


@query
def flagged_shipments(t: Tables) -> DataFrame:
    flagged = scoring.flagged_shipments(t.enriched(delivered=False), sample_scorer, AS_OF, THRESHOLD)
    return flagged.withColumn("distance_km", F.round("distance_km", 3))


@query
def flagged_top(t: Tables) -> DataFrame:
    rows = browse.in_transit(t.enriched(delivered=False))
    return scoring.flagged_shipments(rows, sample_scorer, AS_OF, THRESHOLD, limit=100).select(
        "order_id", "delay_probability", "days_until_delivery"
    )


@query
def alert_stats(t: Tables) -> DataFrame:
    return scoring.alert_stats(scoring.flagged_shipments(t.enriched(delivered=False), sample_scorer, AS_OF, THRESHOLD))


@query
def risk_levels(t: Tables) -> DataFrame:
    return scoring.with_risk(_scored(t)).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@query
def risk_filter(t: Tables) -> DataFrame:
    return scoring.of_risk(_scored(t), "HIGH").select("order_id", "delay_probability", "risk_level")


@query
def scored_listing(t: Tables) -> DataFrame:
    page = browse.page_of(browse.filter_shipments(t.enriched(), status="late"), page=2, size=50)
    listed = browse.details(scoring.with_prediction(page, sample_scorer))
    return listed.withColumn("distance_km", F.round("distance_km", 3))


@query
def unscored_listing(t: Tables) -> DataFrame:
    return browse.details(scoring.with_prediction(browse.page_of(_listing(t), page=1, size=10)))


@query
def confusion_metrics(t: Tables) -> DataFrame:
    return ev.confusion(_scored(t), 0.5)


@query
def roc_auc_rank(t: Tables) -> DataFrame:
    return ev.roc_auc(_scored(t))


@query
def classification_report(t: Tables) -> DataFrame:
    return ev.classification_report(ev.confusion(_scored(t), 0.5))


def _requests(t: Tables) -> DataFrame:
    """Scoring requests shaped from the order items, with out-of-range values among them."""
    item = F.col("order_item_id")
    return t.sources["order_items"].select(
        F.concat_ws("-", "order_id", "order_item_id", "product_id", "seller_id").alias("request_id"),
        (F.col("freight_value") * 10 - 20).alias("distance_km"),
        F.when(item != 3, F.lit("small")).alias("category_name"),
        F.concat(F.lit("N"), "order_item_id").alias("seller_state"),
        item.cast("int").alias("day_of_week"),
        F.when(item != 2, (item * 2).cast("int")).alias("month"),
        "freight_value",
        F.col("price"),
        F.when(item != 5, F.col("price") / 80000).alias("seller_historical_delay_rate"),
    )


@query
def input_violations(t: Tables) -> DataFrame:
    checked = audit.input_violations(_requests(t))
    return checked.select("request_id", "month", F.array_join("violations", ",").alias("violations"))


@query
def scored_requests(t: Tables) -> DataFrame:
    answered, _ = scoring.score_requests(_requests(t), sample_scorer, 0.5)
    return answered.select("request_id", "predicted_late", "risk_level")


# --- model registry -------------------------------------------------------------------------


def _versions(t: Tables) -> DataFrame:
    """One model version per year of data: trained at the year's last purchase."""
    facts = t.facts()
    year = F.year("purchase_timestamp")
    accuracy = F.round(1 - numbers.share(F.col("is_late")), 6)
    return facts.groupBy(year.alias("year")).agg(
        F.concat(F.lit("v"), F.first(year)).alias("version"),
        F.max("purchase_timestamp").alias("trained_at"),
        accuracy.alias("accuracy"),
        F.lit(0.5).alias("precision_late"),
        F.lit(0.5).alias("recall_late"),
        F.lit(0.5).alias("f1_late"),
        F.lit(THRESHOLD).alias("threshold"),
        (F.first(year) <= 1997).alias("is_active"),
        F.lit(None).cast("string").alias("storage_path"),
        F.lit(None).cast("string").alias("notes"),
    ).drop("year")


@query
def active_model(t: Tables) -> DataFrame:
    return registry.active_version(_versions(t)).select("version", "trained_at", "accuracy", "threshold")


@query
def retrain_trigger(t: Tables) -> DataFrame:
    shipments = t.facts().withColumn("created_at", F.col("purchase_timestamp"))
    return registry.retrain_decision(shipments, _versions(t), "1997-06-15 00:00:00", min_new_rows=1_000_000_000)


@query
def retrain_new_rows(t: Tables) -> DataFrame:
    shipments = t.facts().withColumn("created_at", F.col("purchase_timestamp"))
    return registry.retrain_decision(shipments, _versions(t), "1997-06-15 00:00:00", min_new_rows=10)
