"""On-time, delay, fulfilment and cost indicators. Rates named ``*_rate`` are percentages here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions import labels, numbers, times
from haulmark.operators.aggregates import seller_sums

LATE = "is_late"


def otif(shipments: DataFrame) -> DataFrame:
    return shipments.agg(numbers.percent(~F.col(LATE)).alias("otif_rate"))


def avg_delay(shipments: DataFrame, group_by: str | None = None, only_late: bool = True) -> DataFrame:
    """Mean delay, of late rows by default. Groups without a qualifying row are left out."""
    rows = shipments.where(F.col(LATE)) if only_late else shipments
    value = numbers.mean(F.col("delay_days")).alias("avg_delay_days")
    if group_by is None:
        return rows.agg(value)
    return rows.where(F.col(group_by).isNotNull()).groupBy(group_by).agg(value)


def fulfillment_rate(orders: DataFrame) -> DataFrame:
    return orders.agg(numbers.percent(_delivered()).alias("fulfillment_rate"))


def cost_per_shipment(shipments: DataFrame) -> DataFrame:
    return shipments.agg(numbers.mean(F.col("freight_value")).alias("avg_cost_per_shipment"))


def _delivered() -> Column:
    return F.coalesce(F.col("order_status") == "delivered", F.lit(False))


def _weekly(shipments: DataFrame, *keys: str) -> DataFrame:
    """Weekly share on time; the groups that later steps gather are bounded by the calendar."""
    week = times.week_start(F.col("purchase_timestamp")).alias("week_start")
    return (
        shipments.where(F.col("purchase_timestamp").isNotNull())
        .groupBy(*keys, week)
        .agg(numbers.percent(~F.col(LATE)).alias("otif_rate"))
    )


def filled_trend(weekly: DataFrame, weeks: int, *keys: str) -> DataFrame:
    """Fill the last ``weeks`` weeks up to the latest one, in one pass over the weekly rows."""
    by_week = F.map_from_entries(F.collect_list(F.struct("week_start", "otif_rate")))
    folded = weekly.groupBy(*keys).agg(F.max("week_start").alias("_latest"), by_week.alias("_by_week"))
    first = F.date_sub("_latest", 7 * (weeks - 1))
    spine = F.sequence(first, F.col("_latest"), F.expr("interval 7 days"))
    return (
        folded.where(F.col("_latest").isNotNull())
        .select(*keys, "_by_week", F.explode(spine).alias("week_start"))
        .select(*keys, "week_start", F.try_element_at("_by_week", F.col("week_start")).alias("otif_rate"))
    )


def weekly_otif_trend(shipments: DataFrame, weeks: int = 8) -> DataFrame:
    """Oldest first; weeks without shipments have a NULL rate."""
    return filled_trend(_weekly(shipments), weeks).orderBy("week_start")


def seller_weekly_trends(shipments: DataFrame, weeks: int = 8) -> DataFrame:
    """The same trend for every seller, each ending at its own latest week."""
    keyed = shipments.where(F.col("seller_id").isNotNull())
    return filled_trend(_weekly(keyed, "seller_id"), weeks, "seller_id")


def seller_profile(stats: DataFrame, shipments: DataFrame, seller_id: str | None = None) -> DataFrame:
    """Seller statistics with the eight-week trend, one row per seller and week.

    With ``seller_id`` the filter reaches both scans; without it all sellers are profiled.
    """
    if seller_id is not None:
        stats = stats.where(F.col("seller_id") == seller_id)
        shipments = shipments.where(F.col("seller_id") == seller_id)
    filled = stats.withColumns(
        {
            "total_orders": F.coalesce("total_orders", F.lit(0)),
            "delay_rate": F.coalesce("delay_rate", F.lit(0.0)),
            "avg_cost": F.coalesce("avg_cost", F.lit(0.0)),
        }
    )
    return filled.join(seller_weekly_trends(shipments, 8), "seller_id", "left")


def delay_by_category(shipments: DataFrame) -> DataFrame:
    """Late-only mean delay and the count of all orders, worst first."""
    return (
        shipments.na.drop(subset=["category_name"])
        .groupBy("category_name")
        .agg(
            numbers.mean(F.col("delay_days"), where=F.col(LATE)).alias("avg_delay_days"),
            F.count(F.lit(1)).alias("order_count"),
        )
        .orderBy(F.desc_nulls_last("avg_delay_days"), "category_name")
    )


def top_delay_categories(shipments: DataFrame, n: int = 10) -> DataFrame:
    """Chart rows: the ``n`` worst categories with a display label and band."""
    worst = (
        delay_by_category(shipments)
        .where(F.col("avg_delay_days").isNotNull())
        .orderBy(F.desc("avg_delay_days"), "category_name")
        .limit(n)
    )
    return worst.select(
        labels.category_label(F.col("category_name")).alias("category"),
        F.round("avg_delay_days", 2).alias("avg_delay_days"),
        "order_count",
        labels.delay_days_band(F.round("avg_delay_days", 2)).alias("band"),
    )


SCORECARD_SORTS = ["delay_rate", "total_orders", "avg_delay_days", "avg_cost"]


def seller_scorecard(shipments: DataFrame) -> DataFrame:
    """Per seller: volume, late share (a fraction), late-only mean delay and mean freight."""
    return scorecard_of(seller_sums(shipments))


def scorecard_of(sums: DataFrame) -> DataFrame:
    """The scorecard from sums per seller."""
    rows = sums.select(
        "seller_id",
        "seller_state",
        F.col("orders").alias("total_orders"),
        numbers.per(F.col("late"), F.col("orders")).alias("delay_rate"),
        numbers.per(F.col("late_delay"), F.col("late_delay_n")).alias("avg_delay_days"),
        numbers.per(F.col("freight"), F.col("freight_n")).alias("avg_cost"),
    )
    return rows.orderBy(F.desc_nulls_last("delay_rate"), "seller_id")


def ranked_scorecard(
    shipments: DataFrame, sort_by: str = "delay_rate", order: str = "desc", limit: int = 50
) -> DataFrame:
    """``first_sellers`` of these shipments' scorecard."""
    return first_sellers(seller_scorecard(shipments), sort_by, order, limit)


def first_sellers(card: DataFrame, sort_by: str = "delay_rate", order: str = "desc", limit: int = 50) -> DataFrame:
    """The scorecard's first ``limit`` sellers; unknown sort columns fall back to the late share."""
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    key = F.col(sort_by if sort_by in SCORECARD_SORTS else "delay_rate")
    direction = key.asc_nulls_last() if order == "asc" else key.desc_nulls_last()
    return card.orderBy(direction, "seller_id").limit(limit)


def _latest_weeks(week: Column, rate: Column) -> Column:
    """Weekly rates, newest first."""
    entry = F.when(week.isNotNull(), F.struct(week.alias("week"), rate.alias("rate")))
    return F.sort_array(F.collect_list(entry), asc=False)


def _change(weeks: Column) -> Column:
    return F.get(weeks, 0)["rate"] - F.get(weeks, 1)["rate"]


def wow_otif_delta(shipments: DataFrame) -> DataFrame:
    """Latest week minus the week before it that has data; NULL with fewer than two weeks."""
    weeks = _latest_weeks(F.col("week_start"), F.col("otif_rate"))
    delta = F.round(_change(F.col("_weeks")), 4)
    return (
        _weekly(shipments).agg(weeks.alias("_weeks")).select(delta.alias("week_over_week_otif_delta"))
    )


def kpi_summary(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """All seven headline figures in one row from one scan of each input.

    Shipments shrink to weekly partial sums, orders to one row of counts; a union of those
    few rows is then summed, so nothing is joined.
    """
    late = F.col(LATE)
    weekly = shipments.groupBy(times.week_start(F.col("purchase_timestamp")).alias("week")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(late).alias("late"),
        F.sum(F.when(late, F.col("delay_days"))).alias("delay"),
        F.count(F.when(late, F.col("delay_days"))).alias("delay_n"),
        F.sum("freight_value").cast("decimal(38,2)").alias("freight"),
        F.count("freight_value").alias("freight_n"),
    )
    counts = orders.agg(F.count(F.lit(1)).alias("all_n"), F.count_if(_delivered()).alias("delivered"))
    return summary_of(weekly, counts)


def summary_of(weekly: DataFrame, counts: DataFrame) -> DataFrame:
    """The summary from sums per week, whatever they were added up from, and the number of orders."""
    parts = weekly.unionByName(counts, allowMissingColumns=True)

    rate = numbers.per(F.col("n") - F.col("late"), F.col("n")) * 100
    weeks = _latest_weeks(F.when(F.col("n") > 0, F.col("week")), rate)
    sums = ["n", "late", "delay", "delay_n", "freight", "freight_n", "all_n", "delivered"]
    total = parts.agg(*[F.sum(name).alias(name) for name in sums], weeks.alias("weeks"))

    return total.select(
        F.round(numbers.per(F.col("n") - F.col("late"), F.col("n")) * 100, 4).alias("otif_rate"),
        F.round(numbers.per(F.col("delay"), F.col("delay_n")), 4).alias("avg_delay_days"),
        F.round(numbers.per(F.col("delivered"), F.col("all_n")) * 100, 4).alias("fulfillment_rate"),
        F.round(numbers.per(F.col("freight"), F.col("freight_n")), 4).alias("avg_cost_per_shipment"),
        F.coalesce("n", F.lit(0)).alias("total_shipments"),
        F.coalesce("late", F.lit(0)).alias("late_shipments"),
        F.round(_change(F.col("weeks")), 4).alias("week_over_week_otif_delta"),
    )


def kpi_summary_or_zero(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """The summary with zeros instead of NULL, as a dashboard shows it; the delta stays NULL."""
    rates = ["otif_rate", "avg_delay_days", "fulfillment_rate", "avg_cost_per_shipment"]
    return kpi_summary(shipments, orders).na.fill(0.0, rates)

