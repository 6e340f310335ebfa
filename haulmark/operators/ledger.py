"""Partial sums of shipments and orders that add up over loads, at several grains.

A sum is exact: rows are counted, amounts are decimals and delays whole microseconds. So a row that is replaced can be
taken out again, whatever was added since, and sums of batches equal those of the whole table. Figures are quotients
taken last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions import numbers, times

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Ledger:
    """``dims`` and ``measures`` are taken from a row; ``grains`` name the groups of dims that sums are kept for.

    A measure is a pair: its SQL type once summed, and its value in one row.
    """

    dims: dict[str, tuple[str, Callable[[], Column]]]
    measures: dict[str, tuple[str, Callable[[], Column]]]
    grains: dict[str, list[str]]

    def ddl(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, (kind, _) in {**self.dims, **self.measures}.items())

    def signed(self, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
        """Sums of ``added`` less those of ``removed`` for every grain, from one pass and one shuffle.

        Groups in which nothing changed are left out.
        """

        def values(rows: DataFrame, sign: int) -> DataFrame:
            measured = [(value() if sign > 0 else -value()).alias(name) for name, (_, value) in self.measures.items()]
            return rows.select(*[value().alias(name) for name, (_, value) in self.dims.items()], *measured)

        rows = values(added, 1)
        if removed is not None:
            rows = rows.unionByName(values(removed, -1))
        named = {self._grouping(dims): grain for grain, dims in self.grains.items()}
        if len(named) != len(self.grains):
            raise ValueError("two grains have the same dims")
        sums = [F.sum(name).cast(kind).alias(name) for name, (kind, _) in self.measures.items()]
        grain = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.grouping_id().cast("int")]
        grouped = rows.groupingSets(list(self.grains.values()), *self.dims).agg(grain.alias("grain"), *sums)
        changed = F.greatest(*[F.coalesce(F.col(name) != 0, F.lit(False)) for name in self.measures], F.lit(False))
        return grouped.where(changed).select("grain", *self.dims, *self.measures)

    def _grouping(self, dims: list[str]) -> int:
        """Spark's grouping_id: a bit for each dim that is summed over, the first dim in the highest."""
        return int("".join("0" if name in dims else "1" for name in self.dims), 2)

    def total(self, sums: DataFrame, grain: str) -> DataFrame:
        """One row per group of ``grain`` from the sums of many loads; groups that were emptied again are gone."""
        kept = [F.sum(name).cast(kind).alias(name) for name, (kind, _) in self.measures.items()]
        return sums.groupBy(*self.grains[grain]).agg(*kept).where(F.col("n") != 0)

    def coarsest(self, *needed: str) -> str:
        """The grain with the fewest dims that still has all of ``needed``; the week is known where the day is."""
        have = {grain: {*dims, *(["week_start"] if "date" in dims else [])} for grain, dims in self.grains.items()}
        fit = [grain for grain, dims in have.items() if set(needed) <= dims]
        if not fit:
            raise ValueError(f"no grain has {', '.join(needed)}")
        return min(fit, key=lambda grain: len(self.grains[grain]))


def _when(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _one_if(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def _micros() -> Column:
    """Fractional days were made from whole microseconds; a double of this size holds them exactly."""
    return F.round(F.col("delay_days") * DAY_US).cast("decimal(19,0)")


def _cost() -> Column:
    return (F.col("freight_value") + F.col("price")).cast("decimal(19,2)")


SHIPMENT_LEDGER = Ledger(
    dims={
        "date": ("date", lambda: times.utc_date(F.col("purchase_timestamp"))),
        "week_start": ("date", lambda: times.week_start(F.col("purchase_timestamp"))),
        "seller_id": ("string", lambda: F.col("seller_id")),
        "seller_state": ("string", lambda: F.col("seller_state")),
        "category_name": ("string", lambda: F.col("category_name")),
    },
    measures={
        "n": ("bigint", lambda: F.lit(1).cast("bigint")),
        "late": ("bigint", lambda: _one_if(F.col("is_late"))),
        "delay_us": ("decimal(38,0)", _micros),
        "delay_n": ("bigint", lambda: _one_if(F.col("delay_days").isNotNull())),
        "late_delay_us": ("decimal(38,0)", lambda: _when(F.col("is_late"), _micros())),
        "late_delay_n": ("bigint", lambda: _one_if(F.col("is_late") & F.col("delay_days").isNotNull())),
        "freight": ("decimal(38,2)", lambda: F.col("freight_value").cast("decimal(18,2)")),
        "freight_n": ("bigint", lambda: _one_if(F.col("freight_value").isNotNull())),
        "cost": ("decimal(38,2)", _cost),
        "cost_n": ("bigint", lambda: _one_if(_cost().isNotNull())),
    },
    grains={
        "day": ["date"],
        "category": ["category_name"],
        "seller": ["seller_id", "seller_state"],
        "week_seller_category": ["week_start", "seller_id", "seller_state", "category_name"],
    },
)

ORDER_LEDGER = Ledger(
    dims={"order_status": ("string", lambda: F.col("order_status"))},
    measures={"n": ("bigint", lambda: F.lit(1).cast("bigint"))},
    grains={"status": ["order_status"]},
)


def days(micros: Column) -> Column:
    return micros.cast("double") / F.lit(float(DAY_US))


def mean_delay(prefix: str = "") -> Column:
    return numbers.per(days(F.col(f"{prefix}delay_us")), F.col(f"{prefix}delay_n"))


def kpi_daily(day_sums: DataFrame) -> DataFrame:
    """The maintained daily figures from sums of grain ``day``."""
    return day_sums.where(F.col("date").isNotNull()).select(
        "date",
        numbers.per(F.col("n") - F.col("late"), F.col("n")).alias("otif_rate"),
        mean_delay().alias("avg_delay_days"),
        F.lit(1.0).alias("fulfillment_rate"),
        numbers.per(F.col("freight"), F.col("freight_n")).alias("avg_cost_per_shipment"),
        F.col("n").alias("total_shipments"),
        F.lit(0).cast("bigint").alias("flagged_count"),
    )


def per_seller(seller_sums: DataFrame) -> DataFrame:
    """One row per seller; a seller with rows of several states shows the first one."""
    sums = [F.sum(name).alias(name) for name in SHIPMENT_LEDGER.measures]
    named = seller_sums.where(F.col("seller_id").isNotNull())
    return named.groupBy("seller_id").agg(F.min("seller_state").alias("seller_state"), *sums)


def seller_stats(seller_sums: DataFrame) -> DataFrame:
    """The maintained seller figures from sums of grain ``seller``."""
    return per_seller(seller_sums).select(
        "seller_id",
        "seller_state",
        F.col("n").alias("total_orders"),
        numbers.per(F.col("late"), F.col("n")).alias("delay_rate"),
        mean_delay().alias("avg_delay_days"),
        numbers.per(F.col("freight"), F.col("freight_n")).alias("avg_cost"),
    )


def seller_rates(stored: DataFrame, replaced: DataFrame | None, facts: DataFrame) -> DataFrame:
    """Late share of each seller of ``facts``, and its rows there (``n``).

    The history is the stored sums (grain ``seller``), less the stored rows that are replaced, plus the delivered facts.
    """
    done = F.coalesce(F.col("order_status") == "delivered", F.lit(False))
    old = stored.select("seller_id", F.col("n").alias("known"), "late", F.lit(0).cast("bigint").alias("n"))
    fresh = facts.groupBy("seller_id").agg(
        F.count_if(done).alias("known"), F.count_if(done & F.col("is_late")).alias("late"), F.count(F.lit(1)).alias("n")
    )
    parts = old.unionByName(fresh)
    if replaced is not None:
        gone = replaced.groupBy("seller_id").agg((-F.count(F.lit(1))).alias("known"), (-F.count_if("is_late")).alias("late"))
        parts = parts.unionByName(gone.withColumn("n", F.lit(0).cast("bigint")))
    sums = [F.sum(name).alias(name) for name in ("known", "late", "n")]
    sellers = parts.where(F.col("seller_id").isNotNull()).groupBy("seller_id").agg(*sums).where("n > 0")
    return sellers.select("seller_id", numbers.per(F.col("late"), F.col("known")).alias("seller_historical_delay_rate"), "n")
