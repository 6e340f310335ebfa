"""The shipment fact composed from the nine sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.operators import cleaning as c
from haulmark.operators import enrichment as e
from haulmark.staging import stage, together

FEATURES = ("distance", "calendar", "seller_rate", "cost_per_km")


def enrich_facts(
    facts: DataFrame, sources: c.Sources, rates: DataFrame | None = None, features: tuple[str, ...] = FEATURES
) -> DataFrame:
    """Dimensions and the named features for order facts, joined in the order that moves the fewest rows.

    Coordinates are attached to the seller and customer tables before those meet the facts, and
    the seller history is aggregated before the facts widen. ``rates`` are stored seller rates;
    by default they come from the delivered rows of ``facts``, which should then be stored too.
    """
    distance = "distance" in features or "cost_per_km" in features

    def places() -> list[DataFrame]:
        """Sellers and customers with their state, and their coordinates if a distance is asked for."""
        if not distance:
            return [sources[f"{role}s"].select(f"{role}_id", f"{role}_state") for role in ("seller", "customer")]
        zips = stage(e.zip_coordinates(sources["geolocation"]), "zips")
        return together(*[lambda role=role: e.located(sources[f"{role}s"], zips, role) for role in ("seller", "customer")])

    def seller_rates() -> DataFrame | None:
        if "seller_rate" not in features or rates is not None:
            return rates
        return stage(e.seller_delay_rates(facts, F.col("order_status") == "delivered"), "seller-rates")

    known, products, (sellers, customers) = together(
        seller_rates, lambda: c.english_categories(sources["products"], sources["category_translation"]), places
    )
    rows = c.with_dimensions(facts, products, sellers, customers)
    if "seller_rate" in features:
        rows = e.with_rates(rows, known)
    if distance:
        rows = e.with_distance(rows)
    if "calendar" in features:
        rows = e.with_calendar(rows)
    if "cost_per_km" in features:
        rows = e.with_cost_per_km(rows)
    return rows


def enriched_shipments(
    sources: c.Sources, order_by: list[str], delivered: bool = True, features: tuple[str, ...] = FEATURES
) -> DataFrame:
    """Cleaned and enriched shipments. Facts that the seller history reads as well are stored first."""
    facts = c.order_facts(sources, order_by, delivered)
    if "seller_rate" in features:
        facts = stage(facts, "facts")
    return enrich_facts(facts, sources, features=features)


def shipments_with(
    sources: c.Sources, order_by: list[str], *dimensions: str, delivered: bool = True
) -> DataFrame:
    """Order facts with only the named dimensions ("product", "seller", "customer")."""
    facts = c.order_facts(sources, order_by, delivered)
    tables = {}
    if "product" in dimensions:
        tables["products"] = c.english_categories(sources["products"], sources["category_translation"])
    for role in ("seller", "customer"):
        if role in dimensions:
            tables[f"{role}s"] = sources[f"{role}s"].select(f"{role}_id", f"{role}_state")
    return c.with_dimensions(facts, **tables)
