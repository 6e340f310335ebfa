"""haulmark: shipment analytics as Spark DataFrame transformations."""
