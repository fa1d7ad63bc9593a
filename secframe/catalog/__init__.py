"""Runnable queries over the driver tables, each with the equivalent SQL where SQL can say it."""
from secframe.catalog import alerts, detections, incidents, ingest, packs, predicates, streams
from secframe.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "alerts", "detections", "incidents", "ingest", "packs", "predicates", "streams"]
