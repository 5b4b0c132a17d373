"""Curation of astronomical redshift catalogs as Spark jobs."""

from skyloom.functions.expr import CatalogError
from skyloom.plans.curate import CurateSpec, curate, curate_to, curate_to_collection
from skyloom.plans.inspect import inspect, write_report
from skyloom.plans.prepare import prepare, read_sources
from skyloom.plans.qa import qa
from skyloom.session import build_session
from skyloom.sinks.collection import write_collection
from skyloom.sinks.parquet import write_parquet
from skyloom.sources.collection import read_margin, read_spatial
from skyloom.sources.readers import read_catalog, read_fits, read_parquet
from skyloom.sources.text import read_csv, read_footprint, read_whitespace

__all__ = [
    "CatalogError",
    "CurateSpec",
    "build_session",
    "curate",
    "curate_to",
    "curate_to_collection",
    "inspect",
    "prepare",
    "qa",
    "read_catalog",
    "read_csv",
    "read_fits",
    "read_footprint",
    "read_margin",
    "read_parquet",
    "read_sources",
    "read_spatial",
    "read_whitespace",
    "write_collection",
    "write_parquet",
    "write_report",
]
