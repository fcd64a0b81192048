"""All registered queries."""

from weirspan.plans import queries_flow, queries_hydraulics, queries_spatial, queries_stream, queries_tables, queries_validate  # noqa: F401
from weirspan.plans.catalog import CHECKS, QUERIES  # noqa: F401
