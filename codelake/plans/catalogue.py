"""All queries of the core, by name."""

from codelake.plans import code_queries, ingest_queries, usage_queries  # noqa: F401
from codelake.registry import OPS

QUERIES = {k: o.run for k, o in OPS.items()}
ORACLE = {k: o.sql for k, o in OPS.items() if o.sql}
