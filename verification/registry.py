"""All registered queries and oracles."""

from verification import (
    constraint_queries,
    evidence_queries,
    ingest_queries,
    mining_queries,
    perturb_queries,
    scoring_queries,
)

_MODULES = (constraint_queries, mining_queries, evidence_queries, scoring_queries, ingest_queries, perturb_queries)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
