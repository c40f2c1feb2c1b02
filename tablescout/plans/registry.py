"""All registered queries and their SQL twins."""

from __future__ import annotations

from tablescout.plans import (
    discovery_queries,
    enrichment_queries,
    integration_queries,
    profile_queries,
    querygen_queries,
    source_queries,
)

_MODULES = [source_queries, profile_queries, querygen_queries, discovery_queries, integration_queries,
            enrichment_queries]
QUERIES, ORACLES = {}, {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)

flagship = enrichment_queries.end_to_end
