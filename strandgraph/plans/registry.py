"""All registered queries and oracles."""

from __future__ import annotations

from strandgraph.plans import benchmark_queries, graph_queries, inference_queries, link_queries, metric_queries, record_queries, report_queries, source_queries

_MODULES = [report_queries, graph_queries, record_queries, metric_queries, benchmark_queries, link_queries, source_queries, inference_queries]

QUERIES: dict = {}
ORACLE: dict = {}
for _module in _MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
