"""Named queries over the driver tables, each with its DuckDB oracle where SQL can state it."""

from quern.plans import content, decisions, documents, matching, notices, procurement, records, retrieval, web

_MODULES = (retrieval, procurement, content, decisions, documents, records, matching, web, notices)
QUERIES = {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
