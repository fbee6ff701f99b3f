"""Every registered query of the library, with the SQL that gives the same rows."""

from millrace.plans import composed, graph, library, measures, navigated, retrieval, text

MODULES = (text, retrieval, graph, library, measures, composed, navigated)
FLAGSHIP = "d4_search"
QUERIES: dict = {}
SQL: dict = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    SQL |= module.SQL
