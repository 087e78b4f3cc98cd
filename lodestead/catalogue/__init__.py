"""All registered queries outside the llm subpackage, with their SQL."""

from lodestead.catalogue import answers, lifecycle, retrieval, site, text

_PARTS = (text, retrieval, site, answers, lifecycle)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
FLAGSHIP = "hybrid_search"
