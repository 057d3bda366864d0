"""Queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.plans import checks, guard, library, more, panel, search

Query = Callable[[SparkSession, str], DataFrame]

# Ranks and sizes that are int in Spark and bigint in SQL.
WIDE = {
    "bm25_topk": ("rank",), "match_ranked": ("rank",), "filtered_search": ("rank",), "packet_text": ("n_chars",), "verify_status": ("cit_no",), "verify_permitted": ("cit_no",), "tfidf_top_terms": ("r",), "distant_peers": ("r",),
    "disclosure_set": ("r",), "audit_cases": ("cit_no",), "text_functions": ("n_words",), "reads_topk": ("r",), "holdout_pairs": ("r",), "out_of_scope": ("cit_no",),
}


def _widened(query: Query, columns: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).withColumns({c: F.col(c).cast("bigint") for c in columns})

    run.__doc__, run.__name__ = query.__doc__, query.__name__
    return run


_ALL: dict[str, Query] = {**search.QUERIES, **panel.QUERIES, **library.QUERIES, **more.QUERIES, **guard.QUERIES, **checks.QUERIES}
QUERIES: dict[str, Query] = {n: _widened(q, WIDE[n]) if n in WIDE else q for n, q in _ALL.items()}
SQL: dict[str, str] = {**search.SQL, **panel.SQL, **library.SQL, **more.SQL, **guard.SQL, **checks.SQL}
