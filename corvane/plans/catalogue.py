"""All registered queries of the core."""

from __future__ import annotations

from corvane.plans import annotated, cascade, clusters, documents, files, naming, qa, shredded, skewed, streams, summaries, vectors  # noqa: F401  they register themselves
from corvane.plans.registry import QUERIES, SQL, Query
from corvane.plans.summaries import canonical_documents  # noqa: F401  the flagship query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
