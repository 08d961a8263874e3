"""All registered queries and their SQL."""

from __future__ import annotations

from lexloom.plans import arrays, auditing, comparing, comparison, curation, embeddings, pairing, preparing, ranking, rates, reading, reports, sources, speaking, splitting, streams, text  # noqa: F401  they register
from lexloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
