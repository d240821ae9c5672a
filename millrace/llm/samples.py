"""Bounded samples that models are fitted on: bounded in rows, however often an id or a text is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written

DRAWS = 1 << 40


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """All distinct rows, or ``most`` of them if there are more, drawn by a hash of the whole row."""
    distinct = written(rows.distinct(), "distinct")
    count = distinct.count()
    if count <= most:
        return distinct
    draw = F.xxhash64(*[F.col(c) for c in distinct.columns])
    near = F.pmod(draw, F.lit(DRAWS)) < int(min(1.0, 1.2 * most / count) * DRAWS)
    # the share leaves little more than is wanted, so that the order is taken of a bounded number of rows
    return distinct.where(near).orderBy(F.pmod(draw, F.lit(DRAWS)), *distinct.columns).limit(most)
