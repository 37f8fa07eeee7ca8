"""The best representative of each duplicate group, field by field, in one aggregation.

For every field the maximum of a composite (has a value, measure of completeness, trust in the source, time, smaller id first) is taken, so
all fields of all groups survive in a single pass that combines before its shuffle; a group of any size never sits in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(members: DataFrame, group: str, record: str, fields: dict[str, tuple[Column, Column]], trust: Column, time: Column, least_records: int = 1) -> DataFrame:
    """Rows ``(group, field, record)``: the record whose value of each field survives.

    ``fields`` maps a field to (is blank, measure): the largest measure among values that are not blank wins, then ``trust``, then the later
    ``time``, then the smaller record. Nulls in measure, trust and time lose. A field that is blank in the whole group gives no row, nor does
    a group of fewer than ``least_records``.
    """
    ranks = [F.max(F.when(~blank, F.struct(measure.cast("double").alias("m"), trust.cast("int").alias("t"), time.alias("h"), (-F.col(record)).alias("r")))).alias(f) for f, (blank, measure) in fields.items()]
    best = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *ranks).filter(F.col("_n") >= least_records)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (-F.col(f"{f}.r")).alias("record")) for f in fields))).alias("_s")
    return best.select(group, rows).select(group, F.col("_s.field").alias("field"), F.col("_s.record").alias(record)).filter(F.col(record).isNotNull())
