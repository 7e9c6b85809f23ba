"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dimension sides up to this estimated size are broadcast; larger ones fall
# back to the shuffled join Catalyst/AQE picks.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


#: Plan nodes whose output is at most their leaves' rows: what was written or given as literals.
_MEASURED = {"Project", "Filter", "SubqueryAlias", "LocalRelation", "LogicalRelation", "Range", "OneRowRelation", "Generate"}


def known_size(df: DataFrame) -> int | None:
    """Bytes of local rows or of written files; None where the plan computes them and Catalyst could only guess."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _MEASURED:
            return None
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return int(str(plan.stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast when the size is known and under ``limit_bytes``; else the join is left to the sizes AQE measures."""
    size = known_size(df)
    return F.broadcast(df) if size is not None and size <= limit_bytes else df


def broadcast_written(df: DataFrame, name: str) -> DataFrame:
    """Write a small result and hint a broadcast by the size of its files.

    Catalyst's estimate of an aggregate follows its input, not the number of
    groups; what was written has its true size, however large the input is.
    """
    from ..session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return broadcast_if_small(spark.read.schema(df.schema).parquet(path))


def local_table(spark, rows: list[tuple], ddl: str) -> DataFrame:
    """A small dimension table built JVM-side (no Python RDD, exact size stats).

    ``ddl`` is "name TYPE, ..."; rows are tuples in that column order.
    """
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(ddl)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
               for r in rows]
    if not structs:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.array(*structs)))
