"""A result folder whose readers see committed parts only.

``parts/`` holds one folder for each attempt to write a micro-batch, ``commits/``
one small file for each batch that is done: its part, row count and range of
ids. A part is read only if a commit names it, so what a failed attempt left is
invisible. A batch is known by the run (the stream's own id, kept in its
checkpoint) and its number: a batch that is replayed after its commit is
recognised, and a stream that lost its checkpoint is another run, which can't
overwrite the earlier one's parts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder
from ..sources.tables import SPREAD_ROWS

_COMMIT = "run STRING, batch BIGINT, part STRING, n_rows BIGINT, low BIGINT, high BIGINT"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The id that a stream keeps in its checkpoint; another one once the checkpoint is lost."""
    return spark.read.schema("id STRING").json(f"{checkpoint_dir}/metadata").first()["id"]


class CommitLog:
    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _commit_path(self, run: str, batch: int) -> str:
        return f"{self.path}/commits/{run}-{batch}.json"

    def committed(self, run: str, batch: int) -> bool:
        path, fs = _fs(self.spark, self._commit_path(run, batch))
        return fs.exists(path)

    def commits(self) -> DataFrame:
        """One row for each committed batch."""
        path, fs = _fs(self.spark, f"{self.path}/commits")
        if not fs.exists(path):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(f"{self.path}/commits")

    def write(self, rows: DataFrame, run: str, batch: int) -> bool:
        """Write ``rows`` as a part and commit it; False if the batch was committed before."""
        if self.committed(run, batch):
            return False
        part = f"{self.path}/parts/{run}-{batch}-{uuid.uuid4().hex[:12]}"
        rows.write.mode("errorifexists").parquet(part)
        stats = self.spark.read.schema(rows.schema).parquet(part).agg(
            F.count(F.lit(1)).alias("n"), F.min(self.key).alias("low"), F.max(self.key).alias("high")).first()
        entry = {"run": run, "batch": batch, "part": part, "n_rows": stats["n"], "low": stats["low"], "high": stats["high"]}
        tmp, fs = _fs(self.spark, f"{self.path}/commits/{run}-{batch}.{uuid.uuid4().hex[:12]}.tmp")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        done, _ = _fs(self.spark, self._commit_path(run, batch))
        if not fs.rename(tmp, done):  # another attempt of the batch was first
            fs.delete(tmp, False)
            delete_folder(self.spark, part)
            return False
        return True

    def read(self, schema, low: int | None = None, high: int | None = None) -> DataFrame:
        """Committed rows; with bounds only the parts whose ids may lie between them."""
        wanted = self.commits().filter("n_rows > 0")
        if low is not None and high is not None:
            wanted = wanted.filter((F.col("high") >= low) & (F.col("low") <= high))
        parts = [r["part"] for r in wanted.select("part").collect()]  # one path for each batch
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """``rows`` without those whose key is committed, one row for each key (of several the least by hash).

        Rows are partitioned by their number: a stream's batch is whatever has arrived, and no
        adaptive plan sizes its shuffles.
        """
        span = rows.agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count(F.lit(1)).alias("n")).first()
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(max(least, -(-span["n"] // SPREAD_ROWS)), self.key)
        one = (rows.groupBy(self.key).agg(F.min(F.struct(F.xxhash64(*rows.columns).alias("h"), F.struct(*rows.columns).alias("r"))).alias("m"))
               .select(self.key, *(f"m.r.`{c}`" for c in rows.columns if c != self.key)))  # the key as grouped: it keeps its partitions
        if span["low"] is None:
            return one
        kind = rows.schema[self.key]
        done = self.read(f"{self.key} {kind.dataType.simpleString()}", span["low"], span["high"]).select(self.key)
        return one.join(done, self.key, "left_anti").select(*rows.columns)

    def vacuum(self) -> int:
        """Delete parts that no commit names; returns how many. Run it while no stream writes."""
        path, fs = _fs(self.spark, f"{self.path}/parts")
        if not fs.exists(path):
            return 0
        named = {r["part"].rsplit("/", 1)[1] for r in self.commits().select("part").collect()}
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
