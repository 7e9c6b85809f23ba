"""Session helpers: build a session for tests/bench and find the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job of the library relies on. On a cluster they come from the
# cluster's defaults; ``get_session`` only fills the ones that are unset.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "evalcube") -> SparkSession:
    """Local session for tests and the bench (the cluster passes its own)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("EVALCUBE_DRIVER_MEM", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_dir(spark)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one; only when it is
    unset (local tests) a scratch folder is created and registered.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="evalcube-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared work folder for one written table."""
    base = work_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df, name: str):
    """Write ``df`` to a fresh folder of the shared work folder and read it back (lineage cut); ``drop_table`` deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems keep it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_table(df) -> None:
    """Delete the files of a ``write_table`` that nothing reads any more."""
    delete_folder(df.sparkSession, df._written_at)


_MATERIALIZED: dict[tuple, str] = {}


def materialize(spark: SparkSession, df, key: tuple, name: str):
    """Write ``df`` (a DataFrame or a function building it) once to the shared
    work folder and read it back.

    Cuts the lineage (a lost executor recomputes from the written files, not
    from the sources) and lets every consumer of a fact table share one
    computation. Memoised per application and ``key``.
    """
    app = spark.sparkContext.applicationId
    full = (app,) + tuple(key)
    path = _MATERIALIZED.get(full)
    if path is None:
        path = scratch_path(spark, name)
        (df() if callable(df) else df).write.mode("overwrite").parquet(path)
        _MATERIALIZED[full] = path
    return spark.read.parquet(path)


def checkpoint_df(df):
    """Reliable checkpoint into the shared folder (``spark.checkpoint.dir``): cuts lineage."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import the package wherever they run: its sources go along as one archive, once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="evalcube-src-")
    archive = os.path.join(folder, "evalcube_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "evalcube")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
