"""Session helpers.

``shared_dir`` is the one place that decides where intermediate tables
go: the folder the cluster names in ``spark.checkpoint.dir``.  A folder
of our own is only created when the session does not name one (tests,
a laptop).
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

# Fixed defaults for local runs; a cluster passes its own configuration.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "tablesteps", **conf) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; create one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        configured = tempfile.mkdtemp(prefix="tablesteps-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/tables/" + f"{name}-{uuid.uuid4().hex[:12]}"


def written_copy(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder now and read it back.

    Whatever reads the copy sees the same rows, however often and after
    the loss of any executor.  Columns are stored by position, so any
    names (dots, duplicates) come back as they were.
    """
    names, kinds = df.columns, [f.dataType for f in df.schema.fields]
    stored = df.toDF(*[f"c{i}" for i in range(len(names))])
    void = [f"c{i}" for i, k in enumerate(kinds) if isinstance(k, NullType)]
    stored = stored.withColumns({c: F.lit(None).cast("string") for c in void}) if void else stored
    path = shared_dir(df.sparkSession, name)
    stored.write.parquet(path)
    back = df.sparkSession.read.schema(stored.schema).parquet(path)
    back = back.withColumns({c: F.lit(None) for c in void}) if void else back
    return back.toDF(*names)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablesteps`` importable by the Python workers (once per application).

    Steps that run Python on executors (pandas functions, Python data
    sources) call this: the package is zipped in memory, written to the
    shared checkpoint folder and added with ``addPyFile``, so it works
    when the driver found the package through a path the workers do not
    share.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("tablesteps", os.path.relpath(full, pkg)))
    target = shared_dir(spark, "pyfiles").rstrip("/") + "/tablesteps.zip"
    if is_local_uri(target):
        os.makedirs(os.path.dirname(local_path(target)), exist_ok=True)
        with open(local_path(target), "wb") as fh:
            fh.write(buf.getvalue())
    else:
        jvm = sc._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(target)
        out = hpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(hpath, True)
        try:
            out.write(bytearray(buf.getvalue()))
        finally:
            out.close()
    sc.addPyFile(target)
    _SHIPPED.add(app)


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme for libraries that want a plain path."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri


def is_local_uri(uri: str) -> bool:
    return uri.startswith("file:") or uri.startswith("/") or "://" not in uri


__all__ = [
    "LOCAL_CONF",
    "build_session",
    "ensure_checkpoint_dir",
    "shared_dir",
    "local_path",
    "is_local_uri",
    "ship_package",
    "written_copy",
]
