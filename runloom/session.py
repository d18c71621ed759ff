"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results (time zone) or plans (AQE); sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a checkpoint goes when nothing refers to it any more; else every query would leave its intermediate tables behind
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "runloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; ``conf`` keys use double underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """All tables hold UTC wall time; casts between NTZ and LTZ are only exact in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="runloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/runloom-{label}-{uuid.uuid4().hex}"


class Files:
    """A folder on whatever file system its path names: through Hadoop with a session, else as a local or mounted one."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self._jvm = path.rstrip("/"), None
        if spark is None:
            os.makedirs(self.path, exist_ok=True)
            return
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._folder)

    def put(self, name: str, text: str) -> None:
        """A file that is seen only when it is complete."""
        if self._jvm is None:
            hidden = os.path.join(self.path, f".{name}")
            with open(hidden, "w", encoding="utf-8") as out:
                out.write(text)
            os.rename(hidden, os.path.join(self.path, name))
            return
        at = lambda n: self._jvm.org.apache.hadoop.fs.Path(self._folder, n)
        out = self._fs.create(at(f".{name}"), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        self._fs.rename(at(f".{name}"), at(name))

    def names(self) -> list[str]:
        """The complete files."""
        found = os.listdir(self.path) if self._jvm is None else [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return [n for n in found if not n.startswith(".")]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the Hadoop file system it belongs to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_name(taken: list[str], base: str) -> str:
    """``base``, lengthened until it clashes with no name in ``taken`` (letter case ignored)."""
    lowered = {name.lower() for name in taken}
    while base.lower() in lowered:
        base += "_"
    return base
