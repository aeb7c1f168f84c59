"""Written intermediate tables: what cuts lineage and survives the loss of an executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


UNION = "spark.sql.unionOutputPartitioning"
#: Bytes of a table, at most, that a join sends to all executors by way of the driver, where a workspace has lean joins.
BROADCAST, SENT = "spark.sql.autoBroadcastJoinThreshold", 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where unset, as in tests, a local master sets one.

    On any other master executors would write to disks of their own, so an unset folder is an error there.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="nearway-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def release() -> None:
    """Deletes the tables of all workspaces, once no result that reads them is needed: for drivers that live long."""
    for work in list(Workspace.open):
        work.close()


class Workspace:
    """Tables written under the shared folder.

    A table is dropped by drop() as soon as nothing needs it; what results still read goes by close() or release(), or
    when the driver ends. With lean joins tables of more than SENT are shuffled to be joined and never gathered by the driver.
    """

    open: set[Workspace] = set()

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.lean = lean
        self.spark, self.path = spark, f"{shared_root(spark)}/nearway/{name}-{uuid.uuid4().hex}"
        self.count, self.paths = 0, {}
        Workspace.open.add(self)

    def close(self) -> None:
        Workspace.open.discard(self)
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone when the driver ends; nothing depends on this
            return

    def write(self, df: DataFrame) -> DataFrame:
        """df as a table of its own, written once."""
        self.count += 1
        path = f"{self.path}/{self.count:03d}"
        # Spark 4.1 lets a union keep the partitioning that its inputs share, even where adaptive execution has since given
        # them different numbers of partitions; the job then fails. A union of such inputs is planned within write().
        set_to = {UNION: "false"} if self.spark.version >= "4.1" and self.spark.conf.get(UNION) == "true" else {}
        if self.lean and self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > SENT:
            set_to[BROADCAST] = str(SENT)
        before = {k: self.spark.conf.get(k) for k in set_to}
        try:
            for k, v in set_to.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def write_seen(self, df: DataFrame, **seen: Column) -> tuple[DataFrame, dict]:
        """As write(), and aggregates of df's rows that are taken while they are written, which spares a job.

        A task that runs again may count twice, so they only tell whether there are rows, or the least or greatest value.
        """
        watch = Observation()
        out = self.write(df.observe(watch, *[c.alias(k) for k, c in seen.items()]))
        return out, watch.get

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                self._delete(path)


atexit.register(release)
