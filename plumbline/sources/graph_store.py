"""A property graph in files: nodes and edges by project, merged by key, seen only through commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GraphStore:
    """Frames of nodes or edges under a root folder, each with a column project_id.

    A write adds a new version of the projects that it touches, in folders of their own, and then a commit: a small table
    that names each project's version, renamed into place when it is complete. Readers take the versions that the latest
    commits name, so they see all of a write or nothing of it, and a write never opens another project's files. Of two
    writers at once the second one fails when it commits, and its files are never read.
    """

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, T.StructType]) -> None:
        for kind, schema in kinds.items():
            if "project_id" not in schema.fieldNames():
                raise ValueError(f"{kind} has no project_id")
        self.spark, self.root, self.kinds = spark, root.rstrip("/"), kinds
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        at = self._path(f"{self.root}/commits")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commit(self, number: int, rows: DataFrame) -> None:
        draft = f"{self.root}/drafts/{number:012d}"
        rows.select("kind", "project_id", F.col("v").cast("long").alias("v"), F.lit(number).cast("long").alias("n")).write.mode("overwrite").parquet(draft)
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        target = self._path(f"{self.root}/commits/{number:012d}")
        if self._fs.exists(target) or not self._fs.rename(self._path(draft), target):
            raise RuntimeError(f"commit {number} was taken by another writer")

    def versions(self, kind: str) -> DataFrame:
        """(project_id, v): the version of each project that readers see; projects that were wiped don't appear."""
        project = self.kinds[kind]["project_id"].dataType
        names = self._commits()
        if not names:
            return self.spark.createDataFrame([], T.StructType([T.StructField("project_id", project), T.StructField("v", T.LongType())]))
        schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("project_id", project), T.StructField("v", T.LongType()), T.StructField("n", T.LongType())])
        log = self.spark.read.schema(schema).parquet(*[f"{self.root}/commits/{n}" for n in names])
        # The greatest commit decides, even where its version is null.
        last = log.where(F.col("kind") == kind).groupBy("project_id").agg(F.max(F.struct("n", "v")).alias("m"))
        return last.select("project_id", F.col("m.v").alias("v")).where("v IS NOT NULL")

    def read(self, kind: str) -> DataFrame:
        """All rows of a kind as of the latest commits."""
        schema, path = self.kinds[kind], f"{self.root}/{kind}"
        if not self._fs.exists(self._path(path)):
            return self.spark.createDataFrame([], schema)
        inner = T.StructType([f for f in schema if f.name != "project_id"])
        data = self.spark.read.schema(T.StructType([*inner, schema["project_id"], T.StructField("v", T.LongType())])).option("basePath", path).parquet(path)
        return data.join(self.versions(kind), ["project_id", "v"], "left_semi").select(*schema.fieldNames())

    def merge(self, kind: str, rows: DataFrame, keys: Sequence[str], without: DataFrame | None = None) -> int:
        """Merges rows by project and keys, drops the keys of without, and returns the commit's number.

        A row's values replace those of the same key where they aren't null; other values stay. Of rows with the same key the
        greatest values count, field by field. The same merge twice changes nothing. Rows without a project are left out.
        """
        schema, both = self.kinds[kind], ["project_id", *keys]
        others = [c for c in schema.fieldNames() if c not in both]
        new = rows.where("project_id IS NOT NULL").select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        new = new.groupBy(*both).agg(*[F.max(c).alias(c) for c in others]) if others else new.distinct()
        touched = new.select("project_id")
        if without is not None:
            touched = touched.unionAll(without.select("project_id"))
        touched = touched.where("project_id IS NOT NULL").distinct()
        old = self.read(kind).join(touched, "project_id", "left_semi")
        # By key, a new value before an old one: one shuffle, and nulls are equal keys.
        tagged = old.select("*", F.lit(0).alias("_age")).unionByName(new.select("*", F.lit(1).alias("_age")))
        out = tagged.groupBy(*both).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c) for c in others], F.max("_age").alias("_age")).drop("_age")
        if without is not None:
            gone = without.select(*[F.col(c).alias(f"_g_{c}") for c in both]).distinct()
            same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in both]
            out = out.join(gone, same, "left_anti")
        number = int((self._commits() or ["0"])[-1]) + 1
        out.withColumn("v", F.lit(number)).repartition("project_id").write.mode("append").partitionBy("project_id", "v").parquet(f"{self.root}/{kind}")
        self._commit(number, touched.select(F.lit(kind).alias("kind"), "project_id", F.lit(number).alias("v")))
        return number

    def wipe(self, projects: DataFrame) -> int:
        """Takes all nodes and edges of projects (project_id) out of sight, in one commit; no file of data is opened or written."""
        kinds = F.explode(F.array(*map(F.lit, self.kinds))).alias("kind")
        number = int((self._commits() or ["0"])[-1]) + 1
        self._commit(number, projects.select("project_id", kinds).where("project_id IS NOT NULL").distinct().withColumn("v", F.lit(None)))
        return number

    def superseded(self, kind: str) -> DataFrame:
        """(project_id, v): versions that no reader takes any more and a clean-up may delete."""
        names = self._commits()
        current = self.versions(kind)
        if not names:
            return current
        schema = T.StructType([T.StructField("kind", T.StringType()), *current.schema.fields])
        log = self.spark.read.schema(schema).parquet(*[f"{self.root}/commits/{n}" for n in names])
        return log.where((F.col("kind") == kind) & F.col("v").isNotNull()).select("project_id", "v").distinct().join(current, ["project_id", "v"], "left_anti")
