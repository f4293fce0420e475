"""Reading tables, and tables written once where driver and executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files go when it ends; else they stay until the driver collects garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a task takes, as a text takes long.
TASK_BYTES = 6 << 20


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table, in the splits of its files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame, text_col: str = "text") -> int:
    """Over how many tasks a table's texts are dealt: by their bytes, and as many as a shuffle's partitions and the cores at least.

    Splits of a file do not tell: one that holds no beginning of a row group is empty, and a group may hold the whole table.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def _place(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def there(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there."""
    files, place = _place(spark, path)
    return files.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, not a file."""
    files, place = _place(spark, path)
    return files.getFileStatus(place).isDirectory()


def table_of(path: str) -> str:
    """What the catalog calls the table in buckets that lies in a folder."""
    return "_".join(path.rstrip("/").split("/")[-2:]).replace("-", "_")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all that it holds, and the catalog's entry of it where it has one."""
    spark.sql(f"DROP TABLE IF EXISTS `{table_of(path)}`")
    files, place = _place(spark, path)
    files.delete(place, True)


class Staging:
    """Tables in the shared folder of ``spark.checkpoint.dir``, to cut lineage.

    Only a local master may leave that unset: there a temporary folder serves. A written table
    outlives lost executors, and what is measured from it does not work the text out again.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="inkgauge-")
        self.root = f"{base.rstrip('/')}/inkgauge/{label}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []

    def save(self, df: DataFrame, name: str, by: str | None = None, buckets: int | None = None, dealt: bool = False) -> DataFrame:
        """Writes a table and reads it again; one in buckets of ``by`` needs no shuffle to be grouped or joined by that column.

        There are as many buckets as partitions of a shuffle, unless it is told. A table that is ``dealt`` by ``by`` over as many does
        not move: helpers in Python hide from the planner that it is.
        The shuffle files that made it are freed at once.
        """
        was = self.spark.conf.get(FREES_SHUFFLES)
        self.spark.conf.set(FREES_SHUFFLES, "true")
        try:
            return self._write(df, name, by, buckets, dealt)
        finally:
            self.spark.conf.set(FREES_SHUFFLES, was)

    def _write(self, df: DataFrame, name: str, by: str | None, buckets: int | None, dealt: bool) -> DataFrame:
        path = f"{self.root}/{name}"
        if by is None:
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        n, table = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")), table_of(path)
        self.tables.append(path)
        # Rows of a bucket meet in one task first, which writes one file.
        (df if dealt else df.repartition(n, by)).write.mode("overwrite").bucketBy(n, by).option("path", path).saveAsTable(table, format="parquet")
        return self.spark.table(table)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all."""
        for path in [] if name else self.tables:
            delete(self.spark, path)
        delete(self.spark, f"{self.root}/{name}" if name else self.root)
