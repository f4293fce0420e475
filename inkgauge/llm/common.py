"""What the operators of this subpackage share: reading tables, Arrow mapping, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts are handed to Python code in slices of at most so many characters (one text at least).
SLICE_CHARS = 8_000_000
#: Whether a query's shuffle files go when it ends; else they stay until the driver collects garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer splits than there are cores is dealt out first, as its rows take long."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def map_texts(
    docs: DataFrame,
    keys: Sequence[str],
    text_col: str,
    out: T.StructType,
    compute: Callable[[list[str]], dict[str, Sequence]],
) -> DataFrame:
    """One row per input row: the key columns and what ``compute`` returns for its text.

    Only the keys and the text reach Python, so further columns of ``docs`` cannot clash.
    Null texts arrive as empty ones. ``compute`` sees bounded slices of a batch.
    """
    schema = T.StructType([*(docs.schema[k] for k in keys), *out.fields])
    arrow = to_arrow_schema(schema)
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(len(names))
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            while at < len(sizes):
                end, chars = at, 0
                while end < len(sizes) and (end == at or chars + sizes[end] <= SLICE_CHARS):
                    chars += sizes[end]
                    end += 1
                made = compute([t or "" for t in texts.slice(at, end - at).to_pylist()])
                columns = [batch.column(i).slice(at, end - at) for i in range(len(names))]
                columns = [c.cast(arrow.field(i).type) for i, c in enumerate(columns)]
                columns += [pa.array(made[f.name], type=arrow.field(f.name).type) for f in out.fields]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                at = end
        # Workers serve one stage after the other; what this one needed must not stay.
        pa.default_memory_pool().release_unused()

    return docs.select(*[docs[k] for k in keys], docs[text_col]).mapInArrow(run, schema)


class SharedFolder:
    """Tables written to the folder that driver and executors share, to cut lineage.

    The folder comes from ``spark.checkpoint.dir``; only a local master may leave that unset
    (tests on one machine), and a temporary folder is used. A written table survives lost executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="inkgauge-")
        self.root = f"{base.rstrip('/')}/inkgauge/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back; the shuffle files that made it are freed at once."""
        path = f"{self.root}/{name}"
        was = self.spark.conf.get(FREES_SHUFFLES)
        self.spark.conf.set(FREES_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(FREES_SHUFFLES, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)
