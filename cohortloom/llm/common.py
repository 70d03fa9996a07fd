"""What the corpus operators share: reading tables, cutting lineage, held-out folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local session, as in tests, may do without one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: Folders of the tables that materialize() wrote and nothing has deleted, by the frame that reads them, and in order.
_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()
_WRITTEN: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: df as a written table in the shared folder, which outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    _WRITTEN.append(path)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of materialize() that no frame in use reads any more."""
    for df in frames:
        path = _FOLDERS.pop(df)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def written() -> int:
    """A mark for discard_since()."""
    return len(_WRITTEN)


def discard_since(spark: SparkSession, mark: int, but: int = 0) -> None:
    """Delete every table written since the mark, but for the last so many: for a caller that needs only what they led to."""
    gone = _WRITTEN[mark : len(_WRITTEN) - but]
    del _WRITTEN[mark : len(_WRITTEN) - but]
    for path in gone:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def whole_text(text: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, max_chars: int) -> DataFrame:
    """At most per_class labelled rows of each class, in crc32 order of their ids, joined to their texts: (doc_id, text, y).

    The bound makes the broadcast of ids safe. Rows over max_chars characters are left out of the sample, which
    concerns fitting alone; scoring takes every row. A doc_id that is labelled twice counts once, with its largest label;
    one that several rows have counts with its smallest text.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("y"))
    order = (F.crc32(F.concat(F.lit("sample "), F.col("doc_id").cast("string")).cast("binary")), F.col("doc_id"))
    ids = rows.where("y = 1").orderBy(*order).limit(per_class).unionAll(rows.where("y = 0").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", whole_text().alias("text")).where(F.length("text") <= max_chars)
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def map_text(df: DataFrame, make: Callable, added: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """df with the columns of the DDL string `added`, computed from the whole texts in Arrow batches.

    make() is called once a task and returns a function from a list of texts to a dict of lists, one for each new
    column. Nulls in other columns pass through untouched; the text itself is dropped if drop_text. A column of df that
    has the name of an added one is replaced (text is read first).
    """
    new = StructType.fromDDL(added)
    names = [f.name for f in new.fields]
    lower = {n.lower() for n in names}
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text) and f.name.lower() not in lower]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        work, types = make(), [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = work(["" if t is None else t for t in part.column(text).to_pylist()])
                old = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*old, *(pa.array(made[n], t) for n, t in zip(names, types, strict=True))], [*(f.name for f in kept), *names])

    return df.mapInArrow(run, StructType([*kept, *new.fields]))
