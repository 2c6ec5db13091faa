"""What the operators of this subpackage share: the shared folder, written tables and word rules."""

from __future__ import annotations

import atexit
import shutil
import uuid
import weakref

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters between words (U+0020 and U+0009 to U+000D), as regular expression classes.
SPACES = "[\\x20\\x09-\\x0D]"
NOT_SPACES = "[^\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[str] = []
_tables: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local master, as in tests, may do without a named one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/") + "/fathomline"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder; it is deleted when the process ends, if not before."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def scratch_table(name: str) -> None:
    """Have a table of the catalog dropped when the process ends."""
    _tables.append(name)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and a lost executor
    costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise gave and that nothing reads any more."""
    for table in tables:
        path = _path_of.pop(table, None)
        if path is not None:
            _delete(table.sparkSession.sparkContext, path)
            _written.remove(path)


def hadoop_path(context: SparkContext, path: str):
    """The file system of a path, and the path as it takes it."""
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(context._jsc.hadoopConfiguration()), there


def _delete(context: SparkContext, path: str) -> None:
    files, there = hadoop_path(context, path)
    files.delete(there, True)


@atexit.register
def _sweep() -> None:
    """What is left goes through Hadoop's file system while the context lives, as the folder may be a remote one."""
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        spark = SparkSession.getActiveSession()
        for name in _tables if spark is not None else ():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in _written:
            _delete(context, path)
        return
    for path in _written:
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does just that for a text of single bytes, and far faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def without(text: Column, chars: str) -> Column:
    """text without any of chars."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACES + "+")), F.lit(0)).cast("long")


#: Rows of an Arrow batch at most: texts are long, and the JVM and Python hold a batch each for every running task.
BATCH_ROWS = 1000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of BATCH_ROWS at most; a session that asks for smaller ones keeps them.

    Spark reads the setting when it plans the query that the frame ends up in, so it stays set on the session."""
    now = int(df.sparkSession.conf.get(_ROWS_CONF, "0"))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(_ROWS_CONF, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def slices(batch, most_bytes: int = 4_000_000):
    """Parts of an Arrow batch of about most_bytes each, one row at least; a batch without rows has none."""
    n = batch.num_rows
    step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def keep_one(docs: DataFrame, verdicts: DataFrame, key: Column) -> DataFrame:
    """The rows of docs that verdicts(doc_id, key, kept, repeats) keeps, with all their columns: one for each doc_id and key that is
    kept, that with the smallest hash of all its columns. verdicts has a row for each pair that docs has, is a written table, and
    says how many rows of docs share the pair; key is computed over docs."""
    marked = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), key.alias("_own_key"), row_hash(docs).alias("_row_hash"))
    pairs = verdicts.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "kept", "repeats")
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own_key") == F.col("_key"))
    # What goes is mostly less than what stays, and may be small enough for Spark to broadcast.
    once = marked.join(pairs.where(~F.col("kept") | (F.col("repeats") > 1)).select("_doc", "_key"), same, "left_anti").select("_row.*")
    again = pairs.where(F.col("kept") & (F.col("repeats") > 1)).select("_doc", "_key")
    if again.isEmpty():
        return once
    rows = marked.join(again, same, "left_semi").groupBy("_id", "_own_key").agg(F.min_by("_row", "_row_hash").alias("_row"))
    return once.unionByName(rows.select("_row.*"))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark hashes and orders values of the type: maps and variants it doesn't."""
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of docs, of any type, that tells apart rows which agree in what an operator looks at."""
    own = [_quoted(f.name) if _hashable(f.dataType) else F.to_json(F.struct(_quoted(f.name).alias("c"))) for f in docs.schema.fields]
    return F.xxhash64(*own)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one, so that their names meet no others."""
    return F.struct(*(_quoted(c) for c in docs.columns))


def numbered_types(df: DataFrame, *names: str) -> str:
    """DDL of the named columns, in order."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)
