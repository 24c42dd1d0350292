"""Plumbing that the operators share: written intermediate tables and joins that check sizes.

Intermediate results are Parquet tables in the folder that the session names
in ``spark.checkpoint.dir``; all executors see it, so a lost executor costs a
reread and nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of the small side of a join that are sent to every executor, as
#: Spark's rows hold them.  Above it, rows are shuffled.
BROADCAST_BYTES = 32 << 20

#: What goes to a Python worker at once: whole texts are long, and both sides hold
#: a batch several times over.  Set once in a session, unless it asks for less.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 10_000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
#: Written tables of this process that nobody has deleted yet.
_left: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that has none (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="duelscope-")
    return _own["folder"]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/duelscope/{name}-{uuid.uuid4().hex}"


def _bounded(spark: SparkSession) -> None:
    for key, most in ARROW.items():
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About what a value takes in one of Spark's rows."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType | T.ArrayType):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, kind.elementType))
        else:
            inner = F.size(value).cast("long") * 8
        return F.coalesce(inner, F.lit(0).cast("long")) + 16
    return F.lit(8).cast("long")


def _sizes(df: DataFrame) -> tuple[Column, Column]:
    each = sum((_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))
    return F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each), F.lit(0)).alias("bytes")


def stash(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write the rows once and read them back: lineage ends here and no later job computes them again.

    The rows and bytes are counted while they are written, so that a choice
    of join needs no job of its own (a task that runs twice may count twice).
    by: a column of few values that later plans select one of; each gets a folder of its own.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    _bounded(spark)
    seen = Observation()
    writer = df.observe(seen, *_sizes(df)).write.option("compression", "snappy")
    kept_until_end(spark, path)
    (writer.partitionBy(by) if by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stashed, back._sizes = path, (seen.get["rows"], seen.get["bytes"])
    return back


def kept_until_end(spark: SparkSession, path: str) -> str:
    """A folder that something else than ``stash`` writes to, to be deleted with the tables of this process."""
    if not _left:
        atexit.register(clean, spark)
    _left.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _left.discard(path)


def forget(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_stashed", None):
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all written tables of this process, results that read them included; also done when it ends."""
    for path in list(_left):
        with contextlib.suppress(Exception):
            _delete(spark, path)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table: known where it is a stashed one, else counted."""
    if not hasattr(df, "_sizes"):
        row = df.agg(*_sizes(df)).first()
        df._sizes = (row["rows"], row["bytes"])
    return df._sizes


def empty(df: DataFrame) -> bool:
    return not measured(df)[0]


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the table's rows take at most so many bytes."""
    return measured(df)[1] <= most


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def sent(small: DataFrame) -> DataFrame:
    """The table, marked to go to all executors if it is small enough."""
    return F.broadcast(small) if small_enough(small) else small


def keyed(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join a table with a smaller one: sent to all executors if it is small, else shuffled (AQE splits hot keys)."""
    return big.join(sent(small), on, how)


def lookup(big: DataFrame, small: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """Left join with a table of one row per key (null is a key too), where one key may hold a third of all rows.

    A small table is broadcast.  A larger one is repeated once per salt and the
    big side is dealt out by (key, salt), so no task gets a whole hot key.
    """
    other = small.withColumnRenamed(key, "__key")
    if small_enough(small):
        return big.join(F.broadcast(other), big[key].eqNullSafe(other["__key"]), "left").drop("__key")
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[big[c] for c in big.columns]), F.lit(salts)))
    other = other.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(other, salted[key].eqNullSafe(other["__key"]) & (salted["__salt"] == other["__salt2"]), "left").drop("__key", "__salt", "__salt2")


def row_key(docs: DataFrame, *columns: str) -> Column:
    """A 64-bit key of what a row holds in these columns: with doc_id it tells rows of one doc_id apart, unless they are equal."""
    parts = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*parts, *[p.isNull() for p in parts])


def rows_but(docs: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """The documents without those rows whose doc_id and ``row_key`` of the columns stand in ``gone`` (doc_id, key)."""
    key, other = unused(docs, "__key"), unused(docs, "__doc")
    out = gone.select(F.col("doc_id").alias(other), F.col("key").alias(f"{key}2"))
    out = F.broadcast(out) if small_enough(gone) else out
    keyed_docs = docs.withColumn(key, row_key(docs, *columns))
    return keyed_docs.join(out, (F.col(key) == F.col(f"{key}2")) & F.col("doc_id").eqNullSafe(F.col(other)), "left_anti").drop(key)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a whole text, divided by ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
