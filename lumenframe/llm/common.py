"""What the training-data operators share: tables, scratch tables, hash folds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lumenframe.session import lean_workers

#: The characters that separate words; everything else belongs to a word.
WORD_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to Python, at most, but for a longer row.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keeps batches of long texts small on either side of the pipe to Python, and workers lean."""
    lean_workers(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.sub(r"\D", "", spark.conf.get(key, None) or "")
    if not now or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def write_scratch(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes df to the shared folder, returns the table read back and its path.

    The files outlive lost executors. drop_scratch() removes them once nothing reads them."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{scratch_root(spark)}/lumenframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def id_fold(col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string")) % F.lit(mod)


#: Cells that ids are dealt to for a coarse first choice; the most rows that are broadcast for it.
COARSE = 1 << 20


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs but for the rows whose id stands in ids (one column of that name).

    Rows in cells that hold none of ids pass without an exchange; the others are joined."""
    cell = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(COARSE))
    cells = F.broadcast(ids.select(cell.alias("__cell")).distinct())  # COARSE rows at most
    marked = docs.withColumn("__cell", cell)
    sure = marked.join(cells, "__cell", "left_anti")
    rest = marked.join(cells, "__cell", "left_semi").join(ids.select(id_col).distinct(), id_col, "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return sure.select(*columns).unionByName(rest.select(*columns))


#: Keys with more than 1/HEAVY of all rows are heavy, so there are fewer than HEAVY of them.
HEAVY = 4096


def join_spread(rows: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame, n_col: str, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined to `one`, which has a row for each key at most; counts gives the rows of each key.

    Heavy keys are split: their rows are salted by the columns `by`, and their row of `one`
    is repeated for each salt, so that no salted key has more than 1/HEAVY of all rows."""
    total = counts.agg(F.sum(n_col)).first()[0] or 1
    heavy = F.broadcast(counts.where(F.col(n_col) * HEAVY > total).select(*keys, F.ceil(F.col(n_col) * HEAVY / total).cast("int").alias("__k")))  # fewer than HEAVY rows
    salted = rows.join(heavy, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), F.coalesce("__k", F.lit(1))).cast("int")).drop("__k")
    each = one.join(heavy, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__k", F.lit(1)) - 1))).drop("__k")
    return salted.join(each, [*keys, "__salt"], how).drop("__salt")


def met_by(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of big whose keys stand in small; rows in cells that hold none of small aren't shuffled."""
    cell = F.pmod(F.xxhash64(*keys), F.lit(COARSE))
    cells = F.broadcast(small.select(cell.alias("__cell")).distinct())  # COARSE rows at most
    return big.withColumn("__cell", cell).join(cells, "__cell", "left_semi").drop("__cell").join(small.select(*keys), keys, "left_semi")


def beside_text(docs: DataFrame, name: str, fields: str, of, text_col: str = "text", rows: int = 512, keep: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """docs (or its columns `keep`) with a struct column `name`, made of its whole texts by Python.

    of() is called once for each task and returns a function from a list of texts to a
    dict of arrays by field; the other columns pass through as they are."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]
    names = [*(docs.columns[i] for i in kept), name]

    def run(batches):  # noqa: ANN001, ANN202
        make = of()
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                got = make(b.column(at).to_pylist())
                new = pa.StructArray.from_arrays([pa.array(v) for v in got.values()], names=list(got))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), new], names)

    schema = StructType([*(docs.schema.fields[i] for i in kept), StructField(name, StructType.fromDDL(fields))])
    return docs.mapInArrow(run, schema)
