"""Writing results all or nothing."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """Nothing was written."""


#: Names the version that readers see; replaced by one rename.
POINTER = "CURRENT"


def write_all(tables: Mapping[str, DataFrame], root: str, sensitive: Mapping[str, Sequence[str]] | None = None, form: str = "parquet", separator: str = ";") -> str:
    """A new version of all tables below ``root``; gives its name. Readers find it by ``current``.

    All are written aside and read again: columns, numbers of rows and a hash of
    all cells must agree. Then one file, the pointer, is replaced, so readers see
    either all old tables or all new ones; whatever fails before leaves them the
    old ones, and the version before stays until the next run. Sensitive columns
    (by table) must hold nothing but ``masked``.
    """
    for name, columns in (sensitive or {}).items():
        for c in columns:
            if name in tables and c in tables[name].columns and not tables[name].where(F.col(c).isNotNull() & (F.col(c) != "masked")).isEmpty():
                raise Refused(f"{name}.{c} holds values that should be masked")
    version = f"version-{uuid.uuid4().hex}"
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    before = current(spark, root)
    try:
        for name, df in tables.items():
            out = decimal_commas(df) if form == "csv" else df
            writer = out.write.option("sep", separator).option("header", True).option("quoteAll", True) if form == "csv" else out.write
            writer.format(form).save(f"{root}/{version}/{name}")
            again = spark.read.option("sep", separator).option("header", True).option("multiLine", True).format(form).load(f"{root}/{version}/{name}")
            if again.columns and (again.columns != out.columns or _figures(again) != _figures(out)):
                raise Refused(f"{name} reads back with other rows")
        stream = fs.create(path(f"{root}/{version}.pointer"), True)
        stream.write(bytearray(version.encode()))
        stream.close()
        options = spark._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = spark._sc._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri() if "://" in root else fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(path(f"{root}/{version}.pointer")), fs.makeQualified(path(f"{root}/{POINTER}")), kinds)
    except BaseException:
        for left in (f"{root}/{version}", f"{root}/{version}.pointer"):
            fs.delete(path(left), True)
        raise
    for old in fs.listStatus(path(root)):
        name = old.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            fs.delete(old.getPath(), True)
    return version


def current(spark, root: str) -> str | None:
    """The name of the version that counts; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return spark.read.text(path.toString()).first().value


def _figures(df: DataFrame) -> tuple:
    """Number of rows and a sum over hashes of their cells as text (empty as null, which a text file can't tell apart)."""
    cells = [F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("\x00")) for c in df.columns]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def decimal_commas(df: DataFrame) -> DataFrame:
    """Numbers with fractions as text with a comma."""
    return df.select(*[F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) if t.startswith(("double", "float", "decimal")) else F.col(c) for c, t in df.dtypes])


def replace_period(df: DataFrame, path: str, column: str) -> None:
    """Write a partitioned table so that only the periods in ``df`` are replaced: a run can be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 5000, **options: str) -> None:
    """Append by batches of inserts."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()
