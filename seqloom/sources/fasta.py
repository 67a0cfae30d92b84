"""FASTA files as tables, and tables as FASTA files; gzip by suffix."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs


def parse_record(record: Column) -> tuple[Column, Column]:
    """(name, residues) of what stands between one ``>`` that begins a line and the next."""
    cut = F.instr(record, "\n")
    name = F.when(cut > 0, F.substring(record, F.lit(1), cut - 1)).otherwise(record)
    rest = F.when(cut > 0, F.substring(record, cut + 1, F.lit(2**31 - 1))).otherwise(F.lit(""))
    return F.trim(F.replace(name, F.lit("\r"), F.lit(""))), F.regexp_replace(rest, r"\s", "")


def read_fasta(spark: SparkSession, paths: str | list[str], mask: bool = True, first_id: int = 0) -> DataFrame:
    """``seq_id, name, residues``; ids are dense and follow the order of paths, of files in them and of records.

    A record starts at a ``>`` that begins a line, so ``>`` within a header stays; blank lines and an empty header are
    fine; text before the first record is ignored; an empty file has no records. Files are read by splits, so a large
    one is many tasks and no value is larger than a record (a gzip file is one task). Ids need two reads: one counts
    the records of each split. Residues are upper-cased without ``*``; ``mask`` turns J, O and U to X.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = None
    for order, path in enumerate(paths):
        place = F.struct("_metadata.file_path", "_metadata.file_block_start")
        one = spark.read.option("lineSep", "\n>").text(path).select(F.lit(order).alias("file"), place.alias("split"), F.monotonically_increasing_id().alias("place"), "value")
        files = one if files is None else files.unionAll(one)
    splits = files.groupBy("file", "split").agg(F.min("place").alias("first"), F.min_by("value", "place").substr(1, 1).alias("mark"), F.count("*").alias("n"))
    # what a file begins with is a record only if it begins with the mark
    begins = F.col("split.file_block_start") == 0
    skip = (begins & (F.coalesce("mark", F.lit("")) != ">")).cast("long")
    before = F.sum(F.col("n") - F.col("skip")).over(Window.orderBy("file", "split")) - (F.col("n") - F.col("skip"))  # a row a split
    splits = splits.withColumn("skip", skip).select(F.col("file").alias("f"), F.col("split").alias("s"), "first", "skip", before.alias("base"))
    rows = files.join(splits, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    at = F.col("place") - F.col("first")
    rows = rows.where(at >= F.col("skip")).withColumn("value", F.when((at == 0) & (F.col("split.file_block_start") == 0), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")))
    name, residues = parse_record(F.col("value"))
    residues = exprs.normalize(residues)
    return rows.select((F.col("base") + at - F.col("skip") + first_id).alias("seq_id"), name.alias("name"), (exprs.mask_ignored(residues) if mask else residues).alias("residues"))


def write_fasta(df: DataFrame, path: str, order_col: str = "seq_id", space: bool = False, asterisk: bool = False, mode: str = "errorifexists", compression: str | None = None) -> None:
    """Records ordered by id over all files (range partitions, so no single task sorts the table);
    ``compression`` is a codec such as gzip."""
    rows = df.repartitionByRange(F.col(order_col)).sortWithinPartitions(order_col)
    out = rows.select(exprs.fasta_record(F.col("name"), F.col("residues"), space, asterisk).alias("value")).write.mode(mode)
    (out.option("compression", compression) if compression else out).text(path)
