"""Answer sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: One answer may be a megabyte of names that thousands of questions share. The dictionary of a column chunk takes such
#: texts, so a chunk holds each once, and row groups are short, as writers and readers hold a page or a batch of
#: whole texts, which by default may have thousands of rows and never reaches over the end of a row group.
#: A text is stored again in every row group, so it is packed by a codec that sees more of it than 64 kB at a time. Least
#: and greatest answers are of no use, and finding them compares every long text byte by byte.
_LONG_TEXTS = {
    "compression": "zstd",
    "parquet.column.statistics.enabled#answer": "false",
    "parquet.dictionary.page.size": 64 << 20,
    "parquet.block.size": 16 << 20,
    "parquet.block.row.count.limit": 256,
    "parquet.block.size.row.check.max": 64,
    "parquet.block.size.row.check.min": 64,
    "parquet.page.size.row.check.max": 64,
    "parquet.page.size.row.check.min": 64,
}


def write_answers(answers: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    answers.write.mode(mode).format(fmt).options(**(_LONG_TEXTS if fmt == "parquet" else {})).save(path)


def read_answers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The written answers, a task for each file or piece of one.

    A file holds few different long texts, but tasks that read several files hold those of all. More than a writer's
    dictionary takes, by default a megabyte, and it writes the rows so far whole, all in one page. How
    files are dealt to tasks is a setting of the session that opens them, so they are opened by one of their own.
    """
    opening = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if opening.conf.isModifiable(key):
            opening.conf.set(key, value)
    opening.conf.set("spark.sql.files.openCostInBytes", opening.conf.get("spark.sql.files.maxPartitionBytes"))
    answers = opening.read.format(fmt).load(path)
    return spark.createDataFrame([], answers.schema).unionByName(answers)
