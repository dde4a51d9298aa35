"""File texts stored by path, so that edits and line requests come to the text and no text moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class TextTable:
    """A table of files in ``buckets`` by path; every join on path with ``aligned`` rows is co-located."""

    spark: SparkSession
    name: str
    buckets: int

    @property
    def files(self) -> DataFrame:
        return self.spark.table(self.name)

    def aligned(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``path``, sent to the buckets of their texts.

        The rows are what moves: edits, hints or line numbers, never texts.  An operator that groups them
        by path keeps this partitioning, so nothing is shuffled twice.
        """
        return rows.repartition(self.buckets, "path")


def store_texts(files: DataFrame, name: str, buckets: int, folder: str | None = None) -> TextTable:
    """Write files to a table bucketed and sorted by path; texts are shuffled here, once.

    Choose ``buckets`` so that one holds a few hundred MB of text: it is the unit of every later join.
    Paths are spread by their hash, so no repository fills a bucket.  One task writes one bucket, which
    leaves one file per bucket.  A table of that name is replaced.  Null texts stay null; rows with a
    null path are kept in one bucket and meet no edit.  ``folder`` places the files, else the warehouse does.
    """
    spark = files.sparkSession
    writer = files.repartition(buckets, "path").write.bucketBy(buckets, "path").sortBy("path").mode("overwrite")
    if folder is not None:
        writer = writer.option("path", folder)
    writer.saveAsTable(name)
    return TextTable(spark, name, buckets)
