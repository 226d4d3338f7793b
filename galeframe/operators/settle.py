"""Small fitted tables and cut lineage: written once to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from galeframe.session import shared_folder


def settle(table: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a fitted table as Parquet to the cluster's shared folder and read it back.

    A lost executor then causes no new fit. The written size is what the planner knows of the table, so it broadcasts
    by bytes (``spark.sql.autoBroadcastJoinThreshold``), and beyond them shuffles and splits skewed keys. ``folder`` is a
    ``shared_folder`` that the caller deletes when the table has served.
    """
    folder = folder or shared_folder(table.sparkSession)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)
