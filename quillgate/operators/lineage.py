"""Tables that several passes read are written once, into the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillgate.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
