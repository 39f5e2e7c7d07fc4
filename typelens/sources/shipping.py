"""Give executors this package, so that their Python can import it; settle what is read several times."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_typelens_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="typelens-"), "typelens_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(out)
    sc._typelens_shipped = True


def settle(df: DataFrame) -> DataFrame:
    """Write a frame that several steps read to the folder that driver and executors share (spark.checkpoint.dir), and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="typelens-shared-"))
    return df.checkpoint(eager=True)
