"""The folder that driver and executors share: tables on the way, and files that are written whole, sidecars last."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, where that is unset below the warehouse; an error where that is a folder of one machine of a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if spark.conf.get("spark.checkpoint.dir", None) is None and base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/quillstage-{uuid.uuid4().hex}-{name}"


def write_files(files: DataFrame, folder: str) -> tuple[int, int]:
    """Writes (name, content, sidecar) and returns how many files and bytes of content there are.

    A file has a passing name until it is whole, so readers never see a part, and a task that is run again leaves the same
    files. A sidecar (text, null for none) is written behind its content, as <name>.json: where it stands, the content does.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()

        def put(name: str, content: bytes) -> None:
            passing = f"{base}/.{name}.{attempt}.tmp"
            with store.open_output_stream(passing, compression=None) as out:
                out.write(content)
            store.move(passing, f"{base}/{name}")

        for frame in frames:
            for name, content, sidecar in zip(frame["name"].tolist(), frame["content"].tolist(), frame["sidecar"].tolist(), strict=True):
                put(name, content or b"")
                if sidecar is not None:
                    put(f"{name}.json", sidecar.encode())
            yield pd.DataFrame({"name": frame["name"], "bytes": [len(c or b"") for c in frame["content"].tolist()]})

    rows = files.select("name", F.col("content").cast("binary").alias("content"), F.col("sidecar").cast("string").alias("sidecar"))
    done = rows.mapInPandas(write, "name string, bytes long").agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return done[0], done[1]
