"""Plays as a source and sink of Spark: ``spark.read.format("plays")`` and ``df.write.format("plays")``.

Reading plans its partitions by the sizes of files, passes over documents of other pieces where a filter names one, and
refuses documents of another schema version. Writing puts every document into a passing folder; only the commit of the whole job
moves them to where readers look, and a job that fails leaves nothing.
"""

from __future__ import annotations

import heapq
import json
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillstage.sources.play import DOCUMENT, SCHEMA_VERSION

#: Bytes of files that a partition reads, more only where one file has more, and documents of a batch.
PART_BYTES, BATCH_DOCS = 16_000_000, 256
#: Moves of a commit at a time, and how often a passing folder is tried to be deleted.
MOVERS, LEAVING = 16, 10
_PASSING = "_passing"


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


def _store(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def dealt(sizes: list[tuple[str, int]], most: int = PART_BYTES) -> list[list[str]]:
    """Files in groups of at most ``most`` bytes or a single file, the largest first, each to the group that holds least, a new one where it does not fit."""
    groups: list[list[str]] = []
    least: list[tuple[int, int]] = []
    for name, size in sorted(sizes, key=lambda f: (-f[1], f[0])):
        if least and least[0][0] + size <= most:
            held, k = least[0]
            groups[k].append(name)
            heapq.heapreplace(least, (held + size, k))
        else:
            groups.append([name])
            heapq.heappush(least, (size, len(groups) - 1))
    return groups


def documents(raw: bytes) -> Iterator[dict]:
    """The documents of a file: one over all its lines, or one a line."""
    text = raw.decode("utf-8-sig")
    try:
        yield json.loads(text)
    except json.JSONDecodeError:
        yield from (json.loads(line) for line in text.splitlines() if line.strip())


class PlayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, strict: bool) -> None:
        self.path, self.schema, self.strict = path, schema, strict
        self.pieces: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("piece",):
                self.pieces = {f.value} if self.pieces is None else self.pieces & {f.value}
            else:
                yield f

    def partitions(self) -> list[Files]:
        import pyarrow.fs as fs

        store, base = _store(self.path)
        listed = store.get_file_info(fs.FileSelector(base, recursive=False))
        sizes = [(f.path, f.size) for f in listed if f.type == fs.FileType.File and f.base_name.endswith(".json") and f.base_name[0] not in "._"]
        return [Files(names) for names in dealt(sizes)]

    def read(self, partition: Files):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        store, kind, found = _store(self.path)[0], to_arrow_schema(self.schema), []
        for name in partition.names:
            with store.open_input_stream(name) as file:
                for doc in documents(file.read()):
                    if self.strict and doc.get("schema") != SCHEMA_VERSION:
                        raise ValueError(f"unexpected schema {doc.get('schema')} in {name}")
                    if self.pieces is None or doc.get("piece") in self.pieces:
                        found.append(doc | {"file": name})
            if len(found) >= BATCH_DOCS:
                yield from pa.Table.from_pylist(found, kind).to_batches()
                found = []
        if found:
            yield from pa.Table.from_pylist(found, kind).to_batches()


class PlayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        # tasks never make this folder, so none brings it back that ends after the job was given up
        store, base = _store(path)
        store.create_dir(f"{base}/{_PASSING}-{self.job}", recursive=True)

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, base = _store(self.path)
        task = TaskContext.get()
        # a task that is run again writes to a folder of its own, and only the one that counts tells its names
        folder = f"{base}/{_PASSING}-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(folder, recursive=False)
        done = Written()
        for n, row in enumerate(row for batch in iterator for row in batch.to_pylist()):
            doc = {k: v for k, v in row.items() if v is not None and k != "file"}
            slug = re.sub(r"[^\w-]+", "-", str(doc.get("piece", "")))[:80]
            name = f"{folder}/{slug}.{task.partitionId()}-{n}_REPET.json"
            with store.open_output_stream(name, compression=None) as out:
                out.write(json.dumps(doc, ensure_ascii=False).encode())
            done.names.append(name)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        import pyarrow.fs as fs

        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.base_name.endswith(".json"):
                    store.delete_file(f.path)

        def move(name: str) -> None:
            place = name.rsplit("/", 1)[1]
            store.move(name, f"{base}/{place.replace('_REPET.json', f'-{self.job[:8]}_REPET.json')}")

        # a move waits for the store, so many wait at once
        with ThreadPoolExecutor(MOVERS) as movers:
            for _ in movers.map(move, (n for m in messages if m is not None for n in m.names)):
                pass
        self._leave()

    def abort(self, messages: list[Written | None]) -> None:
        self._leave()

    def _leave(self) -> None:
        import pyarrow.fs as fs

        store, base = _store(self.path)
        passing = f"{base}/{_PASSING}-{self.job}"
        for tries in range(LEAVING, 0, -1):
            if store.get_file_info(passing).type != fs.FileType.Directory:
                return
            try:
                store.delete_dir(passing)
            except OSError:  # a task that has not ended yet put a file there meanwhile
                if tries == 1:
                    raise
                time.sleep(0.2)


class PlaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plays"

    def schema(self) -> str:
        return f"{DOCUMENT}, file string"

    def reader(self, schema: StructType) -> PlayReader:
        return PlayReader(self.options["path"], schema, self.options.get("strict", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> PlayWriter:
        return PlayWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format ``plays`` from now on and hands filters to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlaySource)
    return spark
