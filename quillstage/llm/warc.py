"""WARC archives: whole-file gzip streams are inflated once and rewritten with a gzip member for every record, beside a
sidecar index of offsets.

``write_archives`` puts the rows of each partition into archives of bounded size, each a single gzip stream, and returns a
narrow index. ``decide`` finds payloads that occur more than once from that index alone: payloads are never shuffled.
``normalise`` streams each archive once, writes every record as its own member, its header lines as they came, makes revisit
records of the repeated ones, and writes the sidecar. ``read_archives`` goes by the sidecars: it seeks, inflates one member at a time, parses it and checks
the digest.

Files get a name of their own while they are written and are then renamed, so a task that is run again leaves the same
files. All files lie in the shared folder; any file system that pyarrow can open will do.

Defined results: no two records have one id, whatever the page ids; null html is the empty payload; of equal payloads that with the largest page id is the response; rows with
equal id and payload are responses alike; pages without an id are given back without one; payloads below ``least`` bytes are
responses always; an empty table writes no archive and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm.common import drop_table, read, shared_dir, written

#: Bytes of payload after which an archive is closed, and most records in one.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 32_000_000, 50_000
CHUNK = 1 << 18
GZIP = 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page: str | None, archive: str, at: int) -> str:
    """The id of a record: its page, and by archive and place there no other record's."""
    return f"<urn:page:{quote(page or '', safe='')}:{archive}:{at}>"


def record(urn: str, url: str | None, payload: bytes, sha1: str) -> bytes:
    """A WARC response record. An address is written as it is but for what no header line can hold."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: {urn}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisit(head: bytes, block: bytes, refers_to: str) -> bytes:
    """The revisit record of a response: its header lines but for type and length, its HTTP headers, none of its payload."""
    http = block[: block.find(b"\r\n\r\n") + 4]
    changed = {b"warc-type": b"WARC-Type: revisit", b"content-length": b"Content-Length: %d" % len(http)}
    lines = [changed.get(line.partition(b":")[0].strip().lower(), line) for line in head.split(b"\r\n")]
    lines += [f"WARC-Profile: {PROFILE}".encode(), f"WARC-Refers-To: {refers_to}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Fields of a header block by lower-cased name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Header lines, their fields and block of each record in a stream of inflated bytes."""
    have, more = bytearray(), True

    def pull(n: int) -> bool:
        nonlocal more
        while len(have) < n and more:
            chunk = next(chunks, None)
            more = chunk is not None
            have.extend(chunk or b"")
        return len(have) >= n

    while pull(1):
        seen = 0
        while (at := have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(have)
            if not pull(seen + 1):
                raise ValueError("an archive ends inside a header")
        head = bytes(have[:at])
        fields = headers(head)
        end = at + 4 + int(fields["content-length"])
        if not pull(end + 4):
            raise ValueError("an archive ends inside a record")
        block = bytes(have[at + 4 : end])
        del have[: end + 4]
        yield head, fields, block


def page_of(urn: str | None) -> str | None:
    return unquote(urn.split(":")[2]) or None if urn else None


def _store(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


class _Out:
    """A file under a passing name that takes its own when it is closed."""

    def __init__(self, folder: str, name: str) -> None:
        self.store, base = _store(folder)
        self.store.create_dir(base, recursive=True)
        self.name, self.path = name, f"{base}/{name}"
        task = TaskContext.get()
        self.passing = f"{base}/.{name}.{task.taskAttemptId() if task else 0}"
        self.stream = self.store.open_output_stream(self.passing, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.passing, self.path)


def write_archives(df: DataFrame, folder: str, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Archives of response records, each one gzip stream. Lazy: the index (archive, at, page, payload_bytes, payload_digest) must be written once."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        out = gz = None
        size = n = 0
        for frame in frames:
            rows = []
            for p, u, h in zip(frame["p"].tolist(), frame["u"].tolist(), frame["h"].tolist(), strict=True):
                if out is None:
                    out, gz, size, n = _Out(folder, f"{part:06d}-{k:04d}.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                    k += 1
                payload = (h or "").encode("utf-8", "surrogatepass")
                sha1 = digest(payload)
                out.write(gz.compress(record(urn(p, out.name, n), u, payload, sha1)))
                rows.append((out.name, n, p, len(payload), sha1))
                size, n = size + len(payload), n + 1
                if size >= ARCHIVE_BYTES or n >= ARCHIVE_RECORDS:
                    out.write(gz.flush())
                    out.close()
                    out = None
            yield pd.DataFrame(rows, columns=["archive", "at", "page", "payload_bytes", "payload_digest"])
        if out is not None:
            out.write(gz.flush())
            out.close()

    rows = df.select(F.col(page).cast("string").alias("p"), F.col(url).cast("string").alias("u"), F.col(source).cast("string").alias("h"))
    return rows.mapInPandas(write, "archive string, at long, page string, payload_bytes long, payload_digest string")


def decide(index: DataFrame, least: int = 0) -> DataFrame:
    """Adds refers_to and refers_at: null for responses, else page and (archive, at) of the response with the same payload. Page ids compare as integers; other ids never stand first."""
    number = F.col("page").try_cast("long")
    place = F.when(number.isNotNull(), F.struct(number.alias("page"), "archive", "at"))
    first = index.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max(place).alias("__first"), F.count("*").alias("__n"))
    first = first.filter("__n > 1 and __first is not null").drop("__n")
    joined = index.join(first, ["payload_digest", "payload_bytes"], "left")
    repeats = F.col("__first.page") != F.coalesce(number, F.col("__first.page") - 1)
    return joined.withColumns(
        {"refers_to": F.when(repeats, F.col("__first.page").cast("string")), "refers_at": F.when(repeats, F.struct("__first.archive", "__first.at"))}
    ).drop("__first")


def _inflated(stream) -> Iterator[bytes]:
    engine = zlib.decompressobj(GZIP)
    while chunk := stream.read(CHUNK):
        yield engine.decompress(chunk)
    yield engine.flush()
    if not engine.eof:
        raise ValueError("a gzip stream is cut short")


def normalise(decided: DataFrame, source: str, folder: str) -> DataFrame:
    """Per archive: its stream is inflated once and each record rewritten as its own member; the sidecar has their offsets.

    The rows of one archive are at most ARCHIVE_RECORDS. Lazy: returns (archive, records, bytes), to be written once.
    """

    def rewrite(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["archive"].iloc[0]
        refers = {
            at: None if page is None else urn(page, other, int(place)) for at, page, other,
            place in zip(rows["at"].tolist(), rows["refers_to"].tolist(), rows["other"].tolist(), rows["place"].tolist(), strict=True)
        }
        store, base = _store(source)
        out, sidecar, offset, n = _Out(folder, name), _Out(folder, f"{name}.idx"), 0, 0
        with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
            for n, (head, fields, block) in enumerate(records(_inflated(stream)), 1):
                target = refers[n - 1]
                kind = "response" if target is None else "revisit"
                engine = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                raw = revisit(head, block, target) if target else head + b"\r\n\r\n" + block + b"\r\n\r\n"
                member = engine.compress(raw) + engine.flush()
                out.write(member)
                sidecar.write(f"{offset}\t{len(member)}\t{kind}\t{fields['warc-record-id']}\n".encode())
                offset += len(member)
        if n != len(refers):
            raise ValueError(f"{name} has {n} records, its index {len(refers)}")
        out.close()
        sidecar.close()
        return pd.DataFrame([(name, n, offset)], columns=["archive", "records", "bytes"])

    decided = decided.select("archive", "at", "refers_to", F.col("refers_at.archive").alias("other"), F.coalesce("refers_at.at", F.lit(-1).cast("long")).alias("place"))
    return decided.groupBy("archive").applyInPandas(rewrite, "archive string, records long, bytes long")


READ = "page string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives named in the column ``archive``, found by offset; responses are checked by their digest."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        columns = [c.split()[0] for c in READ.split(", ")] + ["payload"] * with_payload
        for frame in frames:
            for name in frame["archive"].tolist():
                with store.open_input_stream(f"{base}/{name}.idx", compression=None) as s:
                    entries = [line.split("\t") for line in s.read().decode().splitlines()]
                rows = []
                with store.open_input_file(f"{base}/{name}") as s:
                    for offset, length, kind, _ in entries:
                        s.seek(int(offset))
                        (_, fields, block), = records(iter([zlib.decompress(s.read(int(length)), GZIP)]))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        sha1, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(headers(head)["content-length"])
                        if fields["warc-type"] != kind or kind == "response" and (len(payload) != size or digest(payload) != sha1):
                            raise ValueError(f"a record of {name} at {offset} is damaged")
                        rows.append(
                            (
                                page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind,
                                page_of(fields.get("warc-refers-to")), size, sha1, *([payload] * with_payload)
                            )
                        )
                        if len(rows) >= 2000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

    return archives.select("archive").repartition("archive").mapInPandas(members, READ + ", payload binary" * with_payload)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    whole, split = f"{folder}-whole", f"{folder}-members"
    index = written(write_archives(read(spark, sf_dir, "pages"), whole), "warc-index")
    archives = written(normalise(decide(index), whole, split), "archives")
    drop_table(spark, whole)
    found = read_archives(archives, split)
    return found.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {"op4_warc": op4_warc}
SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, from_hex(sha1(h)) AS raw FROM p),
bits AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY h) AS top, CAST(raw AS BIT)::VARCHAR AS b FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits"""
}
