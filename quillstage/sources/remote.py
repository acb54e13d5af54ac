"""Plays in a remote folder behind an injected fetch: listing, download, ingestion."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Fetch = Callable[[str], tuple[int, str]]
SUFFIX = "_REPET.json"


class RemoteError(RuntimeError):
    def __init__(self, code: int) -> None:
        super().__init__(f"the store answered {code}")
        self.code = code


def listing_url(base: str, folder: str, token: str | None = None) -> str:
    query = {
        "q": f"'{folder}' in parents and trashed = false", "fields": "nextPageToken,files(id,name,modifiedTime)", "pageSize": 1000
    } | ({"pageToken": token} if token else {})
    return f"{base}/files?{urlencode(query)}"


def content_url(base: str, file: str) -> str:
    return f"{base}/files/{quote(file, safe='')}?alt=media"


def _get(fetch: Fetch, url: str) -> str:
    code, body = fetch(url)
    if not 200 <= code < 300:
        raise RemoteError(code)
    return body


def list_plays(spark: SparkSession, base: str, folder: str, fetch: Fetch) -> DataFrame:
    """(id, name, modified) of the plays of a folder. Names are compared here, as the store's own search cuts them into words."""
    rows, token = [], None
    while True:
        page = json.loads(_get(fetch, listing_url(base, folder, token)))
        rows += [(f["id"], f["name"], f.get("modifiedTime")) for f in page.get("files", []) if f["name"].endswith(SUFFIX)]
        token = page.get("nextPageToken")
        if not token:
            return spark.createDataFrame(rows, "id string, name string, modified string")


def download(files: DataFrame, base: str, fetch: Fetch) -> DataFrame:
    """(id, name, text, code) of listed files, fetched by the tasks; a refusal has its code and no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, name in zip(frame["id"], frame["name"], strict=True):
                code, body = fetch(content_url(base, i))
                rows.append((i, name, body if 200 <= code < 300 else None, code))
            yield pd.DataFrame(rows, columns=["id", "name", "text", "code"])

    return files.select("id", "name").mapInPandas(run, "id string, name string, text string, code int")
