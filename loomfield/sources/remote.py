"""What lies elsewhere: files and web addresses as bytes, images, and query endpoints."""

from __future__ import annotations

import base64
import io
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import DataError

RETRIES, BACKOFF = 5, 1.0
ACCEPT = {"json": "application/sparql-results+json", "xml": "application/sparql-results+xml", "tsv": "text/tab-separated-values"}


def should_retry(status: int) -> bool:
    return status == 429 or 500 <= status < 600


def wait(attempt: int, retry_after: str | None) -> float:
    """Seconds before the next attempt: what the server asks for, else doubling."""
    try:
        return max(0.0, float(int(retry_after)))
    except (TypeError, ValueError):
        return BACKOFF * 2**attempt


def fetch(url: str, headers: dict[str, str] | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep, data: bytes | None = None, timeout: float = 60) -> bytes:
    """The answer to a GET, or to a POST of data; tried again where the server is busy."""
    for attempt in range(RETRIES + 1):
        try:
            with opener(urllib.request.Request(url, data, headers=headers or {}), timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if not should_retry(e.code) or attempt == RETRIES:
                raise
            sleep(wait(attempt, e.headers.get("Retry-After") if e.headers else None))
    raise AssertionError


def load(url: str) -> bytes:
    """Bytes of an http, https or file address, or of a bare path."""
    scheme = urllib.parse.urlparse(url).scheme
    if scheme in ("http", "https"):
        return fetch(url)
    if scheme == "file":
        url = urllib.parse.unquote(urllib.parse.urlparse(url).path)
    elif scheme:
        raise DataError(f"unsupported scheme {scheme}")
    with open(url, "rb") as f:
        return f.read()


def load_column(df: DataFrame, url: str, into: str = "data") -> DataFrame:
    """df with the bytes behind a column of addresses."""

    @F.pandas_udf("binary")
    def get(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else load(u))

    return df.withColumn(into, get(F.col(url)))


def rgb(data: bytes | str):
    """Height x width x 3 array of an image's bytes or base64 text; needs an image library."""
    try:
        import numpy as np
        from PIL import Image
    except ImportError as e:
        raise DataError("decoding images needs PIL") from e
    raw = base64.b64decode(data) if isinstance(data, str) else data
    return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))


class EndpointSource(DataSource):
    """Batch source `query_endpoint`: one GET with the query, its answer as one row of text. Options: url, query, format, and header.NAME."""

    @classmethod
    def name(cls) -> str:
        return "query_endpoint"

    def schema(self) -> str:
        return "format string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _EndpointReader(dict(self.options))


class _EndpointReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple[str, str]]:
        kind = self.options.get("format", "json")
        headers = {k[7:]: v for k, v in self.options.items() if k.startswith("header.")} | {"Accept": ACCEPT[kind]}
        url = self.options["url"] + "?" + urllib.parse.urlencode({"query": self.options["query"]})
        yield kind, fetch(url, headers).decode()
