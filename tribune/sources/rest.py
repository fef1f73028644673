"""REST sources as Python data sources: verbatims and votings by months, voters by voting, members.

The transport (a function url, parameters -> status, parsed JSON) is an option of the module, so that
tests run without a network; the default uses urllib. Requests of one source share a rate limit, so its partitions should be read by one task at a
time: read with coalesce(1), or set `pause` to the interface's limit times the number of tasks.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], tuple[int, object]]


def http(url: str, params: dict, timeout: float = 30) -> tuple[int, object]:
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params, doseq=True)}" if params else url, timeout=timeout) as answer:
            return answer.status, json.load(answer)
    except urllib.error.HTTPError as e:
        return e.code, None


@dataclass
class Request(InputPartition):
    """One request of a source."""

    url: str
    params: dict
    keep: dict


class _Reader(DataSourceReader):
    def __init__(self, source: _Rest, requests: list[Request]):
        self.source, self.requests = source, requests

    def partitions(self) -> list[Request]:
        return self.requests

    def read(self, request: Request | None) -> Iterator[tuple]:
        if request is None:  # how Spark reads a source without partitions
            return
        options = self.source.options
        pause, tries, wait = float(options.get("pause", 6.1)), int(options.get("tries", 1)), float(options.get("wait", 10))
        answer = None
        for _ in range(tries):
            time.sleep(pause)
            status, answer = self.source.transport(request.url, request.params)
            if status != 429:
                answer = answer if status == 200 else None
                break
            answer = None
            time.sleep(wait)
        yield from self.source.rows(answer, request.keep)


class _Rest(DataSource):
    """Rows are one text column of JSON, parsed with from_json by the caller; a request that fails gives no rows."""

    transport: Transport = staticmethod(http)

    def schema(self) -> str:
        return "json string"

    def rows(self, answer: object, keep: dict) -> Iterator[tuple]:
        for item in answer if isinstance(answer, list) else []:
            yield (json.dumps(item, ensure_ascii=False),)

    def reader(self, schema) -> _Reader:
        return _Reader(self, self.requests())

    def requests(self) -> list[Request]:
        raise NotImplementedError


class MonthsSource(_Rest):
    """Options: url, months (JSON list of first and last days), pause. A request per month."""

    @classmethod
    def name(cls) -> str:
        return "rest_months"

    def requests(self) -> list[Request]:
        o = self.options
        return [Request(o["url"], {"startDate": a, "endDate": b}, {}) for a, b in json.loads(o["months"])]


class ListSource(_Rest):
    """Options: url, params (JSON), pause. One request."""

    @classmethod
    def name(cls) -> str:
        return "rest_list"

    def requests(self) -> list[Request]:
        return [Request(self.options["url"], json.loads(self.options.get("params", "{}")), {})]


class VotersSource(_Rest):
    """Options: url, votings (JSON list of uuid and startDateTime), tries, pause, wait. A request per voting; too many requests (429) are
    tried again, other failures and votings without voters give no rows."""

    @classmethod
    def name(cls) -> str:
        return "rest_voters"

    def requests(self) -> list[Request]:
        url = self.options["url"]
        return [Request(f"{url}/{urllib.parse.quote(v['uuid'])}", {}, v) for v in json.loads(self.options["votings"])]

    def rows(self, answer: object, keep: dict) -> Iterator[tuple]:
        voters = answer.get("voters") if isinstance(answer, dict) else None
        if voters:
            yield (json.dumps(keep | {"voters": voters}, ensure_ascii=False),)


def register(spark: SparkSession, transport: Transport | None = None) -> None:
    """Register the sources; transport replaces HTTP, as in tests."""
    for source in (MonthsSource, ListSource, VotersSource):
        own = type(source.__name__, (source,), {"transport": staticmethod(transport)}) if transport else source
        spark.dataSource.register(own)
