"""The query API: validation, plans, and answers as plain dicts. Only limited or aggregated rows reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators import attendance, search
from .operators.analyzer import Analyzer, SimpleAnalyzer
from .operators.query import parse_query

#: Origins that a web server in front may answer, fixed values.
ORIGINS = ["http://localhost:5173", "http://127.0.0.1:5173"]
SEARCH_LIMITS = (1, 200)


class Invalid(ValueError):
    """A parameter that the API rejects (status 422)."""


class Service:
    """Over tables speeches, postings and attendance with one analyzer."""

    def __init__(self, speeches: DataFrame, postings: DataFrame, roll: DataFrame, analyzer: Analyzer | None = None):
        self.speeches, self.postings, self.roll, self.analyzer = speeches, postings, roll, analyzer or SimpleAnalyzer()
        self._held: tuple[str, DataFrame] | None = None

    def _matches(self, q: str) -> DataFrame | None:
        """Matches of a query; those of the last query are kept, as a page asks for results, activity and speakers in turn."""
        groups = parse_query(q, self.analyzer)
        if not groups:
            return None
        if not self._held or self._held[0] != q:
            if self._held:
                self._held[1].unpersist()
            self._held = (q, search.match(self.postings, groups).persist())
        return self._held[1]

    @staticmethod
    def _dicts(df: DataFrame) -> list[dict]:
        return [r.asDict() for r in df.collect()]

    def root(self) -> dict:
        return {"status": "ok"}

    @staticmethod
    def headers(origin: str) -> dict:
        """What an answer to a browser at that origin carries: leave to read it, with any method and header, if the origin is one of ORIGINS."""
        leave = {"Access-Control-Allow-Origin": origin, "Access-Control-Allow-Methods": "*", "Access-Control-Allow-Headers": "*"}
        return leave if origin in ORIGINS else {}

    def search(self, q: str, limit: int = 50) -> dict:
        if not q or not SEARCH_LIMITS[0] <= limit <= SEARCH_LIMITS[1]:
            raise Invalid("q must not be empty, limit from 1 to 200")
        found = self._matches(q)
        results = [] if found is None else self._dicts(search.search(self.speeches, found, limit))
        return {"query": q, "count": len(results), "results": results}

    def activity(self, q: str, interval: str = "monthly") -> dict:
        if not q:
            raise Invalid("q must not be empty")
        found = self._matches(q)
        rows = [] if found is None else self._dicts(search.activity(search.attach(self.speeches.select("speech_id", "date"), found), interval))
        return {"query": q, "interval": interval, "activity": rows}

    def speakers(self, q: str, limit: int = 20) -> dict:
        found = self._matches(q) if q else None
        return {"query": q, "speakers": [] if found is None else self._dicts(search.top_speakers(search.attach(self.speeches.select("speech_id", "speaker"), found), limit))}

    def attendance(self) -> list[dict]:
        return self._dicts(attendance.stats(self.roll))
