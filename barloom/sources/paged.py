"""Bars from a paged service, as a Spark data source.

A service answers `page(symbol, timeframe, since, limit)` with at most `limit`
bars from a time on, as [milliseconds, open, high, low, close, volume]. The
source cuts the range asked for into stretches of `pages` pages; each symbol,
timeframe and stretch is a partition, which a task reads page by page until its
end. With the option push=true, filters on symbol, timeframe and ts reach the
source, so stretches outside them are never asked for; Spark wants the setting
`spark.sql.python.filterPushdown.enabled` for that, which is the caller's. As a
stream, offsets are times: a batch has the bars between the last one and the
newest bar that the service tells of, and a restart goes on from its checkpoint.

Options: `service` (module:Class, made with all options), `symbols` and
`timeframes` (comma-separated), `since` and `until` (milliseconds, or times
like 2024-01-31T00:00:00), `limit` (1000), `pages` (50), `attempts` (3).

`Files` is a service over a folder, for what was downloaded before and for tests.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .bars import TIMEFRAMES

SCHEMA = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
_ARROW = pa.schema([("symbol", pa.string()), ("timeframe", pa.string()), ("ts", pa.timestamp("us", "UTC")), *((c, pa.float64()) for c in ("open", "high", "low", "close", "volume"))])


class Files:
    """Pages in a folder (option `folder`, a path or URI): {symbol}/{timeframe}/{first bar's milliseconds}.json, a list of bars each."""

    def __init__(self, options: dict[str, str]):
        folder = options["folder"]
        self.fs, self.root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)

    def _pages(self, symbol: str, timeframe: str) -> list[tuple[int, str]]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{symbol}/{timeframe}", allow_not_found=True))
        return sorted((int(f.base_name.removesuffix(".json")), f.path) for f in found if f.base_name.endswith(".json"))

    def page(self, symbol: str, timeframe: str, since: int, limit: int) -> list[list[float]]:
        pages, out = self._pages(symbol, timeframe), []
        first = max((i for i, (ms, _) in enumerate(pages) if ms <= since), default=0)
        for _, path in pages[first:]:
            with self.fs.open_input_file(path) as f:
                out += [bar for bar in json.loads(f.read()) if bar[0] >= since]
            if len(out) >= limit:
                break
        return sorted(out)[:limit]

    def newest(self, symbol: str, timeframe: str) -> int | None:
        """Milliseconds of the last bar."""
        pages = self._pages(symbol, timeframe)
        if not pages:
            return None
        with self.fs.open_input_file(pages[-1][1]) as f:
            return int(max(bar[0] for bar in json.loads(f.read())))


def milliseconds(x) -> int:
    if isinstance(x, datetime):
        return round((x if x.tzinfo else x.astimezone()).timestamp() * 1000)
    if str(x).lstrip("-").isdigit():
        return int(x)
    return round(datetime.fromisoformat(x).replace(tzinfo=timezone.utc).timestamp() * 1000)


@dataclass
class Stretch(InputPartition):
    """The bars of a series from since until (not itself)."""

    symbol: str
    timeframe: str
    since: int
    until: int


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        module, name = self.options.get("service", "barloom.sources.paged:Files").split(":")
        self.service = getattr(importlib.import_module(module), name)(self.options)
        self.symbols, self.timeframes = ([x.strip() for x in self.options[n].split(",")] for n in ("symbols", "timeframes"))
        self.limit, self.pages, self.attempts = (int(self.options.get(n, d)) for n, d in (("limit", 1000), ("pages", 50), ("attempts", 3)))
        self.since = milliseconds(self.options.get("since", 0))
        self.until = milliseconds(self.options["until"]) if "until" in self.options else None

    def newest(self) -> int:
        """The end of the newest bar, in milliseconds; `since` if there is none."""
        found = [(self.service.newest(s, t), TIMEFRAMES[t]) for s in self.symbols for t in self.timeframes]
        return max((ms + 1000 * width for ms, width in found if ms is not None), default=self.since)

    def stretches(self, since: int, until: int) -> list[Stretch]:
        out = []
        for symbol in self.symbols:
            for timeframe in self.timeframes:
                step = 1000 * TIMEFRAMES[timeframe] * self.limit * self.pages
                out += [Stretch(symbol, timeframe, at, min(at + step, until)) for at in range(since, until, step)]
        return out

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no stretches
            return
        width, at = 1000 * TIMEFRAMES[part.timeframe], part.since
        while at < part.until:
            bars = self._asked(part, at)
            own = [b for b in bars if at <= b[0] < part.until]
            if own:
                columns = list(zip(*own, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([part.symbol] * len(own)), pa.array([part.timeframe] * len(own)), pa.array([1000 * int(ms) for ms in columns[0]], pa.timestamp("us", "UTC")), *(pa.array([None if x is None else float(x) for x in c], pa.float64()) for c in columns[1:6])], schema=_ARROW)
            if len(bars) < self.limit:
                return
            at = int(bars[-1][0]) + width

    def _asked(self, part: Stretch, at: int) -> list[list[float]]:
        for attempt in range(self.attempts):
            try:
                return self.service.page(part.symbol, part.timeframe, at, self.limit)
            except OSError:
                if attempt == self.attempts - 1:
                    raise
                time.sleep(0.2 * 2**attempt)
        return []


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        newest = self.newest()
        return self.stretches(self.since, newest if self.until is None else min(self.until, newest))


class _Narrowed(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what narrows symbols, timeframes and the range; Spark keeps the rest, and all on ts, whose bounds are only a range here."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column in ("symbol", "timeframe") and isinstance(f, (EqualTo, In)):
                name, wanted = f"{column}s", {f.value} if isinstance(f, EqualTo) else set(f.value)
                setattr(self, name, [x for x in getattr(self, name) if x in wanted])
                continue
            if column == "ts" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.since = max(self.since, milliseconds(f.value))
            if column == "ts" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.until = min(milliseconds(f.value) + 1, self.until if self.until is not None else 1 << 62)
            yield f


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"ms": self.since}

    def latestOffset(self) -> dict:
        newest = self.newest()
        return {"ms": max(self.since, newest if self.until is None else min(self.until, newest))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self.stretches(start["ms"], end["ms"])


class PagedBars(DataSource):
    """spark.dataSource.register(PagedBars), then spark.read.format("paged_bars").options(..).load()."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_Narrowed if dict(self.options).get("push") == "true" else _Reader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
