"""The external detection feed as a data source: `spark.read.format("detection_feed")`, a row an entry.

Box, days, data set and number of rows are applied by the feed itself. A day is a partition (with `tiles`, each of so many
by so many parts of the box is one). An answer with `limit` entries may have been cut, so its box is asked for again in
quarters, and theirs, until no answer is full: no entry is lost, whatever the limit. Quarters share no number: the first ends
at the largest double below the middle. Conditions on day, lat and lon narrow what is asked for.

Addresses of http and https are asked; any other is a folder of recorded answers, to which the reader applies box and limit as
the feed would. A day is a file, or a folder of them, each a part of the day's entries that a task reads by itself. A recorded
answer is whole, so it is given whole, too, where a single place has more entries than the limit, which is an error otherwise.
"""

from __future__ import annotations

import json
import math
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
)

from skerry.operators import order
from skerry.sources import files, scenes

TIMEOUT_S, ATTEMPTS, WAIT_S = 60, 3, 0.5
# The environment's names for reader options.
ENVIRONMENT = {"dataset": "GFW_DATASET", "limit": "GFW_LIMIT", "path": "GFW_PATH", "token": "GFW_TOKEN"}

Box = tuple[float, float, float, float]
"""West, south, east, north; all edges are inside."""


def from_environment(env: dict[str, str] | None = None) -> dict[str, str]:
    """Reader options that the environment sets."""
    env = os.environ if env is None else env
    return {option: env[name] for option, name in ENVIRONMENT.items() if env.get(name)}


def halves(low: float, high: float) -> list[tuple[float, float]]:
    """A closed interval as two that hold the same doubles, or as itself where there is only one."""
    middle = low / 2 + high / 2
    if not low < middle:
        middle = high
    return [(low, math.nextafter(middle, -math.inf)), (middle, high)] if low < high else [(low, high)]


def quarters(box: Box) -> list[Box]:
    """The parts of a box: south-west, south-east, north-west, north-east."""
    west, south, east, north = box
    return [(w, s, e, n) for s, n in halves(south, north) for w, e in halves(west, east)]


def tiled(box: Box, tiles: int) -> list[Box]:
    """The box in tiles by tiles parts."""

    def cuts(low: float, high: float) -> list[tuple[float, float]]:
        edges = [low + (high - low) * k / tiles for k in range(tiles)]
        return [(a, math.nextafter(b, -math.inf)) for a, b in zip(edges, edges[1:], strict=False)] + [(edges[-1], high)]

    return [(w, s, e, n) for s, n in cuts(box[1], box[3]) for w, e in cuts(box[0], box[2])] if tiles > 1 else [box]


def entries_of(body: str) -> list:
    """The entries of an answer: a bare list, or the first list among the known envelopes; else an error."""
    found = json.loads(body)
    if isinstance(found, list):
        return found
    own = found if isinstance(found, dict) else {}
    for name in scenes.ENVELOPES:
        if isinstance(own.get(name), list):
            return own[name]
    raise ValueError(f"unexpected answer with keys {', '.join(list(own)[:5])}")


def position(entry) -> tuple[float | None, float | None]:
    """Latitude and longitude of an entry under any of their names."""
    own = entry if isinstance(entry, dict) else {}
    more = own.get("properties") if isinstance(own.get("properties"), dict) else {}

    def number(what: str) -> float | None:
        found = next((x[n] for x in (own, more) for n in scenes.ALIASES[what] if x.get(n) is not None), None)
        try:
            return None if isinstance(found, bool) else float(found)
        except (TypeError, ValueError):
            return None

    return number("lat"), number("lon")


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options.get("url", "") + options.get("path", "")
        if not self.url:
            raise ValueError("the feed needs a url")
        self.remote = self.url.startswith(("http://", "https://"))
        if not self.remote:
            files.store_of(self.url)
        self.token, self.timeout = options.get("token"), float(options.get("timeout", TIMEOUT_S))
        box = options.get("bbox")
        self.box = tuple(float(x) for x in box.split(",")) if box else scenes.REGION
        if len(self.box) != 4:
            raise ValueError("bbox is west, south, east, north")
        first, last = scenes.window(options.get("end"), options.get("start"))
        self.first, self.last = date.fromisoformat(first), date.fromisoformat(last)
        self.dataset, self.limit = options.get("dataset", scenes.DATASET), int(options.get("limit", scenes.MAX_ROWS))
        self.tiles, self.failures = int(options.get("tiles", 1)), options.get("failures", "raise")
        if self.limit < 1 or self.tiles < 1 or self.failures not in ("raise", "row"):
            raise ValueError("limit and tiles are 1 or more, failures is raise or row")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow days and box. Spark evaluates all conditions again, since edges of a box are always inside."""
        west, south, east, north = self.box
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            values = [x for x in value if x is not None] if isinstance(f, In) else [value]
            if values and name in ("day", "lat", "lon") and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = min(values) if not isinstance(f, (LessThan, LessThanOrEqual)) else None
                high = max(values) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else None
                if name == "day":
                    low, high = (x.date() if isinstance(x, datetime) else x for x in (low, high))
                    self.first, self.last = max(self.first, low or self.first), min(self.last, high or self.last)
                elif name == "lat":
                    south, north = max(south, south if low is None else float(low)), min(north, north if high is None else float(high))
                else:
                    west, east = max(west, west if low is None else float(low)), min(east, east if high is None else float(high))
            yield f
        self.box = (west, south, east, north)

    def partitions(self) -> list[InputPartition]:
        west, south, east, north = self.box
        if self.first > self.last or west > east or south > north:
            return [InputPartition(None)]
        days = [self.first + timedelta(days=k) for k in range((self.last - self.first).days + 1)]
        parts = [[box] for box in tiled(self.box, self.tiles)]
        if self.failures == "row":  # a day is whole or fails as a whole
            parts = [[box for own in parts for box in own]]
        whole = self.remote or self.failures == "row"
        return [InputPartition((day, boxes, path)) for day in days for path in ([None] if whole else self._files(day)) for boxes in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        day, boxes, path = partition.value
        try:
            if self.remote:
                found = [e for box in boxes for e in self._whole(day, box)]
            else:
                answers = [self._recorded(own) for own in ([path] if path else self._files(day))]
                found = [e for answer in answers for box in boxes for e in self._split(answer, np.arange(len(answer[2])), box)]
        except (OSError, ValueError) as wrong:  # urllib's errors and timeouts are OSErrors
            if self.failures == "raise":
                raise
            yield day, None, None, None, f"{type(wrong).__name__}: {wrong}"
            return
        for entry in found:
            lat, lon = position(entry)
            yield day, lat, lon, json.dumps(entry, ensure_ascii=False), None

    def _whole(self, day: date, box: Box) -> Iterator:
        """The entries of a box, however many."""
        found = self._ask(day, box)
        if len(found) < self.limit:
            yield from found
            return
        parts = quarters(box)
        if len(parts) == 1:
            raise ValueError(f"{day}: {self.limit} entries or more at one place, {box}")
        for part in parts:
            yield from self._whole(day, part)

    def _ask(self, day: date, box: Box) -> list:
        asked = scenes.query_parameters(box, day.isoformat(), day.isoformat(), self.dataset, self.limit)
        url = f"{self.url.replace('{day}', day.isoformat())}?{urllib.parse.urlencode(asked)}"
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for attempt in range(1, ATTEMPTS + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.timeout) as answer:  # noqa: S310
                    return entries_of(answer.read().decode("utf-8"))
            except urllib.error.HTTPError as wrong:
                if attempt == ATTEMPTS or (wrong.code < 500 and wrong.code != 429):
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt == ATTEMPTS:
                    raise
            time.sleep(WAIT_S * 2**attempt)
        return []

    def _files(self, day: date) -> list[str]:
        """The recorded answers of a day: a file, or those in a folder."""
        from pyarrow import fs

        store, path = files.store_of(self.url.replace("{day}", day.isoformat()))
        if store.get_file_info(path).type != fs.FileType.Directory:
            return [path]
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file)

    def _recorded(self, path: str) -> tuple[np.ndarray, np.ndarray, list]:
        """Latitudes, longitudes (NaN: none) and entries of a recorded answer."""
        store, _ = files.store_of(self.url)
        with store.open_input_stream(path) as body:
            entries = entries_of(body.read().decode("utf-8"))
        at = np.array([position(e) for e in entries], dtype=np.float64).reshape(-1, 2)
        return at[:, 0], at[:, 1], entries

    def _split(self, answer: tuple[np.ndarray, np.ndarray, list], among: np.ndarray, box: Box) -> Iterator:
        """The entries of a box, looked for among those of the box around it, so each is looked at once a level. What has no
        position counts for the region's first corner."""
        lat, lon, entries = answer
        west, south, east, north = box
        y, x = lat[among], lon[among]
        inside = (south <= y) & (y <= north) & (west <= x) & (x <= east)
        if west <= self.box[0] and south <= self.box[1]:
            inside |= np.isnan(y) | np.isnan(x)
        among, y, x = among[inside], y[inside], x[inside]
        parts = quarters(box) if len(among) >= self.limit and not (np.all(y == y[0]) and np.all(x == x[0])) else [box]
        if len(parts) == 1:
            yield from (entries[k] for k in among)
            return
        for part in parts:
            yield from self._split(answer, among, part)


class DetectionFeed(DataSource):
    """Options: url (with {day} where an address has it), path, token, timeout, bbox, start, end, dataset, limit, tiles, and
    failures: raise, or row, which gives a day that fails one row that says why."""

    @classmethod
    def name(cls) -> str:
        return "detection_feed"

    def schema(self) -> str:
        return "day date, lat double, lon double, entry string, failure string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DetectionFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, **options) -> DataFrame:
    """Entries: day, lat, lon, entry (its JSON text), failure."""
    register(spark)
    return spark.read.format("detection_feed").options(**options).load()


def mapped(entries: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Entries as detections with day and usable. Entries of a day are numbered by position and text, so a number does not
    depend on how answers were split. seen counts, in the pass that reads the feed, the entries that are usable and those
    that are left out."""
    own = entries.filter("entry is not null")
    rows = order.numbered(_counted(own, seen), ["day"], ["lat", "lon", "entry"], "place")
    rows = rows.withColumns({"entry": F.parse_json("entry"), "entry_no": F.col("place") - 1})
    return scenes.map_feed(rows, keep=("day",))


def _counted(entries: DataFrame, seen: Observation | None) -> DataFrame:
    if seen is None:
        return entries
    judged = scenes.map_feed(entries.withColumns({"raw": F.col("entry"), "entry": F.parse_json("entry"), "entry_no": F.lit(0)}), keep=(
        "day", "raw", F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon")
    ))
    judged = judged.observe(seen, F.count_if("usable").alias("mapped"), F.count_if(~F.col("usable")).alias("skipped"))
    return judged.select("day", F.col("at_lat").alias("lat"), F.col("at_lon").alias("lon"), F.col("raw").alias("entry"))


def detections(spark: SparkSession, fallback: DataFrame, seen: Observation | None = None, **options) -> DataFrame:
    """Usable detections of the feed, and for each day of the window that it fails on, or has nothing usable of, those of the
    fallback (with scene_id, ord and day). Without an address, or without a token for a remote one, all are the fallback's."""
    url = options.get("url", "")
    if not url or (url.startswith("http") and not options.get("token")):
        return fallback
    found = scenes.usable(mapped(load(spark, failures="row", **options), seen))
    found = found.withColumn("scene_id", F.concat(F.lit("feed "), F.col("day").cast("string")))
    first, last = scenes.window(options.get("end"), options.get("start"))
    wanted = fallback.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    missing = wanted.join(found.select("day").distinct(), "day", "left_anti")
    given = [F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fallback.schema]
    return found.select(*given).unionByName(missing)
