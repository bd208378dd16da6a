"""The feed through its reader: a server that cuts its answers, recorded answers, failures, pushed-down conditions."""

import http.server
import json
import math
import threading
import urllib.parse
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from skerry.sources import feed, files, scenes


def entry(i, lat, lon, **more):
    return {"id": f"E{i}", "lat": lat, "lon": lon, "length_m": 9 + i % 7, "score": 0.5} | more


@pytest.fixture
def server():
    """Answers by day, box and limit as the feed does; asked holds the requests."""
    entries, asked, wrong = {}, [], Counter()

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            given = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append((self.path, self.headers.get("Authorization"), given))
            day = given["start-date"]
            if wrong[day]:
                wrong[day] -= 1
                self.send_error(503)
                return
            west, south, east, north = map(float, given["bbox"].split(","))
            found = [e for e in entries.get(day, []) if south <= e["lat"] <= north and west <= e["lon"] <= east][: int(given["limit"])]
            body = json.dumps({"entries": found}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    own.entries, own.asked, own.wrong, own.url = entries, asked, wrong, f"http://127.0.0.1:{own.server_port}"
    yield own
    own.shutdown()


def test_halves_hold_every_double_once():
    rng = np.random.default_rng(0)
    for low, high in [(-7.5, -6.0), (0.0, 5e-324), (1.0, math.nextafter(1.0, 2)), (-1e308, 1e308), *np.sort(rng.normal(size=(50, 2)), axis=1).tolist()]:
        (a, b), (c, d) = feed.halves(low, high)
        assert a == low and d == high and a <= b and c <= d and math.nextafter(b, math.inf) == c
    assert feed.halves(2.0, 2.0) == [(2.0, 2.0)] and feed.quarters((1.0, 1.0, 1.0, 1.0)) == [(1.0, 1.0, 1.0, 1.0)]
    west, south, east, north = -7.5, 36.0, -6.0, 37.5
    tiles = feed.tiled((west, south, east, north), 3)
    assert len(tiles) == 9 and tiles[0][:2] == (west, south) and tiles[-1][2:] == (east, north)


def test_full_answers_are_split(spark, server):
    rng = np.random.default_rng(1)
    days = ["2024-01-01", "2024-01-02"]
    for day in days:
        spots = [(36.75, -6.75)] * 4 + [(float(a), float(b)) for a, b in zip(rng.uniform(36, 37.5, 300), rng.uniform(-7.5, -6, 300), strict=True)]
        server.entries[day] = [entry(i, *spot) for i, spot in enumerate(spots)]
    options = {"url": server.url, "token": "secret", "start": days[0], "end": "2024-01-03", "bbox": "-7.5,36,-6,37.5", "limit": "9"}
    for more in ({}, {"tiles": "2"}):
        found = feed.load(spark, **options, **more).collect()
        want = Counter((day, e["id"]) for day in days for e in server.entries[day])
        assert Counter((str(r["day"]), json.loads(r["entry"])["id"]) for r in found) == want
    assert all(a == "Bearer secret" and len(g["bbox"].split(",")) == 4 for _, a, g in server.asked)
    server.entries[days[0]] += [entry(i, 36.75, -6.75) for i in range(20)]
    with pytest.raises(Exception, match="at one place"):
        feed.load(spark, **options).collect()


def test_numbers_do_not_depend_on_the_split(spark, server):
    rng = np.random.default_rng(2)
    server.entries["2024-01-01"] = [
        {"lat": float(a), "lon": float(b), "length_m": 9, "score": 0.5} for a, b in zip(rng.uniform(36, 37.5, 80), rng.uniform(-7.5, -6, 80), strict=True)
    ]
    options = {"url": server.url, "start": "2024-01-01", "end": "2024-01-01", "bbox": "-7.5,36,-6,37.5"}
    got = [
        sorted((r["id"], r["ord"], r["lat"]) for r in scenes.usable(feed.mapped(feed.load(spark, limit=limit, **options))).collect()) for limit in (7, 500)
    ]
    assert got[0] == got[1] and [r[1] for r in sorted(got[0], key=lambda r: r[2])] == list(range(80))


def test_environment_and_retries(spark, server, monkeypatch):
    monkeypatch.setattr(feed, "WAIT_S", 0.01)
    server.entries["2024-01-01"] = [entry(1, 36.5, -6.75)]
    env = {"GFW_DATASET": "own", "GFW_LIMIT": "7", "GFW_TOKEN": "secret", "GFW_PATH": "/v9"}
    options = feed.from_environment(env) | {"url": server.url, "start": "2024-01-01", "end": "2024-01-01", "bbox": "-7,36,-6,37"}
    server.wrong["2024-01-01"] = 2
    reader = feed.FeedReader(options)
    assert [json.loads(r[3])["id"] for p in reader.partitions() for r in reader.read(p)] == ["E1"] and len(server.asked) == 3
    path, token, given = server.asked[-1]
    assert path.startswith("/v9?") and token == "Bearer secret" and given["limit"] == "7" and given["datasets[0]"] == "own" and given["bbox"] == "-7.0,36.0,-6.0,37.0"
    server.wrong["2024-01-01"] = 3
    with pytest.raises(OSError):
        list(reader.read(reader.partitions()[0]))
    for bad, match in (({}, "url"), ({"url": "/x", "bbox": "1,2"}, "bbox"), ({"url": "/x", "limit": "0"}, "limit"), ({"url": "viewfs://x/y"}, "stores")):
        with pytest.raises(ValueError, match=match):
            feed.FeedReader(bad)


def test_conditions_are_asked_for(spark, server):
    for k in range(1, 10):
        server.entries[f"2024-01-0{k}"] = [entry(i, 36 + i / 10, -7 + i / 10) for i in range(10)]
    rows = feed.load(spark, url=server.url, start="2024-01-01", end="2024-01-09", bbox="-7.5,36,-6,37.5")
    found = rows.filter("day > '2024-01-03' and day <= '2024-01-05' and lat >= 36.25 and lon < -6.5").collect()
    assert Counter(str(r["day"]) for r in found) == {"2024-01-04": 2, "2024-01-05": 2}
    asked = [g for _, _, g in server.asked]
    assert {g["start-date"] for g in asked} <= {"2024-01-03", "2024-01-04", "2024-01-05"} and {g["bbox"] for g in asked} == {"-7.5,36.25,-6.5,37.5"}
    reader = feed.FeedReader({"url": server.url, "start": "2024-01-01", "end": "2024-01-09"})
    given = [In(("day",), (date(2024, 1, 4), date(2024, 1, 2))), EqualTo(("lat",), 36.5), GreaterThan(("lon",), -7.0), EqualTo(("entry",), "x")]
    assert list(reader.pushFilters(given)) == given and len(reader.partitions()) == 3 and reader.box == (-7.0, 36.5, -6.5, 36.5)
    list(reader.pushFilters([LessThanOrEqual(("lon",), -8.0)]))
    assert [list(reader.read(p)) for p in reader.partitions()] == [[]]


def test_days_fall_back_one_by_one(spark, server, monkeypatch):
    """What a day lacks comes from the local scene: where the feed fails, or has nothing usable."""
    server.entries |= {"2024-01-01": [entry(1, 36.5, -6.75)], "2024-01-02": [{"id": "no length", "lat": 36.5, "lon": -6.75}], "2024-01-03": [entry(3, 36.5, -6.75)]}
    server.wrong["2024-01-03"] = 99
    monkeypatch.setattr(feed, "ATTEMPTS", 1)
    local = spark.createDataFrame([(f"S{k}", k, f"2024-01-0{k}", f"L{k}", 36.5) for k in range(1, 6)], "scene_id string, ord long, day string, id string, lat double")
    local = local.withColumn("day", F.col("day").cast("date"))
    options = {"start": "2024-01-01", "end": "2024-01-04"}
    seen = Observation("seen")
    rows = feed.detections(spark, local, seen, url=server.url, token="t", **options)
    assert sorted((r["scene_id"], r["id"]) for r in rows.collect()) == [("S2", "L2"), ("S3", "L3"), ("S4", "L4"), ("feed 2024-01-01", "E1")]
    assert seen.get == {"mapped": 1, "skipped": 1}
    for given in ({}, {"url": server.url}):  # no address; no token
        assert feed.detections(spark, local, **given, **options).count() == 5


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_recorded_answers_by_any_local_path(spark, tmp_path, form):
    path = form.format(f"{tmp_path}/answers")
    entries = [entry(i, 36.2 + i / 1000, -7.3) for i in range(30)] + [{"id": "nowhere"}]
    assert files.write_files(spark.createDataFrame([("2024-01-01.json", json.dumps(entries).encode())], "name string, content binary"), path) == 1
    rows = feed.load(spark, url=f"{path}/{{day}}.json", start="2024-01-01", end="2024-01-01", limit=4)
    assert sorted(json.loads(r["entry"])["id"] for r in rows.collect()) == sorted(e["id"] for e in entries)
    found = feed.load(spark, url=f"{path}/{{day}}.json", start="2024-01-01", end="2024-01-02", failures="row").filter("failure is not null").collect()
    assert [str(r["day"]) for r in found] == ["2024-01-02"] and "FileNotFound" in found[0]["failure"]


def test_a_recorded_day_in_parts(spark, tmp_path):
    """A folder a day, each of its answers read by a task of its own; a place with more entries than the limit is whole."""
    path, days = str(tmp_path), ("2024-01-01", "2024-01-02")
    own = [entry(i, 36.2 + i % 40 / 100, -7.3 + i % 3 / 10) for i in range(300)] + [entry(i, 36.5, -7.0) for i in range(300, 330)] + [{"id": f"E{i}"} for i in range(330, 340)]
    bodies = [(f"{day}/{k}.json", json.dumps({"data": own[k::3]}).encode()) for day in days for k in range(3)]
    files.write_files(spark.createDataFrame(bodies, "name string, content binary"), path)
    options = {"url": f"{path}/{{day}}", "start": days[0], "end": days[1], "limit": "4"}
    assert len(feed.FeedReader(options).partitions()) == 6
    want = Counter((day, e["id"]) for day in days for e in own)
    for more in ({}, {"tiles": "2"}, {"failures": "row"}):
        found = feed.load(spark, **options, **more).collect()
        assert Counter((str(r["day"]), json.loads(r["entry"])["id"]) for r in found) == want, more
    lost = feed.load(spark, **options | {"end": "2024-01-03", "failures": "row"}).filter("failure is not null").collect()
    assert [str(r["day"]) for r in lost] == ["2024-01-03"]


def test_an_entry_is_looked_at_once_a_level(tmp_path, monkeypatch):
    """Recorded answers of two sizes: what is looked at grows as they do, but for the levels."""
    rng, looked = np.random.default_rng(5), []
    split = feed.FeedReader._split
    monkeypatch.setattr(feed.FeedReader, "_split", lambda self, answer, among, box: looked.append(len(among)) or split(self, answer, among, box))
    for n in (1000, 16000):
        spots = zip(rng.uniform(36.2, 37.1, n), rng.uniform(-7.4, -6.5, n), strict=True)
        (tmp_path / "2024-01-01").write_text(json.dumps([entry(i, float(a), float(b)) for i, (a, b) in enumerate(spots)]))
        reader = feed.FeedReader({"url": f"{tmp_path}/{{day}}", "start": "2024-01-01", "end": "2024-01-01", "limit": "20"})
        looked.clear()
        assert len([r for p in reader.partitions() for r in reader.read(p)]) == n
        assert sum(looked) < n * 4 * 12
