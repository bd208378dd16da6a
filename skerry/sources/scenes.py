"""Readers: scene and regulatory documents, the external detection feed, chips, labels. All schemas are declared."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skerry.schemas import SCENE_DOCUMENT, STRUCTURES, Config, Season, Weights, Zone
from skerry.sources import files

# The box of a request, its largest answer, and the data set that is asked for.
REGION = (-7.40, 36.20, -6.50, 37.15)
MAX_ROWS = 500
DATASET = "public-global-sar-presence:latest"


DETECTION_FIELDS = ("id", "lat", "lon", "estimated_length_m", "ais_matched", "fishing_score", "speed_kn", "likely_gear", "mmsi", "vessel_name", "flag")


DOCUMENT = 5000
"""Detections that a scene document holds, at most, where `write_documents` writes it."""


def _scene_file(first: Column, path: str = "_metadata.file_path") -> Column:
    """The file of a scene: of a later part, which names the place of its first detection, the file of the first one."""
    return F.when(first.isNull(), F.col(path)).otherwise(F.regexp_replace(path, r"\.part-\d+\.json$", ".json"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """One row a scene document: scene_id (its file), scene, first_detection (null but in a scene's later parts), detections."""
    rows = spark.read.schema(SCENE_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(_scene_file(F.col("first_detection")).alias("scene_id"), "*")


def scene_rows(scenes: DataFrame) -> DataFrame:
    """scene_id, source, mode, timestamp, area."""
    return scenes.filter("first_detection is null").select("scene_id", "scene.*")


def detection_rows(scenes: DataFrame) -> DataFrame:
    """Detections with scene_id, ord (their place in the scene) and the scene's date.

    A typed column cannot tell a missing AIS flag from null: both are unknown. read_strict_scenes keeps the difference.
    """
    from skerry.functions.temporal import scene_date

    rows = scenes.withColumn("day", scene_date(F.col("scene.timestamp")))
    return rows.select("scene_id", "day", "first_detection", F.posexplode("detections").alias("ord", "d")).select(
        "scene_id", (F.col("ord") + F.coalesce("first_detection", F.lit(0).cast("bigint"))).alias("ord"), "day", "d.*"
    )


def read_strict_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Detections as detection_rows gives them, from documents read as VARIANT: numbers must be numbers, and an AIS flag
    that is present but null counts as false, unlike one that is missing."""
    from skerry.functions.temporal import fail, scene_date

    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("v"))
    docs = docs.withColumn("first", F.expr("try_variant_get(v, '$.first_detection', 'bigint')"))
    rows = docs.select(
        _scene_file(F.col("first"), "path").alias("scene_id"), "first", scene_date(F.expr("try_variant_get(v, '$.scene.timestamp', 'string')")).alias("day"),
        F.posexplode(F.expr("variant_get(v, '$.detections', 'array<variant>')")).alias("ord", "d")
    )
    get = lambda k, kind: F.try_variant_get("d", f"$.{k}", kind)
    name = F.coalesce(get("id", "string"), F.lit("?"))

    def number(key: str) -> Column:
        kind = F.schema_of_variant(get(key, "variant"))
        is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | kind.startswith("DECIMAL")
        return F.when(F.coalesce(is_number, F.lit(False)), get(key, "double")).otherwise(fail(
            F.concat(F.lit("detection "), name, F.lit(f": {key} is missing or not numeric")), "double"
        ))

    flag = get("ais_matched", "variant")
    return rows.select(
        "scene_id", (F.col("ord") + F.coalesce("first", F.lit(0).cast("bigint"))).alias("ord"), "day", get("id", "string").alias("id"), number("lat").alias("lat"), number("lon").alias("lon"), number("estimated_length_m").alias("estimated_length_m"), number("fishing_score").alias("fishing_score"),
        F.when(flag.isNull(), F.lit(None)).when(F.is_variant_null(flag), F.lit(False)).otherwise(get("ais_matched", "boolean")).alias("ais_matched"), get("speed_kn", "double").alias("speed_kn"),
        get("likely_gear", "string").alias("likely_gear"), get("mmsi", "string").alias("mmsi"), get("vessel_name", "string").alias("vessel_name"), get("flag", "string").alias("flag"),
    )


def regulations(spark: SparkSession, path: str) -> tuple[Config, list[Zone], DataFrame]:
    """Configuration, zones and structures of one regulatory document. It is configuration: a few zones become literals of plans.

    Keys that begin with an underscore are notes.
    """
    doc = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    return configuration(doc["config"]), [zone(z) for z in doc["zones"]], structure_rows(spark, doc.get("fixed_structures", []))


def configuration(c: dict) -> Config:
    base, env = c.get("patrol_base"), c.get("environment", {})
    season = env.get("season")
    weights = {k: int(v) for k, v in c.get("score_weights", {}).items() if not k.startswith("_")}
    return Config(
        ais_length_threshold_m=float(c["ais_length_threshold_m"]), fishing_score_threshold=float(c["fishing_score_threshold"]), length_sigma_m=float(c.get("length_sigma_m", 0.0)), length_sigma_k=float(c.get("length_sigma_k", 1.0)),
        vms_length_threshold_m=None if c.get("vms_length_threshold_m") is None else float(c["vms_length_threshold_m"]), weights=Weights(**weights), ais_legal_basis=c.get("ais_legal_basis"), lawful_dark_derogation=c.get("lawful_dark_derogation"),
        base=(
            float(base["lat"]), float(base["lon"]), base.get("name")
        ) if base else None, patrol_radius_km=c.get("patrol_radius_km"), study_area=c.get("study_area"), output_language=c.get("output_language", "English"),
        season=Season(season.get("start"), season.get("end")) if season is not None else Season(), dark_illumination=float(env.get("dark_illumination", 0.25)),
    )


def zone(z: dict) -> Zone:
    from skerry.functions.temporal import closure_dates

    shut = z.get("closure")
    polygon = z["polygon"] if isinstance(z["polygon"], dict) else tuple(tuple(p) for p in z["polygon"])
    out = Zone(
        z["id"], z["name"], z["type"], polygon, tuple(z.get("prohibited_gear", ())),
        (shut.get("start"), shut.get("end"), shut.get("reason")) if shut else None, z.get("designation")
    )
    closure_dates(out)  # a malformed closure is an error here, also where no detection is near
    return out


def structure_rows(spark: SparkSession, structures: list[dict]) -> DataFrame:
    rows = [
        (
            i, s.get("id"), s.get("name"), s.get("type"), float(s["lat"]), float(s["lon"]),
            None if s.get("match_radius_m") is None else float(s["match_radius_m"])
        ) for i,
        s in enumerate(structures)
    ]
    return spark.createDataFrame(rows, STRUCTURES)


# --- the external feed ---------------------------------------------------------------------------------------------------

# The names under which feeds give the same thing, first come first.
ALIASES = {
    "lat": ("detect_lat", "lat", "latitude"), "lon": ("detect_lon", "lon", "longitude"), "length": (
        "length_m", "estimated_length_m", "length"
    ), "id": ("id", "detect_id", "detection_id"), "score": ("fishing_score", "score"),
    "active": ("is_fishing", "fishing"), "class": ("vessel_class", "matched_category"), "match": (
        "matched_category", "match_category", "matched"
    ), "mmsi": ("mmsi", "ssvid"), "gear": ("likely_gear", "geartype", "vessel_class"), "speed": ("speed_kn", "speed"),
}
ENVELOPES = ("entries", "data", "features")
# Fixed value: the id of an entry without one, by its number.
UNNAMED = "GFW-%04d"


def feed_entries(answers: DataFrame, column: str = "body") -> DataFrame:
    """entry_no and entry (VARIANT) of answers: a bare list, or the first list among the known envelopes; else an error."""
    from skerry.functions.temporal import fail

    v = F.parse_json(column)
    lists = [F.try_variant_get(v, "$", "array<variant>"), *(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ENVELOPES)]
    keys = F.array_join(F.slice(F.coalesce(F.json_object_keys(column), F.array()), 1, 5), ", ")
    return answers.select(
        "*",
        F.posexplode(F.coalesce(*lists, fail(F.concat(F.lit("unexpected answer with keys "), keys), "array<variant>"))).alias("entry_no", "entry")
    )


def _alias(what: str, kind: str, names: tuple[str, ...] | None = None) -> Column:
    names = names or ALIASES[what]
    return F.coalesce(*(F.try_variant_get("entry", f"$.{n}", kind) for n in names), *(F.try_variant_get("entry", f"$.properties.{n}", kind) for n in names))


def _number(what: str) -> Column:
    return F.coalesce(*(F.try_variant_get("entry", f"${p}.{n}", "string") for p in ("", ".properties") for n in ALIASES[what])).try_cast("double")


def map_feed(entries: DataFrame, keep: tuple = ()) -> DataFrame:
    """Entries as detections with usable: whether position, length and a sign of activity are there. Nothing is dropped here.

    The match is true, false, or unknown for all that is ambiguous; a boolean false is ambiguous too. Identity and gear are
    kept for matched entries only.
    """
    lat, lon, length, score = _number("lat"), _number("lon"), _number("length"), _number("score")
    flag, category = _alias("active", "boolean"), F.lower(F.coalesce(_alias("class", "string"), F.lit("")))
    is_flag = F.schema_of_variant(_alias("active", "variant")) == "BOOLEAN"
    fishing = F.coalesce(score, F.when(is_flag, F.when(flag, 1.0).otherwise(0.0)), F.when(F.contains(category, F.lit("fishing")), 1.0))
    raw = _alias("match", "variant")
    word = F.lower(F.coalesce(_alias("match", "string"), F.lit("")))
    boolean_false = (F.schema_of_variant(raw) == "BOOLEAN") & (word == "false")
    matched = F.when(word.isin("matched", "true"), True).when(word.isin("unmatched", "false") & ~F.coalesce(boolean_false, F.lit(False)), False)
    kept = lambda c: F.when(matched, c)
    raw_id = _alias("id", "string")
    named = F.when(raw_id.isin("", "0", "false"), F.lit(None)).otherwise(raw_id)
    return entries.select(
        *keep, F.col("entry_no").cast("bigint").alias("ord"), F.coalesce(
            named, F.format_string(UNNAMED, "entry_no")
        ).alias("id"), lat.alias("lat"), lon.alias("lon"), length.alias("estimated_length_m"), matched.alias("ais_matched"), fishing.alias("fishing_score"), _number("speed").alias("speed_kn"),
        F.coalesce(
            kept(F.nullif(_alias("gear", "string"), F.lit(""))), F.lit("unknown")
        ).alias("likely_gear"), kept(_alias("mmsi", "string")).alias("mmsi"), kept(F.coalesce(
            _alias("", "string", ("shipname",)), _alias("", "string", ("vessel_name",))
        )).alias("vessel_name"),
        kept(_alias("", "string", ("flag",))).alias("flag"), (lat.isNotNull() & lon.isNotNull() & length.isNotNull() & fishing.isNotNull()).alias("usable"),
    )


def usable(mapped: DataFrame) -> DataFrame:
    return mapped.filter("usable").drop("usable")


def skipped(mapped: DataFrame) -> DataFrame:
    """One row: how many entries were mapped and how many were left out."""
    return mapped.agg(F.count_if("usable").alias("mapped"), F.count_if(~F.col("usable")).alias("skipped"))


def window(end: str | None = None, start: str | None = None) -> tuple[str, str]:
    """First and last day of a request: the day before the last, unless given."""
    last = date.fromisoformat(end) if end else date.today()
    return start or (last - timedelta(days=1)).isoformat(), last.isoformat()


def query_parameters(
    region: tuple[float, float, float, float] = REGION, start: str | None = None, end: str | None = None, dataset: str = DATASET,
    limit: int = MAX_ROWS
) -> dict[str, str]:
    """Filters that the source applies itself: box, days, number of rows."""
    first, last = window(end, start)
    # The names of the parameters.
    return {"datasets[0]": dataset, "start-date": first, "end-date": last, "bbox": ",".join(str(x) for x in region), "limit": str(limit)}


def load_detections(spark: SparkSession, path: str, source: str = "local", seen: Observation | None = None, **options) -> DataFrame:
    """Detections of local documents, or of the feed (options of its reader), which falls back to them day by day."""
    local = detection_rows(read_scenes(spark, path))
    if source == "local":
        return local
    if source != "feed":
        raise ValueError(f"unknown source {source!r}")
    from skerry.sources import feed

    return feed.detections(spark, local, seen, **options)


# --- chips and labels ------------------------------------------------------------------------------------------------------


SPLIT = 64 << 20
"""Bytes of a chip's file that a task reads."""


class ChipReader(DataSourceReader):
    """Pixels of .npy files: a large file is read by several tasks, each the rows (of one in Fortran order, the columns) in its
    range of bytes; small ones are read several by a task."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        files.store_of(path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = files.store_of(self.path)
        listed = store.get_file_info(fs.FileSelector(root))
        out, small, size = [], [], 0
        for f in sorted((f for f in listed if f.is_file and f.base_name.endswith(".npy")), key=lambda f: f.path):
            parts = -(-f.size // self.split)
            if parts > 1:
                out += [InputPartition([(f.path, k, parts)]) for k in range(parts)]
                continue
            small.append((f.path, 0, 1))
            size += f.size
            if size >= self.split:
                out.append(InputPartition(small))
                small, size = [], 0
        return out + [InputPartition(small)] * bool(small) or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = files.store_of(self.path)
        for path, k, parts in partition.value:
            with store.open_input_file(path) as held:
                yield from _chip_part(held, path, k, parts)


PIXEL_ROWS = 1 << 20


def _chip_part(held, path: str, k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Part k of a chip's pixels, in batches."""
    version = np.lib.format.read_magic(held)
    read_header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read_header(held)
    if len(shape) != 2:
        raise ValueError(f"{path}: a chip has two dimensions, not {len(shape)}")
    if kind.hasobject:
        raise ValueError(f"{path}: pixels must be numbers")
    begin, (lines, length) = held.tell(), shape[::-1] if by_column else shape
    first, last = lines * k // parts, lines * (k + 1) // parts
    step = max(1, PIXEL_ROWS // max(length, 1))
    for at in range(first, last, step):
        n = min(step, last - at)
        held.seek(begin + at * length * kind.itemsize)
        values = np.frombuffer(held.read(n * length * kind.itemsize), dtype=kind).astype(np.float64)
        line, along = np.divmod(np.arange(n * length, dtype=np.int32), np.int32(length))
        line += at
        row, col = (along, line) if by_column else (line, along)
        same = lambda x, t: pa.repeat(pa.scalar(x, t), n * length)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([
            same(path.rpartition("/")[2][:-4], pa.string()), same(shape[0], pa.int32()), same(shape[1], pa.int32()), pa.array(row, pa.int32()),
            pa.array(col, pa.int32()), pa.array(values)
        ], names=["chip_id", "rows_n", "cols_n", "row", "col", "value"])


class Chips(DataSource):
    """`spark.read.format("npy_chips")`: pixels of the .npy files in the folder path; split: bytes of a file that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy_chips"

    def schema(self) -> str:
        return "chip_id string, rows_n int, cols_n int, row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return ChipReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_chips(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Pixels of .npy chips in a folder: chip_id (the file's stem), rows_n, cols_n, row, col, value.

    A chip of more than split bytes is read by several tasks. `chip_paths` gives the chips themselves in order.
    """
    spark.dataSource.register(Chips)
    return spark.read.format("npy_chips").option("split", split).load(files.qualified(spark, path))


def chip_paths(spark: SparkSession, path: str) -> DataFrame:
    """chip_id and path of the chips in a folder, sorted by name; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("chip_id"), "path").orderBy("chip_id")


def write_chips(pixels: DataFrame, path: str) -> int:
    """Write whole chips (chip_id, row, col, value) as <chip_id>.npy below path; their number."""

    def image(key: tuple, table: pa.Table) -> pa.Table:
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        out = np.zeros((int(row.max()) + 1, int(col.max()) + 1))
        out[row, col] = table["value"].to_numpy()
        held = io.BytesIO()
        np.save(held, out)
        return pa.table({"name": pa.array([f"{key[0].as_py()}.npy"]), "content": pa.array([held.getvalue()], pa.binary())})

    made = pixels.select("chip_id", "row", "col", "value").groupBy("chip_id").applyInArrow(image, "name string, content binary")
    return files.write_files(made, path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, line_no, line of the label files in a folder."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    lines = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))
    return lines.select("path", F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("stem"), (F.col("k") + 1).alias("line_no"), "line")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest file; none where there is no such file, which is no error."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], "manifest string")
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "manifest")


ENTRIES = "manifest"
_ENTRY = "name string, candidate_labels bigint, review_status string"


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """name, candidate_labels, review_status: the entries of the manifest of a data set in a folder, which are in the manifest or
    beside it in parts."""
    if files.exists(spark, f"{path}/{ENTRIES}"):
        return spark.read.schema(_ENTRY).option("mode", "FAILFAST").json(f"{path}/{ENTRIES}")
    held = F.from_json(F.get_json_object("manifest", "$.entries"), f"array<struct<{_ENTRY.replace(' string', ':string').replace(' bigint', ':bigint')}>>")
    return read_manifest(spark, f"{path}/manifest.json").select(F.explode(held).alias("e")).select("e.*")


def write_documents(detections: DataFrame, path: str, source: str = "", mode: str = "", area: str = "", size: int = DOCUMENT) -> None:
    """Scene documents that read_scenes reads back: detections with scene_id, ord and day, in the order of ord.

    A document holds at most size detections, so no task, group or text holds a scene: one that has more goes on in documents
    beside it, `<scene_id>.part-00001.json` and so on, which name the place of their first detection.
    """
    from skerry.operators import order

    fields = [c for c in DETECTION_FIELDS if c in detections.columns]
    rows = order.numbered(detections.select("scene_id", "ord", "day", *fields), ["scene_id"], ["ord", *fields], "_place")
    rows = rows.withColumn("_part", F.expr(f"(_place - 1) div {size}"))
    stamp = F.concat(F.col("day").cast("string"), F.lit("T00:00:00Z"))
    scene = F.struct(F.lit(source).alias("source"), F.lit(mode).alias("mode"), F.first(stamp).alias("timestamp"), F.lit(area).alias("area"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("d")))), lambda x: x.d)
    later = F.col("_part") > 0
    docs = rows.groupBy("scene_id", "_part").agg(
        F.to_json(F.struct(scene.alias("scene"), F.when(later, F.col("_part") * size).alias("first_detection"), own.alias("detections"))).alias("value")
    )
    name = F.concat("scene_id", F.when(later, F.format_string(".part-%05d", "_part")).otherwise(""), F.lit(".json"))
    files.write_files(docs.select(name.alias("name"), F.encode("value", "utf-8").alias("content")), path)


def write_archive(documents: DataFrame, path: str) -> None:
    """Run archives: one JSON object a scene (dossier, prioritisation, report, validation), as lines."""
    documents.write.mode("overwrite").json(path)
