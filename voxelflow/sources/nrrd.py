"""NRRD volumes: read into voxel and volume tables, and written from them."""

from __future__ import annotations

import bz2
import gzip
import os
import posixpath
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The format's names of number types.
TYPES = {
    "signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "longlong": "i8", "int64": "i8", "float": "f4", "double": "f8",
}


#: The space that a header without one is in.
SPACE = "left-posterior-superior"


def header(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and what follows them."""
    if not raw.startswith(b"NRRD"):
        raise ValueError("no NRRD file")
    ends = [(i, len(blank)) for blank in (b"\n\n", b"\r\n\r\n") if (i := raw.find(blank)) >= 0] or [(len(raw), 0)]
    end, blank = min(ends)
    fields = {}
    for line in raw[:end].decode("ascii", "replace").splitlines()[1:]:
        if ": " in line and not line.startswith("#"):
            name, value = line.split(": ", 1)
            fields[name.strip().lower()] = value.strip()
    return fields, raw[end + blank :]


def parse(raw: bytes, beside: bytes | None = None) -> tuple[dict[str, str], np.ndarray]:
    """Header fields and the array (z, y, x) of a file; data is raw, gzip, bzip2 or text, attached, or in a file of its own (`beside`)."""
    fields, data = header(raw)
    kind = np.dtype(("<" if fields.get("endian", "little") == "little" else ">") + TYPES[fields["type"]])
    if "data file" in fields or "datafile" in fields:
        if beside is None:
            raise ValueError("the data file is missing")
        data = beside
    encoding = fields.get("encoding", "raw").lower()
    sizes = [int(n) for n in fields["sizes"].split()]
    count = int(np.prod(sizes))
    if encoding in ("txt", "text", "ascii"):
        return fields, np.array(data.split()[:count]).astype(float).astype(kind).reshape(sizes[::-1])
    read = {"raw": bytes, "gzip": gzip.decompress, "gz": gzip.decompress, "bzip2": bz2.decompress, "bz2": bz2.decompress}
    if encoding not in read:
        raise ValueError(f"encoding {encoding}")
    return fields, np.frombuffer(read[encoding](data), kind, count=count).reshape(sizes[::-1])


def _vectors(value: str) -> list[list[float]]:
    return [[float(c) for c in v.strip("() ").split(",")] for v in value.split(") (")]


def spacing_of(fields: dict[str, str]) -> tuple[float, float, float]:
    """Sizes of a cell along z, y, x; 1 where the header has none."""
    if "space directions" in fields:
        return tuple(float(np.linalg.norm(v)) for v in _vectors(fields["space directions"])[::-1])
    if "spacings" in fields:
        return tuple(float(n) for n in fields["spacings"].split()[::-1])
    return (1.0, 1.0, 1.0)


def origin_of(fields: dict[str, str]) -> list[float]:
    """Where the first cell lies, as x, y, z of the space; 0 where the header has none."""
    return _vectors(fields["space origin"])[0] if "space origin" in fields else [0.0, 0.0, 0.0]


def direction_of(fields: dict[str, str]) -> list[float]:
    """The unit vectors of the axes x, y, z in space, one after the other; the axes of space where the header has none."""
    if "space directions" not in fields:
        return np.eye(3).ravel().tolist()
    return [float(c) for v in _vectors(fields["space directions"]) for c in np.divide(v, max(float(np.linalg.norm(v)), 1e-300))]


def _name(path: str) -> str:
    return posixpath.basename(path).rsplit(".", 1)[0]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, and where the header names a data file of the same folder, its content as `beside`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    name = F.regexp_extract(F.decode(F.substring("content", 1, 4096), "ISO-8859-1"), r"(?im)^data ?file: *([^\r\n]+?) *\r?$", 1)
    heads = files.where(F.substring("content", 1, 4) == F.lit(b"NRRD")).withColumn("wanted", F.when(name != "", F.concat(F.regexp_extract("path", "^(.*/)", 1), name)))
    if not heads.where("wanted is not null").limit(1).count():
        return heads.select("path", "content", F.lit(None).cast("binary").alias("beside"))
    folder = posixpath.dirname(path) if path.endswith((".nhdr", ".nrrd")) else path
    data = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("wanted"), F.col("content").alias("beside"))
    return heads.join(data, "wanted", "left").select("path", "content", "beside")


_GEOMETRY = ["nz", "ny", "nx", "sz", "sy", "sx", "origin", "direction", "space", "pixel_type"]


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(volume_id, nz, ny, nx, sz, sy, sx, origin, direction, space, pixel_type) of the files of a path; a file's name without its ending is its id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                fields, _ = header(raw)
                sizes = [int(n) for n in fields["sizes"].split()]
                rows.append((_name(name), *sizes[::-1], *spacing_of(fields), origin_of(fields), direction_of(fields), fields.get("space", SPACE), fields["type"]))
            yield pd.DataFrame(rows, columns=["volume_id", *_GEOMETRY])

    files = _files(spark, path).select("path", "content")
    return files.mapInPandas(run, "volume_id string, nz int, ny int, nx int, sz double, sy double, sx double, origin array<double>, direction array<double>, space string, pixel_type string")


def read_voxels(spark: SparkSession, path: str, background: float | None = None) -> DataFrame:
    """(volume_id, z, y, x, v) of the files of a path, without cells of the value `background`; slices are sent one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw, beside in zip(batch["path"], batch["content"], batch["beside"], strict=True):
                _, array = parse(raw, beside)
                y, x = np.indices(array.shape[1:])
                for z, layer in enumerate(array):
                    keep = np.ones(layer.shape, bool) if background is None else layer != background
                    yield pd.DataFrame({"volume_id": _name(name), "z": np.int32(z), "y": y[keep].astype(np.int32), "x": x[keep].astype(np.int32), "v": layer[keep].astype(np.float64)})

    return _files(spark, path).mapInPandas(run, "volume_id string, z int, y int, x int, v double")


def encode(array: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), compressed: bool = True, origin: list[float] | None = None, direction: list[float] | None = None, space: str = SPACE) -> bytes:
    """A file of an array (z, y, x). spacing: along z, y, x; origin and direction: as `origin_of` and `direction_of` give them."""
    names = {np.dtype(v).newbyteorder("=").str[1:]: k for k, v in TYPES.items() if " " not in k}
    kind = array.dtype.str[1:]
    unit = np.asarray(direction if direction is not None else np.eye(3).ravel(), float).reshape(3, 3)
    point = lambda v: "(" + ",".join(repr(float(c)) for c in v) + ")"
    sizes, steps = " ".join(map(str, array.shape[::-1])), " ".join(point(v * float(n)) for v, n in zip(unit, spacing[::-1], strict=True))
    head = f"NRRD0004\ntype: {names[kind]}\ndimension: 3\nspace: {space}\nsizes: {sizes}\nspace directions: {steps}\nendian: little\nencoding: {'gzip' if compressed else 'raw'}\nspace origin: {point([0.0] * 3 if origin is None else origin)}\n\n"
    data = array.astype(array.dtype.newbyteorder("<")).tobytes()
    return head.encode() + (gzip.compress(data) if compressed else data)


def encoded_volumes(voxels: DataFrame, volumes: DataFrame, kind: str = "int16", fill: float = 0.0) -> DataFrame:
    """(volume_id, content): a file for each volume, made in one task, with the geometry that `volumes` has for it. A mask has value 1."""
    from ..operators.slabs import dense

    sides = ["nz", "ny", "nx", "sz", "sy", "sx"]
    more = [c for c in ("origin", "direction", "space") if c in volumes.columns]
    value = "v" if "v" in voxels.columns else None

    def run(rows: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        out = []
        for one in info.to_dict("records"):
            array = dense(rows, 0, tuple(int(one[n]) for n in sides[:3]), value, fill).astype(kind)
            out.append((one["volume_id"], encode(array, tuple(one[n] for n in sides[3:]), **{c: one[c] for c in more if one[c] is not None})))
        return pd.DataFrame(out, columns=["volume_id", "content"])

    cells = voxels.select("volume_id", "z", "y", "x", *([value] if value else []))
    return cells.groupBy("volume_id").cogroup(volumes.select("volume_id", *sides, *more).groupBy("volume_id")).applyInPandas(run, "volume_id string, content binary")


def write_nrrd(voxels: DataFrame, volumes: DataFrame, folder: str, kind: str = "int16", fill: float = 0.0) -> int:
    """Writes <folder>/<volume_id>.nrrd for each volume, empty ones too, and returns how many.

    folder: a path that all machines have. A file gets its name when it is whole, so a task that runs again or twice leaves the same files.
    """
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError("files are written to a folder that all machines have mounted")
    os.makedirs(place.path, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["volume_id"], batch["content"], strict=True):
                part = os.path.join(place.path, f".{uuid.uuid4().hex}.part")
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, os.path.join(place.path, f"{posixpath.basename(name)}.nrrd"))
            yield pd.DataFrame({"n": [len(batch)]})

    written = encoded_volumes(voxels, volumes, kind, fill).mapInPandas(run, "n long").agg(F.sum("n")).first()[0]
    return int(written or 0)


def write_volumes(voxels: DataFrame, path: str) -> None:
    """The voxel table as Parquet by volume, which `spark.read.parquet` reads back."""
    voxels.write.mode("overwrite").partitionBy("volume_id").parquet(path)


def with_geometry(volumes: DataFrame, source: DataFrame) -> DataFrame:
    """`volumes` with the spacing, origin, direction and space of the volumes of the same name in `source`."""
    taken = [c for c in ("sz", "sy", "sx", "origin", "direction", "space") if c in source.columns]
    return volumes.drop(*taken).join(source.select("volume_id", *taken), "volume_id", "left")


def coerce(spark: SparkSession, source: str | DataFrame | None) -> DataFrame | None:
    """A path is read, by its ending as NRRD or Parquet; a DataFrame and None pass; anything else is an error."""
    if source is None or isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return read_voxels(spark, source) if source.endswith(".nrrd") else spark.read.parquet(source)
    raise TypeError(f"a path, a DataFrame or None, not {type(source).__name__}")


def region_options(config: dict | None = None, gpu: int | None = None) -> dict[str, object]:
    """What a segmentation plug-in is called with: device ("gpu", or "gpu:" and its number, unless given), fast, quiet, verbose."""
    config = config or {}
    device = config.get("device") or ("gpu" if gpu is None else f"gpu:{gpu}")
    return {"device": device, "fast": bool(config.get("fast", False)), "quiet": bool(config.get("quiet", True)), "verbose": bool(config.get("verbose", False))}


def segment_regions(image: DataFrame, names: list[str], table: dict[str, int], plug_in: Callable[..., DataFrame], config: dict | None = None, gpu: int | None = None) -> DataFrame:
    """(volume_id, z, y, x, label) of the named regions, by `plug_in(image, names, device=, fast=, quiet=, verbose=)`; other labels go.

    A name that the table lacks is an error, as in `roi_labels`.
    """
    if missing := [n for n in names if n not in table]:
        raise KeyError(", ".join(missing))
    made = plug_in(image, names, **region_options(config, gpu))
    return made.where(F.col("label").isin(*(table[n] for n in names))).select("volume_id", "z", "y", "x", F.col("label").cast("int").alias("label"))


def roi_labels(spark: SparkSession, names: list[str], table: dict[str, int]) -> DataFrame:
    """(name, label, position) of region names in order; an error names all that the table lacks."""
    if missing := [n for n in names if n not in table]:
        raise KeyError(", ".join(missing))
    return spark.createDataFrame([(n, table[n], i + 1) for i, n in enumerate(names)], "name string, label int, position int")


def one_region_labels(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Region cells (volume_id, z, y, x, label) renumbered by position in `labels`; other regions go."""
    if labels.count() > 65_536:
        raise ValueError("more regions than labels")
    return regions.join(F.broadcast(labels.select("label", "position")), "label").select("volume_id", "z", "y", "x", F.col("position").alias("label"))
