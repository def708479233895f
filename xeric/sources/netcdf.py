"""Layers of classic NetCDF files as a Spark data source: one partition a slab of time steps, only its bytes read.

``netcdf_layers(spark, path, variable="tp")`` gives the rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the classic format: tags of the header's lists, and number types by code as numpy names them.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Seconds of the units that a time may be counted in.
UNITS = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600, "day": 86400, "days": 86400}
#: Rows of a batch that is handed to Spark, and bytes of a header that are read at once.
BATCH_ROWS, HEADER_STEP = 65_536, 65_536
TIME_NAMES, LAT_NAMES, LON_NAMES = ("time", "valid_time"), ("latitude", "lat", "y"), ("longitude", "lon", "x")


class _Header:
    """Reads a header's fields one after another, from a file of which more bytes are fetched as they are needed."""

    def __init__(self, file, size: int):
        self.file, self.size, self.data, self.at = file, size, b"", 0
        magic = self.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file (version 1, 2 or 5); NetCDF-4 files hold HDF5 and are not read")
        self.version = magic[3]

    def take(self, n: int) -> bytes:
        while len(self.data) < self.at + n:
            if len(self.data) >= self.size:
                raise ValueError("the header ends early")
            self.file.seek(len(self.data))
            self.data += self.file.read(max(HEADER_STEP, self.at + n - len(self.data)))
        self.at += n
        return self.data[self.at - n : self.at]

    def whole(self) -> int:
        return struct.unpack(">q" if self.version == 5 else ">i", self.take(8 if self.version == 5 else 4))[0]

    def tag(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def offset(self) -> int:
        return struct.unpack(">i" if self.version == 1 else ">q", self.take(4 if self.version == 1 else 8))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.whole()).decode()

    def listed(self, tag: int, item) -> list:
        found, n = self.tag(), self.whole()
        if found not in (0, tag):
            raise ValueError(f"list of kind {found} where {tag} belongs")
        return [item() for _ in range(n)] if found else []

    def attribute(self) -> tuple[str, object]:
        name, kind, n = self.name(), self.tag(), self.whole()
        kind = np.dtype(TYPES[kind])
        data = self.padded(n * kind.itemsize)
        return name, data.decode("utf-8", "replace").rstrip("\0") if kind.kind == "S" else np.frombuffer(data, kind)


@dataclass(frozen=True)
class Stored:
    """A variable: its dimensions, attributes, number type and first byte; a record's bytes lie ``step`` apart."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    attributes: dict
    kind: str
    begin: int
    step: int

    def bytes_of(self, first: int, n: int) -> list[tuple[int, int]]:
        """(place, length) of the entries first to first + n of the first dimension: one piece, or one a record."""
        entry = int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.kind).itemsize
        if self.step == entry:
            return [(self.begin + first * entry, n * entry)]
        return [(self.begin + (first + i) * self.step, entry) for i in range(n)]

    def read(self, file, first: int = 0, n: int | None = None) -> np.ndarray:
        """Entries as float64, scaled, with NaN for fill values and missing values."""
        n = self.shape[0] - first if n is None else n
        data = bytearray()
        for place, length in self.bytes_of(first, n):
            file.seek(place)
            got = file.read(length)
            if len(got) < length:
                raise ValueError("the file ends before its last value")
            data += got
        raw = np.frombuffer(bytes(data), self.kind).reshape(n, *self.shape[1:])
        out = raw.astype(np.float64)
        for a in ("_FillValue", "missing_value"):
            if a in self.attributes and not isinstance(self.attributes[a], str):
                out[np.isin(raw, self.attributes[a].astype(raw.dtype))] = np.nan
        scale, offset = (float(self.attributes[a][0]) if a in self.attributes else d for a, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + offset


def read_header(file, size: int) -> dict[str, Stored]:
    """The variables of a classic file by name, with at least one dimension each."""
    h = _Header(file, size)
    count = h.whole()
    dims = h.listed(DIMENSION, lambda: (h.name(), h.whole()))
    h.listed(ATTRIBUTE, h.attribute)

    def variable():
        name, ids = h.name(), [h.whole() for _ in range(h.whole())]
        attributes, kind = dict(h.listed(ATTRIBUTE, h.attribute)), np.dtype(TYPES[h.tag()])
        return name, ids, attributes, kind, h.whole(), h.offset()

    found = h.listed(VARIABLE, variable)
    record = next((i for i, d in enumerate(dims) if d[1] == 0), None)
    entry = lambda ids, kind: int(np.prod([dims[i][1] for i in ids if i != record], dtype=np.int64)) * kind.itemsize
    held = [entry(v[1], v[3]) for v in found if v[1] and v[1][0] == record]
    between = held[0] if len(held) == 1 else sum(e + -e % 4 for e in held)  # a sole record variable is not padded
    if count < 0 and between:  # written as a stream: as many records as there are bytes for
        count = (size - min(v[5] for v in found if v[1] and v[1][0] == record)) // between
    out = {}
    for name, ids, attributes, kind, _, begin in found:
        if ids:
            shape = tuple(count if i == record else dims[i][1] for i in ids)
            step = between if ids[0] == record else int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
            out[name] = Stored(tuple(dims[i][0] for i in ids), shape, attributes, kind.str, begin, step)
    return out


def month_after(first: date, n: int) -> date:
    m = first.year * 12 + first.month - 1 + n
    return date(m // 12, m % 12 + 1, 1)


def layer_dates(variables: dict[str, Stored], file, time_dim: str, n: int, start: date) -> list[date]:
    """A date a layer: from the time dimension's variable if its units can be read, else ``valid_time`` as seconds since 1970, else months from ``start``."""
    for name in dict.fromkeys((time_dim, *TIME_NAMES)):
        v = variables.get(name)
        if v is None or len(v.shape) != 1 or v.shape[0] != n:
            continue
        words = str(v.attributes.get("units", "")).split()
        since = datetime(1970, 1, 1, tzinfo=UTC) if name == "valid_time" and not words else None
        seconds = 1
        if len(words) >= 3 and words[1] == "since" and words[0].lower() in UNITS:
            seconds = UNITS[words[0].lower()]
            try:
                since = datetime(*(int(p) for p in words[2][:10].split("T")[0].split("-")), tzinfo=UTC)
                if len(words) > 3:
                    clock = [float(p) for p in words[3].rstrip("Z").split(":")]
                    since += timedelta(seconds=sum(p * s for p, s in zip(clock, (3600, 60, 1), strict=False)))
            except ValueError:
                since = None
        values = v.read(file)
        if since is not None and np.isfinite(values).all():
            return [(since + timedelta(seconds=float(t) * seconds)).date() for t in values]
    return [month_after(start, i) for i in range(n)]


def _files(path: str) -> list[tuple[str, str, int]]:
    """(store's address, path in it, bytes) of the files at a path or address, or of those in a folder that end in .nc."""
    store, at = fs.FileSystem.from_uri(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = sorted((f for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and f.path.endswith(".nc")), key=lambda f: f.path)
    elif info.is_file:
        found = [info]
    else:
        raise FileNotFoundError(path)
    return [(path, f.path, f.size) for f in found]


@dataclass
class Slab(InputPartition):
    """Layers of a file: where the variable lies and all that a task needs to write rows without the header."""

    address: str
    path: str
    variable: Stored
    first: int
    dates: list[date]
    lat: np.ndarray
    lon: np.ndarray
    flipped: bool


class LayerReader(DataSourceReader):
    """Options: ``variable`` (needed if the file has several of three dimensions), ``steps`` of a partition, ``start`` for files without dates."""

    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options.get("variable")
        self.steps = int(options.get("steps", 12))
        self.start = date.fromisoformat(options.get("start", "1950-01-01"))
        self.low, self.high = date.min, date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the date choose the layers that are read; all others are left to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            known = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if not known or f.attribute != ("date",) or not isinstance(value, date):
                yield f
                continue
            if isinstance(f, GreaterThan) and value < date.max:
                self.low = max(self.low, value + timedelta(days=1))
            elif isinstance(f, LessThan) and value > date.min:
                self.high = min(self.high, value - timedelta(days=1))
            else:
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, value)
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, value)
                if isinstance(f, (GreaterThan, LessThan)):
                    yield f

    def partitions(self) -> list[Slab]:
        out = []
        for address, path, size in _files(self.path):
            with fs.FileSystem.from_uri(address)[0].open_input_file(path) as file:
                out += self._slabs(address, path, file, size)
        return out

    def _slabs(self, address: str, path: str, file, size: int) -> Iterator[Slab]:
        variables = read_header(file, size)
        named = [n for n, v in variables.items() if len(v.shape) == 3]
        name = self.variable or (named[0] if len(named) == 1 else None)
        if name not in named:
            raise ValueError(f"{path}: variable {name!r} is not among those of three dimensions: {named}")
        v = variables[name]
        axes = [next((a for a in LAT_NAMES if a == d.lower()), None) for d in v.dims[1:]], [next((a for a in LON_NAMES if a == d.lower()), None) for d in v.dims[1:]]
        flipped = axes[0][1] is not None and axes[1][0] is not None
        sides = [variables[d].read(file) if d in variables else np.arange(v.shape[i + 1], dtype=float) for i, d in enumerate(v.dims[1:])]
        lat, lon = sides[::-1] if flipped else sides
        dates = layer_dates(variables, file, v.dims[0], v.shape[0], self.start)
        ordered = all(a <= b for a, b in zip(dates, dates[1:], strict=False))
        first, last = (bisect_left(dates, self.low), bisect_right(dates, self.high)) if ordered else (0, len(dates))
        for i in range(first, last, self.steps):
            yield Slab(address, path, v, i, dates[i : min(i + self.steps, last)], lat, lon, flipped)

    def read(self, slab: Slab | None) -> Iterator[pa.RecordBatch]:
        if slab is None:  # what Spark hands over where there is no partition
            return
        with fs.FileSystem.from_uri(slab.address)[0].open_input_file(slab.path) as file:
            for i, day in enumerate(slab.dates):
                if not self.low <= day <= self.high:
                    continue
                layer = slab.variable.read(file, slab.first + i, 1)[0]
                layer = (layer.T if slab.flipped else layer).ravel()
                for a in range(0, len(layer), BATCH_ROWS):
                    cells = np.arange(a, min(a + BATCH_ROWS, len(layer)))
                    value = layer[cells]
                    columns = [
                        pa.array([slab.path] * len(cells), pa.string()), pa.array([day] * len(cells), pa.date32()), pa.array(slab.lat[cells // len(slab.lon)]),
                        pa.array(slab.lon[cells % len(slab.lon)]), pa.array(value, mask=np.isnan(value)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "date", "lat", "lon", "value"])


class NetcdfLayers(DataSource):
    """(file, date, lat, lon, value): a row a cell and layer of a variable over time, latitude and longitude.

    The path is a file, or a folder of .nc files, on the local disk or at an address that Arrow's file systems open
    (file, hdfs, s3, gs, abfs). The driver reads headers and coordinates alone. A task reads the bytes of its variable's
    layers one at a time, so its memory is a layer's. Other variables' bytes are never read, nor layers that bounds on
    ``date`` rule out. Fill values and NaN become null, scaled numbers are unpacked, latitude may come before or after
    longitude. A lost task reads its slab anew.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf_layers"

    def schema(self) -> str:
        return "file string, date date, lat double, lon double, value double"

    def reader(self, schema) -> LayerReader:
        return LayerReader(dict(self.options))


def netcdf_layers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The layers at a path (see NetcdfLayers for rows and LayerReader for options), with bounds on the date pushed to the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetcdfLayers)
    return spark.read.format(NetcdfLayers.name()).options(**options).load(path)
