"""The NetCDF source on files that are written here byte by byte."""

import struct
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from xeric.sources.netcdf import netcdf_layers

KINDS = {"i2": (3, 2), "i4": (4, 4), "f4": (5, 4), "f8": (6, 8)}


def pad(b, fill=b"\0"):
    return b + fill * (-len(b) % 4)


def text(s):
    return struct.pack(">i", len(s)) + pad(s.encode())


def attributes(a):
    if not a:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", 12, len(a))
    for k, v in a.items():
        if isinstance(v, str):
            out += text(k) + struct.pack(">ii", 2, len(v)) + pad(v.encode())
        else:
            v = np.asarray(v)
            kind = v.dtype.str[1:]
            out += text(k) + struct.pack(">ii", KINDS[kind][0], v.size) + pad(v.astype(">" + kind).tobytes())
    return out


def classic(path, dims, variables, record=None, version=1, streamed=False):
    """Write dims {name: size} and variables {name: (dims, array, attributes)}; a record dimension's data are interleaved."""
    names, n = list(dims), dims.get(record, 0)
    plain = [k for k, v in variables.items() if record not in v[0]]
    kept = [k for k, v in variables.items() if record in v[0]]

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", -1 if streamed else n) + struct.pack(">ii", 10, len(dims))
        for k, s in dims.items():
            out += text(k) + struct.pack(">i", 0 if k == record else s)
        out += attributes({"title": "a fixture"}) + struct.pack(">ii", 11, len(variables))
        for k, (d, a, at) in variables.items():
            kind = a.dtype.str[1:]
            out += text(k) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", names.index(x)) for x in d) + attributes(at)
            size = a.nbytes // (n or 1) if k in kept else a.nbytes
            out += struct.pack(">ii", KINDS[kind][0], size + -size % 4) + struct.pack(">i" if version == 1 else ">q", begins.get(k, 0))
        return out

    at, begins = len(header({})), {}
    for k in plain:
        begins[k] = at
        at += len(pad(variables[k][1].tobytes()))
    for k in kept:
        begins[k] = at
        size = variables[k][1].nbytes // max(n, 1)
        at += size if len(kept) == 1 else size + -size % 4
    out = header(begins)
    big = lambda a: a.astype(a.dtype.newbyteorder(">")).tobytes()
    for k in plain:
        out += pad(big(variables[k][1]))
    for i in range(n):
        for k in kept:
            b = big(variables[k][1][i : i + 1])
            out += b if len(kept) == 1 else pad(b)
    path.write_bytes(out)


LAT, LON = np.array([50.0, 49.5, 49.0]), np.array([-120.0, -119.5])


@pytest.fixture
def load(spark):
    return lambda path, **o: netcdf_layers(spark, str(path), **o)


def test_packed_records_with_fill_values(load, tmp_path):
    """Two record variables of odd size, packed numbers, hours since a date, several partitions."""
    t = np.array([0, 31 * 24, 59 * 24, 90 * 24, 120 * 24], "i4")
    sd = np.arange(30, dtype="i2").reshape(5, 3, 2)
    sd[2, 1, 1] = -999
    other = np.full((5, 3), 7, "i2")
    variables = {
        "latitude": (("latitude",), LAT, {}), "longitude": (("longitude",), LON, {}), "time": (("time",), t, {"units": "hours since 1990-01-01 00:00:00"}),
        "sd": (("time", "latitude", "longitude"), sd, {"scale_factor": np.array([0.5]), "add_offset": np.array([10.0]), "_FillValue": np.array([-999], "i2")}),
        "zone": (("time", "latitude"), other, {}),
    }
    for version, streamed in ((1, False), (2, False), (1, True)):
        f = tmp_path / f"v{version}{streamed}.nc"
        classic(f, {"time": 5, "latitude": 3, "longitude": 2}, variables, "time", version, streamed)
        d = load(f, steps="2")
        assert d.rdd.getNumPartitions() == 3
        got = {(r["date"], r["lat"], r["lon"]): r["value"] for r in d.collect()}
        days = [date(1990, m, 1) for m in range(1, 6)]
        want = {(days[i], LAT[j], LON[k]): None if (i, j, k) == (2, 1, 1) else 10 + 0.5 * sd[i, j, k] for i in range(5) for j in range(3) for k in range(2)}
        assert got == want


def test_dates_choose_the_layers(load, tmp_path):
    v = np.arange(24.0 * 6).reshape(24, 3, 2)
    classic(tmp_path / "a.nc", {"valid_time": 24, "lat": 3, "lon": 2}, {"lat": (("lat",), LAT, {}), "lon": (("lon",), LON, {}), "tp": (("valid_time", "lat", "lon"), v, {})}, "valid_time")
    d = load(tmp_path / "a.nc", steps="3", start="2000-01-01")
    some = d.filter((F.col("date") >= F.lit(date(2000, 6, 1))) & (F.col("date") < F.lit(date(2000, 9, 1))))
    assert sorted(r["value"] for r in some.collect()) == list(np.arange(30.0, 48.0)) and some.rdd.getNumPartitions() == 1
    assert d.filter(F.col("date") == F.lit(date(2001, 12, 1))).count() == 6 and d.filter(F.col("date") > F.lit(date(2001, 12, 1))).count() == 0
    assert d.filter("date > date'2001-10-15' and value < 140").count() == 8 and d.filter("month(date) = 1").count() == 12
    assert d.agg(F.min("date"), F.max("date")).first()[:] == (date(2000, 1, 1), date(2001, 12, 1))


def test_seconds_since_1970_a_folder_and_turned_axes(load, tmp_path):
    days = [date(1999, 12, 31), date(2000, 1, 1)]
    t = np.array([(d - date(1970, 1, 1)).days * 86400.0 for d in days])
    v = np.arange(12, dtype="f4").reshape(2, 2, 3)
    v[0, 0, 0] = np.nan
    for name in ("b.nc", "a.nc"):
        classic(tmp_path / name, {"valid_time": 2, "lon": 2, "lat": 3}, {"lat": (("lat",), LAT, {}), "lon": (("lon",), LON, {}), "valid_time": (("valid_time",), t, {}), "swe": (("valid_time", "lon", "lat"), v, {})})
    (tmp_path / "notes.txt").write_text("no layers")
    rows = load(tmp_path).collect()
    assert len(rows) == 24 and {r["file"].rsplit("/")[-1] for r in rows} == {"a.nc", "b.nc"}
    got = {(r["date"], r["lat"], r["lon"]): r["value"] for r in rows if r["file"].endswith("a.nc")}
    assert got == {(days[i], LAT[k], LON[j]): None if np.isnan(v[i, j, k]) else float(v[i, j, k]) for i in range(2) for j in range(2) for k in range(3)}
    assert load(f"file://{tmp_path}").count() == 24


def test_what_is_not_read_is_refused(load, tmp_path):
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(100))
    with pytest.raises(Exception, match="HDF5"):
        load(tmp_path / "h.nc").count()
    v = np.zeros((1, 3, 2))
    two = {n: (("time", "lat", "lon"), v, {}) for n in ("p", "q")}
    classic(tmp_path / "two.nc", {"time": 1, "lat": 3, "lon": 2}, two)
    with pytest.raises(Exception, match="three dimensions"):
        load(tmp_path / "two.nc").count()
    assert load(tmp_path / "two.nc", variable="q").count() == 6
    whole = (tmp_path / "two.nc").read_bytes()
    (tmp_path / "cut.nc").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends before"):
        load(tmp_path / "cut.nc", variable="q").collect()
    classic(tmp_path / "none.nc", {"time": 0, "lat": 3, "lon": 2}, {"p": (("time", "lat", "lon"), np.zeros((0, 3, 2)), {})}, "time")
    assert load(tmp_path / "none.nc").count() == 0
