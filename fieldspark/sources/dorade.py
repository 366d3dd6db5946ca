"""Radar sweeps in DORADE files as tables, both ways.

A sweep file is a chain of blocks: those of the volume, the radar, its fields
and gates, then the rays, each with its platform and a block of data for every
field.  A task walks the chain to the rays that begin in its range of bytes
and decodes the asked fields of these, nothing else: the schema that is given
prunes.  Rays are decoded and written by the batch: a ray costs a few steps of
Python along the chain.  Either byte order is read.  Fields are 16-bit words, plain or
run-length coded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import radar
from ..operators import runs
from .place import files_below, opened

AIRBORNE = 9  # the scan mode whose angles follow from the platform's
RAYS = 2048  # rays in a batch

# fixed values of the format: where a block holds what, from its tag on
VOLUME = {"year": ("h", 36)}
RADAR = {"wide": ("f", 40), "high": ("f", 44), "scan_mode": ("h", 50), "fields": ("h", 64), "compressed": ("h", 68), "longitude": ("f", 80), "latitude": ("f", 84), "altitude": ("f", 88)}
FIELD = {"kind": ("h", 78), "scale": ("f", 92), "missing": ("i", 100)}
RAY = {"julian": ("i", 12), "hour": ("h", 16), "minute": ("h", 18), "second": ("h", 20), "azimuth": ("f", 24), "elevation": ("f", 28)}
PLATFORM = {"longitude": ("f", 8), "latitude": ("f", 12), "altitude": ("f", 20), "heading": ("f", 36), "roll": ("f", 40), "pitch": ("f", 44), "drift": ("f", 48), "rotation": ("f", 52), "tilt": ("f", 56)}
CORRECTION = {"longitude": ("f", 20), "latitude": ("f", 24), "altitude": ("f", 32), "heading": ("f", 48), "roll": ("f", 52), "pitch": ("f", 56), "drift": ("f", 60), "rotation": ("f", 64), "tilt": ("f", 68)}
SIZES = {"VOLD": 72, "RADD": 144, "PARM": 104, "CFAC": 72, "SWIB": 40, "RYIB": 44, "ASIB": 80}
NUMPY = {"h": "i2", "i": "i4", "f": "f4"}
WORDS = 2  # the kind of 16-bit fields

PLATE = "longitude latitude altitude heading roll pitch drift rotation tilt".split()
DOUBLES = ["azimuth", "elevation", "beam_width", "distance", *PLATE]
WHOLE = ["ray", "second", "gate", "scan_mode"]


def _values(raw: bytes, order: str, places: dict[str, tuple[str, int]]) -> dict[str, float]:
    return {n: struct.unpack_from(order + kind, raw, at)[0] for n, (kind, at) in places.items() if at + struct.calcsize(kind) <= len(raw)}


def _arrays(blocks: list[bytes], order: str, places: dict[str, tuple[str, int]]) -> dict[str, np.ndarray]:
    """_values of many blocks of a kind, NaN beyond a block's end."""
    size = max(at + struct.calcsize(kind) for kind, at in places.values())
    raw = np.frombuffer(b"".join([b[:size].ljust(size, b"\0") for b in blocks]), np.uint8).reshape(-1, size)
    ends, out = np.array([len(b) for b in blocks], np.int64), {}
    for n, (kind, at) in places.items():
        after = at + struct.calcsize(kind)
        out[n] = np.where(ends >= after, np.ascontiguousarray(raw[:, at:after]).view(order + NUMPY[kind])[:, 0].astype(float), np.nan)
    return out


def _blocks(tag: str, order: str, places: dict[str, tuple[str, int]], told: dict[str, np.ndarray], many: int) -> np.ndarray:
    """_block of many rays, as rows of bytes; told has their values."""
    made = np.zeros(many, np.dtype({"names": ["tag", "size", *told], "formats": ["S4", order + "i4", *[order + NUMPY[places[n][0]] for n in told]], "offsets": [0, 4, *[places[n][1] for n in told]], "itemsize": SIZES[tag]}))
    made["tag"], made["size"] = tag.encode(), SIZES[tag]
    for n, v in told.items():
        made[n] = v
    return made.view(np.uint8).reshape(many, SIZES[tag])


def _block(tag: str, order: str, places: dict[str, tuple[str, int]], told: dict[str, float], names: dict[int, str] | None = None) -> bytes:
    raw = bytearray(SIZES[tag])
    struct.pack_into(order + "4si", raw, 0, tag.encode(), len(raw))
    for n, v in told.items():
        struct.pack_into(order + places[n][0], raw, places[n][1], v)
    for at, name in (names or {}).items():
        raw[at : at + 8] = name.encode().ljust(8)[:8]
    return bytes(raw)


@dataclass
class _Sweep:
    """What stands before the rays."""

    order: str
    year: int = 1970
    radar: dict[str, float] = field(default_factory=dict)
    fields: dict[str, dict[str, float]] = field(default_factory=dict)
    correction: dict[str, float] = field(default_factory=dict)
    gates: np.ndarray = field(default_factory=lambda: np.zeros(0))


class _Chain:
    """The blocks of a file, front to back, reading ahead."""

    def __init__(self, f, size: int, ahead: int = 1 << 20):
        self.f, self.size, self.ahead, self.held, self.base = f, size, ahead, b"", 0
        tag, n = self.bytes(0, 4), self.bytes(4, 4)
        little, big = (struct.unpack(o + "i", n)[0] for o in "<>")
        self.order = "<" if 8 <= little < 1 << 20 else ">"
        if len(tag) < 4 or self.order == ">" and not 8 <= big < 1 << 20:
            raise ValueError("not a sweep file")

    def bytes(self, at: int, n: int) -> bytes:
        if at < self.base or at + n > self.base + len(self.held):
            self.base, self.held = at, self.f.read_at(min(max(n, self.ahead), max(self.size - at, 0)), at)
        out = self.held[at - self.base : at - self.base + n]
        if len(out) < n:
            raise ValueError("the file ends within a block")
        return out

    def blocks(self) -> Iterator[tuple[str, int, int]]:
        """Tag, place and length; the table of angles is the last."""
        at, told = 0, struct.Struct(self.order + "4si").unpack
        while at + 8 <= self.size:
            tag, n = told(self.bytes(at, 8))
            tag = tag.decode("latin-1")
            if n < 8:
                raise ValueError(f"a block of {n} bytes at {at}")
            yield tag, at, n
            if tag == "RKTB":
                return
            at += n


def _name(raw: bytes) -> str:
    return raw[8:16].decode("latin-1").split("\0")[0].replace(" ", "")


def _header(s: _Sweep, tag: str, raw: bytes) -> None:
    if tag == "VOLD":
        s.year = int(_values(raw, s.order, VOLUME)["year"])
    elif tag == "RADD":
        s.radar = _values(raw, s.order, RADAR)
    elif tag == "PARM":
        s.fields[_name(raw)] = _values(raw, s.order, FIELD)
    elif tag == "CFAC":
        s.correction = _values(raw, s.order, CORRECTION)
    elif tag == "CELV":
        n = struct.unpack_from(s.order + "i", raw, 8)[0]
        s.gates = np.frombuffer(raw, s.order + "f4", n, 12).astype(float)


def _gates(s: _Sweep, name: str, raw: bytes) -> np.ndarray:
    """A field's values along a ray, NaN where missing or not there."""
    f, out = s.fields[name], np.full(len(s.gates), np.nan)
    if f["kind"] != WORDS:
        raise ValueError(f"{name} is not of 16-bit words")
    words = np.frombuffer(raw, s.order + "u2", (len(raw) - 16) // 2, 16).astype(np.uint16)
    found = (runs.decode(words, int(f["missing"])) if s.radar.get("compressed") else words.view(np.int16))[: len(out)]
    out[: len(found)] = np.where(found == f["missing"], np.nan, found / f["scale"])
    return out


@dataclass
class _Ray:
    at: int
    number: int
    told: dict[str, float]
    platform: dict[str, float] = field(default_factory=dict)
    values: dict[str, np.ndarray] = field(default_factory=dict)


def rays(f, size: int, asked: set[str], first: int = 0, last: int = 1 << 62) -> Iterator[tuple[_Sweep, _Ray]]:
    """The rays of a file that begin at first or later, before last; ray numbers count from the file's start."""
    chain = _Chain(f, size)
    s, ray, number = _Sweep(chain.order), None, 0
    for tag, at, n in chain.blocks():
        if tag == "RYIB":
            if ray:
                yield s, ray
            if at >= last:
                return
            ray = _Ray(at, number, _values(chain.bytes(at, n), s.order, RAY)) if at >= first else None
            number += 1
        elif tag in ("VOLD", "RADD", "PARM", "CFAC", "CELV"):
            _header(s, tag, chain.bytes(at, n))
        elif ray and tag == "ASIB":
            ray.platform = _values(chain.bytes(at, n), s.order, PLATFORM)
        elif ray and tag == "RDAT" and (name := _name(chain.bytes(at, 16))) in asked:
            ray.values[name] = _gates(s, name, chain.bytes(at, n))
    if ray:
        yield s, ray


@dataclass
class _Rays:
    """Rays of one sweep as blocks of bytes: their own, those of the platforms, and of each field, by the ray's place here."""

    sweep: _Sweep
    numbers: list[int] = field(default_factory=list)
    own: list[bytes] = field(default_factory=list)
    platforms: dict[int, bytes] = field(default_factory=dict)
    data: dict[str, dict[int, bytes]] = field(default_factory=dict)

    def values(self, name: str) -> np.ndarray:
        """A field's values, a row for each ray: what _gates makes of each."""
        held, wide = self.data.get(name, {}), len(self.sweep.gates)
        out = np.full([len(self.own), wide], np.nan)
        if not held:
            return out
        f = self.sweep.fields[name]
        if f["kind"] != WORDS:
            raise ValueError(f"{name} is not of 16-bit words")
        many = np.array([(len(b) - 16) // 2 for b in held.values()], np.int64)
        words = np.frombuffer(b"".join([b[16 : 16 + (len(b) - 16) // 2 * 2] for b in held.values()]), self.sweep.order + "u2").astype(np.uint16)
        ends = np.cumsum(many)
        if self.sweep.radar.get("compressed"):
            found = runs.decode_rows(words, ends - many, ends, wide, int(f["missing"]))
        else:
            plain = np.full([len(held), wide], int(f["missing"]) & 0xFFFF, np.uint16)
            runs.copied(words, ends - many, np.minimum(many, wide), plain, np.arange(len(held)))
            found = plain.view(np.int16)
        filled = np.array(int(f["missing"]) & 0xFFFF, np.uint16).view(np.int16)  # what stands in runs of missing words, and where there are no more
        out[list(held)] = np.where(found == filled, np.nan, found / f["scale"])
        return out

    def told(self) -> dict[str, np.ndarray]:
        """The rays' own values: whole seconds, and the platform's with their corrections; one without a platform is the radar's."""
        s, many, r = self.sweep, len(self.own), _arrays(self.own, self.sweep.order, RAY)
        if any(np.isnan(r[n]).any() for n in ("julian", "hour", "minute", "second")):
            raise ValueError("a ray's block has no time")
        days = np.datetime64(f"{s.year:04d}-01-01", "D").astype(int) + r["julian"].astype(np.int64) - 1
        clock = [r[n].astype(np.int64) for n in ("hour", "minute", "second")]
        out = {"ray": np.array(self.numbers), "second": days * 86400 + clock[0] * 3600 + clock[1] * 60 + clock[2], "scan_mode": np.full(many, int(s.radar.get("scan_mode", 0)))}
        flown, at = _arrays(list(self.platforms.values()), s.order, PLATFORM), list(self.platforms)
        for n in PLATE:
            out[n] = np.full(many, s.radar.get(n, np.nan) if n in ("longitude", "latitude", "altitude") else np.nan)
            out[n][at] = flown[n]
            out[n] += s.correction.get(n, 0.0)
        out["altitude"] *= 1000  # the format's kilometres
        return out | {"azimuth": r["azimuth"], "elevation": r["elevation"], "beam_width": np.full(many, (s.radar.get("wide", np.nan) + s.radar.get("high", np.nan)) / 2)}


def ray_batches(f, size: int, asked: set[str], first: int = 0, last: int = 1 << 62) -> Iterator[_Rays]:
    """What rays finds, RAYS rays at a time, as bytes."""
    chain = _Chain(f, size)
    s, number, within = _Sweep(chain.order), 0, False
    held = _Rays(s)
    for tag, at, n in chain.blocks():
        if tag == "RYIB":
            if at >= last:
                break
            if len(held.own) == RAYS:
                yield held
                held = _Rays(s)
            within = at >= first
            if within:
                held.numbers.append(number)
                held.own.append(chain.bytes(at, n))
            number += 1
        elif tag in ("VOLD", "RADD", "PARM", "CFAC", "CELV"):
            if held.own:  # what is held is of the header before
                yield held
                held, within = _Rays(s), False
            _header(s, tag, chain.bytes(at, n))
        elif within and tag == "ASIB":
            held.platforms[len(held.own) - 1] = chain.bytes(at, n)
        elif within and tag == "RDAT" and (name := _name(chain.bytes(at, 16))) in asked:
            held.data.setdefault(name, {})[len(held.own) - 1] = chain.bytes(at, n)
    if held.own:
        yield held


@dataclass
class _Range:
    path: str
    first: int
    last: int


@dataclass
class _Share(InputPartition):
    ranges: list[_Range]


class DoradeReader(DataSourceReader):
    """A task has a range of a large file, or some small files: together an eighth of such a range at most."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.bytes_a_task = schema, options["path"], int(options.get("bytespertask", 1 << 26))

    def partitions(self) -> list[InputPartition]:
        out, held = [], self.bytes_a_task
        for path in files_below(self.path):
            files, at = opened(path)
            size = files.get_file_info(at).size
            for a in range(0, size, self.bytes_a_task):
                b = min(a + self.bytes_a_task, size)
                if held + b - a > self.bytes_a_task // 8:
                    out.append(_Share([]))
                    held = 0
                out[-1].ranges.append(_Range(path, a, b))
                held += b - a
        return out or [_Share([])]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        asked = {c.name for c in self.schema} - {"file", *DOUBLES, *WHOLE}
        for part in partition.ranges:
            files, at = opened(part.path)
            with files.open_input_file(at) as f:
                for held in ray_batches(f, f.size(), asked, part.first, part.last):
                    yield self._batch(part.path, held)

    def _batch(self, path: str, held: _Rays) -> pa.RecordBatch:
        """A row for each gate."""
        gates, many, told = held.sweep.gates, len(held.own), held.told()
        columns = []
        for c in self.schema:
            if c.name == "file":
                made = pa.array([path] * (many * len(gates)), pa.string())
            elif c.name == "gate":
                made = pa.array(np.tile(np.arange(1, len(gates) + 1), many), pa.int64())
            elif c.name == "distance":
                made = pa.array(np.tile(gates, many))
            elif c.name in told:
                made = pa.array(np.repeat(told[c.name], len(gates)), pa.int64() if c.name in WHOLE else pa.float64(), from_pandas=True)
            else:
                made = pa.array(held.values(c.name).ravel(), from_pandas=True)
            columns.append(made)
        return pa.RecordBatch.from_arrays(columns, names=[c.name for c in self.schema])


class Dorade(DataSource):
    """Options: path, bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "dorade"

    def schema(self) -> StructType:
        raise ValueError("give the schema: its columns are the fields that are decoded")

    def reader(self, schema: StructType) -> DataSourceReader:
        return DoradeReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_dorade(spark: SparkSession, path: str, reflectivity: str = "DBZ", velocity: str = "VEL", width: str = "WIDTH", **options: object) -> DataFrame:
    """Gates of all sweeps at path: azimuth and elevation relative to the earth (an airborne radar's from its platform), places of the radar, the three fields by their names.

    ray counts within its file, gate from 1.  Missing values are NULL, as is a field that a file lacks.
    """
    spark.dataSource.register(Dorade)
    fields = {"reflectivity": reflectivity, "velocity": velocity, "width": width}
    schema = ", ".join(["file string", *[f"{n} long" for n in WHOLE], *[f"{n} double" for n in DOUBLES], *[f"`{v}` double" for v in fields.values()]])
    rows = spark.read.format("dorade").schema(schema).options(**{k: str(v) for k, v in options.items()}).load(path)
    c = F.col
    azimuth, elevation = radar.earth_angles(*[c(n) for n in ("roll", "pitch", "heading", "drift", "rotation", "tilt")])
    flown = c("scan_mode") == AIRBORNE
    return rows.select(
        "file", "ray", "gate", "second", F.when(flown, azimuth).otherwise(c("azimuth")).alias("azimuth"), F.when(flown, elevation).otherwise(c("elevation")).alias("elevation"), "beam_width", "distance",
        "latitude", "longitude", "altitude", *[c(v).alias(n) for n, v in fields.items()],
    )


def sweep_bytes(gates: list[float], told: Sequence[dict[str, float]] | dict[str, np.ndarray], fields: dict[str, Sequence[np.ndarray]], radar_told: dict[str, float] | None = None, scale: float = 100.0, missing: int = -32768, order: str = "<", compressed: bool = True, correction: dict[str, float] | None = None) -> bytes:
    """A sweep file: told has each ray's second, azimuth and elevation and its platform's values, as arrays or ray by ray; fields their rays' values, NaN where missing."""
    if not isinstance(told, dict):
        told = {n: np.array([ray.get(n, 0.0) for ray in told]) for n in ("second", "azimuth", "elevation", *PLATFORM)}
    many = len(told["second"])
    year = np.datetime64(int(told["second"][0]), "s").astype("datetime64[Y]")
    start = int(year.astype("datetime64[s]").astype(np.int64))
    about = {"wide": 1.0, "high": 1.0, "scan_mode": 1} | (radar_told or {}) | {"fields": len(fields), "compressed": int(compressed)}
    out = [_block("VOLD", order, VOLUME, {"year": int(year.astype(int)) + 1970}), _block("RADD", order, RADAR, about, {8: "RADAR"})]
    out += [_block("PARM", order, FIELD, {"kind": WORDS, "scale": scale, "missing": missing}, {8: name}) for name in fields]
    out.append(struct.pack(order + "4sii", b"CELV", 12 + 4 * len(gates), len(gates)) + np.array(gates, order + "f4").tobytes())
    out += [_block("CFAC", order, CORRECTION, correction or {}), _block("SWIB", order, {"rays": ("i", 20)}, {"rays": many}, {8: "RADAR"})]
    day, rest = np.divmod(told["second"].astype(np.int64) - start, 86400)
    clock = {"julian": day + 1, "hour": rest // 3600, "minute": rest // 60 % 60, "second": rest % 60}
    blocks = [_blocks("RYIB", order, RAY, clock | {n: told[n] for n in ("azimuth", "elevation")}, many), _blocks("ASIB", order, PLATFORM, {n: told[n] for n in PLATFORM if n in told}, many)]
    coded = {}
    for name, values in fields.items():
        v = np.asarray(values, float).reshape(many, -1)
        raw = np.where(np.isnan(v), missing, np.round(np.nan_to_num(v) * scale)).astype(np.int16)
        coded[name] = runs.encode_rows(raw, missing) if compressed else (raw.view(np.uint16).ravel(), np.full(many, raw.shape[1]))
    # every block's length is a multiple of 4: its place in its ray, and the rays' places, follow from the numbers of words
    lengths = [np.full(many, b.shape[1]) for b in blocks] + [16 + n * 2 + n * 2 % 4 for _, n in coded.values()]
    ends = np.cumsum(np.sum(lengths, 0))
    at = ends - np.sum(lengths, 0)
    body = np.zeros(int(ends[-1]), np.uint8)
    for b, n in zip(blocks, lengths, strict=False):
        body[at[:, None] + np.arange(b.shape[1])] = b
        at = at + n
    words_of = body.view(order + "u2")
    for (name, (words, n)), size in zip(coded.items(), lengths[len(blocks) :], strict=True):
        head = np.zeros(many, [("tag", "S4"), ("size", order + "i4"), ("name", "S8")])
        head["tag"], head["size"], head["name"] = b"RDAT", size, name.encode().ljust(8)
        body[at[:, None] + np.arange(16)] = head.view(np.uint8).reshape(many, 16)
        words_of[np.repeat(at // 2 + 8 - (np.cumsum(n) - n), n) + np.arange(len(words))] = words
        at = at + size
    return b"".join([*out, body.tobytes(), struct.pack(order + "4si", b"NULL", 8), struct.pack(order + "4si", b"RKTB", 8)])


def write_dorade(gates: DataFrame, folder: str, sweep: str, fields: list[str], distances: list[float], scale: float = 100.0) -> int:
    """Writes gates (sweep, ray, gate from 1, second, azimuth, elevation, latitude, longitude, altitude and fields) as one file a sweep; tells how many.

    A sweep is a radar's one turn, some thousand rays at most by its format, and made by one task.
    A file appears whole under its name, and a repeated task writes the same again.
    """

    def made(key: tuple, table: pa.Table) -> pa.Table:
        column = {n: table.column(n).to_numpy() for n in names}
        _, first, at_ray = np.unique(column["ray"], return_index=True, return_inverse=True)
        values = {f: np.full([len(first), len(distances)], np.nan) for f in fields}
        for f, held in values.items():
            held[at_ray, column["gate"].astype(np.int64) - 1] = column[f]
        told = {n: column[n][first] for n in ("second", "azimuth", "elevation", "latitude", "longitude")} | {"altitude": column["altitude"][first] / 1000}
        files, at = opened(folder)
        name, hidden = f"{at}/swp.{key[0].as_py()}", f"{at}/.swp.{key[0].as_py()}-{np.random.default_rng().integers(1 << 62):x}"
        files.create_dir(at, recursive=True)
        with files.open_output_stream(hidden) as f:
            f.write(sweep_bytes(distances, told, values, scale=scale))
        files.move(hidden, name)
        return pa.table({"files": pa.array([1], pa.int64())})

    names = ["ray", "gate", "second", "azimuth", "elevation", "latitude", "longitude", "altitude", *fields]
    return gates.select(sweep, *names).groupBy(sweep).applyInArrow(made, "files long").agg(F.sum("files")).first()[0] or 0
