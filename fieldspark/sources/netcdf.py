"""NetCDF-3 files as tables, both ways.

Reading: a file's header says where every variable's bytes lie, so a file of
any size is cut by ranges of its outer dimension, and a task reads the bytes
of its range of the asked variables, nothing else: the schema that is given
prunes.  Files are opened through Arrow's file systems, from wherever the path
says.

Writing: the header is planned first, with every variable's place; tasks write
their slabs at these places of a hidden file, a repeated task the same bytes
again, and the commit renames it.  An aborted job deletes it.  The folder has
to allow writing at a position, as file systems mounted on all executors do.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .place import files_below, opened

# fixed values of the format: tags, and types by their number
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
NUMBERS = {np.dtype(v).str: k for k, v in TYPES.items()}
ROWS = 1 << 16
TASKS = 256  # that read one file, at most


@dataclass
class Variable:
    dims: list[str]
    kind: str
    attributes: dict[str, object]
    begin: int = 0
    size: int = 0  # bytes of a record, or of the whole variable


@dataclass
class Header:
    dims: dict[str, int]  # 0 for the one that grows
    attributes: dict[str, object]
    variables: dict[str, Variable]
    records: int = 0
    record_bytes: int = 0
    version: int = 2

    def length(self, dim: str) -> int:
        return self.dims[dim] or self.records

    def grows(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]] == 0


class _Bytes:
    """Reads the header forwards, fetching more as it needs it."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch, self.held, self.at = fetch, b"", 0

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.held):
            more = self.fetch(len(self.held), max(n, 1 << 16))
            if not more:
                raise ValueError("the file ends within its header")
            self.held += more
        self.at += n
        return self.held[self.at - n : self.at]

    def number(self, kind: str = ">i") -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode()


def _attributes(b: _Bytes) -> dict[str, object]:
    tag, n = b.number(), b.number()
    if tag not in (0, ATTRIBUTE):
        raise ValueError("not a netCDF-3 header")
    out = {}
    for _ in range(n):
        name, kind, many = b.name(), TYPES[b.number()], b.number()
        raw = b.padded(many * np.dtype(kind).itemsize)
        value = raw.decode(errors="replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind).tolist()
        out[name] = value[0] if isinstance(value, list) and len(value) == 1 else value
    return out


def parsed(fetch: Callable[[int, int], bytes]) -> Header:
    b = _Bytes(fetch)
    if b.take(3) != b"CDF" or (version := b.take(1)[0]) not in (1, 2):
        raise ValueError("not a netCDF-3 file")
    records = b.number()
    b.number()
    dims = {b.name(): b.number() for _ in range(b.number())}
    names = list(dims)
    attributes = _attributes(b)
    b.number()
    variables = {}
    for _ in range(b.number()):
        name = b.name()
        own = [names[b.number()] for _ in range(b.number())]
        told = _attributes(b)
        kind = TYPES[b.number()]
        b.number()
        variables[name] = Variable(own, kind, told, b.number(">q" if version == 2 else ">i"))
    out = Header(dims, attributes, variables, records, 0, version)
    _sizes(out)
    return out


def _sizes(h: Header) -> None:
    growing = [v for v in h.variables.values() if h.grows(v)]
    for v in h.variables.values():
        inner = v.dims[1:] if h.grows(v) else v.dims
        v.size = int(np.prod([h.dims[d] for d in inner], dtype=np.int64)) * np.dtype(v.kind).itemsize
    pad = 4 if len(growing) > 1 else 1  # a lone variable's records are not padded
    h.record_bytes = sum(v.size + -v.size % pad for v in growing)


def planned(h: Header) -> bytes:
    """The header's bytes, once every variable has its place."""
    _sizes(h)

    def name(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def attributes(told: dict[str, object]) -> bytes:
        out = struct.pack(">ii", ATTRIBUTE if told else 0, len(told))
        for k, v in told.items():
            if isinstance(v, str):
                raw, kind, many = v.encode(), "S1", len(v.encode())
            else:
                kind = ">i4" if isinstance(v, int) else ">f4" if isinstance(v, np.float32) else ">f8"
                raw, many = np.atleast_1d(v).astype(kind).tobytes(), np.size(v)
            out += name(k) + struct.pack(">ii", NUMBERS[np.dtype(kind).str], many) + raw + b"\0" * (-len(raw) % 4)
        return out

    names = list(h.dims)

    def whole() -> bytes:
        out = b"CDF\x02" + struct.pack(">i", h.records)
        out += struct.pack(">ii", DIMENSION, len(names)) + b"".join(name(d) + struct.pack(">i", h.dims[d]) for d in names)
        out += attributes(h.attributes) + struct.pack(">ii", VARIABLE, len(h.variables))
        for k, v in h.variables.items():
            out += name(k) + struct.pack(">i", len(v.dims)) + b"".join(struct.pack(">i", names.index(d)) for d in v.dims)
            out += attributes(v.attributes) + struct.pack(">iI", NUMBERS[np.dtype(v.kind).str], min(v.size + -v.size % 4, 0xFFFFFFFF)) + struct.pack(">q", v.begin)
        return out

    at = len(whole())
    for growing in (False, True):
        for v in h.variables.values():
            if h.grows(v) == growing:
                v.begin, at = at, at + v.size + -v.size % (4 if not growing or sum(map(h.grows, h.variables.values())) > 1 else 1)
    return whole()


def header_of(path: str) -> Header:
    """The header of one file: dimensions, attributes, variables."""
    files, at = opened(path)
    with files.open_input_file(at) as f:
        return parsed(lambda begin, n: f.read_at(n, begin))


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int


def _values(h: Header, v: Variable, f, first: int, last: int) -> np.ndarray:
    """The variable's values, of the range of its outer dimension where it has the outer one of the rows."""
    kind = np.dtype(v.kind)
    shape = [h.length(d) for d in v.dims]
    if h.grows(v):
        step = h.record_bytes
        raw = f.read_at((last - first - 1) * step + v.size, v.begin + first * step) if last > first else b""
        rows = [np.frombuffer(raw, kind, v.size // kind.itemsize, k * step) for k in range(last - first)]
        return np.stack(rows).reshape([last - first, *shape[1:]]) if rows else np.zeros([0, *shape[1:]], kind)
    inner = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize if shape else kind.itemsize
    return np.frombuffer(f.read_at((last - first) * inner, v.begin + first * inner), kind).reshape([last - first, *shape[1:]] if shape else [])


class NetcdfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.rows_a_task, self.dims = int(options.get("rowspertask", ROWS)), options.get("dims", "")

    def _row_dims(self, h: Header) -> list[str]:
        if self.dims:
            return self.dims.split(",")
        asked = [h.variables[c.name] for c in self.schema if c.name in h.variables]
        return max((v.dims[:-1] if v.kind == "S1" else v.dims for v in asked), key=len, default=[])

    def _step(self, h: Header, dims: list[str]) -> int:
        """Places of the outer dimension that are read at a time."""
        inner = int(np.prod([h.length(d) for d in dims[1:]], dtype=np.int64)) if dims else 1
        return max(1, self.rows_a_task // max(inner, 1))

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowsPerTask rows, or of some times as many where that would be more than TASKS of a file."""
        out = []
        for path in files_below(self.path):
            h = header_of(path)
            dims = self._row_dims(h)
            n = h.length(dims[0]) if dims else 1
            step = self._step(h, dims)
            step *= max(1, -(-n // (step * TASKS)))
            out += [_Range(path, a, min(a + step, n)) for a in range(0, n, step)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.last <= partition.first:
            return
        h = header_of(partition.path)
        dims = self._row_dims(h)
        files, at = opened(partition.path)
        step = self._step(h, dims)
        with files.open_input_file(at) as f:
            for first in range(partition.first, partition.last, step):  # a long range is never held whole
                part = _Range(partition.path, first, min(first + step, partition.last))
                shape = [part.last - part.first, *[h.length(d) for d in dims[1:]]] if dims else [1]
                columns = [self._column(c, h, f, dims, shape, part) for c in self.schema]
                schema = pa.schema([(c.name, a.type) for c, a in zip(self.schema, columns, strict=True)])
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=ROWS)

    def _column(self, c, h: Header, f, dims: list[str], shape: list[int], part: _Range) -> pa.Array:
        kind = {"double": pa.float64(), "float": pa.float32(), "long": pa.int64(), "bigint": pa.int64(), "integer": pa.int32(), "int": pa.int32(), "string": pa.string()}[c.dataType.typeName()]
        total = int(np.prod(shape, dtype=np.int64))
        if c.name == "file":
            return pa.array([part.path] * total, pa.string())
        v = h.variables.get(c.name)
        if v is None:
            if c.name in dims:  # a dimension without a variable: its index
                k = dims.index(c.name)
                index = np.arange(shape[k]) + (part.first if k == 0 else 0)
                return pa.array(np.broadcast_to(index.reshape([-1 if j == k else 1 for j in range(len(shape))]), shape).ravel()).cast(kind)
            return pa.nulls(total, kind)
        own = v.dims[:-1] if v.kind == "S1" else v.dims
        outer = bool(dims) and bool(own) and own[0] == dims[0]
        values = _values(h, v, f, *((part.first, part.last) if outer else (0, h.length(v.dims[0]) if v.dims else 1)))
        if v.kind == "S1":
            width = values.shape[-1]
            values = np.frombuffer(np.ascontiguousarray(values).tobytes(), f"S{width}").reshape(values.shape[:-1])
        if any(d not in dims for d in own):
            raise ValueError(f"{c.name} has dimensions {own}, rows have {dims}")
        values = np.broadcast_to(values.reshape([values.shape[own.index(d)] if d in own else 1 for d in dims] or [1]), shape).ravel()
        if v.kind == "S1":
            return pa.array([x.decode(errors="replace").strip() for x in values], pa.string())
        missing = np.zeros(total, bool)
        for k in ("_FillValue", "missing_value"):
            if k in v.attributes and not isinstance(v.attributes[k], str):
                missing |= values == np.array(v.attributes[k]).astype(v.kind)
        scale, offset = v.attributes.get("scale_factor"), v.attributes.get("add_offset")
        plain = values.astype(values.dtype.newbyteorder("="))
        if scale is not None or offset is not None:
            plain = plain * float(scale if scale is not None else 1) + float(offset or 0)
        if plain.dtype.kind == "f" and pa.types.is_integer(kind):
            plain = np.where(np.isfinite(plain), plain, 0)
        return pa.array(plain, mask=missing).cast(kind, safe=False)


@dataclass
class _Done(WriterCommitMessage):
    rows: int


@dataclass
class NetcdfWriter(DataSourceArrowWriter):
    path: str
    header: Header
    fields: list[str]
    dims: list[str]
    hidden: str = field(default="")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        rows, handle = 0, os.open(self.hidden, os.O_WRONLY)
        try:
            for batch in iterator:
                index = {d: batch.column(batch.schema.get_field_index(f"i{d}")).to_numpy(zero_copy_only=False) for d in self.dims}
                for name in self.fields:
                    self._put(handle, batch, index, name)
                rows += batch.num_rows
        finally:
            os.close(handle)
        return _Done(rows)

    def _put(self, handle: int, batch: pa.RecordBatch, index: dict[str, np.ndarray], name: str) -> None:
        """Writes a field's values as runs of neighbours; one that lacks a dimension is written where that is 0."""
        v = self.header.variables[name]
        some = np.flatnonzero(np.logical_and.reduce([index[d] == 0 for d in self.dims if d not in v.dims])) if len(v.dims) < len(self.dims) else np.arange(batch.num_rows)
        at = np.ravel_multi_index([index[d][some] for d in v.dims], [self.header.length(d) for d in v.dims]).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order]) != 1) + 1
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.float64())
        raw = column.fill_null(float(v.attributes["_FillValue"])).to_numpy(zero_copy_only=False)[some][order].astype(v.kind)
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]), strict=True):
            if b > a:
                os.pwrite(handle, raw[a:b].tobytes(), v.begin + int(at[order[a]]) * raw.itemsize)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        wanted = int(np.prod([self.header.length(d) for d in self.dims], dtype=np.int64))
        if sum(m.rows for m in messages if m) != wanted:
            self.abort(messages)
            raise ValueError("the rows are not the whole grid")
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class Netcdf(DataSource):
    """Options to read: path, dims (those of a row, outer first; else those of the widest asked variable), rowsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> StructType:
        raise ValueError("give the schema: its columns are the variables that are read")

    def reader(self, schema: StructType) -> DataSourceReader:
        return NetcdfReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        told = json.loads(self.options["header"])
        path = urlparse(self.options["path"]).path
        if not overwrite and os.path.exists(path):
            raise FileExistsError(path)
        axes = {k: v for k, v in told["axes"].items() if isinstance(v, list)}
        dims = {k: len(axes[k]) if k in axes else v for k, v in told["axes"].items()}
        variables = {k: Variable([k], ">f8", told["about"].get(k, {})) for k in axes}
        kind, number = (">f8", float) if told["doubles"] else (">f4", np.float32)
        missing = {"missing_value": number(told["missing"]), "_FillValue": number(told["missing"])}
        variables |= {k: Variable(told["along"].get(k, list(dims)), kind, told["about"].get(k, {}) | missing) for k in told["fields"]}
        header = Header(dims, told["attributes"], variables)
        raw = planned(header)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        hidden = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
        with open(hidden, "wb") as f:
            f.write(raw)
            for k, values in axes.items():
                f.seek(variables[k].begin)
                f.write(np.array(values, ">f8").tobytes())
            f.truncate(max(v.begin + v.size for v in variables.values()))
        return NetcdfWriter(path, header, told["fields"], list(dims), hidden)


def read_netcdf(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    """The asked variables of all files at path; missing and fill values are NULL, packed ones unpacked."""
    spark.dataSource.register(Netcdf)
    return spark.read.format("netcdf3").schema(schema).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_netcdf(
    grid: DataFrame, path: str, axes: dict[str, list[float] | int], fields: list[str], about: dict[str, dict] | None = None, attributes: dict | None = None,
    missing: float = -999.0, doubles: bool = False, along: dict[str, list[str]] | None = None,
) -> None:
    """Writes grid (i<axis> of every axis, and the fields) as one file; axes, outer first, have their nodes' coordinates, or a length alone.

    Every node has to have one row; a NULL field is written as missing.  about
    has attributes by axis or field, such as units; along the axes of fields
    that do not depend on all: their values are those of the rows where the others are 0.
    """
    grid.sparkSession.dataSource.register(Netcdf)
    told = {"axes": axes, "fields": fields, "about": about or {}, "attributes": attributes or {}, "missing": missing, "doubles": doubles, "along": along or {}}
    rows = grid.select(*[F.col(f"i{a}").cast("long").alias(f"i{a}") for a in axes], *[F.col(f).cast("double").alias(f) for f in fields])
    nodes = [f"i{a}" for a in axes]
    rows = rows.repartitionByRange(*nodes).sortWithinPartitions(*nodes)  # runs of neighbouring nodes
    rows.write.format("netcdf3").option("header", json.dumps(told)).mode("append").save(path)
