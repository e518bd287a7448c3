"""Array files (.npy) that lie side by side, with records, as one Spark data source that reads and writes.

A folder holds arrays whose first index is the same row, and perhaps JSON records of these rows. A partition is a range
of rows over all of them, so labels, numbers, ids and traces come out of one task and nothing is joined by position.
An array is one file, or a folder of part files that continue each other in the order of their names; records are one
JSON list, or a folder with a file of JSON lines for each part of the first array.

Reading: `spark.read.format("aligned_arrays")`, see `read_aligned`. Columns that the reader's schema leaves out are not
read, and filters on split and position leave out ranges. Batches and partitions are bounded by bytes.
Writing: a task puts whole blocks of rows into part files of its own attempt; when the job commits, the files of the
successful attempts are moved to their places, and a failed job leaves nothing.

Paths are those of pyarrow's file systems (local ones, which driver and executors share, and by their URIs hdfs, s3, gs and abfs);
any other one raises.
"""

from __future__ import annotations

import codecs
import json
import math
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a partition that is read, of an Arrow batch, and of a part file that is written.
PARTITION, BATCH, PART = 32 << 20, 4 << 20, 64 << 20
#: Fields of a record, each with how its JSON value is read; every other key goes into `extra` as JSON text.
FIELDS = {"sample_id": ("string", str), "point_id": ("string", str), "depth_value": ("double", float), "source_label": ("int", int)}
#: Keys of a record that the arrays give.
FROM_ARRAYS = ("label",)
RECORD = ", ".join(f"{k} {kind}" for k, (kind, _) in FIELDS.items()) + ", extra map<string,string>"
NUMBERS = {"float": (np.float32, pa.float32()), "double": (np.float64, pa.float64()), "long": (np.int64, pa.int64()), "int": (np.int32, pa.int32())}


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


def part_files(path: str, ending: str = ".npy") -> list[str]:
    """The file, or the part files of the folder, at path; none raises."""
    at, place = store(path)
    info = at.get_file_info(place)
    if info.type == pafs.FileType.File:
        return [place]
    if info.type == pafs.FileType.Directory:
        found = sorted(f.path for f in at.get_file_info(pafs.FileSelector(place)) if f.is_file and f.path.endswith(ending))
        if found:
            return found
    raise FileNotFoundError(path)


@dataclass(frozen=True)
class Part:
    """A file of an array: rows [first, first + n) start at `offset`."""

    file: str
    offset: int
    dtype: str
    shape: tuple[int, ...]
    first: int

    @property
    def n(self) -> int:
        return self.shape[0]

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * math.prod(self.shape[1:])


def _header(at: pafs.FileSystem, file: str) -> Part:
    with at.open_input_file(file) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran or dtype.hasobject:
            raise ValueError(f"{file}: only arrays of numbers in C order are read")
        return Part(file, f.tell(), dtype.str, shape or (1,), 0)


def array_parts(path: str) -> list[Part]:
    """The files of an array, from their headers; files that do not fit together raise."""
    at, _ = store(path)
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda f: _header(at, f), part_files(path)))
    if len({p.shape[1:] for p in found}) != 1:
        raise ValueError(f"{path}: files of shapes {sorted({p.shape[1:] for p in found})}")
    out, first = [], 0
    for p in found:
        out.append(Part(p.file, p.offset, p.dtype, p.shape, first))
        first += p.n
    return out


def shape(path: str) -> tuple[int, ...]:
    """Shape of the whole array."""
    parts = array_parts(path)
    return (sum(p.n for p in parts), *parts[0].shape[1:])


_BETWEEN = re.compile(r"[ \t\r\n,]*")


def list_items(at: pafs.FileSystem, file: str, start: int = 0, stop: int | None = None, chunk: int = 1 << 20) -> Iterator[tuple[int, int, object]]:
    """(first byte, last byte + 1, value) of each item of a JSON list, or of the items in a range of its bytes; held are a chunk and an item at most."""
    decoder, utf8 = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")()
    text, here, byte, opened, ended = "", 0, start, start > 0, False
    with at.open_input_file(file) as f:
        f.seek(start)
        while True:
            there = _BETWEEN.match(text, here).end()
            byte, here = byte + there - here, there
            if not opened and text[here : here + 1] == "[":
                opened, here, byte = True, here + 1, byte + 1
                continue
            if opened and (text[here : here + 1] == "]" or (ended and here == len(text) and stop is not None)):
                return
            end = None
            if opened and here < len(text):
                try:
                    value, end = decoder.raw_decode(text, here)
                except json.JSONDecodeError:
                    pass
            if end is not None and (end < len(text) or ended):  # a number at the end of a chunk might go on
                size = len(text[here:end].encode())
                yield byte, byte + size, value
                byte, here = byte + size, end
            elif ended or (not opened and here < len(text)):
                raise ValueError(f"{file}: no JSON list")
            else:
                data = f.read(chunk if stop is None else max(0, min(chunk, stop - f.tell())))
                ended = not data
                text, here = text[here:] + utf8.decode(data, ended), 0


def lines_of(at: pafs.FileSystem, file: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a file that hold anything, read bit by bit."""
    rest = b""
    with at.open_input_stream(file) as f:
        while data := f.read(chunk):
            *whole, rest = (rest + data).split(b"\n")
            yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


@dataclass
class Rows(InputPartition):
    """Rows [first, last) of a split: pieces of each array, and the records' file with the range of bytes or the rows before."""

    split: str
    first: int
    last: int
    pieces: dict[str, list[Part]] = field(default_factory=dict)
    records: tuple | None = None


class Layout:
    """What a folder of aligned arrays holds, checked: every array of a split has as many rows, and so have its records."""

    def __init__(self, options: dict):
        spec = json.loads(options["spec"])
        self.path, self.splits = options["path"].rstrip("/"), spec.get("splits")
        self.arrays = {c: (file, kind) for c, file, kind in spec["arrays"]}
        self.records, self.inner = spec.get("records"), {c: tuple(v) for c, v in spec.get("inner", {}).items()}
        self.bytes, self.batch, self.limits = spec.get("bytes", PARTITION), spec.get("batch", BATCH), spec.get("limits", {})

    def schema(self) -> str:
        fields = ["split string", "position long", *(f"{c} {kind}" for c, (_, kind) in self.arrays.items())]
        return ", ".join(fields + ([RECORD] if self.records else []))

    def ranges(self, split: str, columns: list[str], low: int = 0, high: int | None = None) -> list[Rows]:
        """Ranges of rows of one split, with what the columns need of the files."""
        folder = f"{self.path}/{split}" if split else self.path
        parts = {c: array_parts(f"{folder}/{file}") for c, (file, _) in self.arrays.items()}
        for c, wanted in self.inner.items():
            if c in parts and parts[c][0].shape[1:] != wanted:
                raise ValueError(f"{folder}: {self.arrays[c][0]} of shape {parts[c][0].shape[1:]}, expected {wanted}")
        sizes = {self.arrays[c][0]: sum(p.n for p in ps) for c, ps in parts.items()}
        first = next(iter(parts.values()))
        n = sum(p.n for p in first)
        row = max(1, sum(ps[0].row_bytes for c, ps in parts.items() if c in columns))
        step = max(1, self.bytes // row)
        cuts: list[tuple[int, int, tuple | None]]
        wanted = self.records and any(c in columns for c in [*FIELDS, "extra"])
        files = part_files(f"{folder}/{self.records}", ".json") if self.records else []
        at = store(self.path)[0]
        if self.records and at.get_file_info(store(f"{folder}/{self.records}")[1]).type == pafs.FileType.File:
            ends, count = [], 0
            for start, end, value in list_items(at, files[0]):
                if not isinstance(value, dict):
                    raise ValueError(f"{files[0]}: a record is no object")
                if count % step == 0:
                    ends.append([start, end])
                ends[-1][1] = end
                count += 1
            sizes[self.records] = count
            cuts = [(i, min(i + step, n), (files[0], *ends[i // step]) if wanted and i // step < len(ends) else None) for i in range(0, n, step)]
        elif wanted:  # lines of one part are read in order, so a part is not cut
            if len(files) != len(first):
                raise ValueError(f"{folder}: {len(files)} files of records for {len(first)} parts of arrays")
            cuts = [(p.first, p.first + p.n, (file,)) for p, file in zip(first, files, strict=True) if p.n]
        else:
            cuts = [(i, min(i + step, n), None) for i in range(0, n, step)]
        if len(set(sizes.values())) > 1:
            raise ValueError(f"{folder}: parts of different numbers {sizes}")
        high = n if high is None else min(high, n)
        over = lambda ps, a, z: [p for p in ps if p.first < z and p.first + p.n > a]
        return [Rows(split, a, z, {c: over(parts[c], a, z) for c in parts if c in columns}, r) for a, z, r in cuts if a < high and z > low]


class AlignedReader(DataSourceReader):
    def __init__(self, layout: Layout, schema: StructType):
        self.layout, self.columns = layout, schema.names
        self.splits, self.low, self.high = None, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges that filters on split and position exclude are left out; Spark applies all filters to what remains."""
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("split",) and isinstance(f, (EqualTo, In)):
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.splits = named if self.splits is None else self.splits & named
            elif column == ("position",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if column == ("position",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = value + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)
            yield f

    def partitions(self) -> list[Rows]:
        wanted = [s for s in self.layout.splits or [""] if self.splits is None or s in self.splits]
        found = [r for s in wanted for r in self.layout.ranges(s, self.columns, self.low, self.high)]
        return found or [Rows("", 0, 0)]

    def _records(self, part: Rows) -> Iterator[dict]:
        if part.records is None:
            return iter(())
        at = store(self.layout.path)[0]
        if len(part.records) == 3:
            return (value for _, _, value in list_items(at, *part.records))
        return (json.loads(line) for line in lines_of(at, part.records[0]))

    def _numbers(self, open_files: dict, column: str, parts: list[Part], a: int, z: int) -> pa.Array:
        blocks = []
        for p in parts:
            i, j = max(a, p.first), min(z, p.first + p.n)
            if i < j:
                blocks.append(np.frombuffer(open_files[p.file].read_at((j - i) * p.row_bytes, p.offset + (i - p.first) * p.row_bytes), p.dtype))
        kind = self.layout.arrays[column][1]
        numpy_type, arrow_type = NUMBERS[kind.removeprefix("array<").removesuffix(">")]
        flat = np.concatenate(blocks).astype(numpy_type, copy=False)
        if column in self.layout.limits and len(flat) and (flat.min() < 0 or flat.max() >= self.layout.limits[column]):
            raise ValueError(f"{self.layout.path}: {column} beyond 0 to {self.layout.limits[column] - 1}")
        if not kind.startswith("array"):
            return pa.array(flat, arrow_type)
        width = math.prod(parts[0].shape[1:])
        return pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * width), pa.array(flat, arrow_type))

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        at, records = store(self.layout.path)[0], self._records(part)
        open_files = {p.file: at.open_input_file(p.file) for ps in part.pieces.values() for p in ps}
        row = max(1, sum(ps[0].row_bytes for ps in part.pieces.values() if ps))
        step = min(max(1, self.layout.batch // row), 1 << 16)
        try:
            for a in range(part.first, part.last, step):
                z = min(a + step, part.last)
                own = [next(records, None) for _ in range(z - a)] if part.records else []
                if None in own:
                    raise ValueError(f"{part.records[0]}: fewer records than rows")
                columns = []
                for c in self.columns:
                    if c == "split":
                        columns.append(pa.array([part.split] * (z - a), pa.string()))
                    elif c == "position":
                        columns.append(pa.array(np.arange(a, z)))
                    elif c in part.pieces:
                        columns.append(self._numbers(open_files, c, part.pieces[c], a, z))
                    elif c == "extra":
                        rest = [[(k, json.dumps(v, ensure_ascii=False)) for k, v in r.items() if k not in FIELDS and k not in FROM_ARRAYS] for r in own]
                        columns.append(pa.array(rest, pa.map_(pa.string(), pa.string())))
                    else:
                        kind, read = FIELDS[c]
                        columns.append(pa.array([None if r.get(c) is None else read(r[c]) for r in own], {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[kind]))
                yield pa.RecordBatch.from_arrays(columns, names=self.columns)
            if part.records and next(records, None) is not None:
                raise ValueError(f"{part.records[0]}: more records than rows")
        finally:
            for f in open_files.values():
                f.close()


@dataclass
class Written(WriterCommitMessage):
    """Blocks of one task: (split, first position, rows, its files as (where it is, where it goes))."""

    blocks: list[tuple[str, int, int, list[tuple[str, str]]]]


class AlignedWriter(DataSourceArrowWriter):
    """Writes rows sorted by split and position, whose blocks of `block` positions each lie in one task, as a part of every array and of the records."""

    def __init__(self, options: dict):
        spec = json.loads(options["spec"])
        self.path, self.block, self.splits = options["path"].rstrip("/"), spec["block"], spec.get("splits") or [""]
        self.arrays, self.records = spec["arrays"], spec.get("records")

    def _place(self, split: str, file: str, first: int, ending: str) -> str:
        return "/".join(x for x in (store(self.path)[1], split, file, f"part-{first:012d}.{ending}") if x)

    def _files(self, folder: str, split: str, first: int, columns: dict[str, pa.Array], n: int) -> list[tuple[str, str]]:
        at, out = store(self.path)[0], []
        at.create_dir(folder, recursive=True)
        for k, (c, file, dtype, inner) in enumerate(self.arrays):
            flat = columns[c].flatten() if pa.types.is_list(columns[c].type) else columns[c]
            if flat.null_count or len(flat) != n * math.prod(inner):
                raise ValueError(f"{c}: rows of {split} from {first} on do not have {math.prod(inner)} numbers each")
            here = f"{folder}/{k}-{split}-{first}"
            with at.open_output_stream(here) as f:
                np.lib.format.write_array_header_1_0(f, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": (n, *inner)})
                f.write(np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), dtype))
            out.append((here, self._place(split, file, first, "npy")))
        if self.records:
            here, names = f"{folder}/records-{split}-{first}", [c for c in (*FIELDS, *FROM_ARRAYS) if c in columns]
            with at.open_output_stream(here) as f:
                rows = zip(*(columns[c].to_pylist() for c in names), columns["extra"].to_pylist() if "extra" in columns else [None] * n, strict=True)
                for *values, extra in rows:
                    known = {c: v for c, v in zip(names, values, strict=True) if v is not None}
                    f.write((json.dumps({k: json.loads(v) for k, v in extra or ()} | known, ensure_ascii=False) + "\n").encode())
            out.append((here, self._place(split, self.records, first, "json")))
        return out

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        folder = f"{store(self.path)[1]}/_attempts/{TaskContext.get().taskAttemptId()}"
        done, held, key = [], [], None

        def flush() -> None:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                columns = {c: whole.column(c).chunk(0) for c in whole.column_names}
                at = columns["position"].to_numpy()
                if len(at) != at[-1] - at[0] + 1 or (np.diff(at) != 1).any():
                    raise ValueError(f"positions of {key[0]} from {at[0]} to {at[-1]} are not one after the other")
                done.append((key[0], int(at[0]), len(at), self._files(folder, key[0], int(at[0]), columns, len(at))))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            split = batch.column("split").to_numpy(zero_copy_only=False) if "split" in batch.schema.names else np.full(batch.num_rows, "")
            block = batch.column("position").to_numpy() // self.block
            if strange := {*split} - {*self.splits}:
                raise ValueError(f"rows of no split: {sorted(map(str, strange))}")
            edges = np.flatnonzero(np.concatenate(([True], (split[1:] != split[:-1]) | (block[1:] != block[:-1]))))
            for i, j in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if (split[i], block[i]) != key:
                    flush()
                    key = (split[i], block[i])
                held.append(batch.slice(i, j - i))
        flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        at = store(self.path)[0]
        blocks = sorted(b for m in messages if m is not None for b in m.blocks)
        for split in self.splits:
            own, n = [b for b in blocks if b[0] == split], 0
            for _, first, rows, _ in own:
                if first != n:
                    raise ValueError(f"positions of {split} do not count from 0: {first} follows {n - 1}")
                n = first + rows
            if not own:
                types = {c: pa.list_(pa.float64()) if inner else pa.float64() for c, _, _, inner in self.arrays}
                blocks.append((split, 0, 0, self._files(f"{store(self.path)[1]}/_attempts/none", split, 0, {c: pa.array([], t) for c, t in types.items()}, 0)))
        moves = [m for b in blocks for m in b[3]]
        for folder in sorted({to.rpartition("/")[0] for _, to in moves}):
            at.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: at.move(*m), moves))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        at, place = store(f"{self.path}/_attempts")
        if at.get_file_info(place).type == pafs.FileType.Directory:
            at.delete_dir(place)


class AlignedArrays(DataSource):
    """Option `path`, and `spec` as JSON (see read_aligned and write_aligned)."""

    @classmethod
    def name(cls) -> str:
        return "aligned_arrays"

    def schema(self) -> str:
        return Layout(self.options).schema()

    def reader(self, schema: StructType) -> AlignedReader:
        return AlignedReader(Layout(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> AlignedWriter:
        return AlignedWriter(self.options)


def read_aligned(
    spark: SparkSession, path: str, arrays: list[tuple[str, str, str]], splits: list[str] | None = None, records: str | None = None,
    columns: list[str] | None = None, inner: dict[str, tuple[int, ...]] | None = None, limits: dict[str, int] | None = None, **sizes: int,
) -> DataFrame:
    """(split, position, a column of each array (name, file, type), the fields of the records), of every split's folder or of path itself.

    columns: the ones that are read, all by default. inner: shapes of rows by column; limits: numbers must be from 0 to
    below these. Absent files, shapes and numbers of rows that do not fit raise at once, limits and records when read."""
    spec = {"arrays": [list(a) for a in arrays], "splits": splits, "records": records, "inner": inner or {}, "limits": limits or {}} | sizes
    options = {"path": path, "spec": json.dumps(spec)}
    layout = Layout(options)
    for s in splits or [""]:
        layout.ranges(s, [])
    spark.dataSource.register(AlignedArrays)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    whole = [f.strip() for f in layout.schema().split(", ")]
    kept = [f for f in whole if columns is None or f.split()[0] in columns]
    return spark.read.format("aligned_arrays").options(**options).schema(", ".join(kept)).load()


def write_aligned(
    rows: DataFrame, path: str, arrays: list[tuple[str, str, str, tuple[int, ...]]], splits: list[str] | None = None, records: str | None = None,
    part_bytes: int = PART,
) -> None:
    """rows (split if there are splits, position, a column for each array (name, file, dtype, shape of a row), fields of records) as a folder.

    Positions count from 0 in each split, and there are no other splits; else it raises. The rows of one part meet in one task by a hash of their block, which needs neither a count nor a sample of them."""
    spark = rows.sparkSession
    spark.dataSource.register(AlignedArrays)
    row = sum(np.dtype(dtype).itemsize * math.prod(inner) for _, _, dtype, inner in arrays)
    block = max(1, part_bytes // row)
    key = (["split"] if splits else []) + [F.floor(F.col("position") / block)]
    placed = rows.repartition(*key).sortWithinPartitions(*(["split"] if splits else []), "position")
    spec = {"arrays": [[c, file, dtype, list(inner)] for c, file, dtype, inner in arrays], "splits": splits, "records": records, "block": block}
    placed.write.format("aligned_arrays").mode("append").option("path", path).option("spec", json.dumps(spec)).save()


def read_arrays(spark: SparkSession, path: str, kind: str = "array<double>") -> DataFrame:
    """(row, values) of one array, the rest of its indices flattened."""
    folder, _, file = path.rstrip("/").rpartition("/")
    return read_aligned(spark, folder, [("values", file, kind)]).select(F.col("position").alias("row"), "values")


def write_arrays(rows: DataFrame, path: str, inner: tuple[int, ...] = (), dtype: str = "float64", part_bytes: int = PART) -> None:
    """rows (row, values), in the order of row, as one array."""
    folder, _, file = path.rstrip("/").rpartition("/")
    write_aligned(rows.select(F.col("row").alias("position"), "values"), folder, [("values", file, dtype, inner)], part_bytes=part_bytes)
