"""Event and snapshot files partitioned by ranges of a whole-number key (S1, S2), as a Python data source.

A range is ``width`` values of the key; null keys are a range of their own. The sink writes each task's rows in the order of the
key, range after range in one Parquet file, a new one after ``FILE_ROWS`` rows. When all tasks are done, the commit writes a
manifest that lists the files with their parts, under a temporary name, and moves it into place: readers see the old table or the
new one, and files of failed or repeated tasks are never listed. A part is a range with its smallest and largest key and number of
rows, or, in a file of many ranges, several neighbours: files and manifest grow with the rows, not with the ranges.

The scan plans from the manifest alone: one partition for each range and about ``rows_per_partition`` rows of it; were that more
than ``partitions``, neighbours share one, up to so many rows. A task gets the files and keys that it reads, not the manifest.
Conditions on the key select ranges and files before any task starts; those and conditions on other columns go to the Parquet
reader, which skips row groups by their statistics.

Conditions are an argument of the read. ``pushFilters`` is not used: Spark 4.1 keeps one plan of partitions for each loaded
table, so the filters of one query would also cut the rows of the next query over the same DataFrame.

Options: ``path``; sink: ``key`` (default ``id``), ``width``; scan: ``where``, ``columns``, ``rows_per_partition``, ``partitions``. With
``range_column`` the scan adds a column of that name: the first key of the row's range, null for null keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronotile.session import ship_package

OPERATORS = ("==", ">", ">=", "<", "<=", "in", "null", "not null")
FORMAT, MANIFEST, WIDTH, ROWS = "chronotile_ranges", "_manifest.json", 1 << 20, 1_000_000
#: Partitions up to which each range has its own; rows of a file and of a row group; a file lists at most twice so many parts.
PARTITIONS, FILE_ROWS, GROUP_ROWS, PARTS = 64, 1_000_000, 1 << 16, 64


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifest(path: str) -> dict:
    store, at = _open(path)
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


def _range_starts(key: pa.Array, width: int) -> pa.Array:
    """The first key of each key's range, null for null."""
    key = key.cast(pa.int64())
    down = pc.divide(key, width)  # towards zero
    down = pc.subtract(down, pc.less(key, pc.multiply(down, width)).cast(pa.int64()))
    return pc.multiply(down, width)


def _place(start: int | None) -> tuple[bool, int]:
    """Order of the ranges: null keys first."""
    return start is not None, start or 0


def _parts(file: dict) -> list[dict]:
    """What a listed file holds, in order: start (of the first range), smallest and largest key and rows of each part."""
    return [dict(zip(("start", "min", "max", "rows"), x)) for x in file["parts"]] if "parts" in file else [file]


def _fewer(parts: list[list]) -> list[list]:
    """Neighbouring parts two by two as one; null keys stay alone."""
    null, keys = [x for x in parts if x[0] is None], [x for x in parts if x[0] is not None]
    pairs = [keys[i:i + 2] for i in range(0, len(keys), 2)]
    return null + [[x[0][0], x[0][1], x[-1][2], sum(p[3] for p in x)] for x in pairs]


class RangePartition(D.InputPartition):
    """What a task reads: (file name, smallest and largest key of its parts, None for null keys; whether they are the whole file)."""

    def __init__(self, files: list[tuple[str, int | None, int | None, bool]]):
        self.files = files


class RangeReader(D.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, options):
        self.path, self.range_column = path, options.get("range_column")
        self.rows, self.most = int(options.get("rows_per_partition", ROWS)), int(options.get("partitions", PARTITIONS))
        self.names = [f.name for f in schema.fields if f.name != self.range_column]
        found = _manifest(path)
        self.kinds = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(found["schema"])).fields}
        self.key, self.width, self.files = found["key"], found["width"], found["files"]
        self.where = [tuple(x) for x in json.loads(options.get("where", "[]"))]
        for name, op, _ in self.where:
            if op not in OPERATORS or name not in self.kinds or not isinstance(self.kinds[name], (T.IntegralType, T.StringType)):
                raise ValueError(f"no condition {op} on {name}")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "files"}  # every task gets the reader; only the plan needs the manifest

    def _may_hold(self, file: dict) -> bool:
        lo, hi = file["min"], file["max"]
        for name, op, v in self.where:
            if name != self.key:
                continue
            if lo is None:
                ok = op == "null"
            elif op == "in":
                ok = any(x is not None and lo <= x <= hi for x in v)
            else:
                ok = {"==": lambda: lo <= v <= hi, ">": lambda: hi > v, ">=": lambda: hi >= v, "<": lambda: lo < v, "<=": lambda: lo <= v,
                      "null": lambda: False, "not null": lambda: True}[op]()
            if not ok:
                return False
        return True

    def partitions(self) -> list[RangePartition]:
        found = [(x, f["name"]) for f in self.files for x in _parts(f) if self._may_hold(x)]
        groups = []
        for x, name in sorted(found, key=lambda x: (_place(x[0]["start"]), x[1])):
            if not groups or groups[-1][0] != x["start"] or groups[-1][1] + x["rows"] > self.rows:
                groups.append([x["start"], 0, []])
            groups[-1][1] += x["rows"]
            groups[-1][2].append((name, x))
        if len(groups) > self.most:
            groups = self._shared(groups)
        whole, out = {f["name"]: f["rows"] for f in self.files}, []
        for start, _, parts in groups:
            files: dict[str, list[dict]] = {}
            for name, x in parts:  # those of one file are neighbours in it
                files.setdefault(name, []).append(x)
            out.append(RangePartition([(n, v[0]["min"], v[-1]["max"], sum(x["rows"] for x in v) == whole[n]) for n, v in files.items()]))
        return out or [RangePartition([])]

    def _shared(self, groups: list[list]) -> list[list]:
        """Neighbouring groups as one, up to an equal share of the rows or ``rows_per_partition``; null keys stay alone."""
        share, out = min(self.rows, -(-sum(g[1] for g in groups) // self.most)), []
        for start, rows, parts in groups:
            if out and out[-1][1] + rows <= share and (out[-1][0] is None) == (start is None):
                out[-1][1] += rows
                out[-1][2] += parts
            else:
                out.append([start, rows, [*parts]])
        return out

    def _expression(self) -> pc.Expression | None:
        out = None
        for name, op, v in self.where:
            c = ds.field(name)
            one = {"==": lambda: c == v, ">": lambda: c > v, ">=": lambda: c >= v, "<": lambda: c < v, "<=": lambda: c <= v,
                   "in": lambda: c.isin([x for x in v if x is not None]), "null": lambda: c.is_null(), "not null": lambda: c.is_valid()}[op]()
            out = one if out is None else out & one
        return out

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        store, at = _open(self.path)
        kinds = to_arrow_schema(T.StructType([T.StructField(n, t) for n, t in self.kinds.items()]))
        where, key = self._expression(), ds.field(self.key)
        columns = self.names + ([self.key] if self.range_column and self.key not in self.names else [])
        for name, lo, hi, whole in partition.files:
            mine = None if whole else key.is_null() if lo is None else (key >= lo) & (key <= hi)
            wanted = mine if where is None else where if mine is None else where & mine
            rows = ds.dataset([f"{at}/{name}"], format="parquet", filesystem=store, schema=kinds)
            for b in rows.to_batches(columns=columns, filter=wanted, batch_size=GROUP_ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False):
                if self.range_column:
                    b = b.select(self.names).append_column(self.range_column, _range_starts(b.column(self.key), self.width))
                if b.num_rows:
                    yield b


class _File:
    """A file being written: rows in row groups, and parts (start, smallest and largest key, rows), whose number is bounded."""

    def __init__(self, name: str, at: str, kinds: pa.Schema, store: fs.FileSystem):
        self.name, self.kinds, self.rows, self.last = name, kinds, 0, None
        self.parts: list[list] = []
        self.ranges, self.span = 0, 1  # ranges of the last part and at most of each
        self.held: list[pa.RecordBatch] = []
        self.out = pq.ParquetWriter(f"{at}/{name}", kinds, filesystem=store)

    def part(self, start: int | None, lo: int | None, hi: int | None, rows: int) -> None:
        """The next rows, of one range. Once there are too many parts, each is of twice as many ranges."""
        more = bool(self.parts) and self.last != start
        if more and self.ranges < self.span and self.parts[-1][0] is not None:
            self.ranges, more = self.ranges + 1, False
        if self.parts and not more:
            p = self.parts[-1]
            self.parts[-1] = [p[0], None if start is None else min(p[1], lo), None if start is None else max(p[2], hi), p[3] + rows]
        else:
            if len(self.parts) >= 2 * PARTS:
                self.parts, self.span = _fewer(self.parts), 2 * self.span
            self.parts.append([start, lo, hi, rows])
            self.ranges = 1
        self.last = start
        self.rows += rows

    def take(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        if sum(b.num_rows for b in self.held) >= GROUP_ROWS:
            self._group()

    def _group(self) -> None:
        self.out.write_table(pa.Table.from_batches(self.held).cast(self.kinds))
        self.held = []

    def close(self) -> dict:
        if self.held:
            self._group()
        self.out.close()
        return {"name": self.name, "rows": self.rows, "parts": self.parts}


class Written(D.WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class RangeWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, options):
        self.path, self.overwrite = path, overwrite
        self.key, self.width = options.get("key", "id"), int(options.get("width", WIDTH))
        self.schema = schema.json()
        if self.key not in schema.names or not isinstance(schema[self.key].dataType, T.IntegralType):
            raise ValueError(f"no whole-number column {self.key}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come in the order of the key (``write_ranges``); a range that comes after a higher one begins a new file."""
        store, at = _open(self.path)
        store.create_dir(at)
        task, out, files = uuid.uuid4().hex, None, []
        kinds = to_arrow_schema(T.StructType.fromJson(json.loads(self.schema)))
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                key = b.column(self.key).cast(pa.int64())
                start = _range_starts(key, self.width)
                null, value, keys = start.is_null().to_numpy(zero_copy_only=False), start.fill_null(0).to_numpy(), key.fill_null(0).to_numpy()
                first = np.r_[0, np.flatnonzero((null[1:] != null[:-1]) | (value[1:] != value[:-1])) + 1]
                low, high, ends = np.minimum.reduceat(keys, first), np.maximum.reduceat(keys, first), np.r_[first[1:], b.num_rows]
                done = 0
                for i, j, lo, hi in zip(first.tolist(), ends.tolist(), low.tolist(), high.tolist()):
                    s = None if null[i] else int(value[i])
                    if out is None or out.rows >= FILE_ROWS or _place(s) < _place(out.last):
                        if out is not None:
                            out.take(b.slice(done, i - done))
                            files.append(out.close())
                        out, done = _File(f"{self.key}={'null' if s is None else s}-{task}-{len(files)}.parquet", at, kinds, store), i
                    out.part(s, None if s is None else lo, None if s is None else hi, j - i)
                out.take(b.slice(done))
            if out is not None:
                files.append(out.close())
        finally:
            if out is not None:
                out.out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Runs once, on the driver; the manifest has a line for each file."""
        store, at = _open(self.path)
        store.create_dir(at)
        old = []
        if not self.overwrite and store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File:
            found = _manifest(self.path)
            if (found["key"], found["width"]) != (self.key, self.width) or found["schema"] != self.schema:
                raise ValueError("rows are appended with the key, width and columns of the table")
            old = found["files"]
        new = [f for m in messages if m for f in m.files]
        text = json.dumps({"key": self.key, "width": self.width, "schema": self.schema, "files": old + new})
        name = f"{at}/_{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(name) as f:
            f.write(text.encode())
        store.move(name, f"{at}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _open(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{at}/{f['name']}")


class RangedFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        stored = T.StructType.fromJson(json.loads(_manifest(self.options["path"])["schema"]))
        wanted = [c.strip() for c in (self.options.get("columns") or "").split(",") if c.strip()]
        fields = [stored[c] for c in wanted] if wanted else list(stored.fields)
        if extra := self.options.get("range_column"):
            if extra in stored.names:
                raise ValueError(f"the table has a column {extra}")
            fields.append(T.StructField(extra, T.LongType()))
        return T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(self.options["path"], schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> RangeWriter:
        return RangeWriter(self.options["path"], schema, overwrite, self.options)


def _ready(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.dataSource.register(RangedFiles)
    return spark


def write_ranges(rows: DataFrame, path: str, key: str = "id", width: int = WIDTH, mode: str = "overwrite") -> None:
    _ready(rows.sparkSession)
    if key in rows.columns:
        rows = rows.sortWithinPartitions(F.col(f"`{key}`"))
    rows.write.format(FORMAT).mode(mode).option("key", key).option("width", width).save(path)


def read_ranges(spark: SparkSession, path: str, where: Sequence[tuple] = (), columns: Sequence[str] = (), range_column: str | None = None,
                rows_per_partition: int = ROWS) -> DataFrame:
    """Rows that meet all conditions (column, operator, value) of OPERATORS, on stored whole-number and text columns."""
    given = {"where": json.dumps([list(x) + [None] * (3 - len(x)) for x in where]), "columns": ",".join(columns), "range_column": range_column,
             "rows_per_partition": rows_per_partition}
    return _ready(spark).read.format(FORMAT).options(**{k: v for k, v in given.items() if v is not None}).load(path)

