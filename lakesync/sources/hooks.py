"""Sources and writers of one's own, on Spark's Python data sources.

A ``StreamHook`` reads a stream that no built-in reader reads.  It tells its schema, cuts a read into slices (Spark's
partitions, one task each) and yields the rows of a slice; bounds that it can take care of are handed to it before the slices
are made, so that it can leave out slices.  They are given with the read, not found in the query: what Spark 4.1 pushes into a
Python source stays with the relation, and another query over the same relation would get the slices of the first.  A ``WriteHook`` hands rows over in two steps: tasks stage what they get and
return a receipt, then the driver publishes all receipts at once, or discards them.  Receipts of attempts that failed, or ran
twice, never reach the driver, so a repeated task cannot hand a row over twice.
"""

from __future__ import annotations

import io
import json
import operator
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, datasource as ds, functions as F, types as T

_TESTS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda value, some: value in some}


@dataclass(frozen=True)
class Bound:
    """A condition on one column: ``column operator value``, one of ``= > >= < <= in`` (which has several values)."""

    column: str
    operator: str
    value: object

    def holds(self, value: object) -> bool:
        """Whether a value fulfils the condition; null fulfils none."""
        return value is not None and self.value is not None and _TESTS[self.operator](value, self.value)

    def condition(self) -> Column:
        column = F.col(f"`{self.column}`")
        return column.isin(*self.value) if self.operator == "in" else _TESTS[self.operator](column, F.lit(self.value))


class StreamHook(ABC):
    """Reads one kind of stream."""

    @abstractmethod
    def schema(self, options: Mapping[str, str]) -> T.StructType: ...

    def takes(self, bound: Bound, options: Mapping[str, str]) -> bool:
        """Whether the hook sees to it that no row breaks ``bound``; other bounds are left to Spark."""
        return False

    @abstractmethod
    def slices(self, options: Mapping[str, str], bounds: Sequence[Bound]) -> Sequence[object]:
        """The parts of a read, each small enough for one task."""

    @abstractmethod
    def read(self, options: Mapping[str, str], part: object) -> Iterator[tuple | pa.RecordBatch]:
        """Rows of a slice; a task that is lost reads its slice again."""


class _HookReader(ds.DataSourceReader):
    def __init__(self, hook: StreamHook, options: dict[str, str], bounds: Sequence[Bound]):
        self.hook, self.options, self.bounds = hook, options, bounds

    def partitions(self) -> Sequence[ds.InputPartition]:
        return [ds.InputPartition(part) for part in self.hook.slices(self.options, self.bounds)]

    def read(self, partition: ds.InputPartition) -> Iterator[tuple | pa.RecordBatch]:
        return self.hook.read(self.options, partition.value)


def read_hook(spark: SparkSession, name: str, hook: StreamHook, bounds: Sequence[Bound] = (), **options: str) -> DataFrame:
    """The rows of a stream within all ``bounds``, through its hook."""
    taken = [bound for bound in bounds if hook.takes(bound, options)]

    class HookSource(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return hook.schema(dict(self.options))

        def reader(self, schema: T.StructType) -> _HookReader:
            return _HookReader(hook, dict(self.options), taken)

    spark.dataSource.register(HookSource)
    rows = spark.read.format(name).options(**options).load()
    for bound in bounds:
        rows = rows if bound in taken else rows.where(bound.condition())
    return rows


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


@dataclass(frozen=True)
class LandedBodies(StreamHook):
    """Landed bodies: text files, one body a line, in folders named ``column=value``.

    A slice is a range of bytes of one file, so files of any size are read by several tasks; a line belongs to the range it
    begins in.  Bounds on the folders' columns (of type BIGINT) leave out files before they are opened.  ``slices`` is the
    number of slices of the whole read.
    """

    folders: tuple[str, ...] = ()
    slice_bytes: int = 32 << 20
    batch_rows: int = 1000

    def schema(self, options: Mapping[str, str]) -> T.StructType:
        return T.StructType([T.StructField("body", T.StringType()), *(T.StructField(f, T.LongType()) for f in self.folders),
                             T.StructField("slices", T.LongType())])

    def takes(self, bound: Bound, options: Mapping[str, str]) -> bool:
        return bound.column in self.folders

    def slices(self, options: Mapping[str, str], bounds: Sequence[Bound]) -> list[tuple]:
        files, root = _filesystem(options["path"])
        found = []
        for info in files.get_file_info(pafs.FileSelector(root, recursive=True)):
            if info.type != pafs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            named = dict(part.split("=", 1) for part in info.path[len(root):].split("/") if "=" in part)
            values = tuple(int(named[f]) if named.get(f, "").lstrip("-").isdigit() else None for f in self.folders)
            if all(b.holds(values[self.folders.index(b.column)]) for b in bounds):
                found += [(info.path, begin, values) for begin in range(0, info.size, self.slice_bytes)]
        return [(*part, len(found)) for part in found]

    def read(self, options: Mapping[str, str], part: tuple) -> Iterator[pa.RecordBatch]:
        path, begin, values, slices = part
        files, _ = _filesystem(options["path"])
        names = [f.name for f in self.schema(options).fields]
        with files.open_input_file(path) as raw:
            # The line that runs into this range belongs to the one before.
            raw.seek(max(begin - 1, 0))
            lines = io.BufferedReader(raw, 1 << 20)
            at = max(begin - 1, 0)
            if begin:
                at += len(lines.readline())
            held: list[str] = []
            while at < begin + self.slice_bytes:
                line = lines.readline()
                if not line:
                    break
                at += len(line)
                if line.strip():
                    held.append(line.rstrip(b"\r\n").decode())
                if len(held) >= self.batch_rows:
                    yield self._batch(held, values, slices, names)
                    held = []
            if held:
                yield self._batch(held, values, slices, names)

    @staticmethod
    def _batch(bodies: list[str], values: tuple, slices: int, names: list[str]) -> pa.RecordBatch:
        columns = [pa.array(bodies, pa.string()), *(pa.array([v] * len(bodies), pa.int64()) for v in (*values, slices))]
        return pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Receipt(ds.WriterCommitMessage):
    """What a task staged."""

    attempt: str
    rows: int
    details: Mapping[str, object] = field(default_factory=dict)


class WriteHook(ABC):
    """Hands rows over to a destination."""

    @abstractmethod
    def stage(self, options: Mapping[str, str], attempt: str, batches: Iterator[pa.RecordBatch]) -> Receipt:
        """In a task: put the rows where the destination does not act on them yet, under a name of the attempt's own."""

    @abstractmethod
    def publish(self, options: Mapping[str, str], receipts: Sequence[Receipt]) -> None:
        """On the driver, once: let the destination act on exactly these receipts.  Must be safe to repeat."""

    @abstractmethod
    def discard(self, options: Mapping[str, str], receipts: Sequence[Receipt]) -> None:
        """On the driver, after a failure: nothing of the run may stay."""


class _HookWriter(ds.DataSourceArrowWriter):
    def __init__(self, hook: WriteHook, options: dict[str, str]):
        self.hook, self.options = hook, options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Receipt:
        return self.hook.stage(self.options, uuid.uuid4().hex, iterator)

    def commit(self, messages: list[Receipt | None]) -> None:
        self.hook.publish(self.options, [m for m in messages if m is not None])

    def abort(self, messages: list[Receipt | None]) -> None:
        self.hook.discard(self.options, [m for m in messages if m is not None])


def write_hook(df: DataFrame, name: str, hook: WriteHook, **options: str) -> None:
    """Hand all rows of ``df`` over through the hook; all or none."""
    class HookSink(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: T.StructType, overwrite: bool) -> _HookWriter:
            return _HookWriter(hook, dict(self.options))

    df.sparkSession.dataSource.register(HookSink)
    df.write.format(name).options(**options).mode("append").save()


PAYLOADS = "payload string"


@dataclass(frozen=True)
class PayloadFiles(WriteHook):
    """Payloads (one text column ``payload``) as files of lines that a sender picks up.

    Options: ``path``, and ``run``, the run that hands over.  Files are staged below ``staged/<run>``; publishing adds one list
    of them, ``published/<run>.json``, and a sender takes only listed files.  A run is published once: a second one of the same
    name is refused before anything is staged by it is listed.
    """

    refuse: str | None = None

    def stage(self, options: Mapping[str, str], attempt: str, batches: Iterator[pa.RecordBatch]) -> Receipt:
        files, root = _filesystem(options["path"])
        files.create_dir(f"{root}/staged/{options['run']}", recursive=True)
        path, rows, size = f"{root}/staged/{options['run']}/{attempt}.txt", 0, 0
        with files.open_output_stream(path) as out:
            for batch in batches:
                payloads = batch.column(batch.schema.names.index("payload")).to_pylist()
                if any(p is None or "\n" in p or p == self.refuse for p in payloads):
                    raise ValueError("the destination refused a payload")
                size += out.write("".join(p + "\n" for p in payloads).encode())
                rows += len(payloads)
        return Receipt(attempt, rows, {"path": path, "bytes": size})

    def publish(self, options: Mapping[str, str], receipts: Sequence[Receipt]) -> None:
        files, root = _filesystem(options["path"])
        files.create_dir(f"{root}/published", recursive=True)
        target = f"{root}/published/{options['run']}.json"
        if files.get_file_info(target).type != pafs.FileType.NotFound:
            self.discard(options, receipts, keep=[entry["path"] for entry in self.listed(options["path"], options["run"])])
            raise ValueError(f"run {options['run']!r} was published before")
        listed = [{"path": r.details["path"], "rows": r.rows} for r in receipts if r.rows]
        staged = f"{root}/published/.{options['run']}.{uuid.uuid4().hex}"
        with files.open_output_stream(staged) as out:
            out.write(json.dumps(listed).encode())
        files.move(staged, target)  # readers see the whole list or none
        self._sweep(files, root, options["run"], [entry["path"] for entry in listed])

    def discard(self, options: Mapping[str, str], receipts: Sequence[Receipt], keep: Sequence[str] = ()) -> None:
        files, root = _filesystem(options["path"])
        keep = keep or [entry["path"] for entry in self.listed(options["path"], options["run"])]
        self._sweep(files, root, options["run"], keep)

    @staticmethod
    def _sweep(files: pafs.FileSystem, root: str, run: str, keep: Sequence[str]) -> None:
        """Remove what attempts of the run left that are not listed."""
        folder = f"{root}/staged/{run}"
        for info in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if info.path not in set(keep):
                files.delete_file(info.path)

    @staticmethod
    def listed(path: str, run: str) -> list[dict]:
        """The files of a published run; none if it was not published."""
        files, root = _filesystem(path)
        target = f"{root}/published/{run}.json"
        if files.get_file_info(target).type == pafs.FileType.NotFound:
            return []
        with files.open_input_stream(target) as source:
            return json.loads(source.read())


def read_payloads(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The payloads that a run handed over; none if it was not published."""
    paths = [entry["path"] for entry in PayloadFiles.listed(path, run)]
    if not paths:
        return spark.createDataFrame([], PAYLOADS)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return spark.read.text([scheme + p for p in paths]).withColumnRenamed("value", "payload")
