"""Raw scanner files as Spark data sources: readings (`lattica_raw`), arrays (`lattica_array`), files (`lattica_file`).

`readings` reads the public raw-data layout in HDF5: a group with the table `data` of one compound row a
reading and the text `xml`. Driver work is one header a file; a partition is a range of readings, whose
task reads its branch of the chunk index and its readings alone. Conditions on columns of a reading's
header (and is_image, is_noise, is_calibration) go to the source, which decides on the headers before
it reads any sample. They are given to `readings`, not taken from filters of the table: Spark 4.1 keeps
pushed filters with a loaded Python source, so a second query of one table would meet the first one's.
`write_readings` writes such files.

`array` reads any numeric data set: a row is a line of its last axis, or the part of one in a chunk.

Writing has two phases: tasks write into a staging folder beside the target and report their files; when
all tasks are done, those files are moved into place. A failed task leaves nothing, a repeated one leaves
what it reported once. Folders are URIs that pyarrow's file systems open (local paths, hdfs, s3, gcs, abfs);
others raise an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lattica.sources import hdf5
from lattica.sources.acquisitions import FLAGS, IGNORED
from lattica.workers import reachable

#: Fixed values of the public raw-data layout: members of a reading's header in their order.
_IDX = ("kspace_encode_step_1", "kspace_encode_step_2", "average", "slice", "contrast", "phase", "repetition", "set", "segment")
HEAD = np.dtype([
    ("version", "<u2"), ("flags", "<u8"), ("measurement_uid", "<u4"), ("scan_counter", "<u4"), ("acquisition_time_stamp", "<u4"),
    ("physiology_time_stamp", "<u4", (3,)), ("number_of_samples", "<u2"), ("available_channels", "<u2"), ("active_channels", "<u2"),
    ("channel_mask", "<u8", (16,)), ("discard_pre", "<u2"), ("discard_post", "<u2"), ("center_sample", "<u2"), ("encoding_space_ref", "<u2"),
    ("trajectory_dimensions", "<u2"), ("sample_time_us", "<f4"), ("position", "<f4", (3,)), ("read_dir", "<f4", (3,)), ("phase_dir", "<f4", (3,)),
    ("slice_dir", "<f4", (3,)), ("patient_table_position", "<f4", (3,)), ("idx", [*((n, "<u2") for n in _IDX), ("user", "<u2", (8,))]),
    ("user_int", "<i4", (8,)), ("user_float", "<f4", (8,)),
])
READING = hdf5.compound([("head", hdf5.typed(HEAD)), ("traj", hdf5.vlen("<f4")), ("data", hdf5.vlen("<f4"))])

_COLUMN = {"kspace_encode_step_1": "k1", "kspace_encode_step_2": "k2"}
_WIDE = {"u2": pa.int32(), "u4": pa.int64(), "u8": pa.int64(), "i4": pa.int32(), "f4": pa.float64()}


def _head_fields() -> list[tuple[str, tuple[str, ...], np.dtype]]:
    """(column, way to it in HEAD, type) of all columns of a header."""
    out = []
    for name in HEAD.names:
        kind = HEAD.fields[name][0]
        if kind.names:
            out += [("user_idx" if n == "user" else _COLUMN.get(n, n), (name, n), kind.fields[n][0]) for n in kind.names]
        else:
            out.append((name, (name,), kind))
    return out


FIELDS = _head_fields()
_IMAGE = ("is_image", "is_noise", "is_calibration")


def _arrow(kind: np.dtype) -> pa.DataType:
    base = _WIDE[kind.base.str[1:]]
    return pa.list_(base) if kind.subdtype else base


SCHEMA = pa.schema(
    [("file", pa.string()), ("acq_id", pa.int64()), *((n, pa.bool_()) for n in _IMAGE), *((c, _arrow(k)) for c, _, k in FIELDS)]
    + [("traj", pa.list_(pa.float32())), ("re", pa.list_(pa.float32())), ("im", pa.list_(pa.float32()))]
)


def _take(head: np.ndarray, way: tuple[str, ...]) -> np.ndarray:
    for name in way:
        head = head[name]
    return head


def _listed(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(x.astype(kind.to_pandas_dtype()))
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1).astype(kind.value_type.to_pandas_dtype())))


def _joined(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.float32), pa.float32()))


def _files(uri: str, suffix: str = ".h5") -> list[str]:
    """The file, or all files below a folder that end so; hidden ones do not count."""
    from pyarrow import fs

    store, path = hdf5.filesystem(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [uri]
    root = uri.rstrip("/")
    found = (f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix))
    inner = (p[len(path.rstrip("/")) :].lstrip("/") for p in found)
    return sorted(f"{root}/{p}" for p in inner if not any(x.startswith(("_", ".")) for x in p.split("/")))


@dataclass
class Rows(InputPartition):
    file: str
    dataset: str
    start: int
    stop: int

    def __init__(self, file, dataset, start, stop):
        self.file, self.dataset, self.start, self.stop = file, dataset, start, stop


_COMPARE = {"=": np.equal, "!=": np.not_equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "in": np.isin}


class ReadingsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.group = options["path"], options.get("group")
        self.size, self.samples = int(options.get("readings", 4096)), options.get("samples", "true") == "true"
        self.image_mask = int(options.get("image_mask", IGNORED))
        #: (column, comparison, value): all must hold.
        self.keep = [tuple(k) for k in json.loads(options.get("keep", "[]"))]
        for name, compare, _ in self.keep:
            if compare not in _COMPARE or self.column(name, np.zeros(0, HEAD), np.zeros(0, np.int64)) is None:
                raise ValueError(f"no condition on readings: {name} {compare}")

    def column(self, name: str, head: np.ndarray, ids: np.ndarray) -> np.ndarray | None:
        if name == "acq_id":
            return ids
        if name in _IMAGE:
            flags = head["flags"]
            mask = {"is_image": self.image_mask, "is_noise": FLAGS["noise"], "is_calibration": FLAGS["parallel_calibration"] | FLAGS["parallel_calibration_and_imaging"]}[name]
            hit = (flags & np.uint64(mask)) != 0
            return ~hit if name == "is_image" else hit
        way = next((w for c, w, k in FIELDS if c == name and not k.subdtype), None)
        return None if way is None else _take(head, way)

    def _table(self, file: hdf5.File) -> str | None:
        """The last group that holds readings, or the one asked for."""
        groups = [g for g in file.links() if file.find(f"{g}/data") is not None] if self.group is None else [self.group]
        return f"{groups[-1]}/data" if groups and file.find(f"{groups[-1]}/data") is not None else None

    def partitions(self):
        from concurrent.futures import ThreadPoolExecutor

        def count(uri):
            with hdf5.File(uri) as file:
                name = self._table(file)
                return (uri, name, file.dataset(name).shape[0]) if name else (uri, name, 0)

        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(count, _files(self.path)))
        return [Rows(uri, name, a, min(n, a + self.size)) for uri, name, n in found for a in range(0, n, self.size)] or [Rows("", "", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        with hdf5.File(partition.file) as file:
            table = file.dataset(partition.dataset)
            kinds = {n: t for n, _, t in table.type.members}
            step = 256
            for a in range(partition.start, partition.stop, step):
                rows = table.rows(a, min(partition.stop, a + step))
                ids, head = np.arange(a, a + len(rows)), rows["head"]
                keep = np.ones(len(rows), bool)
                for name, compare, value in self.keep:
                    keep &= _COMPARE[compare](self.column(name, head, ids), value)
                rows, ids = rows[keep], ids[keep]
                if not len(rows):
                    continue
                head = rows["head"]
                traj, data = (file.values(kinds[n], rows[n]) for n in ("traj", "data")) if self.samples else ([np.zeros(0, np.float32)] * len(rows),) * 2
                columns = [pa.array([partition.file] * len(rows)), pa.array(ids), *(pa.array(self.column(n, head, ids)) for n in _IMAGE)]
                columns += [_listed(_take(head, w), _arrow(k)) for _, w, k in FIELDS]
                columns += [_joined(traj), _joined([d[0::2] for d in data]), _joined([d[1::2] for d in data])]
                yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


@dataclass
class Staged(WriterCommitMessage):
    files: list


class StagedWriter(DataSourceArrowWriter):
    """Files are put into a staging folder and moved when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.target, self.overwrite = options, options["path"].rstrip("/"), overwrite
        self.stage = f"{self.target}/_staging-{uuid.uuid4().hex}"
        hdf5.filesystem(self.target)

    def contents(self, batches):
        """(name, bytes) of the files of a task."""
        raise NotImplementedError

    def write(self, iterator):
        done, store = [], None
        for name, raw in self.contents(iterator):
            if name.startswith(("/", "_", ".")) or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no name of a file below the folder")
            own = f"{self.stage}/{uuid.uuid4().hex}"
            store, path = hdf5.filesystem(own)
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(raw)
            done.append((own, name))
        return Staged(done)

    def commit(self, messages):
        from pyarrow import fs

        done = [x for m in messages if m for x in m.files]
        names = [n for _, n in done]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows name the same file")
        store, root = hdf5.filesystem(self.target)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if not f.path.rstrip("/").endswith(self.stage.rsplit("/", 1)[1]):
                    (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path)
        for own, name in done:
            path = f"{root}/{name}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            store.move(hdf5.filesystem(own)[1], path)
        self.abort(messages)

    def abort(self, messages):
        store, path = hdf5.filesystem(self.stage)
        store.delete_dir_contents(path, missing_dir_ok=True)
        from pyarrow import fs

        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


class ReadingsWriter(StagedWriter):
    """A file for each data set and task, and a further one beyond so many readings."""

    def __init__(self, options, overwrite):
        super().__init__(options, overwrite)
        self.most, self.by, self.xml = int(options.get("readings", 20_000)), options.get("by"), options.get("xml", "")
        self.group = options.get("group", "dataset")

    def contents(self, batches):
        held: dict[str, list] = {}
        for batch in batches:
            names = batch.column(batch.schema.get_field_index(self.by)).cast(pa.string()).to_pylist() if self.by else ["all"] * batch.num_rows
            for name in dict.fromkeys(names):
                held.setdefault(name, []).append(batch.filter(pa.array([n == name for n in names])))
                if sum(b.num_rows for b in held[name]) >= self.most:
                    yield self.file(name, held.pop(name))
        for name, parts in held.items():
            yield self.file(name, parts)

    def file(self, name: str | None, parts: list[pa.RecordBatch]) -> tuple[str, bytes]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        out, has = np.zeros(rows.num_rows, READING.dtype), set(rows.column_names)
        for column, way, kind in FIELDS:
            if column in has:
                x = rows.column(column).combine_chunks()
                if kind.subdtype:
                    n = kind.shape[0]
                    value = np.array([(v or [])[:n] + [0] * (n - len(v or [])) for v in x.to_pylist()], kind.base)
                else:
                    value = x.fill_null(0).to_numpy(zero_copy_only=False)
                _take(out["head"], way)[...] = value
        build = hdf5.Builder()
        data = []
        for re, im in zip(rows.column("re").to_pylist(), rows.column("im").to_pylist()):
            both = np.empty(2 * len(re), "<f4")
            both[0::2], both[1::2] = re, im
            data.append(both.tobytes())
        traj = [np.asarray(t or [], "<f4").tobytes() for t in rows.column("traj").to_pylist()] if "traj" in has else [b""] * len(out)
        if "scan_counter" not in has:
            out["head"]["scan_counter"] = np.arange(len(out))
        out["data"], out["traj"] = build.references(data, 4), build.references(traj, 4)
        build.dataset(f"{self.group}/data", out, READING, chunk=(64,))
        texts = rows.column("xml").to_pylist() if "xml" in has else [self.xml]
        build.text(f"{self.group}/xml", next((t for t in texts if t), ""))
        return f"{name}/{uuid.uuid4().hex}.h5" if self.by else f"{uuid.uuid4().hex}.h5", build.bytes()


class RawSource(DataSource):
    @classmethod
    def name(cls):
        return "lattica_raw"

    def schema(self):
        return DDL

    def reader(self, schema):
        return ReadingsReader(self.options)

    def writer(self, schema, overwrite):
        return ReadingsWriter(self.options, overwrite)


class FileWriter(StagedWriter):
    def contents(self, batches):
        for batch in batches:
            at = [batch.schema.get_field_index(n) for n in ("name", "content")]
            yield from zip(*(batch.column(k).to_pylist() for k in at))


class FileSink(DataSource):
    """Rows (name, content) as files of a folder."""

    @classmethod
    def name(cls):
        return "lattica_file"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return FileWriter(self.options, overwrite)


LINES = pa.schema([("file", pa.string()), ("shape", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("start", pa.int64()), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dataset, self.bytes = options["path"], options["dataset"], int(options.get("partitionbytes", 8 << 20))

    def partitions(self):
        out = []
        for uri in _files(self.path):
            try:
                with hdf5.File(uri) as file:
                    own = file.dataset(self.dataset)
            except (KeyError, ValueError, OSError):
                continue  # a file without this data set holds none of its lines
            unit = own.chunk[0] if own.layout == "chunked" else 1
            step = max(1, self.bytes // max(1, own.row_bytes) // unit) * unit
            out += [Rows(uri, self.dataset, a, min(own.shape[0], a + step)) for a in range(0, own.shape[0], step)]
        return out or [Rows("", "", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        with hdf5.File(partition.file) as file:
            own = file.dataset(partition.dataset)
            for row in range(partition.start, partition.stop):
                if own.layout == "chunked":
                    parts = []
                    for chunk in own.chunks(row, row + 1):
                        cut = tuple(slice(0, max(0, min(c, s - o))) for c, s, o in zip(own.chunk[1:], own.shape[1:], chunk[0][1:]))
                        parts.append(((row, *chunk[0][1:]), own.decoded(chunk)[row - chunk[0][0]][cut]))
                else:
                    parts = [((row, *[0] * (len(own.shape) - 1)), own.rows(row, row + 1)[0])]
                for offsets, values in parts:
                    yield from self.lines(partition.file, own.shape, offsets, values)

    @staticmethod
    def lines(file, shape, offsets, values):
        re, im = (values["r"], values["i"]) if values.dtype.names else (values, None)
        if values.ndim == 0:
            offsets, values, re, im = (), np.atleast_1d(values), np.atleast_1d(re), None if im is None else np.atleast_1d(im)
        width, n = values.shape[-1], int(np.prod(values.shape[:-1], dtype=np.int64))
        if not n * width:
            return
        lead = np.indices(values.shape[:-1]).reshape(values.ndim - 1, n).T + np.array(offsets[1:-1], np.int64) if values.ndim > 1 else np.zeros((1, 0), np.int64)
        at = np.concatenate([np.full((n, 1), offsets[0]), lead], 1) if offsets and len(shape) > 1 else lead
        lists = lambda x, w, k: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(x).reshape(-1).astype(k)))
        start = offsets[-1] if len(shape) > 1 else (offsets[0] if offsets else 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([file] * n), pa.array([list(shape)] * n, pa.list_(pa.int64())), lists(at, at.shape[1], np.int64), pa.array([start] * n, pa.int64()), lists(re, width, np.float64), lists(np.zeros_like(re) if im is None else im, width, np.float64)],
            schema=LINES,
        )


class ArraySource(DataSource):
    @classmethod
    def name(cls):
        return "lattica_array"

    def schema(self):
        return "file string, shape array<bigint>, at array<bigint>, start bigint, re array<double>, im array<double>"

    def reader(self, schema):
        return ArrayReader(self.options)


def _ddl(field: pa.Field) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.float32(): "float", pa.bool_(): "boolean", pa.string(): "string"}
    return f"`{field.name}` " + (f"array<{names[field.type.value_type]}>" if pa.types.is_list(field.type) else names[field.type])


DDL = ", ".join(_ddl(f) for f in SCHEMA)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    import sys

    reachable(spark)
    for name in ("lattica.sources.hdf5", "lattica.sources.rawdata"):  # planning runs where the library may not be on the path
        cloudpickle.register_pickle_by_value(sys.modules[name])
    for source in (RawSource, ArraySource, FileSink):
        spark.dataSource.register(source)


def readings(spark: SparkSession, path: str, keep: list[tuple] = (("is_image", "=", True),), group: str | None = None, samples: bool = True, per_partition: int = 4096) -> DataFrame:
    """The readings of a file or of all files below a folder that meet all conditions (column, comparison,
    value): file, acq_id, the header's columns, traj, re, im (coil by coil). Without samples those three
    are empty."""
    register(spark)
    source = spark.read.format("lattica_raw").option("readings", per_partition).option("samples", str(samples).lower()).option("keep", json.dumps(list(keep)))
    return (source if group is None else source.option("group", group)).load(path)


def write_readings(df: DataFrame, path: str, by: str | None = None, xml: str = "", mode: str = "append") -> None:
    """Readings with re, im (coil by coil), and whatever header columns, traj and xml the table has; a folder
    for each value of `by`."""
    register(df.sparkSession)
    sink = df.write.format("lattica_raw").mode(mode).option("xml", xml)
    (sink if by is None else sink.option("by", by)).save(path)


def write_files(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (name, content) as files of a folder, all of them or none."""
    register(df.sparkSession)
    df.select("name", "content").write.format("lattica_file").mode(mode).save(path)


def array(spark: SparkSession, path: str, dataset: str, partition_bytes: int = 8 << 20) -> DataFrame:
    """The lines of a data set of a file, or of all files below a folder that have it: file, shape, at (the
    places on all axes but the last), start (the place of the first value on the last), re, im."""
    register(spark)
    return spark.read.format("lattica_array").option("dataset", dataset).option("partitionbytes", partition_bytes).load(path)


def headers_xml(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(file, xml): the header text of each file, from the group of readings or from a text data set by name."""
    register(spark)
    from pyspark.sql import functions as F

    files = spark.createDataFrame([(f,) for f in _files(path)], "file string")

    def run(batches):
        for batch in batches:
            texts = []
            for uri in batch.column(0).to_pylist():
                with hdf5.File(uri) as file:
                    groups = [g for g in file.links() if file.find(f"{g}/data") is not None] if name is None else []
                    texts.append(file.text(name or f"{groups[-1]}/xml"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["file", "xml"])

    return files.repartition(F.col("file")).mapInArrow(run, "file string, xml string")
