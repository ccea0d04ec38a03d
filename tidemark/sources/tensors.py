"""Vectors and features in tensor files, safetensors and NPZ, as rows.

Files come through Spark's binary reader, so they may lie in any store that Spark
reads. A task takes whole files, as many as fit in ``spark.sql.files.maxPartitionBytes``
or one larger one (up to 2 GB); it decodes only the tensors asked for and hands their
rows on in slices.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of element types in safetensors, fixed by the format. BF16 is the upper half of a 32-bit float.
DTYPES = {
    "F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "|i1",
    "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "|u1", "BOOL": "|b1",
}
ROWS = 4096

Wanted = Callable[[str], bool]


def from_safetensors(content: bytes, wanted: Wanted) -> Iterator[tuple[str, np.ndarray]]:
    """Name and values of the tensors that are wanted, in the file's order; a file cut short raises."""
    if len(content) < 8:
        raise ValueError("not a safetensors file")
    size = struct.unpack("<Q", content[:8])[0]
    header = json.loads(content[8 : 8 + size])
    for name, spec in header.items():
        if name == "__metadata__" or not wanted(name):
            continue
        first, end = spec["data_offsets"]
        data = memoryview(content)[8 + size + first : 8 + size + end]
        if len(data) != end - first:
            raise ValueError(f"tensor {name} is cut short")
        values = np.frombuffer(data, DTYPES[spec["dtype"]])
        if spec["dtype"] == "BF16":
            values = (values.astype(np.uint32) << 16).view(np.float32)
        yield name, values.reshape(spec["shape"])


def from_npz(content: bytes, wanted: Wanted) -> Iterator[tuple[str, np.ndarray]]:
    """Name and values of the arrays that are wanted; members of pickled objects raise."""
    with zipfile.ZipFile(io.BytesIO(content)) as members:
        for member in members.namelist():
            name = member.removesuffix(".npy")
            if wanted(name):
                with members.open(member) as f:
                    yield name, np.lib.format.read_array(f, allow_pickle=False)


def to_safetensors(named: list[tuple[str, np.ndarray]]) -> bytes:
    """A file of tensors; repeated names raise."""
    codes = {np.dtype(v): k for k, v in DTYPES.items() if k != "BF16"}
    header: dict[str, dict] = {}
    data: list[bytes] = []
    at = 0
    for name, values in named:
        if name in header:
            raise ValueError(f"two tensors are named {name}")
        values = np.ascontiguousarray(values)
        data.append(values.tobytes())
        header[name] = {"dtype": codes[values.dtype.newbyteorder("<")], "shape": list(values.shape), "data_offsets": [at, at + len(data[-1])]}
        at += len(data[-1])
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(data)


def _sliced(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, content of all files below a folder whose name fits."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def vectors(blobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """path, key, vec (array<double>): a row for each one-dimensional tensor of safetensors files (path, content).

    With ``keys``, other tensors are not decoded. A tensor of more dimensions is laid
    out flat. A null content has no rows.
    """
    asked = None if keys is None else frozenset(keys)
    wanted: Wanted = lambda name: asked is None or name in asked
    schema = pa.schema([("path", pa.string()), ("key", pa.string()), ("vec", pa.list_(pa.float64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1), strict=True):
                    if content.is_valid:
                        for name, values in from_safetensors(content.as_py(), wanted):
                            yield path.as_py(), name, values.ravel().astype(np.float64)

        yield from _sliced(rows(), schema)

    return blobs.select("path", "content").mapInArrow(read, "path string, key string, vec array<double>")


def read_vectors(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """``vectors`` of the safetensors files below a folder."""
    return vectors(files(spark, path, "*.safetensors"), keys)


def vector_blobs(rows: DataFrame, key: str, vec: str, most: int = 100_000) -> DataFrame:
    """path, content: safetensors files of float32 vectors, each of at most ``most`` rows of a task; rows with a null key or vector are left out.

    A key that repeats goes to the next file, so none is lost.
    """
    slim = rows.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("string"), F.col(vec).cast("array<float>"), F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        n = 0

        def blob(task: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [f"part-{task:05d}-{n:05d}.safetensors"], "content": [to_safetensors(list(held.items()))]})

        task = 0
        for batch in batches:
            values = batch.column(1)
            for i in range(len(batch)):
                name, task = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if name in held or len(held) == most:
                    yield blob(task)
                    held, n = {}, n + 1
                held[name] = np.asarray(values[i].values.to_numpy(zero_copy_only=False), np.float32)
        if held:
            yield blob(task)

    return slim.mapInArrow(pack, "path string, content binary")


#: Where a clip's features lie below their root, fixed by the contract: condition/story/gtNNN_variant.npz.
CLIP = r"([^/]+)/([^/]+)/gt(\d+)_([^/]+)\.npz$"
CLIP_KEY = ("cond", "story", "gt", "variant")


def _clips(blobs: DataFrame, wanted: Wanted, rows_of: Callable, columns: str, schema: pa.Schema) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1), strict=True):
                    if content.is_valid:
                        arrays = dict(from_npz(content.as_py(), lambda name: name == "error" or wanted(name)))
                        if "error" not in arrays:
                            for row in rows_of(arrays):
                                yield path.as_py(), *row

        yield from _sliced(rows(), schema)

    found = blobs.select("path", "content").mapInArrow(read, columns)
    part = lambda i: F.regexp_extract("path", CLIP, i)
    return found.select(part(1).alias("cond"), part(2).alias("story"), part(3).cast("int").alias("gt"), part(4).alias("variant"), *[c for c in found.columns if c != "path"])


def frame_features(blobs: DataFrame) -> DataFrame:
    """cond, story, gt, variant, frame, frame_vec, place_vec of each frame of the clips (path, content); clips that hold an error have no rows."""
    names = ("frame_dino", "frame_megaloc")

    def rows(arrays):
        for i in range(max((len(arrays[n]) for n in names if n in arrays), default=0)):
            yield i, *(arrays[n][i].astype(np.float64) if n in arrays and i < len(arrays[n]) else None for n in names)

    vec = pa.list_(pa.float64())
    schema = pa.schema([("path", pa.string()), ("frame", pa.int32()), ("frame_vec", vec), ("place_vec", vec)])
    return _clips(blobs, lambda name: name in names, rows, "path string, frame int, frame_vec array<double>, place_vec array<double>", schema)


def entity_features(blobs: DataFrame) -> DataFrame:
    """cond, story, gt, variant, eid, frame, score, box, crop, face of each entity and frame of the clips; a face is null where none was found."""

    def rows(arrays):
        for name, scores in arrays.items():
            kind, _, eid = name.partition("__")
            if kind != "score":
                continue
            of = {k: arrays.get(f"{k}__{eid}") for k in ("box", "crop", "face", "faceok")}
            at = lambda k, i: None if of[k] is None else of[k][i].astype(np.float64)
            for i, score in enumerate(scores):
                seen = of["faceok"] is not None and bool(of["faceok"][i])
                yield eid, i, float(score), at("box", i), at("crop", i), at("face", i) if seen else None

    vec = pa.list_(pa.float64())
    schema = pa.schema([("path", pa.string()), ("eid", pa.string()), ("frame", pa.int32()), ("score", pa.float64()), ("box", vec), ("crop", vec), ("face", vec)])
    columns = "path string, eid string, frame int, score double, box array<double>, crop array<double>, face array<double>"
    return _clips(blobs, lambda name: "__" in name, rows, columns, schema)



def clip_blobs(clips: DataFrame) -> DataFrame:
    """path, content: an NPZ file of float32 arrays for each clip (path, arrays map<string, array<array<float>>>)."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, arrays in zip(batch.column(0), batch.column(1), strict=True):
                    out = io.BytesIO()
                    np.savez(out, **{name: np.asarray(values, np.float32) for name, values in arrays.as_py() or []})
                    yield path.as_py(), out.getvalue()

        yield from _sliced(rows(), schema)

    return clips.select("path", "arrays").mapInArrow(pack, "path string, content binary")
