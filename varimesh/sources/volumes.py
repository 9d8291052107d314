"""Image volumes as rows of places and values."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: NIfTI-1 data types by code (fixed values of the format).
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def parse_nifti(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The values of a NIfTI-1 file, scaled, and its 4 x 4 affine."""
    import gzip

    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    shape = struct.unpack(f"{order}8h", raw[40:56])
    kind = struct.unpack(f"{order}h", raw[70:72])[0]
    offset, slope, inter = struct.unpack(f"{order}3f", raw[108:120])
    size = tuple(n for n in shape[1 : shape[0] + 1])
    values = np.frombuffer(raw, f"{order}{KINDS[kind]}", int(np.prod(size)), int(offset)).reshape(size, order="F").astype(float)
    affine = np.vstack((np.array(struct.unpack(f"{order}12f", raw[280:328])).reshape(3, 4), [0, 0, 0, 1]))
    return values * slope + inter if slope else values, affine


def read_nifti(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pos, value)`` of every volume at ``path``: ``pos`` counts in the file's own order. Each file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = parse_nifti(content)[0].ravel(order="F")
                for at in range(0, len(v), 1 << 16):
                    part = v[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["path", "pos", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos long, value double")


def put(folder: str, name: str, write: Callable) -> str:
    """Write a file into a store: ``write`` gets a stream of a name of its own, which becomes ``name`` when all is written. Characters that paths give a meaning are replaced."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    mine, final = f"{at}/.{uuid.uuid4().hex}", f"{at}/{re.sub(r'[^A-Za-z0-9._=+-]', '_', name)}"
    with store.open_output_stream(mine, compression=None) as f:
        write(f)
    store.move(mine, final)
    return final


def nifti_header(shape: tuple[int, int, int], affine: np.ndarray, name: str = "") -> bytes:
    """The 352 bytes before the values of a NIfTI-1 file of 4-byte floats."""
    raw = bytearray(352)
    struct.pack_into("<i", raw, 0, 348)
    struct.pack_into("<8h", raw, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", raw, 70, 16, 32)
    struct.pack_into("<8f", raw, 76, 1.0, *np.sqrt((affine[:3, :3] ** 2).sum(0)), 0, 0, 0, 0)
    struct.pack_into("<3f", raw, 108, 352.0, 1.0, 0.0)
    raw[123] = 2  # millimetres
    raw[148 : 148 + min(79, len(name.encode()))] = name.encode()[:79]
    struct.pack_into("<2h", raw, 252, 0, 2)
    struct.pack_into("<12f", raw, 280, *np.asarray(affine, float)[:3].ravel())
    raw[344:348] = b"n+1\0"
    return bytes(raw)


def write_nifti(maps: DataFrame, folder: str, shape: tuple[int, int, int], affine: np.ndarray | None = None, mask: DataFrame | None = None, fill: float = 0.0) -> DataFrame:
    """Write maps ``(map_id, pos, value)`` as volumes, one file each, and give ``(map_id, path, n)``.

    ``pos`` counts in the file's order, or with ``mask`` (``pos, place``) among the places of a mask, whose ``place`` is then that in the volume. A task has its maps' values in order of place and writes them slab by slab, a
    slab in memory, with ``fill`` where there is none; of two values for a place the first by size stands. A place outside the volume raises.
    """
    from pyspark.sql import functions as F

    from .genotypes import qualified

    affine = np.eye(4) if affine is None else np.asarray(affine, float)
    size, slab, base = int(np.prod(shape)), int(shape[0] * shape[1]), qualified(maps.sparkSession, folder)
    rows = maps.select(F.col("map_id").cast("string"), F.col("pos").cast("long"), F.col("value").cast("double"))
    if mask is not None:
        rows = rows.join(mask.select(F.col("pos").cast("long"), F.col("place").cast("long")), "pos").select("map_id", F.col("place").alias("pos"), "value")
    rows = rows.where("value is not null").repartition("map_id").sortWithinPartitions("map_id", "pos", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
            for b in batches:
                d = b.column(0).dictionary_encode()
                at, pos, value = d.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
                for k in range(len(d.dictionary)):  # in order, so each is one run
                    lo, hi = np.searchsorted(at, (k, k + 1))
                    yield d.dictionary[k].as_py(), pos[lo:hi], value[lo:hi]

        for name, parts in groupby(pieces(), key=lambda p: p[0]):
            n = 0

            def write(f) -> None:
                nonlocal n
                f.write(nifti_header(shape, affine, name))  # noqa: B023
                at, now = 0, np.full(slab, fill, "<f4")
                for _, pos, value in parts:  # noqa: B023
                    if pos[0] < 0 or pos[-1] >= size:
                        raise ValueError(f"map {name} has places outside {shape}")  # noqa: B023
                    n += len(pos)
                    for k in range(int(pos[0] // slab), int(pos[-1] // slab) + 1):
                        while at < k:
                            f.write(now.tobytes())
                            at, now = at + 1, np.full(slab, fill, "<f4")
                        lo, hi = np.searchsorted(pos, (k * slab, (k + 1) * slab))
                        now[pos[lo:hi][::-1] - k * slab] = value[lo:hi][::-1]
                while at < shape[2]:
                    f.write(now.tobytes())
                    at, now = at + 1, np.full(slab, fill, "<f4")

            path = put(base, f"{name}.nii", write)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([n])], ["map_id", "path", "n"])

    return rows.mapInArrow(run, "map_id string, path string, n long")


def grid_edges(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """``(a, b)``: pairs of neighbouring places of a volume, corners included, each once."""
    from pyspark.sql import functions as F

    nx, ny, nz = shape
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (k, j, i) > (0, 0, 0)]
    x, y, z = F.col("id") % nx, F.floor(F.col("id") / nx) % ny, F.floor(F.col("id") / (nx * ny))
    rows = spark.range(nx * ny * nz).select(F.col("id").alias("a"), x.alias("x"), y.alias("y"), z.alias("z"))
    moved = [F.when((F.col("x") + i).between(0, nx - 1) & (F.col("y") + j).between(0, ny - 1) & (F.col("z") + k).between(0, nz - 1), F.col("a") + i + nx * (j + ny * k)) for i, j, k in steps]
    return rows.select("a", F.explode(F.array_compact(F.array(*moved))).alias("b"))
