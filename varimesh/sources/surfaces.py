"""Surface meshes and their labels as rows: vertices, faces, neighbours, areas and annotations, and overlays as files."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of a triangle surface, and the data types of the XML format by name (fixed values of the formats).
TRIANGLES = b"\xff\xff\xfe"
XML_KINDS = {"NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_UINT8": "u1"}
#: Vertices of an icosahedral mesh of each order: 10 * 4^order + 2.
ICO = {k: 10 * 4**k + 2 for k in range(8)}


def parse_xml(content: bytes) -> list[tuple[str, np.ndarray]]:
    """The arrays of a GIfTI file with their intents, in order."""
    out = []
    for array in ElementTree.fromstring(content).iter("DataArray"):
        a = array.attrib
        shape = [int(a[f"Dim{k}"]) for k in range(int(a["Dimensionality"]))]
        kind, text = XML_KINDS[a["DataType"]], array.find("Data").text or ""
        if a["Encoding"] == "ASCII":
            values = np.array(text.split(), kind)
        else:
            raw = base64.b64decode(text)
            raw = zlib.decompress(raw) if a["Encoding"].startswith("GZip") else raw
            values = np.frombuffer(raw, ("<" if a.get("Endian", "LittleEndian") == "LittleEndian" else ">") + kind)
        out.append((a["Intent"], values.reshape(shape, order="C" if a.get("ArrayIndexingOrder", "RowMajorOrder") == "RowMajorOrder" else "F")))
    return out


def parse_mesh(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and faces of a triangle surface file, or of a GIfTI file."""
    if content[:3] == TRIANGLES:
        at = content.index(b"\n\n", 3) + 2
        n, m = struct.unpack(">2i", content[at : at + 8])
        points = np.frombuffer(content, ">f4", 3 * n, at + 8).reshape(n, 3).astype(float)
        return points, np.frombuffer(content, ">i4", 3 * m, at + 8 + 12 * n).reshape(m, 3).astype(np.int64)
    if content.lstrip()[:1] != b"<":
        raise ValueError("neither a triangle surface nor a GIfTI file")
    arrays = dict(parse_xml(content))
    return arrays["NIFTI_INTENT_POINTSET"].astype(float), arrays["NIFTI_INTENT_TRIANGLE"].astype(np.int64)


def parse_annotation(content: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, tuple]]:
    """Vertices, their codes, and ``(name, red, green, blue)`` of each code."""
    at = 0

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack(">i", content[at - 4 : at])[0]

    def text() -> str:
        nonlocal at
        n = number()
        at += n
        return content[at - n : at].split(b"\0")[0].decode("utf-8", "replace")

    n = number()
    pairs = np.frombuffer(content, ">i4", 2 * n, at).reshape(n, 2)
    at += 8 * n
    names: dict[int, tuple] = {}
    if at < len(content) and number() == 1:
        version = number()
        if version < 0:  # numbered entries
            number()
            text()
            entries = number()
        else:
            entries = version
            text()
        for _ in range(entries):
            if version < 0:
                number()
            name, (r, g, b, _alpha) = text(), (number(), number(), number(), number())
            names[r + (g << 8) + (b << 16)] = (name, r, g, b)
    return pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64), names


def _each_file(spark: SparkSession, path: str, of, kind: str) -> DataFrame:
    """Rows that ``of`` makes of every file's bytes, as batches of columns; a file is one mesh and one task's work."""
    names = ["path", *(c.split()[0] for c in kind.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                columns = of(content)
                for at in range(0, len(columns[0]), 1 << 16):
                    part = [pa.array(c[at : at + (1 << 16)]) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part[0])), *part], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {kind}")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pos, x, y, z)`` of every mesh at ``path``."""

    def of(content: bytes) -> list:
        points = parse_mesh(content)[0]
        return [np.arange(len(points)), *points.T]

    return _each_file(spark, path, of, "pos long, x double, y double, z double")


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """``(path, face, a, b, c)``: the corners of every triangle."""

    def of(content: bytes) -> list:
        faces = parse_mesh(content)[1]
        return [np.arange(len(faces)), *faces.T]

    return _each_file(spark, path, of, "face long, a long, b long, c long")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pos, code, name)`` of every annotated vertex; ``name`` is null for a code that the file does not name."""

    def of(content: bytes) -> list:
        pos, code, names = parse_annotation(content)
        return [pos, code, [names[c][0] if c in names else None for c in code.tolist()]]

    return _each_file(spark, path, of, "pos long, code long, name string")


def mesh_edges(faces: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: neighbouring vertices, each pair once."""
    pairs = F.array(*[F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")) for u, v in (("a", "b"), ("b", "c"), ("a", "c"))])
    return faces.select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def vertex_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(pos, area)``: a third of the area of every triangle that a vertex is a corner of."""
    df = faces.select("a", "b", "c")
    for corner in "abc":
        df = df.join(vertices.select(F.col("pos").alias(corner), *[F.col(k).alias(f"{corner}{k}") for k in "xyz"]), corner)
    u, v = ([F.col(f"{p}{k}") - F.col(f"a{k}") for k in "xyz"] for p in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    third = F.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2) / 6
    return df.select(F.explode(F.array("a", "b", "c")).alias("pos"), third.alias("area")).groupBy("pos").agg(F.sum("area").alias("area"))


def overlay_xml(values: np.ndarray, name: str) -> bytes:
    """A GIfTI file of one value for each vertex."""
    body = base64.b64encode(zlib.compress(np.ascontiguousarray(values, "<f4").tobytes())).decode()
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE GIFTI SYSTEM "http://www.nitrc.org/frs/download.php/115/gifti.dtd">\n<GIFTI Version="1.0" NumberOfDataArrays="1">\n'
        f'<DataArray Intent="NIFTI_INTENT_NONE" DataType="NIFTI_TYPE_FLOAT32" ArrayIndexingOrder="RowMajorOrder" Dimensionality="1" Dim0="{len(values)}" '
        'Encoding="GZipBase64Binary" Endian="LittleEndian" ExternalFileName="" ExternalFileOffset="0">\n'
        f"<MetaData><MD><Name>Name</Name><Value><![CDATA[{name.replace("]]>", "]] >")}]]></Value></MD></MetaData>\n<Data>{body}</Data>\n</DataArray>\n</GIFTI>\n"
    ).encode()


def write_overlays(maps: DataFrame, folder: str, vertices: int, fill: float = 0.0) -> DataFrame:
    """Write maps ``(map_id, pos, value)`` as GIfTI overlays of so many vertices, one file each, and give ``(map_id, path, n)``.

    A map is as long as its mesh, and one task's work. Vertices without a value, or with a null one, have ``fill``; values past the mesh raise. A file is written under a name of its own and then renamed, so that an attempt
    that is lost or repeated leaves no half file.
    """
    from .genotypes import qualified
    from .volumes import put

    spark = maps.sparkSession
    base = qualified(spark, folder)

    def run(key, table):
        name, pos = key[0].as_py(), table.column("pos").to_numpy()
        if len(pos) and (pos.min() < 0 or pos.max() >= vertices):
            raise ValueError(f"map {name} has values past {vertices} vertices")
        whole = np.full(vertices, fill)
        whole[pos] = np.where(np.isnan(x := table.column("value").fill_null(np.nan).to_numpy()), fill, x)
        path = put(base, f"{name}.func.gii", lambda f: f.write(overlay_xml(whole, str(name))))
        return pa.table({"map_id": [str(name)], "path": [path], "n": pa.array([len(pos)], pa.int64())})

    return maps.select(F.col("map_id").cast("string"), F.col("pos").cast("long"), F.col("value").cast("double")).groupBy("map_id").applyInArrow(run, "map_id string, path string, n long")
