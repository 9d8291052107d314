"""Readers, sinks, streaming sums and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varimesh import __main__ as cli
from varimesh.operators import tables
from varimesh.sources import genotypes, sinks
from varimesh.sources import tables as src
from varimesh.streaming import sufficient


def write_plink(folder, g):
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    n = g.shape[1]
    body = bytearray(genotypes.MAGIC)
    for row in g:
        for at in range(0, n, 4):
            body.append(sum(code[int(v)] << (2 * k) for k, v in enumerate(row[at : at + 4])))
    (folder / "g.bed").write_bytes(bytes(body))
    (folder / "g.fam").write_text("".join(f"f{i} s{i} 0 0 1 -9\n" for i in range(n)))
    (folder / "g.bim").write_text("".join(f"1 rs{k} 0 {k * 10} A C\n" for k in range(len(g))))
    return str(folder / "g")


def test_plink(spark, tmp_path):
    g = np.random.default_rng(1).integers(-1, 3, (9, 7))
    stem = write_plink(tmp_path, g)
    got = {r["snp_id"]: r["dosages"] for r in genotypes.genotypes(spark, stem).collect()}
    assert all(got[f"rs{k}"] == [None if v < 0 else int(v) for v in g[k]] for k in range(9))
    part = {r["snp_id"]: r["dosages"] for r in genotypes.genotypes(spark, stem, ["s3", "s0"]).collect()}
    assert part["rs4"] == [None if v < 0 else int(v) for v in g[4][[3, 0]]]
    with pytest.raises(ValueError):
        genotypes.genotypes(spark, stem, ["nobody"])
    df = genotypes.genotypes(spark, stem)
    m = np.array([np.where(r >= 0, r, np.nan) for r in g.astype(float)])
    m = np.where(np.isnan(m), np.nanmean(m, axis=1, keepdims=True), m)
    std = {r["snp_id"]: r["dosages"] for r in genotypes.standardise(df, "empirical").collect()}
    assert std["rs1"] == pytest.approx((m[1] - m[1].mean()) / m[1].std(ddof=1))
    grm = {(r["i"], r["j"]): r["rel"] for r in genotypes.relatedness(df).collect()}
    p = m.mean(1, keepdims=True) / 2
    z = (m - 2 * p) / np.sqrt(2 * p * (1 - p))
    assert grm[1, 4] == pytest.approx((z[:, 1] * z[:, 4]).mean())


def test_discovery(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "one.csv").write_text("participant_id,session_id,x\np1,s1,1\np2,s1,2\n")
    (b / "one.tsv").write_text("participant_id\tsession_id\tx\np1\ts1\t9\n")
    (b / "still.tsv").write_text("participant_id\tz\np1\t5\n")
    df = src.load_variables(spark, [str(a), str(b)], ["x", "z"], rename={"z": "zed"})
    assert [(r["participant_id"], r["x"], r["zed"]) for r in df.collect()] == [("p1", 1, 5)]
    with pytest.raises(ValueError):
        src.load_variables(spark, [str(a)], ["nothing"])
    assert src.read_config("# c\na: 1\nb : x:y\n") == {"a": "1", "b": "x:y"} and src.vertices(5) == 10242
    c = spark.createDataFrame([("u1", 0.0, 1.0, None), ("m1", 0.0, None, 1.0), ("m1", 0.5, 1.0, -1.0)], "Type string, hypValue double, b double, a double")
    assert src.contrasts(c, ["a", "b"]) == [("u1", [[0.0, 1.0]], [0.0]), ("m1", [[1.0, 0.0], [-1.0, 1.0]], [0.0, 0.5])]


def test_grm_files(spark, tmp_path):
    np.array([0.1, 0.2, 0.3]).astype("<f8").tofile(tmp_path / "g.dat")
    assert sorted((r["iid_i"], r["iid_j"], round(r["rel"], 3)) for r in genotypes.read_grm_dat(spark, str(tmp_path / "g.dat"), ["a", "b", "c"]).collect()) == [("b", "a", 0.1), ("c", "a", 0.2), ("c", "b", 0.3)]
    np.array([1, 0.5, 1]).astype("<f4").tofile(tmp_path / "g.grm.bin")
    (tmp_path / "g.grm.id").write_text("f a\nf b\n")
    assert [tuple(r) for r in genotypes.read_grm_gcta(spark, str(tmp_path / "g")).collect()] == [("b", "a", 0.5)]


def test_sinks(spark):
    df = spark.createDataFrame([("y", "t", float("nan"), float("inf"), -1.0, None)], "y_id string, term string, beta double, se double, z double, logp double")
    assert sinks.by_key(df, "y_id", "term").first()["json"] == '[{"term":"t","beta":"NaN","se":"Inf","z":-1.0,"logp":null}]'
    assert sinks.strict_json({"a": [float("-inf"), 1]}) == '{"a": ["-Inf", 1]}'
    assert sinks.ordered_terms(df, ["t"]).count() == 1


def test_check_inputs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert tables.check_inputs(df, ["x"], ["y"]) == ["y"]
    with pytest.raises(ValueError):
        tables.check_inputs(df.withColumn("x", F.lit(float("inf"))), ["x"], ["y"])


def test_streaming_sums(spark, tmp_path):
    spark.range(100).select((F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("y")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double").parquet(str(tmp_path / "in"))
    got = sufficient.consume(spark, sufficient.product_sums(stream, ["x"], ["y"]), "sums", str(tmp_path / "cp")).first()
    assert got["n"] == 100 and got["x*y"] == pytest.approx(2 * sum(i * i for i in range(100)))


def test_command_line(spark, tmp_path, capsys):
    cli.main(["version"])
    assert capsys.readouterr().out.strip()
    cli.main(["basis", "--ends", "0", "1", "--knots", "0.5", "--out", str(tmp_path / "b")])
    assert spark.read.parquet(str(tmp_path / "b")).count() == 101
    df = spark.range(200).select((F.col("id") / 5).cast("long").alias("fid"), (F.col("id") / 2).cast("long").alias("iid"), F.col("id").alias("eid"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    df.write.parquet(str(tmp_path / "d.parquet"))
    (tmp_path / "job.toml").write_text('[params.dependent]\nname = ["y"]\n[params.fixed]\n[[params.fixed.vars]]\nname = "x"\n')
    cli.main(["fit", "--spec", str(tmp_path / "job.toml"), "--data", str(tmp_path / "d.parquet"), "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o" / "estimates")).count() == 2


def test_volumes(spark, tmp_path):
    import struct

    from varimesh.sources import volumes

    v = np.arange(24, dtype="<f4").reshape((2, 3, 4), order="F")
    head = bytearray(352)
    head[0:4] = struct.pack("<i", 348)
    head[40:56] = struct.pack("<8h", 3, 2, 3, 4, 1, 1, 1, 1)
    head[70:72] = struct.pack("<h", 16)
    head[108:120] = struct.pack("<3f", 352, 2.0, 1.0)
    (tmp_path / "v.nii").write_bytes(bytes(head) + v.tobytes(order="F"))
    got = [r["value"] for r in volumes.read_nifti(spark, str(tmp_path / "v.nii")).orderBy("pos").collect()]
    assert got == [2.0 * k + 1 for k in range(24)]
    edges = volumes.grid_edges(spark, (2, 3, 4))
    want = sum(1 for a in np.ndindex(2, 3, 4) for b in np.ndindex(2, 3, 4) if a < b and max(abs(i - j) for i, j in zip(a, b, strict=True)) == 1)
    assert edges.count() == want == edges.distinct().count()


def test_bed_by_ranges(spark, tmp_path):
    """Several partitions, each of its own bytes; subjects in any order; files that are no .bed or are cut short."""
    rng = np.random.default_rng(2)
    g = rng.integers(-1, 3, (57, 41))
    body = bytearray(genotypes.MAGIC)
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    for line in g:
        bits = [code[int(x)] for x in line] + [0] * (-len(line) % 4)
        body += bytes(sum(bits[k + j] << (2 * j) for j in range(4)) for k in range(0, len(bits), 4))
    path = tmp_path / "big.bed"
    path.write_bytes(bytes(body))
    keep = [5, 6, 7, 40, 0, 1]
    for subjects in (None, keep):
        df = genotypes.read_bed(spark, str(path), 41, subjects, range_bytes=10 * 11)
        assert df.rdd.getNumPartitions() == 6
        want = {k: [None if x < 0 else int(x) for x in (line if subjects is None else line[subjects])] for k, line in enumerate(g)}
        assert {r["row"]: r["dosages"] for r in df.collect()} == want
    for name, content in (("short", bytes(body[:-1])), ("magic", b"abc" + bytes(body[3:]))):
        (tmp_path / f"{name}.bed").write_bytes(content)
        with pytest.raises(Exception, match="whole variants|variant-major"):
            genotypes.read_bed(spark, str(tmp_path / f"{name}.bed"), 41).collect()


def test_triangles_by_ranges(spark, tmp_path):
    n = 23
    rel = np.random.default_rng(3).random((n, n))
    i, j = np.tril_indices(n, -1)
    order = np.lexsort((i, j))
    (tmp_path / "t.dat").write_bytes(rel[i[order], j[order]].astype("<f8").tobytes())
    i, j = np.tril_indices(n)
    (tmp_path / "t.grm.bin").write_bytes(rel[i, j].astype("<f4").tobytes())
    (tmp_path / "t.grm.id").write_text("".join(f"f s{k}\n" for k in range(n)))
    ids = [f"s{k}" for k in range(n)]
    want = {(f"s{a}", f"s{b}"): rel[a, b] for a in range(n) for b in range(a)}
    for df in (genotypes.read_grm_dat(spark, str(tmp_path / "t.dat"), ids, 400), genotypes.read_grm_gcta(spark, str(tmp_path / "t"), 200)):
        got = {(r["iid_i"], r["iid_j"]): r["rel"] for r in df.collect()}
        assert got == pytest.approx(want, rel=1e-6)
    assert len(genotypes.TriangleReader({"path": f"file://{tmp_path}/t.dat", "n": "23", "layout": "columns", "range": "400"}).partitions()) > 4
    with pytest.raises(Exception, match="no triangle"):
        genotypes.read_grm_dat(spark, str(tmp_path / "t.dat"), ids[:-1]).collect()


@pytest.mark.parametrize("block", [3, 4, 100])
def test_relatedness_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (70, 11)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    g[7], g[8] = 1.0, np.nan
    rows = [([None if np.isnan(x) else int(x) for x in line],) for line in g]
    df = spark.createDataFrame(rows, "dosages array<tinyint>").repartition(3)
    got = {(r["i"], r["j"]): r["rel"] for r in genotypes.relatedness(df, block, 16).collect()}
    mean = np.array([0 if np.isnan(line).all() else np.nanmean(line) for line in g])
    scale = np.sqrt(mean * (1 - mean / 2))
    z = np.where(np.isnan(g) | (scale[:, None] <= 0), 0, (g - mean[:, None]) / np.where(scale > 0, scale, 1)[:, None])
    want = z.T @ z / len(g)
    assert len(got) == 66 and all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())


def test_what_a_file_holds(spark, tmp_path):
    (tmp_path / "c.fam").write_text("".join(f"f{i} s{i} 0 0 1 -9\n" for i in range(4)))
    (tmp_path / "c.bim").write_text("".join(f"1 rs{k} 0 {k * 10} A C\n" for k in range(5)))
    subjects, variants = genotypes.check(spark, str(tmp_path / "c"), spark.createDataFrame([("s2",), ("nobody",)], "iid string"), spark.createDataFrame([("rs4",), ("rs4",), ("none",)], "snp_id string"))
    assert {tuple(r) for r in subjects.collect()} == {("s2", 2, True), ("nobody", None, False)}
    assert {tuple(r) for r in variants.collect()} == {("rs4", "1", 40, 4, True), ("none", None, None, None, False)}
    assert genotypes.check(spark, str(tmp_path / "c"))[0].where("in_file").count() == 4


def test_volumes_written_and_read_back(spark, tmp_path):
    from varimesh.sources import volumes

    rng = np.random.default_rng(1)
    maps = {"age z": {int(p): float(rng.normal()) for p in rng.choice(60, 20, replace=False)}, "last": {59: 1.5}, "first": {0: -2.0}}
    df = spark.createDataFrame([(m, p, v) for m, x in maps.items() for p, v in x.items()] + [("first", 3, None)], "map_id string, pos int, value double").repartition(5)
    affine = np.array([[2.0, 0, 0, -9], [0, 2, 0, 4], [0, 0, 3, 1], [0, 0, 0, 1]])
    done = {r["map_id"]: (r["path"], r["n"]) for r in volumes.write_nifti(df, str(tmp_path / "maps"), (3, 4, 5), affine, fill=7.0).collect()}
    assert {k: n for k, (_, n) in done.items()} == {"age z": 20, "last": 1, "first": 1}
    for name, want in maps.items():
        values, got = volumes.parse_nifti((tmp_path / "maps" / (name.replace(" ", "_") + ".nii")).read_bytes())
        assert values.shape == (3, 4, 5) and got == pytest.approx(affine)
        assert values.ravel(order="F") == pytest.approx([want.get(p, 7.0) for p in range(60)], rel=1e-6)
        back = volumes.read_nifti(spark, done[name][0]).where("value <> 7")
        assert {r["pos"] for r in back.collect()} == set(want)
    mask = spark.createDataFrame([(k, 59 - 2 * k) for k in range(30)], "pos int, place int")
    volumes.write_nifti(df.where("map_id = 'first'"), str(tmp_path / "masked"), (3, 4, 5), mask=mask).collect()
    assert volumes.parse_nifti((tmp_path / "masked/first.nii").read_bytes())[0].ravel(order="F")[59] == -2
    with pytest.raises(Exception, match="outside"):
        volumes.write_nifti(df, str(tmp_path / "bad"), (3, 4, 4)).collect()
    assert volumes.write_nifti(df.limit(0), str(tmp_path / "none"), (3, 4, 5)).count() == 0


def octahedron():
    points = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1.0]])
    faces = np.array([[a, b, c] for a in (0, 1) for b in (2, 3) for c in (4, 5)])
    return points, faces


def test_surfaces(spark, tmp_path):
    """Meshes of both formats, labels, neighbours and areas; enhancement with areas from a file."""
    import struct

    from varimesh.operators import resample
    from varimesh.sources import surfaces

    points, faces = octahedron()
    (tmp_path / "lh.tri").write_bytes(surfaces.TRIANGLES + b"made by hand\n\n" + struct.pack(">2i", 6, 8) + points.astype(">f4").tobytes() + faces.astype(">i4").tobytes())
    array = lambda intent, x, kind, form, enc, body: f'<DataArray Intent="{intent}" DataType="{kind}" ArrayIndexingOrder="RowMajorOrder" Dimensionality="2" Dim0="{len(x)}" Dim1="3" Encoding="{enc}" Endian="LittleEndian"><Data>{body}</Data></DataArray>'
    import base64

    xml = "<GIFTI>" + array("NIFTI_INTENT_POINTSET", points, "NIFTI_TYPE_FLOAT32", "f4", "Base64Binary", base64.b64encode(points.astype("<f4").tobytes()).decode())
    xml += array("NIFTI_INTENT_TRIANGLE", faces, "NIFTI_TYPE_INT32", "i4", "ASCII", " ".join(map(str, faces.ravel()))) + "</GIFTI>"
    (tmp_path / "lh.gii").write_text(xml)
    for name in ("lh.tri", "lh.gii"):
        v, f = surfaces.read_vertices(spark, str(tmp_path / name)), surfaces.read_faces(spark, str(tmp_path / name))
        assert [(r.x, r.y, r.z) for r in v.orderBy("pos").collect()] == [tuple(p) for p in points]
        edges, areas = surfaces.mesh_edges(f), {r.pos: r.area for r in surfaces.vertex_areas(f, v).collect()}
        assert edges.count() == 12 and edges.where("a = 0 and b = 1").count() == 0
        assert list(areas.values()) == pytest.approx([4 * np.sqrt(3) / 6] * 6) and len(areas) == 6
    stats = spark.createDataFrame([("m", p, x) for p, x in enumerate([2.0, 0.0, 2.0, 0.0, -1.0, 0.0])], "map_id string, pos long, value double")
    with_area = stats.join(surfaces.vertex_areas(f, v), "pos")
    got = {r.pos: r.tfce for r in resample.enhance(with_area, edges, steps=2).collect()}
    one = 4 * np.sqrt(3) / 6
    assert got[0] == pytest.approx((3 * one) ** 0.5 * 1 + (2 * one) ** 0.5 * 4) and got[4] == pytest.approx(-((3 * one) ** 0.5))
    label = struct.pack(">i", 3) + struct.pack(">6i", 0, 1 + (2 << 8) + (3 << 16), 1, 99, 4, 1 + (2 << 8) + (3 << 16)) + struct.pack(">3i", 1, -2, 2) + struct.pack(">i", 4) + b"tab\0"
    label += struct.pack(">i", 1) + struct.pack(">2i", 0, 6) + b"bank.\0" + struct.pack(">4i", 1, 2, 3, 0)
    (tmp_path / "lh.annot").write_bytes(label)
    assert {(r.pos, r.name) for r in surfaces.read_annotation(spark, str(tmp_path / "lh.annot")).collect()} == {(0, "bank."), (1, None), (4, "bank.")}
    with pytest.raises(Exception, match="neither"):
        surfaces.read_faces(spark, str(tmp_path / "lh.annot")).collect()
    done = surfaces.write_overlays(stats, str(tmp_path / "out"), 8).first()
    assert surfaces.parse_xml(open(done.path, "rb").read())[0][1] == pytest.approx([2, 0, 2, 0, -1, 0, 0, 0])
