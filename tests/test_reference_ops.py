import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.functions import text as T
from foliospark.operators import graph as G
from foliospark.operators import image as I
from foliospark.operators import lda as L
from foliospark.operators import relational as R
from foliospark.operators import stats as S
from foliospark.sources import files
from foliospark.streaming.selection import counts_by_window, valid_selections


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


# --- discriminant


def refit_hits(x, y):
    out = []
    for i in range(len(x)):
        k = np.arange(len(x)) != i
        a, b = x[k & (y == 0)], x[k & (y == 1)]
        if not len(a) or not len(b):
            continue
        s = np.atleast_2d(np.cov(x[k].T)) + L.RIDGE * np.eye(x.shape[1])
        w = np.linalg.solve(s, b.mean(0) - a.mean(0))
        out.append((w @ x[i] > w @ (a.mean(0) + b.mean(0)) / 2) == bool(y[i]))
    return sum(out), len(out)


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_left_out_equals_refit(spark, d):
    rng = np.random.default_rng(d)
    y = (rng.random(60) < 0.4).astype(int)
    x = rng.normal(size=(60, d)) + 5 + y[:, None] * 0.8
    axes = [f"a{i}" for i in range(d)]
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)] + [(*[None] * d, 1)], ", ".join(f"{a} double" for a in axes) + ", y int")
    r = L.leave_one_out(df, axes, "y", "m").head()
    assert (r["hits"], r["n"]) == refit_hits(x, y)
    w, t = L.fit(L.moments(df, axes, "y"))
    s = np.atleast_2d(np.cov(x.T)) + L.RIDGE * np.eye(d)
    want = np.linalg.solve(s, x[y == 1].mean(0) - x[y == 0].mean(0))
    assert np.allclose(w, want) and np.isclose(t, want @ (x[y == 1].mean(0) + x[y == 0].mean(0)) / 2)


def test_class_of_one_is_not_judged(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (2.0, 0), (9.0, 1)], "a double, y int")
    assert L.leave_one_out(df, ["a"], "y", "m").head()["n"] == 3
    assert L.leave_one_out(df.limit(0), ["a"], "y", "m").head()["n"] == 0


# --- statistics


def test_auc_by_ordinal_ranks(spark):
    rows = [("f", v, i, p) for i, (v, p) in enumerate([(1.0, True), (1.0, False), (2.0, True), (3.0, False), (3.0, True)])]
    df = spark.createDataFrame(rows, "feature string, v double, id int, pos boolean")
    # ranks 1 2 3 4 5 by (v, id); positives have 1, 3 and 5
    assert S.rank_auc(df, "pos", "id").head()["auc"] == pytest.approx((1 + 3 + 5 - 6) / 6)


def test_ranks_of_one_big_group(spark):
    df = spark.createDataFrame([("g" if i % 3 else "h", (i * 7919) % 1000, i) for i in range(1000)], "g string, v int, id int")
    rows = R.ordinal_ranks(df, "g", ["v", "id"], 5).collect()
    for g in "gh":
        mine = sorted((r["v"], r["id"], r["rank"]) for r in rows if r["g"] == g)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))


def test_histogram_edges_and_entropy(spark):
    df = spark.createDataFrame([("a", v) for v in (-0.1, 0.0, 0.5, 1.0, 1.1)], "feature string, v double")
    h = {r["bin"]: r["cnt"] for r in S.unit_histogram(df).collect()}
    assert h == {1: 1, 33: 1, 64: 1}
    assert S.entropy(S.unit_histogram(df)).head()["bits"] == pytest.approx(np.log2(3))


def test_constant_columns(spark):
    df = spark.createDataFrame([("a", 2.0, True), ("a", 2.0, False)], "feature string, v double, g boolean")
    assert df.agg(S.pearson(F.col("v"), F.col("v")).alias("r")).head()["r"] == 0
    assert S.class_means(df, "g").head()["gen_z"] is None


def test_ticks(spark):
    assert one(spark, X.ticks(F.lit(0.0), F.lit(1.0), 5).alias("t"))["t"] == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0])
    assert one(spark, X.tick_step(F.lit(2.0), F.lit(2.0), 5).alias("t"))["t"] is None


def test_compact_and_push(spark):
    got = one(spark, *(X.compact(F.lit(v)).alias(f"c{i}") for i, v in enumerate([1500.0, 2000.0, 0.0005, 0.0, 1.23456, -7.0])))
    assert list(got) == ["1.5k", "2k", "5e-4", "0", "1.235", "-7"]
    assert list(one(spark, *(c.alias(a) for a, c in zip("xyz", X.pushed_out([F.lit(0.0)] * 3, 40.0))))) == [40, 0, 0]


# --- keyed tables and graphs


def test_last_wins_and_deletions(spark):
    rows = [(1, "a", 1, None), (1, "b", 3, None), (1, "b", 3, None), (2, "c", 1, None), (2, "c", 2, 5), (None, "n", 1, None)]
    df = spark.createDataFrame(rows, "id int, v string, loaded_at int, deleted_at int")
    assert sorted((r["id"] or 0, r["v"]) for r in R.current(df, "id", ["v"]).collect()) == [(0, "n"), (1, "b")]


def test_enrichment_and_pairs(spark):
    left = spark.createDataFrame([(1, "x", True), (2, "x", False)], "id int, n string, g boolean")
    right = spark.createDataFrame([("x", 5)], "n string, m int")
    assert {tuple(r) for r in R.enrich_where(left, right, "n", F.col("g")).collect()} == {(1, "x", True, 5), (2, "x", False, None)}
    df = spark.range(50).withColumn("g", F.col("id") % 2 == 0)
    rows = R.sampled_pairs(df, "id", F.col("g"), 5, X.portable_hash(F.col("id"))).collect()
    assert len(rows) == 5 and all(r["id_a"] % 2 == 0 and r["id_b"] % 2 == 1 for r in rows)


def test_homophily_and_dangling(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "id int, c int")
    edges = spark.createDataFrame([(1, 2), (1, 4), (2, 3), (3, 9), (None, 1)], "s int, t int")
    h = G.homophily(G.with_ends(edges, nodes, "id", "c")).head()
    assert (h["edges"], h["same"], h["gen_pct"], h["real_pct"]) == (3, 2, pytest.approx(200 / 3), None)
    assert tuple(G.dangling(edges, nodes, "id").head()) == (5, 2)
    assert G.induced(G.with_ends(edges, nodes, "id", "c"), 1).count() == 2 and G.induced(G.with_ends(edges, nodes, "id", "c"), None).count() == 3


def test_cosine_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(500, None), (501, [0.0] * 6)], "id bigint, e array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (4096, 3):
        monkeypatch.setattr(G, "QUERY_BLOCK", block)
        got = {(r["s"], r["rank"]): r["t"] for r in G.nearest_cosine(df, "id", "e", df.filter("id % 10 = 0"), 4).collect()}
        for s in range(0, 120, 10):
            sim = unit @ unit[s]
            sim[s] = -9
            assert [got[s, k + 1] for k in range(4)] == np.argsort(-sim, kind="stable")[:4].tolist()
    g = {r["pair"]: r["similarity"] for r in G.mean_similarities(df.filter("id < 120").withColumn("g", F.col("id") < 50), "e", "g", 6).collect()}
    assert g["g2r"] == pytest.approx((unit[:50] @ unit[50:].T).mean())
    mean, axes = G.principal_axes(df.filter("id < 120"), "e", 2)
    z = (unit - unit.mean(0)) / unit.std(0)
    top = np.linalg.svd(z, full_matrices=False)[2][0]
    assert abs(abs((axes[:, 0] * unit.std(0)) @ top) - 1) < 1e-6 and np.allclose(mean, unit.mean(0))


# --- text


def test_text(spark):
    rows = [("\t a\n",), ("",), ("None",), (None,), ('s12 = "Foo"',), (" x ",), ("ab😀cd",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(T.excerpt(F.col("s"), 3)).collect()] == ["a", "", "", "", "s12", "x", "ab😀"]
    assert df.select(T.without_assignment(F.col("s"))).collect()[4][0] == "Foo"
    names = {"Map 9am.png": "9am", "map_10:30.PNG": "10:30", "Map.png": "Unknown time", "map-noon_late.png": "noon late", "Map1.png": "1"}
    keys = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.time_key(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in keys} == names
    assert one(spark, T.number_in(F.lit("pg_007.png")).alias("a"), T.number_in(F.lit("none")).alias("b"), T.leading_number(F.lit("10:30")).alias("c")) == (7, 0, 10.0)
    flags = one(spark, T.paper_flags(F.lit(None).cast("string"), F.lit("Missing refs, affiliations"), F.lit("")).alias("f"))["f"]
    assert flags == ["no title", "no affiliations", "no references"]


# --- files and images


def png(px):
    h, w = px.shape[:2]
    raw = b"".join(b"\x00" + px[y].tobytes() for y in range(h))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    white, red = np.full((4, 3, 3), 255, np.uint8), np.zeros((3, 4, 3), np.uint8)
    red[1, 1] = (255, 0, 0)
    for name, px in (("white", white), ("red", red)):
        (tmp_path / f"{name}.png").write_bytes(png(px))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    got = {r["name"]: r for r in I.image_features(files.read_images(spark, str(tmp_path))).collect()}
    w, r = got["white.png"], got["red.png"]
    assert (w["edge"], w["ink"], w["sat"], w["ent"], w["white"], w["ar"]) == (0, 0, 0, 0, 1, 0.75)
    assert r["ink"] == 1 and r["sat"] == pytest.approx(1 / 12) and r["ar"] == pytest.approx(4 / 3) and r["edge"] > 0 and got["broken.png"]["ar"] is None
    big = np.tile(np.arange(600, dtype=np.uint8)[None, :, None], (300, 1, 3))
    assert I.thumbnail(big).shape == (128, 256, 3)


def test_graph_csv_sheet_and_bundle(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "name": "A", "type": "real", "x": 1}], "links": [{"source": "a", "target": "b", "weight": 0.5}]}')
    nodes, links = files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.head()["x"] == 1 and tuple(links.head()) == ("a", "b", 0.5)
    (tmp_path / "m.csv").write_text("filename,clip_similarity,structural_complexity,gibberish_ratio,repetition\nf.png,0.5,1.5,0.1,-2.7\n")
    assert tuple(files.read_metrics(spark, str(tmp_path / "m.csv")).head()) == ("f.png", 0.5, 1.5, 0.1, -2)
    (tmp_path / "bad.csv").write_text("filename,clip_similarity,structural_complexity,gibberish_ratio,repetition\nf.png,x,1,1,1\n")
    with pytest.raises(Exception, match="(?i)malformed|x"):
        files.read_metrics(spark, str(tmp_path / "bad.csv")).collect()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t> Title </t></is></c></row><row><c r="A2" t="inlineStr"><is><t>p1 </t></is></c><c r="B2"><v>7</v></c></row><row><c r="B3"><v>8</v></c></row><row><c r="A4" t="inlineStr"><is><t>p2</t></is></c></row>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>File</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    rows = files.read_sheet(spark, str(tmp_path / "b.xlsx"), ["Title", "Gone"], "S").collect()
    assert [tuple(r) for r in rows] == [(0, "p1", "7", ""), (2, "p2", "", "")]
    files.write_bundle({"nodes": nodes, "links": links}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/links")).count() == 1
    listed = spark.createDataFrame([("a",)], "name string")
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "p string, q string")
    assert {r["source"] for r in files.with_fallback(df, listed, "p", "q").collect()} == {"a", "y"}


# --- streams


def test_selection_stream(spark, tmp_path):
    rows = [("2025-01-01 00:00:01", "cluster", "3"), ("2025-01-01 00:00:02", "other", "4"), ("2025-01-01 00:00:03", "cluster", "all"), ("2025-01-01 01:00:04", "cluster", "x")]
    table = spark.createDataFrame(rows, "ts string, type string, value string").withColumn("ts", F.to_timestamp("ts"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = valid_selections(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "cluster")
    q = stream.writeStream.format("memory").queryName("chosen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["value"] for r in spark.table("chosen").orderBy("ts").collect()] == ["3", None, None]
    assert sorted(r["n"] for r in counts_by_window(table, "ts", "type").collect()) == [1, 1, 2]


def test_entry_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['foliospark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_documents_and_class_images(spark, tmp_path):
    a = spark.createDataFrame([(1, "x\"y", None), (2, "ü", 0.5)], "id bigint, n string, v double")
    files.write_document({"rows": a, "none": a.limit(0)}, str(tmp_path / "d/doc.json"))
    text = (tmp_path / "d/doc.json").read_text()
    assert text.count("\n") == 0 and text.startswith('{"rows":[{"id":1')
    got = files.read_document(spark, str(tmp_path / "d/doc.json"), {"rows": "id bigint, n string, v double", "none": "id bigint", "gone": "id bigint"})
    assert sorted(map(tuple, got["rows"].collect())) == [(1, 'x"y', None), (2, "ü", 0.5)] and got["none"].count() == 0 and got["gone"].count() == 0
    (tmp_path / "bad.json").write_text('{"rows": [')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_document(spark, str(tmp_path / "bad.json"), {"rows": "id bigint"})["rows"].collect()
    for folder in ("gen", "real"):
        (tmp_path / folder).mkdir()
    (tmp_path / "gen/a.png").write_bytes(I.encode_png(np.full((2, 2, 3), 255, np.uint8)))
    (tmp_path / "real/a.png").write_bytes(I.encode_png(np.zeros((2, 2, 3), np.uint8)))
    want = spark.createDataFrame([("a.png", True), ("a.png", False), ("b.png", True)], "n string, is_generated boolean")
    rows = {(r["name"], r["path"].split("/")[-2]): r["content"] for r in files.class_images(spark, want, str(tmp_path / "gen"), str(tmp_path / "real")).collect()}
    assert I.decode_png(bytes(rows["a.png", "gen"])).max() == 255 and I.decode_png(bytes(rows["a.png", "real"])).max() == 0 and rows["b.png", "gen"] is None


def _png(w, h, depth, colour, raw, interlaced=0, palette=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_varieties_of_png():
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    assert (I.decode_png(I.encode_png(px)) == px).all()
    # every filter
    flat, raw = px.reshape(9, 33).astype(int), b""
    for y in range(9):
        kind, up = y % 5, flat[y - 1] if y else np.zeros(33, int)
        left, corner = np.concatenate([np.zeros(3, int), flat[y][:-3]]), np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        pick = [min((abs(g - a), 0, a), (abs(g - b), 1, b), (abs(g - c), 2, c))[2] for g, a, b, c in zip(p, left, up, corner)]
        guess = (0, left, up, (left + up) // 2, np.array(pick))[kind]
        raw += bytes([kind]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()
    assert (I.decode_png(_png(11, 9, 8, 2, raw)) == px).all()
    # interlaced, 16 bits, one bit, palette of four bits, grey with alpha
    raw = b""
    for x0, y0, dx, dy in I._PASSES:
        part = px[y0::dy, x0::dx]
        raw += b"".join(b"\0" + row.tobytes() for row in part) if part.size else b""
    assert (I.decode_png(_png(11, 9, 8, 2, raw, 1)) == px).all()
    assert (I.decode_png(_png(11, 9, 16, 2, b"".join(b"\0" + np.repeat(row.ravel(), 2).tobytes() for row in px))) == px).all()
    assert I.decode_png(_png(3, 1, 1, 0, b"\0\xa0")).tolist() == [[[255] * 3, [0] * 3, [255] * 3]]
    assert I.decode_png(_png(3, 1, 4, 3, b"\0\x10\x20", palette=bytes([1, 2, 3, 4, 5, 6, 7, 8, 9]))).tolist() == [[[4, 5, 6], [1, 2, 3], [7, 8, 9]]]
    assert I.decode_png(_png(2, 1, 8, 4, b"\0\x10\xff\x20\x00")).tolist() == [[[16] * 3, [32] * 3]]
    for bad in (b"", b"\x89PNG\r\n\x1a\n", _png(2, 1, 8, 2, b"\x09" + b"\0" * 6)):
        with pytest.raises(ValueError):
            I.decode_png(bad)


def test_orders_scales_and_ticks(spark):
    keys = spark.createDataFrame([(k,) for k in ("b", "10pm", "2", None, "a", "2", "-1x")], "key string")
    got = [r["key"] for r in R.mixed_order(keys, "key").orderBy("place").collect()]
    assert got == ["-1x", "2", "2", "10pm", None, "a", "b"]
    row = spark.range(1).select(X.scaled(F.lit(5.0), (0, 10), (100, 200)).alias("a"), X.scaled(F.lit(150.0), (100, 200), (0, 10)).alias("b"), X.scaled(F.lit(1.0), (3, 3), (0, 1)).alias("c"), X.ticks(F.lit(2.0), F.lit(2.0), 5).alias("d")).head()
    assert (row["a"], row["b"], row["c"], row["d"]) == (150.0, 5.0, None, [2.0, 2.0])


def test_sets_against_refits(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.01]
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=60) > 0).astype(int)
    rows = [(int(c), *map(float, p)) for c, p in zip(y, x)] + [(1, None, 1.0, 1.0), (0, float("nan"), 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double")
    got = {r["name"]: (r["hits"], r["n"]) for r in L.leave_one_out_sets(df, {"a": ["a"], "ab": ["a", "b"], "abc": ["a", "b", "c"]}, "y", unit=["c"]).collect()}

    def refits(cols, unit):
        z = x[:, cols] / [x[:, c].std() if c in unit else 1 for c in cols]
        hits = 0
        for i in range(60):
            k = np.arange(60) != i
            m0, m1 = z[k & (y == 0)].mean(0), z[k & (y == 1)].mean(0)
            w = np.linalg.solve(np.atleast_2d(np.cov(z[k].T)) + 1e-6 * np.eye(len(cols)), m1 - m0)
            hits += int(w @ z[i] > (w @ m0 + w @ m1) / 2) == y[i]
        return hits, 60

    assert got == {"a": refits([0], []), "ab": refits([0, 1], []), "abc": refits([0, 1, 2], [2])}
    empty = {r["name"]: (r["hits"], r["n"]) for r in L.leave_one_out_sets(df.limit(0), {"a": ["a"]}, "y").collect()}
    assert empty == {"a": (0, 0)}


def test_hubs_and_medians(spark):
    edges = spark.createDataFrame([(i % 7, 3) for i in range(3000)] + [(1, 99), (None, 3), (2, 2)], "s bigint, t bigint")
    nodes = spark.createDataFrame([(i, i % 2) for i in range(7)], "id bigint, c int")
    for hub in (100_000, 1_000, 10):
        ends = G.with_ends(edges, nodes, "id", "c", hub)
        assert ends.count() == 3001 and ends.filter("vs = s % 2 and vt = t % 2").count() == 3001
    long = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 1.0), ("b", 4.0), ("b", 1.0), ("c", 7.0)], "feature string, v double")
    assert {r["feature"]: r["med"] for r in S.summary(long).collect()} == {"a": 1.0, "b": 2.5, "c": 7.0} and S.summary(long.limit(0)).count() == 0
