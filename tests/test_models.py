"""Queries that SQL can't express, by their properties; rasters, readers and writers by round trips."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equimap.__main__ import main
from equimap.operators import models, planning, spatial, stats
from equimap.plans import catalog, tables
from equimap.sources import files, raster

DATA = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.QUERIES[name](spark, DATA).collect()


def test_contributions_add_up_to_the_prediction(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(a), float(b), float(a * 3 + (b > 0) * 5)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(data, "id long, a double, b double, y double")
    got: dict[int, float] = {}
    for r in models.contributions(df, "id", ["a", "b"], "y").collect():
        got[r.id] = got.get(r.id, 0.0) + r.contribution
    model = models.GBTRegressor(maxDepth=3, maxIter=10, seed=42, labelCol="y").fit(models.assembled(df, ["a", "b"]))
    want = {r.id: r.prediction for r in model.transform(models.assembled(df, ["a", "b"])).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_boosted_folds_and_baseline(spark):
    cv = rows(spark, "gbt_cv")
    assert [r.fold for r in sorted(cv)] == [0, 1, 2] and all(r.rmse >= r.mae > 0 and r.smearing > 0 and r.mdape <= r.mape for r in cv)
    (h,) = rows(spark, "huber_baseline")
    assert h.folds == 5 and h.r2 < 1 and h.r2_std >= 0
    imp = rows(spark, "importance_topk")
    assert [r.rank for r in sorted(imp, key=lambda r: -r.importance)] == list(range(1, len(imp) + 1)) and sum(r.importance for r in imp) <= 1 + 1e-9


def test_a_learnable_target_is_learned_on_held_out_folds(spark):
    df = spark.range(300).select("id", (F.pmod("id", F.lit(17)) + 1).cast("double").alias("a"), (F.pmod("id", F.lit(5))).cast("double").alias("b"), F.pmod("id", F.lit(3)).cast("int").alias("fold")).withColumn("y", 10 * F.col("a") + 1)
    cv = models.boosted_cv(df, ["a", "b"], "y", "fold", rounds=15).collect()
    assert min(r.r2 for r in cv) > 0.9 and max(r.mdape for r in cv) < 15
    (h,) = models.huber(df.withColumn("c", F.lit(1.0)), ["a", "b", "c"], "y", "fold").collect()
    assert h.r2 > 0.99


def test_trials_have_a_running_best(spark):
    t = sorted(rows(spark, "tuning_trials"))
    assert [r.trial for r in t] == list(range(8)) and [r.best for r in t] == list(itertools.accumulate((math.inf if r.pruned else r.mdape for r in t), min))
    assert all(r.folds == 3 or (r.pruned and r.folds < 3) for r in t) and not any(r.pruned for r in t[:3])


def test_clusters_votes_and_regions(spark):
    pts = {r.vec_id: r for r in tables.points(spark, DATA).collect()}
    got = rows(spark, "kmeans_vote")
    assert {r.vec_id for r in got} == set(pts) and len({r.cluster for r in got}) == 6
    for c in {r.cluster for r in got}:
        own = [pts[r.vec_id].label for r in got if r.cluster == c]
        best = min(set(own), key=lambda x: (-own.count(x), x))
        assert {r.voted for r in got if r.cluster == c} == {best}
    reg = rows(spark, "skater_regions")
    assert {r.vec_id for r in reg} == set(pts) and len({r.region for r in reg}) >= 6


def test_outliers_hull_anchors_and_grid(spark):
    out = rows(spark, "isolation_outliers")
    cutoff = np.quantile([r.score for r in out], 0.96)
    assert all(0 < r.score < 1 and (not r.outlier or r.score > cutoff) for r in out) and 0 < sum(r.outlier for r in out) <= 0.04 * len(out) + 1
    (h,) = rows(spark, "hull_buffer")
    p = np.array([(r.x, r.y) for r in tables.points(spark, DATA).collect()])
    ring = planning.hull([tuple(x) for x in p.tolist()])
    assert h.corners == len(ring) and h.area > spatial.ring_area(ring)
    assert all(0 < v <= 1 for r in rows(spark, "rbf_anchors") for v in r[1:])
    grid = rows(spark, "grid_inference")
    med = float(np.median([r.pred for r in grid if r.source == "model"]))
    assert {r.source for r in grid} == {"model", "median"} and all(abs(r.pred - med) < 1e-9 for r in grid if r.source == "median") and all(r.x is None for r in grid if r.source == "median")


def test_boxcox_lambda_is_the_likeliest(spark):
    (lam,) = rows(spark, "boxcox_lambda")[0]
    y = np.array([r[0] for r in tables.read(spark, DATA, "orders").select("o_totalprice").collect()])
    score = lambda t: (t - 1) * np.log(y).sum() - len(y) / 2 * math.log(np.var(np.log(y) if abs(t) < 1e-8 else (y**t - 1) / t))
    assert score(lam) >= max(score(lam + e) for e in (-0.05, 0.05)) - 1e-6


def test_delaunay_circles_are_empty(spark):
    got = [(r.a, r.b) for r in rows(spark, "delaunay_edges")]
    pts = {r.vec_id: (r.x, r.y) for r in tables.points(spark, DATA).collect()}
    ids, edges = sorted(pts), {frozenset(e) for e in got}
    near: dict[int, set] = {i: set() for i in ids}
    for a, b in got:
        near[a].add(b)
        near[b].add(a)
    at = np.array([pts[i] for i in ids])
    for i in ids[::7]:  # triangles are checked against all points
        for j, k in itertools.combinations(sorted(near[i]), 2):
            if frozenset((j, k)) not in edges:
                continue
            (ax, ay), (bx, by), (cx, cy) = pts[i], pts[j], pts[k]
            d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
            ux = ((cy - ay) * ((bx - ax) ** 2 + (by - ay) ** 2) - (by - ay) * ((cx - ax) ** 2 + (cy - ay) ** 2)) / d
            uy = ((bx - ax) * ((cx - ax) ** 2 + (cy - ay) ** 2) - (cx - ax) * ((bx - ax) ** 2 + (by - ay) ** 2)) / d
            inside = (at[:, 0] - ax - ux) ** 2 + (at[:, 1] - ay - uy) ** 2 < (ux * ux + uy * uy) * (1 - 1e-9)
            others = near[i] & near[j] & near[k]
            assert not inside.any() or others  # only a ring of three around further points may hold some
    hull = planning.hull([tuple(map(float, p)) for p in at.tolist()])
    assert len(edges) == 3 * len(ids) - 3 - len(hull)


def test_matching_limits(spark):
    df = spark.createDataFrame([(i, i) for i in range(9)], "a long, b long")
    with pytest.raises(ValueError):
        stats.best_match(df, "a", "b")
    assert stats.best_match(df.filter("a < 5"), "a", "b").first()[0] == 1.0
    with pytest.raises(ValueError):
        stats.checked_join(df, df.unionAll(df), "a")
    assert stats.checked_join(df, df.select("a", F.lit(1).alias("c")), "a").count() == 9


def test_lifecircles_of_all_cells(spark):
    got = rows(spark, "grid_lifecircles")
    assert len(got) == tables.cells(spark, DATA).count() and min(r.area for r in got) >= 0 and any(abs(r.area - math.pi * 8100) < 1e-6 for r in got)


def test_rasters_go_round(spark, tmp_path):
    px = spark.createDataFrame([(r, c, float(r * 10 + c) if (r + c) % 5 else None) for r in range(70) for c in range(9)], "row long, col long, value double")
    raster.write_tiff(px, f"{tmp_path}/a.tif", 100.0, 500.0, 2.5)
    assert raster.single_band(spark, f"{tmp_path}/a.tif").select("bands", "height", "width", "left", "top", "res", "nodata").first() == (1, 70, 9, 100.0, 500.0, 2.5, -9999.0)
    assert sorted(raster.read_tiff(spark, f"{tmp_path}/a.tif").collect(), key=lambda r: r[:2]) == sorted(px.collect(), key=lambda r: r[:2])
    two = np.arange(24, dtype="<i2").reshape(3, 4, 2)
    head = raster.make_tiff(two[:, :, 0], 0.0, 0.0, 1.0, -1.0)
    data, m = raster.parse_tiff(head)
    assert (data[0] == two[:, :, 0]).all() and m["nodata"] == -1.0
    with pytest.raises(ValueError):
        raster.parse_tiff(b"PNG....")
    raster.write_npy(px, f"{tmp_path}/m.npy")
    assert {tuple(r) for r in raster.read_npy(spark, f"{tmp_path}/m.npy").collect()} == {tuple(r) for r in px.filter("value is not null").collect()}
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    report = {r.name: r for r in raster.normalise_all(spark, {"a": f"{tmp_path}/a.tif", "bad": f"{tmp_path}/bad.tif"}, f"{tmp_path}/out").collect()}
    assert report["a"].action == "written" and report["a"].missing == 126 and report["bad"].action.startswith("failed")


def test_files_go_round(spark, tmp_path):
    df = spark.createDataFrame([(1, "é, x"), (2, "line\nbreak")], "id long, name string")
    files.write_csv_bom(df.filter("id = 1").coalesce(1), f"{tmp_path}/bom")
    (part,) = [p for p in (tmp_path / "bom").iterdir() if p.name.startswith("part")]
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,name") or part.read_bytes().startswith(b'\xef\xbb\xbf"id"')
    assert [tuple(r) for r in files.read_csv(spark, str(part)).collect()] == [("1", "é, x")]
    (tmp_path / "g.csv").write_bytes('名称,n\n"学\n校",1\n名称,2\n'.encode("gbk"))
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/g.csv", "`名称` string, n int").collect()] == [("学\n校", 1), ("名称", 2)]
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]
    poly = spark.createDataFrame([(1, ring), (2, ring[::-1])], "id long, ring array<struct<x: double, y: double>>")
    files.write_features(poly, f"{tmp_path}/f")
    back = {r.id: [tuple(p) for p in r.ring] for r in files.read_features(spark, f"{tmp_path}/f", "id long", "EPSG:4526").collect()}
    assert back[1] == ring and spatial.ring_area(back[2]) == 2.0
    with pytest.raises(ValueError):
        files.read_features(spark, f"{tmp_path}/f", "id long", None)
    inventory = {r.name: r for r in files.convert_layers(spark, {"ok": df, "broken": None}, f"{tmp_path}/layers").collect()}
    assert inventory["ok"].rows == 2 and inventory["ok"].error is None and inventory["broken"].error
    with pytest.raises(ValueError):
        files.only_kinds(df, "name", ["é, x"], [])


def test_registry_and_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("EQUIMAP_DATA", raising=False)
    with pytest.raises(KeyError):
        files.Registry(spark)
    monkeypatch.setenv("EQUIMAP_DATA", str(tmp_path))
    reg, made = files.Registry(spark), []
    make = lambda: made.append(1) or spark.range(3)
    assert reg.normalised("r", make).count() == reg.normalised("r", make).count() == 3 and made == [1]
    assert main(["list"]) == 0 and "knn_k6" in capsys.readouterr().out
    assert main(["run", "top_k", "--data", DATA, "--out", f"{tmp_path}/o"]) == 0 and spark.read.parquet(f"{tmp_path}/o/top_k").count() == 5
    with pytest.raises(SystemExit):
        main(["run", "nothing", "--data", DATA, "--out", "x"])


@pytest.mark.parametrize(("n", "q", "bins"), [(2, 0.5, 64), (57, 0.5, 16), (400, 0.37, 64), (300, 0.5, 1 << 14)])
def test_distances_of_all_pairs(spark, n, q, bins):
    import numpy as np

    from equimap.operators import models

    at = np.random.default_rng(n).normal(size=(n, 2)) * [3, 100]
    at[: n // 3] = at[0]  # equal points
    d = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))[np.triu_indices(n, 1)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in at], "x double, y double")
    assert models.distance_quantile(df, q, bins=bins) == pytest.approx(float(np.quantile(d, q)), rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError, match="more than"):
        models.distance_quantile(df, q, most=n - 1)
    assert models.distance_quantile(df.limit(1), q) is None


def test_distances_of_more_points_than_one_task_had(spark):
    """More than 100,000 points, most of them copies, aren't an error; every copy counts."""
    import numpy as np

    from equimap.operators import models

    at = np.random.default_rng(5).normal(size=(900, 2))
    d = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))[np.triu_indices(900, 1)]
    points = spark.createDataFrame(at.tolist(), "x double, y double").crossJoin(spark.range(120))
    n, same = 900 * 120, 900 * 120 * 119 // 2
    want = np.sort(d)[(int(0.3 * (n * (n - 1) // 2 - 1)) - same) // 120**2]  # each distance 14,400 times
    assert models.distance_quantile(points, 0.3) == pytest.approx(float(want), rel=1e-9)


def test_each_tree_draws_from_all_rows(spark, monkeypatch):
    from equimap.operators import planning

    df = spark.range(30_000).selectExpr("cast(id as double) as x", "if(id = 7, 1e9, 0.0) as y")
    seen = []
    real = planning.np.array
    monkeypatch.setattr(planning.np, "array", lambda *a, **k: (seen.append(a[0]), real(*a, **k))[1])
    scores = planning.isolation_scores(df, ["x", "y"], trees=40, sample=64)
    drawn = {row[1] for rows in seen if isinstance(rows, list) for row in rows if isinstance(row, tuple) and len(row) == 3}
    assert scores.count() == 30_000 and len(drawn) > 0.9 * 40 * 64 and max(drawn) - min(drawn) > 29_000


def test_folder_of_mixed_encodings(spark, tmp_path):
    from equimap.sources import files

    long = "这是一个学校的名字和地址，在城市的中心" * 40
    texts = {"a.csv": ("gbk", f"name,n\n{long},1\n"), "b.csv": ("utf-8", f"n,name\n2,{long}\n"), "c.csv": ("utf-8-sig", "name,n,extra\nplain,3,x\n"), "d.csv": ("latin-1", "name,n\nÉcole supérieure près du café,4\n"), "e.csv": ("utf-8", "name,n\n" + "x" * 200_000 + "é,5\n")}
    for name, (e, text) in texts.items():
        (tmp_path / name).write_bytes(text.encode(e))
    found = {r.path.rsplit("/", 1)[1]: (r.encoding, r.confidence) for r in files.encodings(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in texts.items()}
    assert all(found[k][1] > files.SURE for k in "abcd" for k in [f"{k}.csv"])
    assert found["e.csv"][1] == 0.5  # one character is no proof; the ladder decides
    got = {r.n: (r.name, r.extra) for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert got["1"] == got["2"] == (long, None) and got["3"] == ("plain", "x") and got["4"][0] == "École supérieure près du café" and got["5"][0].endswith("xé")


def test_kept_tables_are_not_overwritten_on_errors(spark, tmp_path):
    from equimap.sources import files

    reg = files.Registry(spark, str(tmp_path))
    reg.normalised("t", lambda: spark.range(3).toDF("n"))
    for part in (tmp_path / "_normalised" / "t").glob("part-*"):
        part.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        reg.normalised("t", lambda: spark.range(9).toDF("n")).collect()
    assert not [p for p in (tmp_path / "_normalised" / "t").glob("part-*") if p.read_bytes() != b"broken"]


def test_densities_beat_random_trials():
    from equimap.operators.tuning import Range, minimise

    space = {"a": Range(0.0, 1.0), "b": Range(1e-4, 1.0, log=True), "n": Range(1, 20, whole=True)}
    surface = lambda p: (p["a"] - 0.3) ** 2 + (math.log10(p["b"]) + 2) ** 2 / 4 + ((p["n"] - 7) / 10) ** 2
    steps = lambda p: (surface(p) * s for s in (1.1, 0.9, 1.0))
    tpe, free = [], []
    for seed in range(12):
        done = minimise(steps, space, 40, 8, seed, {"a": 0.9, "b": 0.9, "n": 19})
        assert done[0].params == {"a": 0.9, "b": 0.9, "n": 19} and all(isinstance(x.params["n"], int) and 1e-4 <= x.params["b"] <= 1 for x in done)
        assert [x.params for x in done] == [x.params for x in minimise(steps, space, 40, 8, seed, {"a": 0.9, "b": 0.9, "n": 19})]
        cut_short = [x for x in done if x.pruned]
        assert cut_short and all(len(x.steps) < 3 for x in cut_short) and all(len(x.steps) == 3 for x in done if not x.pruned)
        tpe.append(min(x.value for x in done if not x.pruned))
        free.append(min(x.value for x in minimise(steps, space, 40, 40, seed)))
    assert sum(a < b for a, b in zip(tpe, free)) >= 9 and sum(tpe) < sum(free) / 2


def test_shapley_values_against_all_subsets(spark):
    """Equal to the weighted sum over all subsets of four features of the trees' expectations."""
    import numpy as np
    from pyspark.ml.regression import GBTRegressor

    from equimap.operators import shapley

    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (120, 4)).astype(float)
    y = x[:, 0] * x[:, 1] + (x[:, 2] > 2) * 5 - x[:, 3] + rng.normal(size=120)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double")
    cols = ["a", "b", "c", "d"]
    model = GBTRegressor(maxDepth=4, maxIter=4, seed=42, labelCol="y").fit(shapley.assembled(df, cols))

    def expected(node, row, known):
        if node.numDescendants() == 0:
            return float(node.prediction())
        kids = (node.leftChild(), node.rightChild())
        f = node.split().featureIndex()
        if f in known:
            return expected(kids[int(row[f] > node.split().threshold())], row, known)
        n = [float(k.impurityStats().count()) for k in kids]
        return sum(w * expected(k, row, known) for w, k in zip(n, kids)) / sum(n)

    roots = [(w, t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees)]
    got, mean = shapley.values(shapley.forest_of(model), x)
    predicted = {r.id: r.prediction for r in model.transform(shapley.assembled(df, cols)).collect()}
    assert all(got[i].sum() + mean == pytest.approx(predicted[i]) for i in range(120))
    for i in (0, 17, 63):
        f = {s: sum(w * expected(r, x[i], s) for w, r in roots) for n in range(5) for s in map(frozenset, itertools.combinations(range(4), n))}
        for j in range(4):
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (f[s | {j}] - f[s]) for s in f if j not in s)
            assert got[i, j] == pytest.approx(want, abs=1e-9)
    c = shapley.shapley(df, "id", cols, "y", depth=4, rounds=4)
    table = {(r.id, r.feature): r.contribution for r in c.collect()}
    assert table[17, "a"] == pytest.approx(got[17, 0]) and table[17, "mean"] == pytest.approx(mean)
    top = sorted(shapley.strongest(c.filter("id = 17"), "id", 3).collect(), key=lambda r: r["rank"])
    assert [r.feature for r in top] == [cols[j] for j in np.argsort(-np.abs(got[17]))[:3]]
    partners = {r.feature: r.partner for r in shapley.dependence(c, df, "id", cols).collect()}
    assert len(partners) == 4 and partners["a"] == "b"
