from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from equimap.functions import scalar as S
from equimap.operators import models, network, spatial, stats, text
from equimap.sources import files


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_normalisation(spark):
    r = one(
        spark, a=S.minmax(F.lit(5.0), F.lit(0.0), F.lit(10.0)), b=S.minmax(F.lit(5.0), F.lit(5.0), F.lit(5.0)), c=S.zscore_clip(F.lit(100.0), F.lit(0.0), F.lit(1.0)),
        d=S.boxcox_inverse(S.boxcox(F.lit(7.0), 0.3), 0.3), e=S.boxcox_inverse(S.boxcox(F.lit(7.0), 0.0), 0.0), f=S.percentile_norm(F.lit(3.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(6.0)),
    )
    assert r.a == 0.5 and r.b == 0.0 and r.c == 3.5
    assert abs(r.d - 7) < 1e-3 and abs(r.e - 7) < 1e-3 and abs(r.f - 0.5) < 1e-6


def test_classes(spark):
    r = one(
        spark, a=S.break_class(F.lit(2.0), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), b=S.quartile_class(F.lit(5.0), F.lit(1.0), F.lit(5.0), F.lit(9.0)),
        c=S.canonical_id(F.lit(" 12.0 ")), d=S.clean_name(F.lit("Ａ（b）　# c")), e=S.axis_state(F.lit(114.0), F.lit(25.0)), f=S.urban_label(F.lit(29.0), F.lit(0.03), F.lit(0.1)),
        g=S.count_override(F.lit("IV"), F.lit(2001)), h=S.least_weight(S.class_list(F.lit("['track', 'x']")), {"track": 0.4}), i=S.network_coefficient(S.class_list(F.lit("a_b c")), {}, 0.6),
    )
    assert (r.a, r.b, r.c, r.e, r.f, r.g, r.h, r.i) == (2, "II", "12", "geographic", 0, "III", 0.4, 0.6)
    assert r.d == "Ａ(b)c"


def test_wkt_and_seats(spark):
    x, y = S.point_of_wkt(F.lit("POINT (1.5 -2e1)"))
    bad, _ = S.point_of_wkt(F.lit("LINE (1 2)"))
    r = one(spark, x=x, y=y, bad=bad, s=S.seats(F.lit(100.0), F.lit(0.5)), t=S.seats(F.lit(430.0), F.lit(2.0)))
    assert (r.x, r.y, r.bad, r.s, r.t) == (1.5, -20.0, None, 200, 450)


def test_ranks_and_running_sums(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None)], "k int, v double")
    got = {r.k: (r.rank_min, r.rank_avg) for r in stats.ranks(df, "v").collect()}
    assert got == {1: (2, 2.5), 2: (1, 1.0), 3: (2, 2.5), 4: (0, 0.0)}
    down = {r.k: r.rank_min for r in stats.ranks(df, "v", descending=True).collect()}
    assert down == {1: 1, 2: 3, 3: 1, 4: 0}


def test_gini_bounds(spark):
    even = spark.createDataFrame([(2.0, 1.0)] * 4, "v double, w double")
    one_has_all = spark.createDataFrame([(0.0, 1.0)] * 99 + [(1.0, 1.0)], "v double, w double")
    assert abs(stats.weighted_gini(even, "v", "w").first()[0]) < 1e-9
    assert abs(stats.weighted_gini(one_has_all, "v", "w").first()[0] - 0.99) < 1e-9


def test_entropy_kappa_rand(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, c string")
    got = {r.k: r.entropy for r in stats.entropy(df, ["k"], "c").collect()}
    assert abs(got[1] - math.log(2)) < 1e-9 and abs(got[2]) < 1e-9
    pairs = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (0, 1)], "a int, b int")
    k = stats.kappa(pairs, "a", "b").first()
    assert k.po == 0.75 and abs(k.kappa - 0.5) < 1e-9
    same = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "a int, b int")
    assert stats.adjusted_rand(same, "a", "b").first()[0] == 1.0


def test_folds_are_even(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    n = [r["count"] for r in stats.kfolds(df, "k", "v").groupBy("fold").count().collect()]
    assert len(n) == 5 and max(n) - min(n) <= 5


def test_knn_is_exact_when_the_radius_is_small(spark):
    pts = [(i, float((i * 37) % 101), float((i * 53) % 97)) for i in range(60)] + [(60, 5000.0, 5000.0)]
    p = spark.createDataFrame(pts, "pid int, x double, y double")
    s = p.select(F.col("pid").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    got = {(r.pid, r["rank"]): r.sid for r in spatial.knn(p, s, 3, 5.0, "pid", "sid", exclude_self=True).collect()}
    for i, x, y in pts:
        best = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in pts if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in best]


def test_rectangles_meet_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "a int, ax0 double, ay0 double, ax1 double, ay1 double")
    b = spark.createDataFrame([(1, 5.0, 5.0, 25.0, 8.0), (2, 10.0, 0.0, 12.0, 1.0)], "b int, bx0 double, by0 double, bx1 double, by1 double")
    assert [(r.b, r.area) for r in spatial.rect_pairs(a, b, 3.0).collect()] == [(1, 15.0)]


def test_shortest_paths(spark):
    e = spark.createDataFrame([(0, 1, 1.0, False, False), (1, 2, 1.0, True, False), (0, 2, 5.0, False, False)], "src long, dst long, w double, oneway boolean, reversed boolean")
    d = network.shortest(network.directed(e), spark.createDataFrame([(0,), (2,)], "node long"), 10.0)
    got = {(r.origin, r.node): r.d for r in d.collect()}
    assert got[0, 2] == 2.0 and got[2, 1] == 6.0 and got[2, 0] == 5.0


def test_two_step_keeps_supply(spark):
    od = spark.createDataFrame([(1, 1, 3.0), (2, 1, 4.0), (2, 2, 1.0)], "i long, j long, t double")
    sup = spark.createDataFrame([(1, 10.0), (2, 7.0)], "j long, s double")
    dem = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 1.0)], "i long, d double")
    got = {r.i: r.a for r in network.two_step(od, sup, dem, 5.0).collect()}
    assert abs(2 * got[1] + 5 * got[2] - 17) < 1e-9 and got[3] == 0


def test_evidence(spark):
    c = spark.createDataFrame([(1, "the robot club meets"), (2, "robot planned"), (3, "nothing")], "entity long, text string")
    lex = spark.createDataFrame([("T1a", "anchor", "robot"), ("T1a", "honor", "club")], "subdim string, kind string, term string")
    got = {r.entity: r.level for r in text.levels(text.evidence(c, lex, ["club"], ["planned"]), text.official(c, lex)).collect()}
    assert got == {1: "E1", 2: "E5"}


def test_a_self_hit_with_an_honour_is_the_first_level(spark):
    c = spark.createDataFrame([(1, "a robot lab"), (2, "a robot lab planned"), (3, "robot prize"), (4, None), (5, "")], "entity long, text string")
    lex = spark.createDataFrame([("T1a", "self", "robot"), ("T1a", "honor", "prize"), ("T1a", "honor", "lab")], "subdim string, kind string, term string")
    got = {r.entity: r.level for r in text.levels(text.evidence(c, lex, ["club"], ["planned"]), text.official(c, lex)).collect()}
    assert got == {1: "E1", 2: "E2", 3: "E1"}


def test_windows_anywhere_in_long_texts(spark):
    """Against plain search, with dense hits, windows over the pieces' ends, and letters of several bytes."""
    rng = np.random.default_rng(3)
    words = ["aé", "bb", "robot", "no", "club", "ärobotb"]
    rows = [(i, " ".join(words[k] for k in rng.choice(6, 1200, p=[0.45, 0.45, 0.04, 0.02, 0.02, 0.02]))) for i in range(4)] + [(9, "robot" * 3000 + "club"), (10, "x" * 2047 + "robot" + "y" * 50 + "club")]
    lex = spark.createDataFrame([("T1a", "anchor", "robot"), ("T2a", "self", "bot")], "subdim string, kind string, term string")
    found = text.evidence(spark.createDataFrame(rows, "entity long, text string"), lex, ["club"], ["no"])
    got = {(r.entity, r.subdim): (r.cooccur, r.self_hit) for r in found.collect()}
    for i, t in rows:
        seg = lambda term, w: [t[max(0, m.start() - w) : m.end() + w] for m in re.finditer(term, t)]  # noqa: B023, E731
        assert got[i, "T1a"] == (any("club" in s and "no" not in s for s in seg("robot", 60)), False)
        assert got[i, "T2a"] == (False, any("no" not in s for s in seg("bot", 20)))
        at = spark.createDataFrame([(t,)], "t string").select(text.positions(F.col("t"), F.lit("bot"))).first()[0]
        assert at == [m.start() + 1 for m in re.finditer("bot", t)]


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 128, 4096, 4097, 10_000):
        got = spark.range(1).select(S.running_sums(F.transform(F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: i < n), lambda i: i % 7))).first()[0]
        assert got == np.r_[0, np.cumsum(np.arange(n) % 7)].tolist()


def test_jenks(spark):
    assert models.jenks([1, 1.1, 5, 5.2, 9, 9.1, 20, 21, 40], 5) == [1.1, 5.2, 9.1, 21.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名称,v\n学校,1\n".encode("gbk"))
    assert files.detect_encoding(spark, str(tmp_path / "a.csv")) == "gbk"
    assert files.read_csv(spark, str(tmp_path / "a.csv")).first()[0] == "学校"
    df = spark.createDataFrame([(1, "-9999")], "School_ID int, v string")
    assert files.resolve(df, ["school_id"]) == "School_ID"
    with pytest.raises(KeyError):
        files.require(df, ["nope"])
    assert df.select(files.numeric(F.col("v"), 0.0, (-9999.0,))).first()[0] == 0.0
    assert files.truncated(["population_a", "population_b"]) == ["population", "populati_1"]
    assert files.write_checked(df, str(tmp_path / "out")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from equimap.streaming.windows import into_table, windowed

    ev = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-03 00:00:00", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    ev.write.parquet(str(tmp_path / "in"))
    q = into_table(windowed(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.event_type, r.n, r.total) for r in got] == [("a", 2, 3.0)]
    assert windowed(ev).count() == 2
