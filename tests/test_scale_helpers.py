"""Positions, ids, quantiles, nearest joins and name matching against brute force."""

from difflib import SequenceMatcher, get_close_matches

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions import geo
from panelcast.operators import matching, quantiles, ranking, spatial


def test_ids_are_dense_with_a_hot_copy(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    ids = [r["i"] for r in ranking.sequential_id(df, "i", chunk=64).collect()]
    assert sorted(ids) == list(range(1, 3001))


def test_copies_are_unrolled_by_many_tasks(spark, monkeypatch):
    """Blocks of copies are tiny until they are unrolled; their tasks follow the number of rows."""
    monkeypatch.setattr(ranking, "UNROLLED", 20_000)
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"))
    ids = ranking.sequential_id(df, "i", chunk=1000)
    tasks = [r["n"] for r in ids.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(tasks) >= 8 and max(tasks) <= 60_000
    assert ids.agg(F.count(F.lit(1)), F.countDistinct("i"), F.min("i"), F.max("i")).first()[:] == (200_000, 200_000, 1, 200_000)


def test_distinct_numbers_are_counted_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task counts more distinct numbers than its share, whatever their bytes."""
    from panelcast.catalog.indicator_queries import linelist_defaults
    monkeypatch.setattr(ranking, "UNROLLED", 1000)
    spark.range(12_000).select(F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, CAST(id % 3 AS INT))").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    result = linelist_defaults(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in result._jdf.queryExecution().executedPlan().toString()
    assert "(Semaine_Epi" in "".join(p for p in result._jdf.queryExecution().executedPlan().toString().split("hashpartitioning") if ", 12)" in p)
    assert [(r["n"], r["n_ids"]) for r in result.collect()] == [(12_000, 12_000)]


def test_rank_equals_sorting(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.integers(0, 50, 2000).astype(float), "b": np.arange(2000)})
    pdf.loc[::3, "a"] = 7.0
    got = ranking.global_rank(spark.createDataFrame(pdf), ["a", "b"], "r").toPandas().sort_values("r")
    expected = pdf.sort_values(["a", "b"])
    assert list(got["r"]) == list(range(1, 2001)) and list(got["b"]) == list(expected["b"])


@pytest.mark.parametrize("shape", ["normal", "ties", "nulls", "single", "hot"])
def test_exact_quantiles(spark, shape):
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=5000), "ties": rng.integers(0, 4, 5000).astype(float),
              "nulls": np.where(rng.random(5000) < 0.5, np.nan, rng.normal(size=5000)), "single": np.array([3.5]),
              "hot": np.where(np.arange(5000) % 3 == 0, 1.25, rng.normal(size=5000))}[shape]
    df = spark.createDataFrame([(None if np.isnan(v) else float(v),) for v in values], "v double").withColumn("e", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.5, 0.75, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, ["v", "e"], probs)
    assert np.allclose(got["v"], np.nanquantile(values, probs)) and got["e"] == [None] * 6
    assert quantiles.exact_quantile(df, "v", 0.9) == pytest.approx(got["v"][4])
    assert quantiles.exact_quantile(df, "e", 0.9) is None


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 4)
    rng = np.random.default_rng(2)
    n = 240
    xy = np.r_[rng.normal(0, 1e-3, (n // 3, 2)), rng.uniform(-50, 50, (n - n // 3, 2))]
    pdf = pd.DataFrame({"health_area": [f"a{i:03d}" for i in range(n)], "x": xy[:, 0], "y": xy[:, 1]})
    got = spatial.build_neighbour_weights(spark.createDataFrame(pdf), 5, "x", "y").toPandas()
    assert np.allclose(got.groupby("health_area")["weight"].sum(), 1.0)
    found = got.groupby("health_area")["neighbor"].apply(set)
    for i in range(n):
        d = np.hypot(*(xy - xy[i]).T)
        d[i] = np.inf
        assert found[f"a{i:03d}"] == {f"a{j:03d}" for j in np.argsort(d, kind="stable")[:5]}


def test_few_areas_use_all_the_others(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 2.0)], "health_area string, x double, y double")
    assert spatial.build_neighbour_weights(df, 5, "x", "y").count() == 6


def test_nearest_line_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 4)
    rng = np.random.default_rng(3)
    points = rng.uniform(0, 10, (80, 2))
    lines = np.c_[rng.uniform(0, 10, (60, 2)), np.zeros((60, 2))]
    lines[:, 2:] = lines[:, :2] + rng.normal(0, 2, (60, 2))
    lines[0, 2:] = lines[0, :2]  # a segment without length
    areas = spark.createDataFrame(pd.DataFrame({"health_area": [f"a{i}" for i in range(80)], "longitude": points[:, 0], "latitude": points[:, 1]}))
    segments = spark.createDataFrame(pd.DataFrame(lines, columns=["x1", "y1", "x2", "y2"]))
    got = spatial.distance_to_lines(areas, segments).toPandas().set_index("health_area")["distance_km"]
    start, step = lines[:, :2], lines[:, 2:] - lines[:, :2]
    length = np.maximum((step ** 2).sum(1), 1e-300)
    for i, p in enumerate(points):
        t = np.clip(((p - start) * step).sum(1) / length, 0, 1)
        assert got[f"a{i}"] == pytest.approx(np.hypot(*(p - start - t[:, None] * step).T).min() * 111)


def test_holes_and_parts(spark):
    def ring(*p):
        return [{"x": float(a), "y": float(b)} for a, b in p]
    outer = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    hole = ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))
    island = ring((20, 0), (20, 2), (22, 2), (22, 0), (20, 0))  # clockwise
    layer = spark.createDataFrame([("Z", [[outer, hole], [island]])], f"health_area string, polygons {geo.MULTIPOLYGON_TYPE}")
    cells = spark.createDataFrame([(1.0, 1.0, 2.0), (5.0, 5.0, 9.0), (21.0, 1.0, 4.0), (15.0, 1.0, 8.0), (2.0, 2.0, None)], "x double, y double, value double")
    row = spatial.zonal_statistics(cells, layer, ("mean", "sum", "count")).first()
    assert (row["mean"], row["sum"], row["count"]) == (3.0, 6.0, 2)
    m = layer.select(geo.polygon_measures("polygons").alias("m")).first()["m"]
    assert m["area"] == pytest.approx(100 - 4 + 4)
    assert m["cx"] == pytest.approx((100 * 5 - 4 * 5 + 4 * 21) / 100)


def test_mollweide_roundtrip_and_area(spark):
    df = spark.createDataFrame([(12.5, 41.0), (-70.0, -33.0), (0.0, 0.0), (10.0, 89.0)], "lon double, lat double")
    p = df.withColumn("p", geo.to_mollweide("lon", "lat")).withColumn("b", geo.from_mollweide(F.col("p.x"), F.col("p.y")))
    for r in p.collect():
        assert r["b"]["x"] == pytest.approx(r["lon"], abs=1e-5) and r["b"]["y"] == pytest.approx(r["lat"], abs=1e-5)
    # equal-area: a box of small steps has the area of the spherical zone
    box = spark.range(1).select(F.lit("a").alias("health_area"), F.array(F.array(geo.box_ring(F.lit(5.0), F.lit(0.0), F.lit(5.5), F.lit(0.5)))).alias("polygons"))
    sphere = (6378.137 ** 2) * np.radians(0.5) * np.sin(np.radians(0.5))
    assert spatial.area_geometry(box).first()["Superficie_km2"] == pytest.approx(sphere, rel=1e-3)


NAMES = ["abala", "abalak", "tahoua", "tahoua est", "niamey-3", "niamey_4", "zinder", "zindér", "diffa", "n'guigmi", "maradi", "maradi ville",
         "agadez", "tillabéri", "tillaberi", "dosso", "dossó sud"]
DIRTY = ["Abala", "abalac", "tahoa", "tahoua ouest", "niamey 3", "zindr", "difa", "nguigmi", "maradi vile", "agades", "tilaberi", "xyz", "dosso sud",
         "maradj", "zinderr", "tahouaa", "agadezz"]


def test_best_match_equals_a_full_scan(spark, monkeypatch):
    monkeypatch.setattr(matching, "FRAGMENT", 5)  # several fragments on both sides
    layer = spark.createDataFrame([(n,) for n in NAMES], "health_area string")
    cases = spark.createDataFrame([(n,) for n in DIRTY], "raw string")
    got = {r["raw_name"]: r["score"] for r in matching.best_matches(cases, "raw", layer).collect()}
    import unicodedata

    def plain(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s.strip().lower()) if unicodedata.category(c) != "Mn")
        return s.replace("-", " ").replace("_", " ")
    for d in DIRTY:
        best = max(SequenceMatcher(None, plain(d), plain(n)).ratio() * 100 for n in NAMES)
        assert (got[d] is None) == (best < 70) and (got[d] is None or got[d] == pytest.approx(best))


def test_suggestions_equal_get_close_matches(spark):
    layer = spark.createDataFrame([(n,) for n in NAMES], "health_area string")
    cases = spark.createDataFrame([(n,) for n in DIRTY + NAMES[:3]], "health_area string")
    for r in matching.unmatched_report(cases, layer).collect():
        close = get_close_matches(r["health_area"], NAMES, n=1, cutoff=0.7)
        assert bool(close) == (r["suggestion"] is not None)
        if close:
            assert SequenceMatcher(None, r["suggestion"], r["health_area"]).ratio() == pytest.approx(
                SequenceMatcher(None, close[0], r["health_area"]).ratio())


def test_strict_mapping_is_conservative(spark):
    layer = spark.createDataFrame([(n,) for n in ("tahoua centre", "zinder", "maradi ville 1", "maradi ville 2")], "health_area string")
    cases = spark.createDataFrame([("tahoua centree",), ("zzinder",), ("maradi ville 3",), ("zinder",)], "health_area string")
    got = {r["raw_name"]: r["health_area"] for r in matching.build_auto_health_area_mapping(layer, cases).collect()}
    assert got == {"tahoua centree": "tahoua centre"}  # other prefix, or several rivals: left alone
    fixed = matching.apply_mapping(cases, matching.build_auto_health_area_mapping(layer, cases))
    assert "tahoua centre" in {r[0] for r in fixed.collect()}


def test_match_areas_keeps_rows(spark):
    layer = spark.createDataFrame([("zinder",), ("diffa",)], "health_area string")
    cases = spark.createDataFrame([("Zindér", 1), ("Zindér", 2), ("qqq", 3)], "aire string, n int")
    got = {(r["n"], r["health_area"]) for r in matching.match_areas(cases, "aire", layer).collect()}
    assert got == {(1, "zinder"), (2, "zinder"), (3, None)}
    counts = matching.match_counts(matching.best_matches(cases, "aire", layer)).first()
    assert tuple(counts) == (2, 1, 1)


def test_fingerprint_depends_on_the_names_alone(spark):
    layer = spark.range(500).select(F.format_string("a%d", "id").alias("health_area"))
    whole = matching.layer_fingerprint(layer).first()[0]
    assert len(whole) == 12 and whole == matching.layer_fingerprint(layer.orderBy(F.desc("health_area")).unionByName(layer)).first()[0]
    assert whole != matching.layer_fingerprint(layer.where("health_area != 'a7'")).first()[0]


def test_quantiles_of_growing_sets(spark, monkeypatch):
    """Segments and their unions in the same passes, with few bits a pass; ties, both zeros, infinities, nulls."""
    monkeypatch.setattr(quantiles, "FEW", 8)
    monkeypatch.setattr(quantiles, "CELLS", 4096)
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 4)), float(v), float(rng.integers(0, 3)), None) for v in rng.standard_cauchy(3000)]
    rows += [(0, 0.0, -0.0, None), (1, float("inf"), 0.0, None), (2, float("-inf"), 1.0, None), (3, float("nan"), None, None), (None, 7.0, 7.0, None)]
    df = spark.createDataFrame(rows, "s int, a double, b double, e double").repartition(5)
    sets = {"first": [0], "two": [0, 1], "all": [0, 1, 2, 3], "none": []}
    got = quantiles.quantiles_of_sets(df, ["a", "b", "e"], [0.1, 0.5, 0.999], sets, F.col("s"))
    for name, members in sets.items():
        for i, c in enumerate("abe"):
            values = [r[1 + i] for r in rows if r[0] in members and r[1 + i] is not None and not np.isnan(r[1 + i])]
            want = np.quantile(values, [0.1, 0.5, 0.999]).tolist() if values else [None] * 3
            assert got[name][c] == (pytest.approx(want) if values else want)


def test_quantiles_of_many_distinct_values(spark, monkeypatch):
    """Two million distinct values and a column that holds one value in a third of its rows: no pass gathers more than its table of counts."""
    df = spark.range(2_000_000, numPartitions=8).select((F.xxhash64("id") / 1e6).alias("v"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7).alias("w"))
    pdf = df.toPandas()
    got = quantiles.exact_quantiles(df, ["v", "w"], [0.0, 0.25, 0.5, 1.0])
    for c in "vw":
        assert got[c] == pytest.approx(np.quantile(pdf[c], [0.0, 0.25, 0.5, 1.0]).tolist(), rel=1e-12)


def test_indexed_names_equal_the_full_comparison(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdeinorst "), int(rng.integers(1, 18))))
    layer = sorted({word() for _ in range(250)} | {"banana banana", "banana", "ana ana ana", "a", "", "\u00e9t\u00e9 \U0001f600 nord"})
    names = [None, "", "a", "bananana", "ana ana an"]
    for name in layer:
        for _ in range(2):  # a letter dropped, doubled or replaced
            at = int(rng.integers(0, len(name) + 1))
            names.append(name[:at] + str(rng.choice(["", "x", name[at:at + 1] * 2])) + name[at + int(rng.integers(0, 2)):])
    left, right = spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(n,) for n in layer], "n string")
    for cutoff, keep, first in ((0.9, 5, True), (0.7, 1, False), (0.7, 3, True), (0.95, 2, False)):
        got = {}
        for r in matching.score_names(left, right, cutoff, keep, first).orderBy("rank").collect():
            got.setdefault(r["key"], []).append((r["score"], r["cand"]))
        want = {}
        for key in {n for n in names if n}:
            scores = [(matching.similarity(c, key) if first else matching.similarity(key, c), c) for c in layer]
            best = sorted([p for p in scores if p[0] >= cutoff], key=lambda p: (-p[0], p[1]))[:keep]
            if best:
                want[key] = best
        assert got == want and len(want) > 100


def test_indexed_names_do_not_meet_all(spark):
    """Few candidate pairs per name reach the comparison."""
    names = spark.range(3000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("cand"))
    keys = names.select(F.concat(F.substring("cand", 1, 15), F.lit("z")).alias("key"))
    every = []
    ratio = matching._pair_ratio
    try:
        matching._pair_ratio = lambda a, b: F.lit(1.0)
        every = matching._indexed(keys, names, 0.9, True).count()
    finally:
        matching._pair_ratio = ratio
    assert 3000 <= every < 3000 * 3000 / 20
    assert matching._indexed(keys, names, 0.9, True).where("substring(key, 1, 15) = substring(cand, 1, 15)").count() == 3000


@pytest.mark.parametrize("crowd", [200, 1])
def test_half_names_lose_no_match(spark, monkeypatch, crowd):
    """Names of 4 to 26 letters with up to four letters left out or put in, also where halves are shared by many."""
    monkeypatch.setattr(matching, "CROWD", crowd)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    layer = {word(int(rng.integers(4, 27))) for _ in range(120)} | {"site_" + word(6) for _ in range(60)}
    names = set()
    for name in sorted(layer):
        for edits in (1, 2, 3, 4):
            new = name
            for _ in range(edits):
                at = int(rng.integers(0, len(new) + 1))
                new = new[:at] + (new[at + 1:] if rng.random() < 0.5 else "x" + new[at:])
            names.add(new)
    names = sorted(n for n in names if len(n) >= 4)
    left, right = spark.createDataFrame([(n,) for n in names], "key string"), spark.createDataFrame([(n,) for n in sorted(layer)], "cand string")
    got = {(r["key"], r["cand"]): r["score"] for r in matching._indexed(left, right, 0.9, True).collect()}
    want = {(k, c): s for k in names for c in layer if (s := matching.similarity(c, k)) >= 0.9}
    assert got == want and len(want) > 200


def test_candidate_pairs_grow_with_the_names(spark, monkeypatch):
    """Twice the names, about twice the pairs that reach the comparison."""
    monkeypatch.setattr(matching, "_pair_ratio", lambda a, b: F.lit(1.0))
    names = spark.range(6000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("cand"))
    keys = names.select(F.concat(F.substring("cand", 1, 15), F.lit("z")).alias("key"))
    assert 6000 <= matching._indexed(keys, names, 0.9, True).count() < 1.1 * 6000


def test_long_segments_meet_few_points(spark, monkeypatch):
    """Segments far longer than their distance from each other: every nearest distance is exact, few targets reach a point's cell."""
    monkeypatch.setattr(spatial, "HOME", 0)  # as deep as the targets
    rng = np.random.default_rng(3)
    ends = rng.uniform(0, 100, (1500, 2))
    lines = np.c_[ends, ends + rng.uniform(-8, 8, (1500, 2))]
    spots = np.r_[rng.uniform(-10, 110, (300, 2)), np.full((3, 2), 50.0)]
    points = spark.createDataFrame([(f"p{i}", *map(float, p)) for i, p in enumerate(spots)], "pid string, px double, py double")
    targets = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(lines)], "tid bigint, x1 double, y1 double, x2 double, y2 double")
    met = []
    real = spatial._nearest_rows

    def counted(wanted):
        inner, seen = real(wanted), spark.sparkContext.accumulator(0)
        met.append(seen)

        def nearest(a, b):
            seen.add(len(a) * len(b))
            return inner(a, b)
        return nearest

    spatial._nearest_rows = counted
    try:
        got = spatial.k_nearest(points, targets, 2).toPandas().sort_values(["pid", "rank"])
    finally:
        spatial._nearest_rows = real
    dx, dy = lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]
    for i, (x, y) in enumerate(spots):
        t = np.clip(((x - lines[:, 0]) * dx + (y - lines[:, 1]) * dy) / (dx * dx + dy * dy), 0, 1)
        want = np.sort(np.hypot(x - lines[:, 0] - t * dx, y - lines[:, 1] - t * dy))[:2]
        assert np.allclose(got[got["pid"] == f"p{i}"]["distance"], want)
    assert 0 < met[0].value < len(spots) * len(lines) / 4


def test_neighbours_of_copies_and_crowds(spark, monkeypatch):
    """Coincident, repeated and unplaced rows against all pairs; groups of points are cut."""
    monkeypatch.setattr(spatial, "CROWD", 7)
    monkeypatch.setattr(spatial, "BLOCK", 50)
    rows = [(f"a{i:02d}", float(i % 3), float(i % 2)) for i in range(40)] + [("a01", 1.0, 1.0), ("a01", 1.0, 1.0), ("z", 9.0, 9.0)]
    points = spark.createDataFrame(rows, "pid string, px double, py double")
    targets = spatial.as_targets(points, "pid", "px", "py")
    for k, self_out in ((1, False), (5, True)):
        got = {}
        for r in spatial.k_nearest(points, targets, k, self_out).orderBy("rank").collect():
            got.setdefault(r["pid"], []).append((r["distance"], r["tid"]))
        for pid in {r[0] for r in rows}:
            every = sorted((float(np.hypot(p[1] - t[1], p[2] - t[2])), t[0]) for p in rows if p[0] == pid for t in rows if not (self_out and t[0] == pid))
            assert got[pid] == every[:k]
