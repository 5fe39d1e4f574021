import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.operators import environment, inference, nearest, presence, propagation, ranking, sampling


def test_sampling(spark):
    df = spark.range(100).selectExpr("id as k", "id % 10 as loc")
    assert sampling.exact_sample(df, ["k"], 1.0).count() == 100 and sampling.exact_sample(df, ["k"], 0.001).count() == 1
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            sampling.exact_sample(df, ["k"], bad)
    train, val = sampling.split(df, ["loc"], 0.25)
    a, b = ({r["loc"] for r in x.select("loc").distinct().collect()} for x in (train, val))
    assert not a & b and len(b) == 3 and train.count() + val.count() == 100
    assert sampling.cap_observations(df.selectExpr("k", "loc as species"), 4, ["k"]).count() == 40


def test_weeks_there_and_back(spark):
    occ = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 1, "a"), (1, 48, "c"), (2, 49, "x"), (2, 0, "x")], "cell int, week int, species string")
    cells = spark.createDataFrame([(1,), (2,)], "cell int")
    sets = presence.species_sets(occ)
    wide = presence.wide_weeks(sets, cells).collect()
    assert {r["cell"]: (r["week_1"], r["week_2"], r["week_48"]) for r in wide} == {1: (["a", "b"], [], ["c"]), 2: ([], [], [])}
    assert presence.long_weeks(presence.wide_weeks(sets, cells), ["cell"]).count() == 96
    assert {tuple(r["species"]) for r in presence.with_yearly(sets).where("week = 0").collect()} == {("a", "b", "c")}


def test_imputation(spark):
    """Column by column, only beside other values, by straight degree distance: polar and lonely cells too."""
    rows = [
        (1, 0.0, 179.9, None, 4), (2, 0.0, -179.9, 10.0, 5), (3, 0.1, 179.0, 20.0, 5), (4, 1.0, 178.0, 60.0, 7), (5, 50.0, 0.0, 1.0, None),
        (6, 3.0, 177.0, None, None), (7, 89.5, -170.0, None, 5), (8, 89.0, 170.0, 40.0, None),
    ]
    df = spark.createDataFrame(rows, "cell int, lat double, lon double, elevation double, landcover int")
    got = {r["cell"]: (r["elevation"], r["landcover"]) for r in environment.impute(df, ["elevation"], ["landcover"]).collect()}
    # 1: cells 3, 4 and 8, as the date line is not crossed; 5 and 8: the mode of three different classes is the smallest
    assert got[1] == (40.0, 4) and got[6] == (None, None) and got[2] == (10.0, 5)
    d = lambda a, b: (rows[a - 1][1] - rows[b - 1][1]) ** 2 + (rows[a - 1][2] - rows[b - 1][2]) ** 2
    for c, column in ((1, 3), (7, 3), (5, 4), (8, 4)):
        near = sorted((r for r in rows if r[column] is not None), key=lambda r: (d(c, r[0]), r[0]))[:3]
        values = [r[column] for r in near]
        assert got[c][column - 3] == (sum(values) / 3 if column == 3 else min(values, key=lambda v: (-values.count(v), v)))


def test_nearest_in_many_shards(spark, monkeypatch):
    import random

    monkeypatch.setattr(nearest, "SHARD_ROWS", 20)
    monkeypatch.setattr(nearest, "ASKED_ROWS", 9)
    rng = random.Random(4)
    place = lambda: rng.choice([0.0, 0.5, rng.gauss(0, 1)])
    asked = [(i, i % 2, place(), place()) for i in range(120)]
    seen = [(i, i % 3, place(), place()) for i in range(300)]
    a = spark.createDataFrame(asked, "q int, g int, x double, y double")
    s = spark.createDataFrame(seen, "near int, g int, x double, y double")
    got = {(r["q"], r["rn"], r["near"]) for r in nearest.k_nearest(a, s, ["g"], ["q"], ["x", "y"], "near", 5).collect()}
    want = set()
    for q, g, x, y in asked:
        best = sorted((round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 9), n) for n, h, u, v in seen if h == g)[:5]
        want |= {(q, r, n) for r, (_, n) in enumerate(best, 1)}
    assert got == want
    few = nearest.k_nearest(a, s.where("near < 3"), ["g"], ["q"], ["x", "y"], "near", 5)
    assert few.count() == 120 and nearest.k_nearest(a.limit(0), s, ["g"], ["q"], ["x", "y"], "near", 5).count() == 0


def samples(spark, rows):
    return spark.createDataFrame(rows, "cell int, week int, lat double, lon double, species array<string>, e double")


def test_propagation_gates(spark):
    seen = (1, 5, 0.0, 0.0, ["a", "b"], 1.0)
    near, far, other_week = (2, 5, 0.2, 0.2, ["a"], 1.0), (3, 5, 60.0, 60.0, [], 1.0), (4, 6, 0.1, 0.1, [], 1.0)
    unlike = (5, 5, 0.1, 0.1, [], 50.0)
    df = samples(spark, [seen, near, far, other_week, unlike])
    run = lambda **k: {r["cell"]: r["species"] for r in propagation.propagate(df, ["e"], **({"k": 5, "radius_km": 1000.0, "least": 2, "spread": 2.0, "env_dist_max": 1.0, "cap_km": 500.0} | k)).collect()}
    assert run() == {1: ["a", "b"], 2: ["a", "b"], 3: [], 4: [], 5: []}
    assert run(env_dist_max=0)[5] == ["a", "b"]
    assert run(spread=0, radius_km=1e6)[3] == ["a", "b"]
    assert run(spread=0.1)[2] == ["a"]
    assert run(least=0) == {1: ["a", "b"], 2: ["a"], 3: [], 4: [], 5: []}
    assert run(least=9) == {1: ["a", "b"], 2: ["a"], 3: [], 4: [], 5: []}


def test_range_floor(spark):
    one = spark.createDataFrame([("a", 1.0, 1.0)], "species string, lat double, lon double")
    assert propagation.species_ranges(one, 2.0, 500.0).first()["max_km"] == 100.0


def test_round_robin(spark):
    rows = [(0, i % 3 != 0, i + 1, i) for i in range(9)] + [(1, i % 3 != 0, 9 - i, i) for i in range(9)]
    ranked = spark.createDataFrame(rows, "region_id int, is_bird boolean, rank int, idx int")
    picks = [(r["region_id"], r["idx"]) for r in ranking.round_robin(ranked, 20).orderBy("pick").collect()]
    assert picks == [(0, 1), (0, 2), (0, 4), (0, 5), (0, 0), (1, 8), (1, 7), (1, 6), (0, 3)]
    assert ranking.round_robin(ranked, 3).count() == 3
    chosen = spark.createDataFrame([(0,), (1,)], "idx int")
    scores = spark.createDataFrame([("r", 0, 0.5), ("r", 2, 0.5), ("r", 1, 0.01)], "name string, idx int, score double")
    assert tuple(ranking.region_coverage(scores, chosen).first()) == ("r", 2, 1, 50.0)


def test_forward_pass(spark):
    x = np.linspace(-4, 4, 81)
    assert np.abs(inference.erf(x) - [math.erf(v) for v in x]).max() < 2e-7
    w = inference.random_weights(7)
    points = spark.createDataFrame([(10.0, 20.0, 1), (-5.0, 100.0, 48)], "lat double, lon double, week int")
    got = {r["week"]: r["probs"] for r in inference.predict(points, w).collect()}
    want = inference.forward(w, np.array([10.0, -5.0]), np.array([20.0, 100.0]), np.array([1, 48]))
    assert np.allclose([got[1], got[48]], want) and ((want > 0) & (want < 1)).all()
    s = inference.sizes(0.5)
    assert (s.embed, s.bottleneck, s.env, s.encoder_blocks, s.species_blocks, s.env_blocks) == (256, 64, 128, 2, 1, 1)
    assert inference.sizes(2.0).embed == 1024 and abs(inference.sizes(2.0).dropout - 0.125) < 1e-12


def test_robust_range(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(float(i),) for i in range(1, 5)], "x double")
    r = environment.robust_range(df, "x", 0.0, 1.0).first()
    assert (r["vmin"], r["vmax"]) == (1.0, 4.0)
    assert environment.drop_all_null(df.withColumn("y", F.lit(None).cast("int"))).columns == ["x"]


def test_samples_are_filters(spark, monkeypatch):
    """The last draw is found by counts, in slots within slots."""
    monkeypatch.setattr(sampling, "EDGE_ROWS", 3)
    monkeypatch.setattr(sampling, "SLOT_DIGITS", 1)
    df = spark.range(500).selectExpr("id as k")
    order = [r["k"] for r in df.orderBy(sampling.draw_order(F.col("k"), seed=7), "k").collect()]
    for count in (1, 2, 17, 250, 499, 500, 900):
        drawn = sampling.exact_sample(df, ["k"], count=count, seed=7)
        assert {r["k"] for r in drawn.collect()} == set(order[:count])
        assert "TakeOrdered" not in drawn._jdf.queryExecution().toString()
    assert sampling.exact_sample(df.limit(0), ["k"], 0.5).count() == 0 and sampling.exact_sample(df, ["k"], count=0).count() == 0


def test_cap_of_a_common_species(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SLOT_DIGITS", 1)
    rows = spark.range(1000).selectExpr("id as k", "case when id % 10 < 8 then 'common' when id % 10 = 8 then null else concat('s', id % 100) end as species")
    draw = sampling.draw_order(F.col("k"), F.col("species"))
    want = {}
    for r in rows.orderBy(draw, "k").collect():
        want.setdefault(r["species"], []).append(r["k"])
    for most in (1, 9, 10, 100, 799, 800, 5000):
        got = {}
        for r in sampling.cap_observations(rows, most, ["k"]).collect():
            got.setdefault(r["species"], set()).add(r["k"])
        assert got == {s: set(k[:most]) for s, k in want.items()}


def test_running_totals_of_groups(spark, monkeypatch):
    """A group with most rows lies in many ranges; null groups and ties count too."""
    from phenogrid.operators import totals

    monkeypatch.setattr(totals, "RANGE_ROWS", 50)
    rng = np.random.default_rng(3)
    rows = [(i, "big" if rng.random() < 0.7 else [None, "a", "b"][rng.integers(3)], float(rng.integers(0, 400)) / 7, int(rng.integers(0, 5))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, g string, x double, v int")
    out = totals.running_totals(df, "x", ["i"], {"n": F.lit(1), "s": F.col("v")}, ("g",))
    seen = {}
    want = {}
    for i, g, x, v in sorted(rows, key=lambda r: (r[2], r[0])):
        n, s = seen.get(g, (0, 0))
        seen[g] = want[i] = (n + 1, s + v)
    assert {r["i"]: (r["n"], r["s"]) for r in out.collect()} == want


def test_sampled_negatives_stand_for_all(spark):
    from phenogrid.operators import losses

    rng = np.random.default_rng(1)
    rows = [(s, i, float(rng.normal()), float(rng.random() < 0.1)) for s in range(40) for i in range(300)]
    df = spark.createDataFrame(rows, "sample int, idx int, logit double, target double")
    whole = losses.assume_negative(df, "sample").first()[0]
    some = losses.assume_negative(df, "sample", negatives=200, idx="idx").first()[0]
    assert some != whole and abs(some / whole - 1) < 0.03
    assert losses.assume_negative(df, "sample", negatives=300, idx="idx").first()[0] == pytest.approx(whole)


def test_names_are_found_by_rare_runs(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abc é"), rng.integers(0, 7)))
    labels = [(i, f"c{i:03d}", word().upper(), word()) for i in range(300)]
    asked = ["", "a", " B ", "ab", "abc", "cab a", "ÉÉ", "C01", "zzz", "c005", "a.c", "%", "bca"]
    df = spark.createDataFrame(labels, "idx int, code string, sci string, com string")
    q = spark.createDataFrame([(x,) for x in asked], "query string")
    found = ranking.matches(df, q)
    want = {(x, i) for x in asked for i, *names in labels if any(x.strip().lower() in n.lower() for n in names)}
    assert {(r["query"], r["idx"]) for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_turns_take_what_is_left(spark):
    rng = np.random.default_rng(6)
    labels = [(i, f"c{i}", "".join(rng.choice(list("ab"), 4)), "x") for i in range(25)]
    turns = [(t, "".join(rng.choice(list("ab"), rng.integers(1, 4)))) for t in range(40)]
    got = {r["turn"]: r["idx"] for r in ranking.resolve_each(spark.createDataFrame(labels, "idx int, code string, sci string, com string"), spark.createDataFrame(turns, "turn int, query string")).collect()}
    taken, want = set(), {}
    for t, q in turns:
        free = [i for i, c, sci, com in labels if q in sci and i not in taken]
        if free:
            want[t] = free[0]
            taken.add(free[0])
    assert got == want and len(want) < 40


def test_network_by_definition(spark):
    """The forward pass of all heads, point by point and number by number."""
    w = inference.random_weights(6, n_env=3, habitat=True, seed=4)

    def dense(x, layer):
        return [sum(x[i] * layer[0][i][j] for i in range(len(x))) + layer[1][j] for j in range(len(layer[1]))]

    def norm(x, layer):
        mean = sum(x) / len(x)
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x) + 1e-4)
        return [(v - mean) / spread * g + b for v, g, b in zip(x, *layer)]

    def gelu(x):
        return [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]

    def block(x, b):
        inner = dense(gelu(norm(x, b["norm_a"])), b["a"])
        return [v + u for v, u in zip(x, dense(gelu(norm(inner, b["norm_b"])), b["b"]))]

    def head(x, h):
        x = x if h["input"] is None else dense(x, h["input"])
        for b in h["blocks"]:
            x = block(x, b)
        x = norm(x, h["norm"])
        return dense(gelu(dense(x, h["squeeze"])) if "squeeze" in h else x, h["out"])

    def waves(angle):
        return [f(k * angle) for f in (math.sin, math.cos) for k in range(1, w["harmonics"] + 1)]

    def network(lat, lon, week):
        x = dense(waves(math.radians(lat)) + waves(math.radians(lon)), w["input"])
        when = waves(2 * math.pi * (week - 1) / 48)
        for b in w["blocks"]:
            film = dense(gelu(dense(when, b["film_a"])), b["film_b"])
            n = len(film) // 2
            x = [v * (1 + math.tanh(g)) + s for v, g, s in zip(block(x, b), film[:n], film[n:])]
        x = norm(x, w["norm"])
        env = head(x, w["env"])
        mixed = [g * a + (1 - g) * b for g, a, b in zip([1 / (1 + math.exp(-v)) for v in dense(x, w["gate"])], head(x, w["species"]), head(env, w["habitat"]))]
        return [1 / (1 + math.exp(-v)) for v in mixed], env

    points = [(10.0, 20.0, 1), (-85.0, 179.5, 30), (0.0, 0.0, 48)]
    got = {r["week"]: (r["probs"], r["env"]) for r in inference.predict(spark.createDataFrame(points, "lat double, lon double, week int"), w).collect()}
    for lat, lon, week in points:
        probs, env = network(lat, lon, week)
        assert np.allclose(got[week][0], probs, atol=1e-5) and np.allclose(got[week][1], env, atol=1e-4)
    assert "env" not in inference.predict(spark.createDataFrame(points, "lat double, lon double, week int"), inference.random_weights(4)).columns


def test_places_of_texts(spark):
    from phenogrid.operators import totals

    rng = np.random.default_rng(9)
    texts = sorted({"".join(rng.choice(list("abé "), rng.integers(0, 9))) for _ in range(500)} | {"", "\U0001f600", "zz"}, key=lambda s: s.encode())
    rows = totals.text_ranks(spark.createDataFrame([(t,) for t in texts], "t string").repartition(5), "t", "place", width=2).collect()
    assert {r["t"]: r["place"] for r in rows} == {t: i + 1 for i, t in enumerate(texts)}


def test_copies_are_searched_once(spark, monkeypatch):
    """Rows at one place find the first by name, and the search sees neither more of them nor places twice."""
    from phenogrid.operators import nearest

    sizes, inner = [], nearest._nearest_to_places

    def counted(asked, seen, *rest):
        sizes.append((asked.count(), seen.count()))
        return inner(asked, seen, *rest)

    monkeypatch.setattr(nearest, "_nearest_to_places", counted)
    place = ("1 as g", "id % 2 * 1.0D as x", "0.0D as y")
    got = nearest.k_nearest(spark.range(1000).selectExpr("id as cell", *place), spark.range(2000).selectExpr("2000 - id as near", *place), ["g"], ["cell"], ["x", "y"], "near", 3)
    rows = sorted((r["cell"], r["rn"], r["near"], r["dist"]) for r in got.collect())
    assert sizes == [(2, 6)]
    assert rows == [(c, i + 1, 2 * (i + 1) - c % 2, 0.0) for c in range(1000) for i in range(3)]


def test_places_of_one_square_are_within_reach(spark):
    """Anywhere on the globe, and for any reach, so that they need no distance."""
    from phenogrid.functions import geo
    from phenogrid.operators import propagation

    some = spark.range(40_000).selectExpr("id % 3 as kind", "element_at(array(50.0D, 500.0D, 9000.0D), cast(id % 3 + 1 as int)) as max_km", "rand(1) * 180 - 90 as lat", "rand(2) * 360 - 180 as lon").cache()
    a = some.withColumns(propagation._inner_square("lat", "lon"))
    b = some.select("kind", "max_km", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b")).withColumns(propagation._inner_square("lat_b", "lon_b")).drop("max_km")
    far = a.join(b, ["kind", "_row", "_column"]).agg(F.count("*").alias("n"), F.max(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) / F.col("max_km")).alias("m")).first()
    assert far["n"] > 40_000 and 0.5 < far["m"] <= 1


def test_heavy_rows_are_dealt_to_tasks(spark, monkeypatch):
    """Rings and points of one file are not one task's work."""
    from phenogrid.operators import inference, repair

    monkeypatch.setattr(repair, "RINGS_PER_TASK", 10)
    monkeypatch.setattr(inference, "POINTS_PER_TASK", 10)
    one = spark.range(0, 100, 1, 1)
    square = "array(struct(0.0D as lon, 0.0D as lat), struct(1.0D as lon, 0.0D as lat), struct(1.0D as lon, 1.0D as lat)) as ring"
    fixed = repair.repair_rings(one.selectExpr("id", square))
    scored = inference.predict(one.selectExpr("id * 0.5D as lat", "1.0D as lon", "1 as week"), inference.random_weights(2))
    for df in (fixed, scored):
        assert df.rdd.getNumPartitions() == 10 and df.count() == 100
