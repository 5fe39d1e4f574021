import math
import random
import statistics

from pyspark.sql import functions as F

from phenogrid.operators import propagation
from phenogrid.operators.stored import passing, stored


def test_only_what_the_result_reads_is_left(spark, tmp_path, monkeypatch):
    """Against a brute force; tables of the search, squares and pairs go when they have served."""
    from phenogrid.operators import stored as module

    monkeypatch.setattr(module, "_shared_folder", lambda spark: str(tmp_path))
    rng = random.Random(3)
    places = {c: (rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([None, rng.gauss(0, 1)])) for c in range(60)}
    rows = [(c, w, *places[c][:2], sorted(rng.sample("abcdefgh", rng.choice([1, 2, 3, 4, 5]))), places[c][2]) for c in places for w in rng.sample(range(1, 5), 3)]
    df = spark.createDataFrame(rows, "cell int, week int, lat double, lon double, species array<string>, e double")

    def km(a, b):
        x = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(x))

    known = [r[5] for r in rows if r[5] is not None]
    mean, sd = statistics.fmean(known), statistics.pstdev(known)
    z = {(r[0], r[1]): 0.0 if r[5] is None else (r[5] - mean) / sd for r in rows}
    seen = [r for r in rows if len(r[4]) >= 4]
    want = {}
    for r in rows:
        new = set()
        if len(r[4]) < 4:
            near = sorted((s for s in seen if s[1] == r[1]), key=lambda s: (round(abs(z[r[:2]] - z[s[:2]]), 9), s[0]))[:5]
            for s in near:
                if km(r, s) <= 2500 and abs(z[r[:2]] - z[s[:2]]) <= 1.5:
                    new |= {x for x in s[4] if any(x in o[4] and km(r, o) <= 400 for o in seen)}
        want[r[:2]] = sorted(set(r[4]) | new)
    out = propagation.propagate(df, ["e"], k=5, radius_km=2500.0, least=4, spread=2.0, env_dist_max=1.5, cap_km=400.0)
    assert {(r["cell"], r["week"]): r["species"] for r in out.collect()} == want and sum(map(len, want.values())) > sum(len(r[4]) for r in rows)
    assert len(list(tmp_path.iterdir())) == 4


def test_passing_tables(spark):
    with passing(spark):
        one = stored(spark.range(3))
        assert one.count() == 3
        two = stored(one.select((F.col("id") + 1).alias("id")), lasting=True)
    assert sorted(r["id"] for r in two.collect()) == [1, 2, 3]
    assert not any(spark._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f)) for f in one.inputFiles())
