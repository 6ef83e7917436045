"""Steps whose work grows no faster than their input."""

from pyspark.sql import functions as F

from massflow.operators import mesh as Q
from massflow.operators import radon as R

G = R.Geometry(3, 12, 4.0)


def _brute(rows, most=9):
    found = set()
    for i, xi, yi, hi in rows:
        near = sorted((((xi - x) ** 2 + (yi - y) ** 2) ** 0.5, j, h) for j, x, y, h in rows)[:most]
        found |= {(min(i, j), max(i, j), min(hi, h), round(d, 9)) for d, j, h in near if j != i and d < 0.75 * (hi + h)}
    return found


def test_edges_equal_brute_force_on_dense_and_shared_places(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW_PLACES", 4)
    rows = [(k, (k * 37 % 101) / 400, (k * 53 % 97) / 400 + (3.0 if k % 50 == 0 else 0.0), 0.06 + k % 7 / 100) for k in range(300)]
    rows += [(1000 + k, 0.1, 0.1, 0.06) for k in range(30)]
    got = Q.edges(spark.createDataFrame(rows, "cell_id long, x double, y double, h double")).collect()
    assert len(got) == len({(r.i, r.j) for r in got})
    assert {(r.i, r.j, r.face, round(r.dist, 9)) for r in got} == _brute(rows)


def test_edges_of_many_squares_on_one_place(spark):
    n = 60_000  # all pairs would be 3.6 billion
    cells = spark.range(n).select(F.col("id").alias("cell_id"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(0.1).alias("h"))
    got = Q.edges(cells)
    assert got.count() == 9 * (n - 9) + 36 and got.where("i > 8 OR dist > 0").count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_projections_make_no_row_of_a_disk_and_a_bin(spark):
    disks = spark.createDataFrame([(0, 0.3, -0.2, 0.7, 1.0), (1, 1.9, 0.4, 0.5, 2.0), (2, None, 0.0, 0.5, 1.0)], "disk_id int, cx double, cy double, r double, rho double")
    for made in (R.radon_disks, R.radon_tents):
        sino = made(disks, G.angles(spark), G)
        assert "MapInArrow" in _plan(sino) and sino.count() == G.nb_angles * G.nb_bins
    whole = R.mass(R.radon_disks(disks.where("disk_id = 0"), G.angles(spark), G), G).collect()
    assert all(abs(r.mass - 3.141592653589793 * 0.49) < 1e-9 for r in whole)


def test_disk_gradient_is_made_in_arrays(spark):
    disks = spark.createDataFrame([(7, 0.31, -0.23, 0.7, 1.0)], "disk_id long, cx double, cy double, r double, rho double")
    step = 1e-6
    moved = [disks.withColumn("cx", F.col("cx") + k * step) for k in (-1, 1)]
    lo, hi = ({(r.angle_id, r.bin_id): r.value for r in R.radon_disks(m, G.angles(spark), G).collect()} for m in moved)
    made = R.disk_gradient(disks, G.angles(spark), G)
    assert "MapInArrow" in _plan(made)
    for r in made.collect():
        assert abs(r.gx - (hi[r.angle_id, r.bin_id] - lo[r.angle_id, r.bin_id]) / (2 * step)) < 1e-3
