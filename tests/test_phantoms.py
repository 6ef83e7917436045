"""Generated inputs: sites, phantoms and seeded points."""

import math

import pytest

from massflow.sources import phantoms as P


def test_hexagonal_sites(spark):
    got = [(r.x, r.y) for r in P.hex_sites(spark, (1.0, -2.0, 3.0), 0.5, 0.25).collect()]
    step = 0.5 * math.sqrt(3) / 2
    want = {(round(1 + (i + 0.5 * (j % 2)) * 0.5, 9), round(-2 + j * step, 9)) for i in range(-20, 20) for j in range(-20, 20)}
    want = {(x, y) for x, y in want if math.hypot(x - 1, y + 2) <= 2.75}
    assert {(round(x, 9), round(y, 9)) for x, y in got} == want and len(got) == len(want)
    # Jitter moves every site by its share of the pitch at most, alike in every partitioning.
    one, two = ({r.site_id: (r.x, r.y) for r in P.hex_sites(spark, (0.0, 0.0, 3.0), 0.5, -1.0, 0.2, 7).repartition(k).collect()} for k in (1, 5))
    plain = {r.site_id: (r.x, r.y) for r in P.hex_sites(spark, (0.0, 0.0, 3.0), 0.5, -1.0).collect()}
    assert one == two and one != plain
    assert all(abs(one[k][a] - plain[k][a]) <= 0.1 + 1e-12 for k in one.keys() & plain.keys() for a in (0, 1))


def test_lung_phantom(spark):
    rows = sorted(P.lung_phantom(spark, 6.0, nb_holes=25).collect(), key=lambda r: r.disk_id)
    assert rows[0][1:] == (0.0, 0.0, pytest.approx(2.7), 1.0) and len(rows) == 26 and len({r.disk_id for r in rows}) == 26
    holes = [(r.cx, r.cy) for r in rows[1:]]
    assert all(r.rho == -1 and math.hypot(r.cx, r.cy) <= 2.7 - 0.08 for r in rows[1:])
    assert min(math.dist(a, b) for k, a in enumerate(holes) for b in holes[:k]) > 0.16  # holes do not meet
    assert P.lung_phantom(spark, 6.0, nb_holes=25, seed=3).collect() != rows


@pytest.mark.parametrize("normal", [False, True])
def test_random_points(spark, normal):
    a, b = ({r.dirac_id: (r.x, r.y) for r in P.random_points(spark, 4000, 6.0, 5, normal).repartition(k).collect()} for k in (1, 7))
    assert a == b and len(a) == 4000
    for axis in (0, 1):
        v = [p[axis] for p in a.values()]
        mean = sum(v) / len(v)
        spread = math.sqrt(sum((x - mean) ** 2 for x in v) / len(v))
        assert abs(mean) < 0.15 and spread == pytest.approx(1.0 if normal else 6 / math.sqrt(12), rel=0.05)
    assert normal or max(abs(x) for p in a.values() for x in p) <= 3
