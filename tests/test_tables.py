"""Driver tables in the roles of the engine's inputs."""

from massflow.plans import tables as B
from tests.conftest import SF


def test_lineitem_problem_is_read_once_and_equal(spark):
    points, target = B.lineitem_problem(spark, SF)
    for got, want in ((points, B.lineitem_points(spark, SF)), (target, B.lineitem_target(spark, SF))):
        assert "lineitem.parquet" not in "".join(got.inputFiles())
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
