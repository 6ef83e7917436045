"""Named runs as JSON, loss tables, HTML point clouds, parameter sweeps."""

from __future__ import annotations

import html
import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def save_run(history: DataFrame, path: str, name: str, meta: dict) -> None:
    """Write a run's rows under path/run=name; a run of that name is replaced."""
    rows = history
    for k, v in meta.items():
        rows = rows.withColumn(f"meta_{k}", F.lit(v))
    rows.write.mode("overwrite").json(f"{path}/run={name}")


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def mismatches(runs: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """(setting, nb_values) of the settings that differ between runs."""
    one = runs.select(run, *keys).distinct()
    pairs = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("setting"), c(k).cast("string").alias("value")) for k in keys))).alias("p"))
    return pairs.groupBy(c("p.setting").alias("setting")).agg(F.count_distinct("p.value").alias("nb_values")).where("nb_values > 1")


def loss_table(history: DataFrame, names: list[str]) -> DataFrame:
    """step and one text column per run, '-' where a run has no such step."""
    wide = history.where(c("run").isin(names)).groupBy("step").pivot("run", names).agg(F.first("loss"))
    return wide.select("step", *(F.when(c(n).isNull(), "-").otherwise(F.format_string("%.6f", c(n))).alias(n) for n in names))


def write_table(table: DataFrame, path: str) -> None:
    """The table as tab-separated text, one header line."""
    table.orderBy("step").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def points_html(frames: DataFrame, extent: float, path: str, max_points: int = 5_000, seed: int = 0) -> None:
    """A page that shows each frame's points; the same at most max_points ids in every frame.

    frames: (frame, dirac_id, x, y).  What reaches the driver is bounded by
    max_points a frame.
    """
    ids = frames.select("dirac_id").distinct().orderBy(F.xxhash64("dirac_id", F.lit(seed)), "dirac_id").limit(max_points)
    rows = frames.withColumn("x", c("x").cast("double")).withColumn("y", c("y").cast("double")).join(F.broadcast(ids), "dirac_id").orderBy("frame", "dirac_id").toPandas()
    data = [g[["x", "y"]].round(5).to_numpy().tolist() for _, g in rows.groupby("frame")]
    page = f"""<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(path)}</title><canvas id="c" width="700" height="700"></canvas><input id="k" type="range" min="0" max="{max(len(data) - 1, 0)}" value="0">
<script>const F={json.dumps(data)},E={extent};const c=document.getElementById("c").getContext("2d");
function show(k){{c.clearRect(0,0,700,700);for(const [x,y] of F[k]||[])c.fillRect(350+700*x/E-1,350-700*y/E-1,3,3);}}
document.getElementById("k").oninput=e=>show(+e.target.value);show(0);</script>"""
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)


def sweep(**params) -> list[dict]:
    """All combinations of parameter values; a comma-separated string is a list of values."""
    lists = {k: v.split(",") if isinstance(v, str) else list(v) if isinstance(v, (list, tuple)) else [v] for k, v in params.items()}
    return [dict(zip(lists, values)) for values in itertools.product(*lists.values())]
