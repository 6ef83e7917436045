"""One-dimensional semi-discrete optimal transport as relations.

The plan is a table of pieces, one per overlap of a dirac's and a cell's
interval in mass space.  Both sides' running masses are merged by one sort per
(batch, bucket); intervals are cut at bucket borders, so a batch of any
size is spread over tasks and no carry crosses a border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massflow.functions.prefix import buckets_for, following, running_sum
from massflow.functions.stored import Store
from massflow.operators.measures import normalize_density, point_mass

c = F.col


def sorted_points(d: DataFrame, buckets: int = 1) -> DataFrame:
    """Normalized diracs of positive weight with q0, the mass before each.

    Weights are summed as given and divided once, so equal or whole ones
    gather no rounding, however many rows a batch has.
    """
    d = d.join(point_mass(d), "batch").where(F.try_divide("w", "mass") > 0)
    s = running_sum(d, "batch", ["pos", "dirac_id"], {"q0": "w"}, buckets)
    return s.withColumn("q0", c("q0") / c("mass")).withColumn("w", c("w") / c("mass")).drop("mass")


def cell_cum_mass(t: DataFrame, buckets: int = 1) -> DataFrame:
    """Normalized cells with m, their mass, and c0, the mass before each."""
    t = normalize_density(t).withColumn("m", c("y") * (c("x1") - c("x0")))
    return running_sum(t, "batch", ["x0", "cell_id"], {"c0": "m"}, buckets)


#: Batches whose borders are broadcast; more are joined by a shuffle.
MOST_BATCHES = 100_000


class _Buckets:
    """Levels that cut the rows of each batch, of both sides together, into buckets of about one size.

    Equal rows, not equal mass: neither many light points nor a fine density
    meet in one task.  A smaller batch has fewer buckets.  ``starts``: frames
    with batch and the level q at which a row's interval starts.
    """

    def __init__(self, k: int, *starts: DataFrame):
        self.table = None
        if k == 1:
            return
        q = starts[0]
        for more in starts[1:]:
            q = q.unionByName(more)
        made = q.groupBy("batch").agg(F.percentile_approx("q", [i / k for i in range(1, k)], 10_000).alias("at"), F.count(F.lit(1)).alias("n"))
        made = Store(q.sparkSession).keep(made)  # a row per batch
        most, count = made.agg(F.max("n"), F.count(F.lit(1))).first()
        every = F.greatest(F.floor(F.lit(k) / F.ceil(c("n") * k / F.lit(most or 1))), F.lit(1))
        made = made.select("batch", F.array_distinct(F.filter("at", lambda v, i: (v > 0) & (v < 1) & ((i + 1) % every == 0))).alias("borders"))
        self.table = F.broadcast(made) if count <= MOST_BATCHES else made

    def _with(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, "batch") if self.table is not None else df.withColumn("borders", F.array().cast("array<double>"))

    @staticmethod
    def _ends(df: DataFrame) -> DataFrame:
        since, until = F.get("borders", c("bucket") - 1), F.get("borders", c("bucket"))
        return df.withColumn("since", F.coalesce(since, F.lit(0.0))).withColumn("until", F.coalesce(until, F.lit(1.0))).drop("borders")

    def split(self, df: DataFrame, start: str, mass: str) -> DataFrame:
        """bucket, since, until and q, the start of each interval, cut at the borders."""
        first = F.size(F.filter("borders", lambda b: b <= c(start)))
        last = F.greatest(first, F.size(F.filter("borders", lambda b: b < c(start) + c(mass))))
        df = self._ends(self._with(df).withColumn("bucket", F.explode(F.sequence(first, last))))
        return df.withColumn("q", F.greatest(c(start), c("since")))

    def place(self, df: DataFrame, level: str, before: bool = False) -> DataFrame:
        """bucket, since and until of a level; one on a border is of the bucket before or after it."""
        at = F.filter("borders", lambda b: b < c(level)) if before else F.filter("borders", lambda b: b <= c(level))
        return self._ends(self._with(df).withColumn("bucket", F.size(at)))


def _once(df: DataFrame, k: int) -> DataFrame:
    """df, written where it is large enough to be cut into buckets: it is read several times."""
    return df if k == 1 else Store(df.sparkSession).keep(df)


def pieces(d: DataFrame, t: DataFrame, buckets: int | None = None) -> DataFrame:
    """(batch, dirac_id, cell_id, pos, w, q0, q1, l, r, dm, y): the transport plan.

    Zero weights and zero-mass cells carry nothing and are left out.
    """
    k = buckets or max(buckets_for(d, "batch"), buckets_for(t, "batch"))
    return pieces_presorted(_once(sorted_points(d, k), k), _once(cell_cum_mass(t, k), k), k)


def pieces_presorted(s: DataFrame, u: DataFrame, buckets: int = 1) -> DataFrame:
    """The plan of points and cells that have their running masses (q0; m and c0): normalizing and both sorts are skipped."""
    u = u.where("m > 0")
    cut = _Buckets(buckets, s.select("batch", c("q0").alias("q")), u.select("batch", c("c0").alias("q")))
    s, u = cut.split(s, "q0", "w"), cut.split(u, "c0", "m")
    dirac = F.struct("dirac_id", "pos", "w")
    cell = F.struct("cell_id", "x0", "x1", "y", "m", "c0")
    left = s.select("batch", "bucket", "until", "q", F.lit(0).alias("kind"), c("pos").alias("at"), dirac.alias("d"), F.lit(None).alias("t"))
    right = u.select("batch", "bucket", "until", "q", F.lit(1).alias("kind"), c("x0").alias("at"), F.lit(None).alias("d"), cell.alias("t"))
    both = _merged(left, right, "batch", "bucket")
    order = Window.partitionBy("batch", "bucket").orderBy("q", "kind", "at", "d.dirac_id", "t.cell_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    merged = both.select("batch", c("q").alias("q0"), F.coalesce(F.lead("q").over(order), c("until")).alias("q1"), F.last("d", ignorenulls=True).over(upto).alias("d"), F.last("t", ignorenulls=True).over(upto).alias("t"))
    merged = merged.where("q1 > q0 AND d IS NOT NULL AND t IS NOT NULL").select("batch", "d.*", "t.*", "q0", "q1")
    slope = (c("x1") - c("x0")) / c("m")
    return merged.select("batch", "dirac_id", "cell_id", "pos", "w", "q0", "q1", "y", (c("x0") + (c("q0") - c("c0")) * slope).alias("l"), (c("x0") + (c("q1") - c("c0")) * slope).alias("r"), (c("q1") - c("q0")).alias("dm"))


def _merged(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Both sides' rows, dealt by the keys in one exchange.

    Explicit, as a union's own partitioning breaks where adaptive execution
    reads one side's exchange in other pieces than the other's.
    """
    return left.unionByName(right).repartition(*keys)


def _quadratic() -> Column:
    a, b = c("l") - c("pos"), c("r") - c("pos")
    return c("dm") * (a * a + a * b + b * b) / 3


def cost(p: DataFrame) -> DataFrame:
    return p.groupBy("batch").agg(F.sum(_quadratic()).alias("cost"))


def barycenters(p: DataFrame) -> DataFrame:
    """(batch, dirac_id, pos, w, barycenter): the mean of each dirac's slice."""
    g = p.groupBy("batch", "dirac_id").agg(F.first("pos").alias("pos"), F.first("w").alias("w"), F.sum(c("dm") * (c("l") + c("r")) / 2).alias("m1"), F.sum("dm").alias("m0"))
    return g.select("batch", "dirac_id", "pos", "w", (c("m1") / c("m0")).alias("barycenter"))


def grad_position(p: DataFrame) -> DataFrame:
    return barycenters(p).select("batch", "dirac_id", (2 * c("w") * (c("pos") - c("barycenter"))).alias("grad"))


def cost_and_gradient(p: DataFrame) -> DataFrame:
    """(batch, dirac_id, cost, grad) from one pass over the pieces; costs add up by batch."""
    g = p.groupBy("batch", "dirac_id").agg(F.first("pos").alias("pos"), F.first("w").alias("w"), F.sum(c("dm") * (c("l") + c("r")) / 2).alias("m1"), F.sum("dm").alias("m0"), F.sum(_quadratic()).alias("cost"))
    return g.select("batch", "dirac_id", "cost", (2 * c("w") * (c("pos") - c("m1") / c("m0"))).alias("grad"))


def potentials(p: DataFrame, d: DataFrame, buckets: int | None = None) -> DataFrame:
    """(batch, dirac_id, w, phi): derivative of the cost by each normalized weight.

    With t the point where a dirac's slice ends and p' the next dirac's
    position, phi of a dirac is the sum of the jumps (t - p)^2 - (t - p')^2 at
    its own and all later ends; at the last end the jump is (t - p)^2.
    """
    k = buckets or buckets_for(d, "batch")
    ends = p.groupBy("batch", "dirac_id").agg(F.first("pos").alias("pos"), F.first("w").alias("w"), F.max("r").alias("t"))
    ends = following(ends, "batch", ["pos", "dirac_id"], {"next_pos": "pos"}, k)
    nxt = c("next_pos")
    jumps = ends.withColumn("phi_m", F.when(nxt.isNull(), (c("t") - c("pos")) ** 2).otherwise((c("t") - c("pos")) ** 2 - (c("t") - nxt) ** 2))
    total = jumps.groupBy("batch").agg(F.sum("phi_m").alias("total"))
    run = running_sum(jumps, "batch", ["pos", "dirac_id"], {"before": "phi_m"}, k)
    return run.join(total, "batch").select("batch", "dirac_id", "w", (c("total") - c("before")).alias("phi"))


def grad_weight(p: DataFrame, d: DataFrame, buckets: int | None = None) -> DataFrame:
    """Derivative by the raw weights: the chain rule of the normalization."""
    f = potentials(p, d, buckets)
    mean = f.groupBy("batch").agg(F.sum(c("w") * c("phi")).alias("mean"))
    mass = d.groupBy("batch").agg(F.sum("w").alias("mass"))
    return f.join(mean, "batch").join(mass, "batch").select("batch", "dirac_id", ((c("phi") - c("mean")) / c("mass")).alias("grad"))


def _end(start: Column) -> Column:
    """Where a merged row's piece ends (or starts), inside its cell t."""
    return c("t.x0") + (start - c("t.c0")) * (c("t.x1") - c("t.x0")) / c("t.m")


def grad_density(d: DataFrame, t: DataFrame, buckets: int | None = None) -> DataFrame:
    """(batch, cell_id, grad): derivative by the raw density values, zero cells included.

    Points and cells are merged once, as in the plan.  A piece adds its second
    moment about the dirac minus phi times its length, where phi falls at the
    end e of a dirac's slice by (e - p)^2 - (e - p')^2, p' being the next dirac's
    position.  A constant in phi cancels in the normalization, so a running sum
    over the merged rows gives it.  A cell without mass lies inside the slice of
    the dirac whose interval holds its level.
    """
    k = buckets or max(buckets_for(d, "batch"), buckets_for(t, "batch"))
    s = _once(following(sorted_points(d, k), "batch", ["pos", "dirac_id"], {"next_pos": "pos", "next_q0": "q0"}, k), k)
    u = _once(cell_cum_mass(t, k), k)
    cut = _Buckets(k, s.select("batch", c("q0").alias("q")), u.select("batch", c("c0").alias("q")))
    none = F.lit(None)
    dirac = F.struct("pos", "next_pos", "next_q0", (c("q") == c("q0")).alias("starts"))
    ends = ["batch", "bucket", "since", "until"]
    at = cut.split(s, "q0", "w").select(*ends, "q", F.lit(0).alias("kind"), c("pos").alias("at"), c("dirac_id").alias("id"), dirac.alias("d"), none.alias("t"), none.alias("z"))
    full = cut.split(u.where("m > 0"), "c0", "m").select(*ends, "q", F.lit(1).alias("kind"), c("x0").alias("at"), none.alias("id"), none.alias("d"), F.struct("cell_id", "x0", "x1", "m", "c0").alias("t"), none.alias("z"))
    flat = cut.place(u.where("m <= 0"), "c0").select(*ends, c("c0").alias("q"), F.lit(1).alias("kind"), c("x0").alias("at"), none.alias("id"), none.alias("d"), none.alias("t"), F.struct("cell_id", "x0", "x1").alias("z"))
    keys = ["q", "kind", "at", "id"]
    order = Window.partitionBy("batch", "bucket").orderBy(*keys)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = _merged(at.unionByName(full), flat, "batch", "bucket")
    rows = rows.select(*ends, *keys, "z", F.coalesce(F.lead("q").over(order), c("until")).alias("q1"), F.lead(F.coalesce(c("d.starts"), F.lit(False))).over(order).alias("followed"), F.last("d", ignorenulls=True).over(upto).alias("d"), F.last("t", ignorenulls=True).over(upto).alias("t"))
    # The next dirac starts after this row, or right behind the bucket's border; what ended at the border before is that bucket's.
    ended = F.coalesce(c("followed") & (c("d.next_q0") > c("since")), c("d.next_q0") <= c("until"))
    fall = F.when(ended, (_end(c("q1")) - c("d.pos")) ** 2 - (_end(c("q1")) - c("d.next_pos")) ** 2)
    rows = rows.where("d IS NOT NULL AND (t IS NOT NULL OR z IS NOT NULL)").withColumn("fall", F.coalesce(fall, F.lit(0.0))).withColumn("fallen", F.coalesce(F.sum("fall").over(before), F.lit(0.0)))

    def part(cell: Column, l: Column, r: Column, fall: Column) -> Column:
        a, b = l - c("d.pos"), r - c("d.pos")
        return F.struct(cell.alias("cell_id"), ((r - l) * ((a * a + a * b + b * b) / 3 + c("fallen"))).alias("g"), (r - l).alias("dx"), fall.alias("fall"))

    piece = part(c("t.cell_id"), _end(c("q")), _end(c("q1")), c("fall"))
    empty = part(c("z.cell_id"), c("z.x0"), c("z.x1"), F.lit(0.0))
    parts = F.when(c("z").isNull(), F.array(piece)).when(c("t").isNull(), F.array(empty)).otherwise(F.array(piece, empty))
    g = rows.select("batch", "bucket", F.inline(parts)).groupBy("batch", "bucket", "cell_id").agg(F.sum("g").alias("g"), F.sum("dx").alias("dx"), F.sum("fall").alias("fall"))
    if k > 1:
        g = Store(d.sparkSession).keep(g)  # a row per cell and bucket
        falls = g.groupBy("batch", "bucket").agg(F.sum("fall").alias("fall"))
        falls = falls.select("batch", "bucket", F.coalesce(F.sum("fall").over(Window.partitionBy("batch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("above"))
        g = g.join(falls, ["batch", "bucket"]).groupBy("batch", "cell_id").agg(F.sum(c("g") + c("above") * c("dx")).alias("g"))
    mass = t.groupBy("batch").agg(F.sum(c("y") * (c("x1") - c("x0"))).alias("mass"))
    cells = t.select("batch", "cell_id", "y", (c("x1") - c("x0")).alias("dx")).join(g.select("batch", "cell_id", "g"), ["batch", "cell_id"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    mean = cells.groupBy("batch").agg(F.sum(c("g") * c("y")).alias("gy")).join(mass, "batch").select("batch", "mass", (c("gy") / c("mass")).alias("mean"))
    return cells.join(mean, "batch").select("batch", "cell_id", ((c("g") - c("dx") * c("mean")) / c("mass")).alias("grad"))


def lookup(levels: DataFrame, t: DataFrame, buckets: int | None = None) -> DataFrame:
    """As-of inversion: (batch, level_id, level) with x, the point below which ``level`` of the mass lies.

    The smallest cell whose cumulated mass reaches the level; inside it, linear.
    """
    k = buckets or max(buckets_for(levels, "batch"), buckets_for(t, "batch"))
    u = _once(cell_cum_mass(t, k).where("m > 0"), k)
    cut = _Buckets(k, u.select("batch", c("c0").alias("q")), levels.select("batch", c("level").alias("q")))
    left = cut.split(u, "c0", "m").select("batch", "bucket", "q", F.lit(0).alias("kind"), F.struct("x0", "x1", "m", "c0").alias("t"), F.lit(None).cast("long").alias("level_id"))
    # A level on a border belongs to the cell before it, except at the very start.
    kind = F.when(c("level") <= 0, F.lit(1)).otherwise(F.lit(-1))
    right = cut.place(levels, "level", before=True).select("batch", "bucket", c("level").alias("q"), kind.alias("kind"), F.lit(None).alias("t"), c("level_id").cast("long").alias("level_id"))
    upto = Window.partitionBy("batch", "bucket").orderBy("q", "kind", "t.x0", "level_id").rowsBetween(Window.unboundedPreceding, 0)
    both = _merged(left, right, "batch", "bucket").withColumn("t", F.last("t", ignorenulls=True).over(upto)).where("level_id IS NOT NULL AND t IS NOT NULL")
    return both.select("batch", "level_id", c("q").alias("level"), (c("t.x0") + F.least((c("q") - c("t.c0")) / c("t.m"), F.lit(1.0)) * (c("t.x1") - c("t.x0"))).alias("x"))


def cost_by_moments(d: DataFrame, t: DataFrame, buckets: int | None = None) -> DataFrame:
    """The same cost from cumulated moments at the slices' ends (as-of lookup, no pieces)."""
    k = buckets or buckets_for(d, "batch")
    s = _once(sorted_points(d, k), k)
    u = cell_cum_mass(t, k).where("m > 0")
    u = u.withColumn("k1", c("y") * (c("x1") ** 2 - c("x0") ** 2) / 2).withColumn("k2", c("y") * (c("x1") ** 3 - c("x0") ** 3) / 3)
    u = _once(running_sum(u, "batch", ["x0", "cell_id"], {"b1": "k1", "b2": "k2"}, k), k)
    cut = _Buckets(k, s.select("batch", c("q0").alias("q")), u.select("batch", c("c0").alias("q")))
    left = cut.split(u, "c0", "m").select("batch", "bucket", "q", F.lit(0).alias("kind"), F.struct("x0", "y", "c0", "b1", "b2").alias("t"), F.lit(None).alias("d"))
    right = cut.place(s, "q0").select("batch", "bucket", c("q0").alias("q"), F.lit(1).alias("kind"), F.lit(None).alias("t"), F.struct("dirac_id", "pos", "w").alias("d"))
    upto = Window.partitionBy("batch", "bucket").orderBy("q", "kind", "d.pos", "d.dirac_id", "t.x0").rowsBetween(Window.unboundedPreceding, 0)
    at = _merged(left, right, "batch", "bucket").withColumn("t", F.last("t", ignorenulls=True).over(upto)).where("d IS NOT NULL")
    x = c("t.x0") + (c("q") - c("t.c0")) / c("t.y")
    at = at.select("batch", "q", "d.*", x.alias("x"), (c("t.b1") + c("t.y") * (x * x - c("t.x0") ** 2) / 2).alias("m1"), (c("t.b2") + c("t.y") * (x**3 - c("t.x0") ** 3) / 3).alias("m2"))
    whole = u.groupBy("batch").agg(F.sum("k1").alias("all1"), F.sum("k2").alias("all2"))
    at = following(at, "batch", ["pos", "dirac_id"], {"next1": "m1", "next2": "m2"}, k)
    at = at.join(whole, "batch").select("batch", "pos", "w", (F.coalesce("next1", "all1") - c("m1")).alias("d1"), (F.coalesce("next2", "all2") - c("m2")).alias("d2"))
    return at.groupBy("batch").agg(F.sum(c("d2") - 2 * c("pos") * c("d1") + c("pos") ** 2 * c("w")).alias("cost"))


def cost_by_barycenters(p: DataFrame) -> DataFrame:
    """Cost as sum w s^2 - 2 w s b plus the target's second moment."""
    b = barycenters(p).groupBy("batch").agg(F.sum(c("w") * c("pos") * (c("pos") - 2 * c("barycenter"))).alias("linear"))
    l, r = c("l"), c("r")
    second = p.groupBy("batch").agg(F.sum(c("dm") * (l * l + l * r + r * r) / 3).alias("second"))
    return b.join(second, "batch").select("batch", (c("linear") + c("second")).alias("cost"))
