"""Prefix trie of conversations, as tables.

Every turn gets its place by a range sort, so one conversation may hold most of
the rows.  A prefix's digest is the XOR of hashes of (place, turn), which is
made in pieces.  The least conversation of each digest owns that node.  What a
conversation shares with a smaller one is a prefix, so its first owned depth is
found by binary search: round k probes depths whose lowest set bit is 2**k, and
reads only the digests and minima of such depths.  The owned depths of a
conversation are a chain; sums over subtrees are added up over the tree of
chains by pointer doubling and then along each chain.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massflow.llm.frames import Scratch, bounded_batches, cut

c = F.col
#: Turns that a rebuilt conversation can take over at most, plus one.
TAKEN = 6
#: Conversations whose shared first turns come from one.
FAMILY = 100
#: Nodes of a chain in one window; a power of two.
BLOCK_BITS = 16
#: Conversations in one list of those that end at a node; a power of two.
ENDS_BITS = 16
#: A key with more than this share of the looked-up rows is broadcast: there are fewer than its inverse.
HOT_SHARE = 1 / 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _lane(hex_: Column, k: int) -> Column:
    return F.conv(F.substring(hex_, 1 + 15 * k, 15), 16, 10).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, d1, d2, chars, seq): seq grows with (conv_id, turn), its high bits are the part of the range sort."""
    role, text = (F.coalesce(c(k).cast("string"), F.lit("")) for k in ("role", "text"))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    narrow = cut(
        conversations.where(c("conv_id").isNotNull())
        .select(c("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("sha"), F.length(text).alias("chars"))
        .select("conv_id", "turn", _lane(c("sha"), 0).alias("d1"), _lane(c("sha"), 1).alias("d2"), "chars")
    )
    order = [c("conv_id"), c("turn").asc_nulls_first(), c("d1"), c("d2")]
    # Rows that are alike in everything are told apart too, so that any number of them is dealt over parts.
    dealt = narrow.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    return cut(dealt.select("conv_id", "d1", "d2", "chars", F.monotonically_increasing_id().alias("seq")))


def _part(seq: str = "seq") -> Column:
    return F.shiftright(seq, 33)


def _xor_up_to(turns: Column, n: Column, lane: str) -> Column:
    """Digest of the first n (at most five) turns of an array in order of place."""
    return F.aggregate(F.slice(turns, 1, n), F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("k")), lambda a, t: F.struct(a["x"].bitwiseXOR(F.xxhash64(a["k"] + 1, t[lane])).alias("x"), (a["k"] + 1).alias("k")))["x"]


def _rebuilt(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) of each rebuilt conversation, and (conv_id, depth, p1, p2, chars, level) of each of its prefixes."""
    turns = _turns(conversations)
    groups = turns.groupBy("conv_id", _part().alias("part")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")  # a row per part of the range sort
    groups = cut(groups.select("*", F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("n").over(own).alias("total"), F.count(F.lit(1)).over(own).alias("parts")))
    placed = (c("seq") - c("first") + c("offset") + 1).alias("place")
    keys = ["conv_id", "part"]
    at = turns.withColumn("part", _part())
    most = TAKEN - 1
    heads = at.where(c("conv_id") % FAMILY == 0).join(groups.where((c("conv_id") % FAMILY == 0) & (c("offset") < most)), keys).select("conv_id", placed, "d1", "d2", "chars").where(c("place") <= most)
    heads = heads.groupBy(c("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "d1", "d2", "chars"))).alias("head"))  # five turns at most
    h = F.crc32(c("conv_id").cast("string").cast("binary")) % TAKEN
    ids = groups.where(c("offset") == 0).select("conv_id", "total", (c("conv_id") - c("conv_id") % FAMILY).alias("base"), h.cast("int").alias("h"))
    convs = ids.join(heads, "base", "left").withColumn("b", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    convs = convs.select("conv_id", "h", "b", (c("b") + F.greatest(c("total") - c("h"), F.lit(0))).alias("len"), F.when(c("b") > 0, F.slice("head", 1, "b")).alias("head"), *(F.coalesce(F.when(c("b") > 0, _xor_up_to(c("head"), c("b"), f"d{k}")), F.lit(0)).alias(f"x{k}") for k in (1, 2)))
    convs = cut(convs)
    # Own turns after the first h come after the b taken ones.
    plan = groups.join(convs.select("conv_id", "h", "b", "x1", "x2"), "conv_id")

    def own_turns(plan: DataFrame) -> DataFrame:
        t = at.join(plan, keys).select("*", placed).where(c("place") > c("h")).withColumn("depth", c("place") - c("h") + c("b"))
        return t.select("*", *(F.xxhash64("depth", f"d{k}").alias(f"z{k}") for k in (1, 2)))

    # Parts before a conversation's last one: at most two conversations' ends a part of the range sort.
    spread = own_turns(plan.where("parts > 1")).groupBy(*keys).agg(*(F.bit_xor(f"z{k}").alias(f"z{k}") for k in (1, 2)))
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spread = cut(spread.select(*keys, *(F.coalesce(F.bit_xor(f"z{k}").over(earlier), F.lit(0)).alias(f"o{k}") for k in (1, 2))))
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tail = own_turns(plan).join(F.broadcast(spread), keys, "left")
    tail = tail.select("conv_id", "depth", *(F.bit_xor(f"z{k}").over(upto).bitwiseXOR(c(f"x{k}")).bitwiseXOR(F.coalesce(f"o{k}", F.lit(0))).alias(f"p{k}") for k in (1, 2)), "chars")
    front = convs.where("b > 0").select("conv_id", "head", F.explode(F.sequence(F.lit(1), c("b"))).alias("depth"))
    front = front.select("conv_id", c("depth").cast("long").alias("depth"), *(_xor_up_to(c("head"), c("depth"), f"d{k}").alias(f"p{k}") for k in (1, 2)), F.element_at("head", c("depth"))["chars"].alias("chars"))
    prefixes = front.unionByName(tail).withColumn("level", F.bit_count(c("depth").bitwiseAND(-c("depth")) - 1))
    return convs.select("conv_id", "len"), cut(prefixes, "level")


def _looked_up(left: DataFrame, right: DataFrame, keys: list[str], value: str, weight: str, most: float) -> DataFrame:
    """left with right's value: an inner join on keys, of which right has each once.

    ``weight`` is how many rows of left may have a key.  Keys with more than
    ``most`` come by a broadcast; the rest by a shuffle, in which the rows that
    are done are dealt by a key of their own.
    """
    hot = right.where(c(weight) > most).select(*(c(k).alias(f"_{k}") for k in keys), c(value).alias("_hot"))
    cold = right.where(c(weight) <= most).select(*(c(k).alias(f"_{k}") for k in keys), F.lit(0).cast("long").alias("_mine"), c(value).alias("_cold"))
    same = [c(k) == c(f"_{k}") for k in keys]
    found = left.join(F.broadcast(hot), same, "left").drop(*(f"_{k}" for k in keys))
    mine = F.when(c("_hot").isNull(), F.lit(0)).otherwise(c("conv_id").bitwiseOR(1))
    found = found.withColumn("_own", mine).join(cold, [*same, c("_own") == c("_mine")], "left").drop(*(f"_{k}" for k in keys), "_mine", "_own")
    return found.select(*left.columns, F.coalesce("_hot", "_cold").alias(value)).where(c(value).isNotNull())


def _chains(convs: DataFrame, prefixes: DataFrame, minima: DataFrame, root: int, longest: int, rows: int) -> DataFrame:
    """(conv_id, len, shared, parent): the depth up to which a smaller conversation owns the nodes, and the owner at that depth."""
    state = convs.select("conv_id", "len", F.lit(0).cast("long").alias("shared"), F.lit(root).cast("long").alias("parent"))
    for k in reversed(range(max(longest, 0).bit_length())):
        probe = c("shared") + (1 << k)
        asked = state.where(probe <= c("len")).withColumn("depth", probe)
        asked = asked.join(prefixes.where(c("level") == k).select("conv_id", "depth", "p1", "p2"), ["conv_id", "depth"])
        told = _looked_up(asked, minima.where(c("level") == k), ["depth", "p1", "p2"], "owner", "n", rows * HOT_SHARE)
        less = c("owner") < c("conv_id")
        told = told.select("conv_id", "len", F.when(less, c("depth")).otherwise(c("shared")).alias("shared"), F.when(less, c("owner")).otherwise(c("parent")).alias("parent"))
        state = cut(state.where(probe > c("len")).unionByName(told))
    return state


def _over_subtrees(chains: DataFrame, minima: DataFrame, root: int, count: int) -> DataFrame:
    """chains with leaves and saved, summed over each chain's subtree, by pointer doubling."""
    saved = minima.groupBy(c("owner").alias("conv_id")).agg(F.sum((c("n") - 1) * c("chars")).alias("saved"))
    tails = chains.where(c("conv_id") != root).select(c("parent").alias("conv_id"), c("shared").alias("len")).distinct().withColumn("goes_on", F.lit(True))
    own = chains.join(saved, "conv_id", "left").join(tails, ["conv_id", "len"], "left")
    up = F.when(c("conv_id") != root, c("parent"))
    state = cut(own.select("conv_id", "len", "shared", "parent", up.alias("up"), F.when(c("goes_on"), 0).otherwise(1).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")))
    while state.where("up IS NOT NULL").limit(1).count():
        added = state.where("up IS NOT NULL").groupBy(c("up").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("below"))
        fields = ["conv_id", "len", "shared", "parent"]
        new = state.join(added, "conv_id", "left").select(*fields, "up", (c("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (c("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.coalesce("below", F.lit(0)).alias("below"))
        new = cut(new)
        ends = new.where(c("up").isNull() | (c("up") == root)).withColumn("up", F.lit(None).cast("long"))
        higher = new.where("below > 0").select(c("conv_id").alias("up"), F.struct("up").alias("next"), "below")
        on = _looked_up(new.where(c("up") != root), higher, ["up"], "next", "below", count * HOT_SHARE)
        state = cut(ends.select(*fields, "up", "leaves", "saved").unionByName(on.select(*fields, c("next.up").alias("up"), "leaves", "saved")))
    return state


def _ends(chains_and_rest: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes at which conversations end.

    Ids are range-sorted and joined in lists of bounded size; a node whose ids
    fill several lists is hashed list by list.
    """
    at = chains_and_rest.select(F.when(c("shared") < c("len"), c("conv_id")).otherwise(c("parent")).alias("node"), c("len").alias("depth"), c("conv_id").alias("id"))
    order = ["node", "depth", "id"]
    placed = cut(at.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.monotonically_increasing_id().alias("seq")))
    lists = placed.groupBy("node", "depth", F.shiftright("seq", ENDS_BITS).alias("list")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))  # 2**ENDS_BITS ids at most
    lists = cut(lists)
    several = lists.groupBy("node", "depth").count().where("count > 1").select("node", "depth")  # at most two a list's worth of ids
    several = cut(several)
    single = lists.join(several, ["node", "depth"], "left_anti").select("node", "depth", F.sha2("ids", 256).alias("ends_sha256"))

    def hashed(batches):
        now, sha = None, None
        for b in batches:
            out = []
            for node, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if (node, depth) != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (node, depth), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield _end_rows(out)
        yield _end_rows([(*now, sha.hexdigest())] if now is not None else [])

    more = lists.join(several, ["node", "depth"]).select("node", "depth", "list", "ids").repartition("node", "depth").sortWithinPartitions("node", "depth", "list")
    return single.unionByName(more.mapInArrow(hashed, "node long, depth long, ends_sha256 string")).withColumnRenamed("node", "conv_id")


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["node", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    Turns come in order of ``turn``, null first; turns that tie come in order of
    a hash of their role and text, and rows that are alike each are a turn.
    Rows without a conv_id belong to no conversation and take no part.  An empty
    table has no conversation and no node.  Other columns are not looked at.
    """
    spark = conversations.sparkSession
    with bounded_batches(spark), Scratch(spark) as work:
        convs, prefixes = _rebuilt(spark, conversations)
        root, longest, count, rows = convs.agg(F.min("conv_id"), F.max("len"), F.count(F.lit(1)), F.sum("len")).first()
        root = 0 if root is None else root
        # A node's members all have its depth, so its least member and their number come from one aggregate.
        minima = cut(prefixes.groupBy("level", "depth", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.min("chars").alias("chars")), "level")
        found = _chains(convs, prefixes, minima, root, longest or 0, rows or 0)
        chains = cut(found.where((c("shared") < c("len")) | (c("conv_id") == root)).withColumn("shared", F.when(c("conv_id") == root, F.lit(-1)).otherwise(c("shared"))))
        summed = _over_subtrees(chains, minima, root, count)
        none = F.lit(None)
        hung = summed.where(c("conv_id") != root).groupBy(c("parent").alias("conv_id"), c("shared").alias("depth")).agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        tops = summed.where(c("conv_id") != root).select("conv_id", (c("shared") + 1).alias("depth"), c("parent").alias("above"))
        last = summed.select("conv_id", c("len").alias("depth"), F.lit(True).alias("is_last"))
        marks = hung.unionByName(tops, True).unionByName(last, True).unionByName(_ends(found), True)
        marks = marks.groupBy("conv_id", "depth").agg(*(F.coalesce(F.max(k), F.lit(0)).alias(k) for k in ("kids", "leaves", "saved")), F.max("above").alias("above"), F.coalesce(F.max("is_last"), F.lit(False)).alias("is_last"), F.max("ends_sha256").alias("ends_sha256"))
        top = spark.range(1 if count else 0).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(count).cast("long").alias("n"), F.lit(0).alias("chars"))
        nodes = minima.select(c("owner").alias("conv_id"), "depth", "n", "chars").unionByName(top)
        nodes = nodes.join(marks, ["conv_id", "depth"], "left").na.fill({"kids": 0, "leaves": 0, "saved": 0, "is_last": False})
        parent = F.when(c("depth") == 0, none).otherwise(F.coalesce("above", "conv_id"))
        nodes = nodes.select(
            "conv_id", "depth", parent.alias("parent_conv_id"), c("n").alias("n_convs"), (c("kids") + F.when(c("is_last"), 0).otherwise(1)).alias("n_children"),
            (c("leaves") + F.when(c("is_last") & (c("kids") == 0), 1).otherwise(0)).alias("leaves"), (c("saved") + (c("n") - 1) * c("chars")).alias("saved"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), F.shiftright("depth", BLOCK_BITS).alias("block"),
        )
        nodes = cut(nodes)
        below = Window.partitionBy("conv_id", "block").orderBy(c("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        if (longest or 0) >> BLOCK_BITS:
            later = Window.partitionBy("conv_id").orderBy(c("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per block
            blocks = nodes.groupBy("conv_id", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(k).over(later), F.lit(0)).alias(k) for k in ("l", "s")))
            nodes = nodes.join(blocks, ["conv_id", "block"])
        else:
            nodes = nodes.select("*", F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("s"))
        return work.last(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.sum("leaves").over(below) + c("l")).alias("n_leaves"), (F.sum("saved").over(below) + c("s")).alias("saved_tokens"), "ends_sha256"))


#: CRC-32 of the bytes of conv_id's decimals, a bit at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"

#: The same by comparing whole prefixes; turns that tie come in the query's order.
ORACLE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, {_CRC} % 6 AS h FROM t),
taken AS (SELECT i.conv_id, t.role, t.text, 0 AS own, t.k FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 100 WHERE t.k <= i.h
  UNION ALL SELECT i.conv_id, t.role, t.text, 1, t.k FROM ids i JOIN t USING (conv_id) WHERE t.k > i.h),
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth FROM taken),
chain AS (SELECT conv_id, depth, length(text) AS chars, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM placed
  UNION ALL SELECT conv_id, 0, 0, [] FROM ids),
sizes AS (SELECT conv_id, max(depth) AS len FROM chain GROUP BY 1),
node AS (SELECT depth, prefix, min(conv_id) AS owner, count(*) AS n, min(chars) AS chars FROM chain GROUP BY 1, 2),
spot AS (SELECT c.conv_id, c.depth, n.owner, n.n, n.chars FROM chain c JOIN node n USING (depth, prefix)),
up AS (SELECT DISTINCT a.owner, a.depth, b.owner AS parent FROM spot a LEFT JOIN spot b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
kids AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY 1, 2),
under AS (SELECT DISTINCT a.owner, a.depth, b.owner AS o, b.depth AS d, (b.n - 1) * b.chars AS saved FROM spot a JOIN spot b ON b.conv_id = a.conv_id AND b.depth >= a.depth),
sums AS (SELECT u.owner, u.depth, sum(u.saved) AS saved, count(*) FILTER (WHERE k.owner IS NULL) AS leaves FROM under u LEFT JOIN kids k ON k.owner = u.o AND k.depth = u.d GROUP BY 1, 2),
ends AS (SELECT a.owner, a.depth, sha256(string_agg(CAST(a.conv_id AS VARCHAR), ',' ORDER BY a.conv_id)) AS h FROM spot a JOIN sizes s ON s.conv_id = a.conv_id AND s.len = a.depth GROUP BY 1, 2)
SELECT n.owner AS conv_id, n.depth, u.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  coalesce(e.h, sha256('')) AS ends_sha256
FROM node n JOIN up u ON u.owner = n.owner AND u.depth = n.depth JOIN sums s ON s.owner = n.owner AND s.depth = n.depth
LEFT JOIN kids k ON k.owner = n.owner AND k.depth = n.depth LEFT JOIN ends e ON e.owner = n.owner AND e.depth = n.depth"""
