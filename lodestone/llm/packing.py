"""Filling fixed-capacity containers: bulk-synchronous best fit.

Documents and gaps (containers with room) stay distributed. A superstep sorts both along one axis, documents by size and
gaps by room, and sweeps every document to its successor among the gaps, the smallest that has room: going up the axis a
document adds one to a running level and a gap takes one off, so a document and the gap that takes it are neighbours
on the same level, as brackets are. Where several documents want one gap, ranks within equal sizes decide. Then the
gaps shrink and the next superstep follows, until nothing moves; what is left opens containers. Supersteps go through
bands of sizes, large documents first. The axis has few places, because sizes are whole tokens up to the capacity, so
levels come from prefix sums over (size, room) and from ranks within them, and no task sees more than a bucket of a size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import cut

from .tokens import VOCABULARY, counted

#: A band of sizes is (capacity / next fold, capacity / fold]: at least ``fold`` of its documents fit a container.
FOLDS = (1, 2, 3, 4, 6, 9, 16)
#: A sweep that moves less than this share of a band is its last before containers are opened, but in the last band.
#: What stays in the gaps is for smaller documents.
WORTH = 0.25
#: Documents or gaps of one place of the axis that one task ranks, about.
BUCKET_ROWS = 100_000

_DOC = ["doc_id", "h", "piece_no"]


def best_fit(sizes: dict[int, int], capacity: int) -> int:
    """Containers that sequential best-fit decreasing needs for ``sizes`` (how many of each); a yardstick for tests."""
    rooms: list[int] = []
    opened = 0
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            at = bisect_left(rooms, size)
            room = rooms.pop(at) if at < len(rooms) else capacity
            opened += at >= len(rooms) and room == capacity
            if room > size:
                insort(rooms, room - size)
    return opened


def sweep(docs: DataFrame, gaps: DataFrame, least: F.Column, most: F.Column, salts: int = 1) -> DataFrame:
    """Documents of one band (pack_no, *_DOC, n_tokens, capacity) with the container they go to, null where none has room.

    ``gaps`` (pack_no, container_id, room); sizes lie between ``least`` and ``most``, expressions of the capacity, which
    both tables have. A gap has a place for every ``most`` of its room and at least one of its own size, so a container
    can take several documents in one sweep; what it keeps can be matched in the next one.
    """
    none = F.lit(None).cast("bigint")
    up = docs.select("pack_no", "capacity", F.col("n_tokens").alias("v"), F.lit(0).cast("bigint").alias("room"), F.lit(1).alias("step"), *_DOC, none.alias("container_id"), F.lit(0).alias("slot"))
    open_ = gaps.where(F.col("room") >= least)
    slot = F.explode(F.sequence(F.lit(1), F.greatest(F.floor(F.col("room") / most), F.lit(1)).cast("int"))).alias("slot")
    down = open_.select("pack_no", "capacity", F.least("room", most).alias("v"), "room", F.lit(-1).alias("step"), none.alias("doc_id"), none.alias("h"), F.lit(None).cast("int").alias("piece_no"), "container_id", slot)
    place = ["pack_no", "v", "room", "salt"]
    axis = up.unionByName(down).withColumn("salt", F.pmod(F.xxhash64(*_DOC, "container_id", "slot"), F.lit(salts)).cast("int"))
    inside = F.row_number().over(Window.partitionBy(*place).orderBy(*_DOC, "container_id", "slot"))
    per = axis.groupBy(*place).agg(F.sum("step").alias("n"))
    before = per.select(*place, (F.sum("n").over(Window.partitionBy("pack_no").orderBy("v", "room", "salt")) - F.col("n")).alias("base"))
    ranked = axis.withColumn("inside", inside).join(before.hint("merge"), place)
    level = F.when(F.col("step") > 0, F.col("base") + F.col("inside")).otherwise(F.col("base") - F.col("inside") + 1)
    # at most one row for each place (v, room) is on a level, so these groups are as small as the axis
    along = Window.partitionBy("pack_no", "level").orderBy("v", "room")
    met = ranked.withColumn("level", level).withColumn("taker", F.lead("container_id").over(along))
    return met.where("step > 0").select("pack_no", "capacity", *_DOC, F.col("v").alias("n_tokens"), F.col("taker").alias("container_id"))


def _fresh(spark: SparkSession, opened: dict[int, tuple[int, int, int]]) -> DataFrame:
    """New empty gaps: pack_no -> (first container, how many, capacity)."""
    total, bounds = 0, []
    for pack, (first, n, capacity) in opened.items():
        bounds.append(F.struct(F.lit(pack).alias("p"), F.lit(total).cast("bigint").alias("lo"), F.lit(total + n).cast("bigint").alias("hi"), F.lit(first - total).cast("bigint").alias("shift"), F.lit(capacity).cast("bigint").alias("c")))
        total += n
    of = F.filter(F.array(*bounds), lambda z: (F.col("id") >= z["lo"]) & (F.col("id") < z["hi"]))[0]
    return spark.range(total).select(of.alias("b"), "id").select(F.col("b.p").alias("pack_no"), (F.col("id") + F.col("b.shift")).alias("container_id"), F.col("b.c").alias("room"), F.col("b.c").alias("capacity"))


def _fill(items: DataFrame, packs: list[tuple[str, int]], salts: int) -> tuple[DataFrame, dict[int, int]]:
    """All documents of positive size with their containers, and how many containers each pack has.

    The driver sees a count, a sum and two extremes for each pack in each superstep.
    """
    spark = items.sparkSession
    fold = F.floor(F.col("capacity") / F.col("n_tokens"))
    band = sum((F.when(fold >= f, 1).otherwise(0) for f in FOLDS), F.lit(0)) - 1
    items = cut(items.withColumn("band", band))
    filled = {r[0] for r in items.select("band").distinct().collect()}  # at most one row for each of FOLDS
    gaps: DataFrame | None = None
    opened = dict.fromkeys(range(len(packs)), 0)
    done: list[DataFrame] = []
    for i, f in enumerate(FOLDS):
        if i not in filled:
            continue
        rest = items.where(F.col("band") == i).drop("band")
        most = F.greatest(F.floor(F.col("capacity") / f), F.lit(1))
        nxt = FOLDS[i + 1] if i + 1 < len(FOLDS) else None
        least = F.floor(F.col("capacity") / nxt) + 1 if nxt else F.lit(1)
        before = None
        while True:
            stats = rest.groupBy("pack_no").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("sum"), F.min("n_tokens").alias("least"))
            if gaps is not None:
                room = gaps.groupBy("pack_no").agg(F.max("room").alias("room"))
                stats = stats.join(F.broadcast(room), "pack_no", "left")  # a row for each kind of container
            left = {r["pack_no"]: r for r in stats.collect()}
            if not left:
                break
            count = sum(r["n"] for r in left.values())
            moved = before is None or nxt is None or count < (1 - WORTH) * before
            before = count
            if not moved or gaps is None or not any((r["room"] or 0) >= r["least"] for r in left.values()):
                fresh = {}
                for p, r in left.items():
                    # as many as take the whole band; in the last one, with nothing smaller to come, as sizes add up to
                    n = -(-r["n"] // f) if nxt else -(-r["sum"] // packs[p][1])
                    fresh[p] = (opened[p], n, packs[p][1])
                    opened[p] += n
                gaps = _fresh(spark, fresh) if gaps is None else gaps.unionByName(_fresh(spark, fresh))
            swept = cut(sweep(rest, gaps, least, most, salts))
            put = swept.where("container_id IS NOT NULL")
            used = put.groupBy("pack_no", "container_id").agg(F.sum("n_tokens").alias("used"))
            shrunk = gaps.join(used.hint("merge"), ["pack_no", "container_id"], "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0)))
            gaps = cut(shrunk.where("room > 0").select("pack_no", "container_id", "room", "capacity"))
            done.append(put)
            rest = swept.where("container_id IS NULL").drop("container_id")
    out = done[0] if done else items.where("false").select("pack_no", "capacity", *_DOC, "n_tokens", F.lit(None).cast("bigint").alias("container_id"))
    for d in done[1:]:
        out = out.unionByName(d)
    return out, opened


def pack(documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack_name, container_id, doc_id, piece_no, token_start, n_tokens): every document in every pack.

    A document over the capacity is cut into pieces of ``capacity`` tokens and a last one; all others stay whole
    (piece_no 0). Null and empty texts have size 0 and are spread over the containers. Repeated rows count once;
    limits with a null name or capacity, or a capacity below 1, are ignored. Ties among equal sizes go by id and a
    hash of the text, so the result is the same for every partitioning. Empty tables give no rows.
    """
    spark = documents.sparkSession
    # one row for each kind of container, as the plan names every capacity
    packs = sorted({(r[0], int(r[1])) for r in limits.where("pack_name IS NOT NULL AND capacity_tokens >= 1").select("pack_name", "capacity_tokens").distinct().collect()})
    shape = "pack_name string, container_id bigint, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"
    if not packs:
        return spark.createDataFrame([], shape)
    src = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sized = cut(src.mapInArrow(partial(counted, text="text", path=vocabulary), "doc_id bigint, h bigint, n_tokens bigint").distinct())
    caps = F.array(*[F.struct(F.lit(i).alias("pack_no"), F.lit(c).cast("bigint").alias("capacity")) for i, (_, c) in enumerate(packs)])
    each = sized.select("doc_id", "h", "n_tokens", F.explode(caps).alias("p")).select("doc_id", "h", "n_tokens", "p.pack_no", "p.capacity")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    items = each.select("pack_no", "doc_id", "h", "capacity", F.col("n_tokens").alias("total"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "pack_no", "doc_id", "h", "piece_no", "capacity", F.least("capacity", F.col("total") - F.col("piece_no") * F.col("capacity")).alias("n_tokens")
    )
    most = items.where("n_tokens > 0").groupBy("pack_no", "n_tokens").count().agg(F.max("count")).collect()[0][0] or 0
    placed, opened = _fill(items.where("n_tokens > 0"), packs, max(1, -(-most // BUCKET_ROWS)))
    some = F.element_at(F.array(*[F.lit(max(opened[i], 1)).cast("bigint") for i in range(len(packs))]), F.col("pack_no") + 1)
    empty = items.where("n_tokens = 0").select("pack_no", "capacity", *_DOC, "n_tokens", F.pmod(F.xxhash64("doc_id", "h"), some).alias("container_id"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in packs]), F.col("pack_no") + 1)
    return placed.unionByName(empty).select(name.alias("pack_name"), "container_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("token_start"), "n_tokens")


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, containers, used_tokens, unused_share) of a packing."""
    caps = limits.select("pack_name", "capacity_tokens").distinct()
    by = packed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("used"))
    total = by.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("used").alias("used_tokens"))
    return total.join(caps, "pack_name").select("pack_name", "containers", "used_tokens", (1 - F.col("used_tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"))


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/pack_limits.parquet")


QUERIES = {
    "p7_packing": lambda spark, sf: pack(*_tables(spark, sf)),
    "p7_fill": lambda spark, sf: fill_report(pack(*_tables(spark, sf)), _tables(spark, sf)[1]),
}
SQL: dict[str, str] = {}
