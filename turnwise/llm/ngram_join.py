"""Exact Jaccard join of documents by word n-grams, as a metric-space join with pivots.

The Jaccard distance is a metric. Almost all pairs of documents are at distance 1, so regions are made from what documents near
each other must share: n-grams are put in one order (those of many documents last, the rest by hash), and documents within
the radius share some of their first ones. Those that share one form a region. In a small region pairs that have enough of
them in common are compared outright. In a large one the most central set is its pivot, and the regions of one pivot make up
its Voronoi cell; a set on the boundary is replicated into every cell that it has a first n-gram in. The distance of every
member to the pivot is evaluated, which is linear; members within the radius are linked to it. Cells with members of several
components go on recursively with a new pivot from outside the last one's component; then members of different components
whose distances to the pivot differ by no more than the radius (by the triangle inequality no others can be linked) are
compared. Their windows are the keys of that last join: a member stands in its window of distances and of sizes, and is
replicated into the next ones; salts spread a window that many members share.

Before two sets are shipped to be compared exactly, their parity sketches are: a bit of a sketch tells whether an odd number of
the set's n-grams fall on it, so that two sets differ in at least as many n-grams as their sketches do in bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructField, StructType

from turnwise.llm.arrowtext import mixed, pieces, powers
from turnwise.llm.common import Scratch, written
from turnwise.llm.components import components

#: Regions of up to this many sets are joined outright.
LEAF = 64
#: A pair must share this many of its first n-grams, where its sets are large enough.
SHARED = 3
#: Most n-grams that are told apart as frequent: 8 bytes each on every worker, 16 MB in all.
MAX_FREQUENT = 2_000_000
#: Fewest documents of a frequent n-gram.
LEAST_FREQUENT = 48
#: Ids in a broadcast: 8 bytes each.
MAX_BROADCAST_IDS = 1_000_000
#: Rounds of pivots, and the pairs a row that a remainder may make to be compared outright.
MAX_ROUNDS, PAIRS_A_ROW, FEW_PAIRS = 8, 64, 500_000

#: Bits of the parity sketches, and the least size of a set that has each: a sketch tells sets apart that differ in up to about a
#: third as many n-grams as it has bits.
SKETCHES = ((1 << 10, 0), (1 << 13, 1_200), (1 << 16, 10_000))
#: N-grams of a block, 8 bytes each: a cell holds the sets of two blocks.
BLOCK_GRAMS = 1_000_000
#: Rows of a salted part of a window in the last join.
PART_ROWS = 2_000
_MEASURED = pa.schema([(c, pa.int64()) for c in ("u", "v", "common", "n_u", "n_v")])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams of `width` words. A text of fewer words is one n-gram; without words, none."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = word[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    up, down = powers(len(data))
    total = np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    words = mixed((total[stops] - before) * down[starts])
    bounds = np.searchsorted(starts, offsets)
    factors = mixed(np.arange(1, width + 1)) | np.uint64(1)
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j, f in enumerate(factors):
        grams += words[j : j + len(grams)] * f
    grams = mixed(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            out.append(mixed((words[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(own: np.ndarray) -> int:
    total = mixed(own ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def frequent(docs: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """Hashes of the n-grams that many documents hold, sorted; how many is bounded by the threshold, which grows with the input.

    N-grams that occur once in 4 million are left out where they stand, so sums are of nearly all that repeat. Only the order of
    n-grams depends on this, never the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = [], 0, 0

        def counted():
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            many = times > 1
            return pa.RecordBatch.from_pydict({"g": pa.array(grams[many].view(np.int64)), "n": pa.array(times[many].astype(np.int64))})

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                for own in shingle_sets(data, offsets, width):
                    held.append(own)
                    n += len(own)
                    total += len(own)
                if n >= 4_000_000:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()
        yield pa.RecordBatch.from_pydict({"g": pa.array([None], pa.int64()), "n": pa.array([total], pa.int64())})

    sums = scratch.write(docs.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(f"g is null or n >= {LEAST_FREQUENT}"), "frequent")
    total = sums.where("g is null").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // MAX_FREQUENT))
    found = sums.where(F.col("g").isNotNull() & (F.col("n") >= least)).select("g").toPandas()["g"].to_numpy(dtype=np.int64)
    scratch.drop(sums)
    return np.sort(found.view(np.uint64))


def first_shingles(docs: DataFrame, width: int, percent: int, often: np.ndarray) -> DataFrame:
    """doc_id, n, digest, indexed, cold, grams of every row: the size of its set, the set's digest, its first n-grams in the common
    order, how many of them stand for it against larger sets, and how many come before the frequent ones. A set repeated within
    a task gives its n-grams once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            sizes, digests, indexed, cold, grams, lengths = [], [], [], [], [], [0]
            for _, _, data, offsets in pieces(batch.column(1)):
                for own in shingle_sets(data, offsets, width):
                    n, digest = len(own), _digest(own) if len(own) else 0
                    sizes.append(n)
                    digests.append(digest)
                    take = reach = rare = 0
                    if n and digest not in seen:
                        if len(seen) < 500_000:
                            seen.add(digest)
                        more = SHARED - 1
                        reach = min(n, n - -(-percent * n // 100) + 1 + more)
                        take = min(n, n - -(-2 * percent * n // (100 + percent)) + 1 + more)
                        at = np.minimum(np.searchsorted(table, own), max(len(table) - 1, 0))
                        hot = table[at] == own if len(table) else np.zeros(n, bool)
                        rare = min(reach, int((~hot).sum()))
                        grams.append(np.concatenate((own[~hot][:reach], own[hot][: reach - rare])))
                    indexed.append(take)
                    cold.append(rare)
                    lengths.append(lengths[-1] + reach)
            flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(indexed, pa.int32()), pa.array(cold, pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat.view(np.int64)))],
                ["doc_id", "n", "digest", "indexed", "cold", "grams"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, digest long, indexed int, cold int, grams array<long>")


def regions(firsts: DataFrame) -> DataFrame:
    """gram, digest, n, at (the gram's place in the set), indexed, members: the distinct sets of every region that has two or more.

    An n-gram that isn't frequent is held by few sets, which meet in one window. The sets of a frequent one may be a third of
    all: they are made distinct by (gram, digest), counted by partial sums, and joined with the counts, a join that Spark splits."""
    rows = firsts.select("digest", "n", "indexed", "cold", F.posexplode("grams").alias("at", "gram"))
    rows = rows.select("gram", "digest", "n", "at", (F.col("at") < F.col("indexed")).alias("indexed"), (F.col("at") >= F.col("cold")).alias("_hot"))
    order = Window.partitionBy("gram").orderBy("digest")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    few = rows.where("not _hot").drop("_hot")
    few = few.select("*", (F.col("digest") == F.lag("digest").over(order)).alias("_again"), F.first("digest").over(every).alias("_p"), F.last("digest").over(every).alias("_q"))
    few = few.where((F.col("_p") != F.col("_q")) & ~F.coalesce("_again", F.lit(False))).select("gram", "digest", "n", "at", "indexed")
    few = few.withColumn("members", F.count("*").over(Window.partitionBy("gram")))
    many = rows.where("_hot").drop("_hot").dropDuplicates(["gram", "digest"])
    counts = many.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    return few.unionByName(many.join(counts, "gram").select(*few.columns))


def _close(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _ordered(percent: int):
    """x is the smaller set, by digest where sizes are equal, and not too small."""
    first = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.digest") < F.col("y.digest")))
    return first & (F.col("x.n") * 100 >= F.col("y.n") * percent)


def _before(percent: int):
    """The smaller set stands by its indexed n-grams."""
    return _ordered(percent) & F.col("x.indexed")


def leaf_pairs(found: DataFrame, percent: int) -> DataFrame:
    """u, v, n_u, n_v: pairs of sets in small regions that may be within the radius.

    They must share enough first n-grams. And up to the last one that they share, every n-gram of either that isn't shared is
    missing from the other, as both are in one order: what is missing must leave room for the overlap. Pairs that also meet in
    a large region are decided there, so that only shares in small ones need be counted."""
    small = found.where(F.col("members") <= LEAF).select("gram", "digest", "n", "at", "indexed")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.gram") == F.col("y.gram")) & _before(percent))
    counted = pairs.groupBy(F.col("x.digest").alias("u"), F.col("y.digest").alias("v")).agg(
        F.count("*").alias("c"), F.first("x.n").alias("n_u"), F.first("y.n").alias("n_v"), (F.max("x.at") + 1).alias("to_u"), (F.max("y.at") + 1).alias("to_v")
    )
    counted = counted.withColumn("least", F.ceil((F.col("n_u") + F.col("n_v")) * percent / (100.0 + percent) - 1e-9))
    room = (F.col("n_u") - F.col("to_u") + F.col("c") >= F.col("least")) & (F.col("n_v") - F.col("to_v") + F.col("c") >= F.col("least"))
    return counted.where((F.col("c") >= F.least(F.lit(SHARED), F.col("least"))) & room).select("u", "v", "n_u", "n_v")


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most MAX_BROADCAST_IDS rows (of two or three numbers); it must be a written table."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_IDS else df


def _sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """Whether an odd number of the n-grams fall on each of `bits` bits, as 64-bit words."""
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_SKETCHED = [f"s{k}" for k in range(len(SKETCHES))]


def set_table(docs: DataFrame, firsts: DataFrame, wanted: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """digest, n, grams (sorted, packed), s0 to s2 (sketches; null where the set is too small for them) of the wanted digests, from
    one document of each; a repeated doc_id may give a row twice."""
    wanted = _small(scratch.write(wanted, "wanted"))
    ids = firsts.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("_id")).join(wanted, "digest", "left_semi").select("_id").distinct()
    ids = _small(scratch.write(ids, "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                own = [x for x in shingle_sets(data, offsets, width) if len(x)]
                columns = [pa.array([_digest(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
                columns += [pa.array([_sketch(x, bits) if len(x) >= least else None for x in own], pa.list_(pa.int64())) for bits, least in SKETCHES]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "grams", *_SKETCHED])

    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    made = texts.mapInArrow(run, "digest long, n long, grams binary, " + ", ".join(f"{x} array<long>" for x in _SKETCHED))
    return made.join(wanted, "digest", "left_semi")


def _may_link(x: str, y: str, percent: int):
    """Whether the sketches of x and y differ in no more bits than sets within the radius may in n-grams."""
    ok = F.lit(True)
    for s in _SKETCHED:
        bits = F.aggregate(F.zip_with(f"{x}.{s}", f"{y}.{s}", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
        ok = ok & F.coalesce(bits * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent), F.lit(True))
    return ok


def sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches may link."""
    own = sets.select("digest", "n", *_SKETCHED)
    found = pairs.select("u", "v").join(own.alias("x"), F.col("u") == F.col("x.digest")).join(own.alias("y"), F.col("v") == F.col("y.digest"))
    return found.where(_may_link("x", "y", percent)).select("u", "v")


def distances(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v, common, n_u, n_v of each pair of digests, from the whole sets; a written table.

    Pairs are dealt to cells by the blocks of their two sets, and each cell gets the sets that its pairs name once: pairs move
    as two numbers, and a set as often as there are cells that need it, at most once for each pair. Blocks are made by bytes, so
    that a cell's sets fit a task's memory."""
    sizes = sets.select("digest", "n")
    # Sets that are paired much with each other go to one block, by the least digest that each is paired with; many of them to several.
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("other")))
    kin = scratch.write(ends.groupBy("node").agg(F.min(F.least("node", "other")).alias("kin")).join(sizes.dropDuplicates(["digest"]), F.col("node") == F.col("digest")).drop("digest"), "kin")
    blocks = max(1, -(-(kin.agg(F.sum("n")).first()[0] or 0) // BLOCK_GRAMS))
    parts = kin.groupBy("kin").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).alias("parts"))
    block = F.pmod(F.xxhash64("kin", F.pmod("node", "parts")), F.lit(blocks))
    placed = scratch.write(kin.join(parts, "kin").select("node", block.alias("block")), "blocks")
    dealt = pairs.join(placed.select(F.col("node").alias("u"), F.col("block").alias("_bu")), "u").join(placed.select(F.col("node").alias("v"), F.col("block").alias("_bv")), "v")
    dealt = scratch.write(dealt.select("u", "v", (F.col("_bu") * blocks + F.col("_bv")).alias("cell")), "dealt")
    named = dealt.select(F.col("cell").alias("for_cell"), F.col("u").alias("digest")).unionByName(dealt.select(F.col("cell").alias("for_cell"), F.col("v").alias("digest"))).distinct()
    named = scratch.write(named, "needed")
    needed = sets.select("digest", "grams").join(_small(named), "digest").select("for_cell", "digest", "grams")

    def whole(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known = {d: np.frombuffer(g, np.uint64) for batch in right.to_batches() for d, g in zip(batch.column("digest").to_pylist(), batch.column("grams").to_pylist(), strict=True)}
        us, vs = left["u"].to_pylist(), left["v"].to_pylist()
        common = []
        for u, v in zip(us, vs, strict=True):
            a, b = sorted((known[u], known[v]), key=len)
            at = np.searchsorted(b, a)
            common.append(int((b[np.minimum(at, len(b) - 1)] == a).sum()))
        return pa.table({"u": us, "v": vs, "common": common, "n_u": [len(known[u]) for u in us], "n_v": [len(known[v]) for v in vs]}, schema=_MEASURED)

    found = dealt.groupBy("cell").cogroup(needed.groupBy("for_cell")).applyInArrow(whole, "u long, v long, common long, n_u long, n_v long")
    found = scratch.write(found, "distances")
    scratch.drop(kin, placed, dealt, named)
    return found


def last_pairs(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of members of a cell (cell, digest, n, label, gap) with different labels that windows and sketches leave.

    The keys are the cell, a window of sizes and one of distances to the pivot, as wide as linked sets can differ: x stands in
    its own, y in its own and those beside it. Members whose size rules the pivot out have no distance and meet all of their
    windows of sizes. A window of many members is cut by salts: x goes to one part, y to all."""
    radius = (100 - percent) / 100.0 + 1e-9
    rows = named.select("cell", "digest", "n", "label", "gap").join(sets.select("digest", *_SKETCHED), "digest")
    rows = rows.withColumn("size", F.floor(F.log("n") / math.log(100.0 / percent) * (1 - 1e-9)).cast("int")).withColumn("near", F.floor(F.col("gap") / radius).cast("int"))
    parts = rows.groupBy("cell", "size").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    x = rows.join(parts, ["cell", "size"]).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    # Linked sets differ by at most one window of sizes; y stands in those of all sets that may be the smaller of the pair.
    y = rows.withColumn("to", F.explode(F.array(F.col("size"), F.col("size") - 1))).drop("size").withColumnRenamed("to", "size").join(parts, ["cell", "size"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    all_near = F.array(F.col("near") - 1, F.col("near"), F.col("near") + 1)
    known = y.where("near is not null").withColumn("to", F.explode(all_near)).drop("near").withColumnRenamed("to", "near")
    same = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.part") == F.col("y.part"))
    both = _ordered(percent) & (F.col("x.label") != F.col("y.label")) & _may_link("x", "y", percent)
    window = (F.col("x.near") == F.col("y.near")) & (F.abs(F.col("x.gap") - F.col("y.gap")) <= radius)
    out = x.where("near is not null").alias("x").join(known.alias("y"), same & window & both).select(F.col("x.digest").alias("u"), F.col("y.digest").alias("v"))
    for a, b in (("near is null", "true"), ("near is not null", "near is null")):
        out = out.unionByName(x.where(a).alias("x").join(y.where(b).alias("y"), same & both).select(F.col("x.digest").alias("u"), F.col("y.digest").alias("v")))
    return out.distinct()


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(F.col("common") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("common")) * percent).select("u", "v")


def link_table(docs: DataFrame, firsts: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, n, digest of every row of firsts, which is dropped, and u, v: links between distinct sets, enough of
    them that components of these are the components of all links."""
    found = scratch.write(regions(firsts), "regions")
    rows = scratch.write(firsts.select("doc_id", "n", "digest"), "rows")
    scratch.drop(firsts)
    leaves = scratch.write(leaf_pairs(found, percent), "leaves")
    large = found.where(F.col("members") > LEAF)
    wanted = leaves.select(F.col("u").alias("digest")).unionByName(leaves.select(F.col("v").alias("digest"))).unionByName(large.select("digest")).distinct()
    sets = scratch.write(set_table(docs, rows, wanted, width, scratch), "sets")
    close = scratch.write(sketched(leaves, sets, percent), "close")
    links = scratch.write(_linked(distances(close, sets, scratch), percent), "links")
    # A set in the middle of its kind has few n-grams of its own, so that it stands in more of the large regions than its kin.
    central = large.groupBy("digest").agg(F.count("*").alias("central"))
    large = scratch.write(large.select("gram", "digest", "n").join(central, "digest"), "large")
    scratch.drop(found, leaves, close)
    first = F.min(F.struct((-F.col("central")).alias("c"), F.col("digest").alias("d"), F.col("n").alias("m")))
    chosen = large.groupBy("gram").agg(first.alias("_c")).select("gram", F.col("_c.d").alias("pivot"), F.col("_c.m").alias("pivot_n"))
    # Regions of one pivot make up its cell: near copies share dozens of regions, and a cell has each of them once.
    rest = scratch.write(large.join(chosen, "gram").select(F.col("pivot").alias("cell"), "digest", "n", "central", "pivot", "pivot_n").distinct(), "rest")
    before = None
    for turn in range(MAX_ROUNDS + 1):
        if rest.isEmpty():
            break
        # Every member's distance to its cell's pivot: as many as members, whatever the cell's size.
        near = rest.where((F.col("digest") != F.col("pivot")) & _close("n", "pivot_n", percent)).select(F.col("digest").alias("u"), F.col("pivot").alias("v")).distinct()
        measured = distances(near, sets, scratch)
        links = scratch.write(links.unionByName(_linked(measured, percent)).distinct(), "links")
        labels = components(links, scratch)
        gap = measured.select(F.col("u").alias("digest"), F.col("v").alias("pivot"), (1 - F.col("common") / (F.col("n_u") + F.col("n_v") - F.col("common"))).alias("gap"))
        named = rest.join(labels, rest["digest"] == labels["node"], "left").drop("node").withColumn("label", F.coalesce("label", "digest"))
        named = named.join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("_pl")), "pivot", "left").withColumn("_pl", F.coalesce("_pl", "pivot"))
        # Resolved cells, all of one component, go; so do pivots, which have met every member.
        several = named.groupBy("cell").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("cell")
        named = named.where(F.col("digest") != F.col("pivot")).join(several, "cell", "left_semi")
        named = scratch.write(named.join(gap, ["digest", "pivot"], "left"), "named")
        load = named.groupBy("cell").agg(F.count("*").alias("m"), F.count_if(F.col("label") != F.col("_pl")).alias("out")).agg(F.sum(F.col("m") * F.col("out")).alias("pairs"), F.sum("m").alias("rows")).first()
        if not load["rows"]:
            break
        # More pivots, while each round takes at least half of what is left to compare; else the rest is compared by windows.
        if turn == MAX_ROUNDS or load["pairs"] <= FEW_PAIRS + PAIRS_A_ROW * load["rows"] or before and load["pairs"] > before / 2:
            pairs = scratch.write(last_pairs(named, sets, percent), "pairs")
            links = scratch.write(links.unionByName(_linked(distances(pairs, sets, scratch), percent)).distinct(), "links")
            break
        before = load["pairs"]
        # The next pivot of a cell: the most central member from outside the last pivot's component.
        choice = F.min(F.struct((F.col("label") == F.col("_pl")).alias("same"), (-F.col("central")).alias("c"), F.col("digest").alias("d"), F.col("n").alias("m")))
        chosen = named.groupBy("cell").agg(choice.alias("_c")).select("cell", F.col("_c.d").alias("pivot"), F.col("_c.m").alias("pivot_n"))
        rest = scratch.write(named.select("cell", "digest", "n", "central").join(chosen, "cell"), "rest")
    scratch.drop(sets)
    return rows, links


def join_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two documents link when the Jaccard index of their sets of word n-grams is at least `percent` in a hundred; component_id is
    the least doc_id that links reach. Documents without words or text have an empty set and reach only themselves; a
    document with fewer words than `width` is one n-gram. Equal sets are one class and never paired. A null doc_id is passed
    over as least, and is the id of a component of such rows only. Repeated rows are returned each. No partner, region or
    candidate is capped: hot regions go by pivots, which costs a distance for each member."""
    labelled = _labelled(docs, width, percent)
    return labelled.select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, digest (of the set) and label (the component's least digest) of every row."""
    docs, scratch = docs.select("doc_id", "text"), Scratch(docs.sparkSession)
    often = frequent(docs, width, scratch)
    firsts = scratch.write(first_shingles(docs, width, percent, often), "firsts")
    rows, links = link_table(docs, firsts, width, percent, scratch)
    labels = components(links, scratch)
    rows = rows.join(labels, F.col("digest") == F.col("node"), "left").select("doc_id", "n", "digest", F.coalesce("label", "digest").alias("label"))
    least = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("_least"))
    full = rows.where("n > 0").join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), F.col("_least").alias("component_id"), "digest", "label")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "digest", "label"))


def _with_digest(docs: DataFrame, width: int) -> DataFrame:
    """docs with _digest, that of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(x) if len(x) else 0 for _, _, data, offsets in pieces(batch.column(batch.num_columns - 1)) for x in shingle_sets(data, offsets, width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], "_digest"])

    held = docs.select("doc_id", F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return held.mapInArrow(run, StructType([*held.schema.fields[:-1], StructField("_digest", LongType())]))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with the document of least doc_id of each component, and every document without words; columns as they came.

    A row goes by its doc_id and its set, so that of rows that share a doc_id each is judged by its own text; of equal ones that
    stay, and of rows of one doc_id and component, one is kept. Rows with a null doc_id stay."""
    joined = written(_labelled(docs, width, percent), "joined").where("doc_id is not null")
    twice = joined.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_twice_id"))
    gone = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"))
    if twice.isEmpty():
        return row.join(gone, F.col("_id") == F.col("_gone_id"), "left_anti").select("_row.*")
    single = row.join(gone.join(twice, F.col("_gone_id") == F.col("_twice_id"), "left_anti"), F.col("_id") == F.col("_gone_id"), "left_anti").join(twice, F.col("_id") == F.col("_twice_id"), "left_anti").select("_row.*")
    verdict = joined.join(twice, F.col("doc_id") == F.col("_twice_id"), "left_semi").where("n_shingles = 0 or doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"), "label", "n_shingles").distinct()
    several = _with_digest(row.join(twice, F.col("_id") == F.col("_twice_id"), "left_semi").select("_row.*"), width)
    several = several.join(verdict, (F.col("doc_id") == F.col("_id")) & (F.col("_digest") == F.col("_d")))
    full = several.where("n_shingles > 0").dropDuplicates(["doc_id", "label"]).select("_row.*")
    return single.unionByName(full).unionByName(several.where("n_shingles = 0").select("_row.*"))
