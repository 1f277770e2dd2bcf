"""Links between sets of n-grams that meet in buckets, and the groups that the links make.

A set is a node with its size n and its n-grams in one order that all sets share. A link needs an overlap of
c (n_x + n_y) with c = s / (1 + s), which is the similarity s said of sizes. Candidates come from buckets; the rows
of document by n-gram incidence of the candidates are multiplied block by block (`product`): the n-grams of a row
are marked in a dense array over the block's columns, and every partner's marks are summed.

All pairs are formed only in buckets of at most FEW members, and only if sizes and places leave room for
a link, if the pair meets as often as a link has to, by parities of BITS bits too. A larger bucket picks one member, the hub h, that all others are multiplied with; they
form h's line. What can be missed then is a link of which one side isn't linked with h. A line is cut into blocks
of at most BLOCK members, and every two blocks of a line are one task's work (`_near`): it holds the parities of their members
against each other, which say how much two sets differ at least, and so do their differences from h. What is left has
nearly the similarity asked for. Members near to many others form a group of their own, so every member is multiplied with at
most a few of those at first, such that have most members near them, and again with four times as many only where
pairs were left and the links found haven't joined them. Large buckets are cut by size first, each member in two
neighbouring classes. Nothing is dropped, and a pair that isn't formed is proven to be no link or joined by others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.text import SPACED, Words, list_array, mix, slices
from tabulon.plans.stage import discard, stage

#: Buckets of at most so many members are compared pair by pair, in every round.
FEW = 32
#: Members of a line's block, and how many of those near it a member is multiplied with at first.
BLOCK, NEAREST = 1024, 4
BITS = 1024
#: Sets with at least this share of all rows are broadcast, at most 1 / COMMON of them.
COMMON = 1e-4
DIGEST = ["n", "d1", "d2"]
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 20
_PARTS, _TOGETHER = 16, 256


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle of `width` words, by row and hash; shorter sequences are one shingle."""
    h = words.hashes()
    pieces, rows = [], []
    if len(h) >= width:
        n = len(h) - width + 1
        window = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            window = mix(window * _GOLDEN + h[j : j + n])
        inside = words.row[:n] == words.row[width - 1 :]
        pieces.append(window[inside])
        rows.append(words.row[:n][inside])
    for row in np.flatnonzero((words.counts > 0) & (words.counts < width)):
        one = np.array([words.counts[row]], dtype=np.uint64)
        for x in h[words.first[row] : words.first[row + 1]]:
            one = mix(one * _GOLDEN + x)
        pieces.append(one)
        rows.append(np.array([row]))
    if not pieces:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    value, row = np.concatenate(pieces), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return row[fresh], value[fresh]


def digests(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two sums of hashes that name the set."""
    size = np.bincount(row, minlength=rows)
    sums = np.zeros((2, rows), dtype=np.uint64)
    np.add.at(sums[0], row, mix(value))
    np.add.at(sums[1], row, mix(value ^ _GOLDEN))
    return size.astype(np.int64), sums[0].view(np.int64), sums[1].view(np.int64)


def parities(row: np.ndarray, value: np.ndarray, rows: int) -> pa.ListArray:
    """BITS bits for each set, each the parity of the n-grams that fall on it.

    Bits that differ between two sets are at most as many as the n-grams that only one of them has."""
    bit = (mix(value + _GOLDEN) >> np.uint64(64 - 10)).astype(np.int64)
    odd = (np.bincount(row * BITS + bit, minlength=rows * BITS) & 1).astype(np.uint8)
    return list_array(pa.array(np.packbits(odd).view(np.int64)), np.full(rows, BITS // 64))


def least_size(permille: int) -> int:
    """The least set that a link can join to a larger one, which then has one shingle more: k / (k + 1) is enough.

    Smaller sets are either equal or less similar; at 1000 all are."""
    return -(-permille // (1000 - permille)) if permille < 1000 else 1 << 62


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(44)).astype(np.int64)


def _count_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column("text")):
                counts += np.bincount(_slot(shingles(Words(part, SPACED), width)[1]), minlength=SLOTS)
        if counts.any():
            some = TaskContext.get().partitionId() // _TOGETHER
            packed = [x.tobytes() for x in np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(_PARTS, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([some] * _PARTS, pa.int32()), pa.array(packed, pa.binary())],
                names=["part", "some", "counts"],
            )

    return run


def _add(kind: type, to: type):
    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros(SLOTS // _PARTS, dtype=np.int64)
        for one in table.column("counts"):
            sums += np.frombuffer(one.as_buffer(), dtype=kind)
        if to is np.uint8:  # the logarithm
            sums = np.frexp(sums.astype(np.float64))[1]
        one = table.slice(0, 1)
        return pa.table({"part": one["part"], "some": one["some"], "counts": pa.array([sums.astype(to).tobytes()], pa.binary())})

    return run


def frequencies(texts: DataFrame, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives the rough logarithm of n-grams' counts in all texts, from SLOTS hashed slots, SLOTS bytes."""
    shape = "part int, some int, counts binary"
    counted = texts.mapInArrow(_count_batches(width), shape).groupBy("part", "some").applyInArrow(_add(np.uint16, np.int64), shape)
    out = np.zeros((_PARTS, SLOTS // _PARTS), dtype=np.uint8)
    for row in counted.groupBy("part").applyInArrow(_add(np.int64, np.uint8), shape).toLocalIterator():
        out[row["part"]] = np.frombuffer(row["counts"], dtype=np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(out.reshape(-1))
    return lambda value: shared.value[_slot(value)]


def product(a: pa.ListArray, b: pa.ListArray, mark: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each pair of rows: both sizes, the n-grams that b has and a lacks, and those that a has and b lacks.

    mark names a's row, so rows that follow each other with one mark are laid out once."""
    flat_a, flat_b = (x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
    to_a, to_b = (np.concatenate([[0], np.cumsum(np.diff(x.offsets.to_numpy()))]) for x in (a, b))
    names = mark.to_pylist()
    columns, code = np.unique(flat_b, return_inverse=True)
    in_a, in_b = (np.zeros(len(columns) + 1, dtype=bool) for _ in range(2))  # the last is for n-grams of no b
    own, laid, last = flat_a[:0], np.zeros(0, dtype=np.int64), None
    for i, name in enumerate(names):
        if last is None or name != names[last]:
            in_a[laid] = False
            own = flat_a[to_a[i] : to_a[i + 1]]
            laid = np.searchsorted(columns, own)
            laid[laid < len(columns)] = np.where(
                columns[laid[laid < len(columns)]] == own[laid < len(columns)], laid[laid < len(columns)], len(columns)
            )
            in_a[laid] = True
            in_a[-1] = False
            last = i
        span = slice(to_b[i], to_b[i + 1])
        in_b[code[span]] = True
        yield len(own), to_b[i + 1] - to_b[i], flat_b[span][~in_a[code[span]]], own[~in_b[laid]]
        in_b[code[span]] = False


def _compare_batches(permille: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes, apart = [], [], []
            for n_a, n, more, less in product(batch.column("grams_a"), batch.column("grams_b"), batch.column("a")):
                linked.append((n - len(more)) * (1000 + permille) >= permille * (n + n_a))
                sizes.append(n), apart.append(len(more) + len(less))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("line", "a", "b")] + [pa.array(linked, pa.bool_()), *(pa.array(v, pa.int64()) for v in (sizes, apart))],
                names=["line", "a", "b", "linked", "n", "apart"],
            )

    return run


COMPARED = "line long, a long, b long, linked boolean, n long, apart long"


def _near(permille: int, most: int):
    """Pairs of two blocks of a line that may be links, `most` for each member, and how many more there are."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        node, label, n, apart, block = (table[k].to_numpy() for k in ("node", "label", "n", "apart", "block"))
        linked = table["linked"].to_numpy()
        parity = table["parity"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        close = 1000 - permille
        pairs = [np.zeros((2, 0), dtype=np.int64)]

        def hold(xs: np.ndarray, ys: np.ndarray) -> None:
            for start in range(0, len(xs), 64):
                x = xs[start : start + 64, None]
                room = close * (n[x] + n[ys])
                fits = (label[x] != label[ys]) & ((1000 + permille) * np.abs(apart[x] - apart[ys]) <= room)
                fits &= 1000 * np.minimum(n[x], n[ys]) >= permille * np.maximum(n[x], n[ys])
                if i == j:
                    fits &= linked[ys] | (node[x] < node[ys])
                at, to = np.nonzero(fits)
                one, two = xs[start + at], ys[to]
                differ = np.bitwise_count(parity[one] ^ parity[two]).sum(axis=1, dtype=np.int64)
                fit = (1000 + permille) * differ <= room[at, to]
                pairs.append(np.array([one[fit], two[fit]]))

        first, second = (np.flatnonzero(block == k) for k in (i, j))
        hold(first[~linked[first]], second)
        if i != j:
            hold(second[~linked[second]], first[linked[first]])
        x, y = np.concatenate(pairs, axis=1)
        degree = np.bincount(np.concatenate([x, y]), minlength=len(node))
        kept = np.zeros(len(x), dtype=bool)
        for one, two in ((x, y), (y, x)):  # a side that is in both roles has `most` in each
            order = np.lexsort((node[two], -degree[two], one))
            sizes = np.bincount(one, minlength=len(node))
            rank = np.arange(len(one)) - (np.cumsum(sizes) - sizes)[one[order]]
            kept[order[rank < most]] = True
        x, y = node[x[kept]], node[y[kept]]
        return pa.table({
            "a": pa.array([*np.minimum(x, y).tolist(), None], pa.int64()), "b": pa.array([*np.maximum(x, y).tolist(), None], pa.int64()),
            "left": pa.array([0] * len(x) + [int((~kept).sum())], pa.int64()),
        })

    return run


def meetings(few: DataFrame, permille: int, shared: int) -> DataFrame:
    """(a, b, sizes) of members that meet in small buckets, as often as a link needs if they meet nowhere else."""
    other = few.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "rest")])
    met = (
        few.join(other, "bucket")
        .where("node_a < node")
        .where(f"1000 * least(n, n_a) >= {permille} * greatest(n, n_a)")
        .where(f"{1000 + permille} * least(rest, rest_a) >= {permille} * (n + n_a)")
        .groupBy(F.col("node_a").alias("a"), F.col("node").alias("b"))
    )
    larger = F.max(F.greatest("n", "n_a")).alias("larger")
    met = met.agg(F.min(F.col("n") + F.col("n_a")).alias("sizes"), larger, F.count("*").alias("times"))
    return met.where(F.expr(f"times >= least({shared}, ceil({permille} * larger / 1000))")).select("a", "b", "sizes")


def links(
    members: DataFrame, bits: DataFrame, sets: Callable[[DataFrame], DataFrame], permille: int, shared: int = 1
) -> DataFrame:
    """(a, b) of nodes, enough of them to join all nodes that links join.

    members: bucket, node, n, and rest, which bounds the overlap of two members by what they have from the bucket on (n where
    nothing is known), given, the number of a node's buckets. shared: the buckets that both sides of a link have in common
    at least, or all n-grams of their overlap if that is less; rest must hold in as many of them. bits: node, parity (see parities), which leaves out pairs that surely differ too much,
    except with a hub. sets: from a frame with the column node to (node, grams).
    """
    zero = F.lit(0).cast("long")
    differ = "aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    # large buckets are cut by size
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = stage(members.join(sizes, "bucket"))
    size_class = F.floor(F.log("n") / math.log(1000 / permille)) if permille < 1000 else F.col("n")
    parts = F.when(F.col("size") <= FEW, F.array("bucket")).otherwise(
        F.array(F.xxhash64("bucket", size_class), F.xxhash64("bucket", size_class + 1))
    )
    members = met.withColumn("bucket", F.explode(parts)).drop("size")
    kept = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held = stage(members.join(kept, "bucket"))
    discard(met)
    few, many = held.where(F.col("size") <= FEW), held.where(F.col("size") > FEW)
    mutual = meetings(few, permille, shared)  # a pair that also meets in a larger bucket is settled there
    for side in "ab":
        mutual = mutual.join(bits.select(F.col("node").alias(side), F.col("parity").alias(f"parity_{side}")), side)
    mutual = mutual.where(f"{1000 + permille} * {differ} <= {1000 - permille} * sizes").select("a", "b")
    found = held.groupBy("node").agg(F.count("*").alias("met"))
    alone = (F.col("met") - F.col("given")).alias("alone")  # a hub should have little that nobody shares
    best = F.struct(alone, "met", (-F.col("n")).alias("less"), (-F.col("node")).alias("first"))
    hubs = many.join(found, "node").groupBy("bucket").agg(F.max(best).alias("h")).select("bucket", (-F.col("h.first")).alias("a"))
    spokes = many.join(hubs, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    no_hub = (zero.alias("line"), "a", F.col("a").alias("label_a"), "b", F.col("b").alias("label_b"), F.lit(False).alias("hub"))
    to_hub = (F.xxhash64("a").alias("line"), *no_hub[1:-1], F.lit(True).alias("hub"))
    pairs = stage(mutual.select(*no_hub).union(spokes.select(*to_hub)))
    discard(held)
    if pairs.isEmpty():
        return pairs.select("a", "b")
    # what follows has no other nodes
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    rows = stage(sets(stage(nodes.distinct())))

    def compare(pairs: DataFrame) -> DataFrame:
        a, b = (rows.select(F.col("node").alias(k), F.col("grams").alias(f"grams_{k}")) for k in "ab")
        return stage(pairs.join(b, "b").join(a, "a").mapInArrow(_compare_batches(permille), COMPARED))

    found = compare(pairs)
    joined = found.where("linked").select("a", "b")
    spoke = found.join(pairs.where("hub").select("line", "a", "b"), ["line", "a", "b"], "left_semi")
    whole = spoke.groupBy("line").agg(F.count("*").alias("size"), F.count_if(~F.col("linked")).alias("apart"))
    whole = whole.where("size > 1 and apart > 0").select("line", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    lines = stage(
        spoke.join(whole, "line").join(bits, F.col("b") == bits["node"]).select(
            "line", "node", "n", "apart", "linked", "parity", "blocks", F.expr("if(linked, a, b)").alias("label"),
            F.expr("cast(pmod(xxhash64(b), blocks) as int)").alias("block"),
        )
    )
    most = NEAREST
    while not lines.isEmpty():
        other = lines.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        shown = tiles.select("line", "i", "j", "block", "node", "label", "n", "apart", "linked", "parity")
        near = stage(shown.groupBy("line", "i", "j").applyInArrow(_near(permille, most), "a long, b long, left long"))
        pairs = stage(near.where("a is not null").select("a", "b").distinct().select(*no_hub))
        joined = joined.union(compare(pairs).where("linked").select("a", "b"))
        if near.where("left > 0").isEmpty():
            break
        roots = components(joined)
        labelled = lines.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        lines, most = stage(labelled), 4 * most
    return joined.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node reachable.

    Alternates the two star operations: every node's larger neighbours are tied to its least neighbour, then
    its smaller ones. Each step is written out, so a lost executor repeats one step.
    """
    pairs = stage(
        pairs.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    )
    before = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), "m")
        pairs = stage(small.where("u <> m").select("u", F.col("m").alias("v")).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _gram_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                row, value = shingles(Words(part, SPACED), width)
                n, d1, d2 = digests(row, value, part.rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n), pa.array(d1), pa.array(d2), list_array(pa.array(value.view(np.int64)), n)],
                    names=[*DIGEST, "grams"],
                )

    return run


def grouped(
    docs: DataFrame, sketched: DataFrame, column: str, members: Callable[[DataFrame], DataFrame], width: int, permille: int,
    shared: int = 1,
) -> DataFrame:
    """sketched's line, id and n with `component`, the least id of the row's group, and `first`, the group's first line.

    docs: id, text. sketched: a written table with line (a number for each row), id, n, d1, d2, parity and `column`, from which
    members makes the buckets: it takes (node, n, `column`) of one row for each set and gives (bucket, node, n, rest, given);
    shared: see links.
    The sets are read again from the texts.
    """
    classes = stage(
        sketched.where("n > 0").groupBy(*DIGEST).agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "line")).alias("one"), F.count("*").alias("copies")
        ).select(*DIGEST, F.col("one.line").alias("node"), F.col("one.id").alias("least"), "copies")
    )
    wide = sketched.where(f"n >= {least_size(permille)}").select(F.col("line").alias("node"), "n", column)
    leaders = wide.join(classes.where(f"n >= {least_size(permille)}").select("node"), "node", "left_semi")

    def sets(nodes: DataFrame) -> DataFrame:
        asked = stage(classes.join(nodes, "node").select(*DIGEST, "node", "least"))
        ids = stage(asked.select("least").distinct())
        texts = docs.join(ids, docs["id"].eqNullSafe(ids["least"]), "left_semi").select("text")
        grams = texts.mapInArrow(_gram_batches(width), "n long, d1 long, d2 long, grams array<long>")
        return grams.groupBy(*DIGEST).agg(F.first("grams").alias("grams")).join(asked.drop("least"), DIGEST).select("node", "grams")

    bits = sketched.select(F.col("line").alias("node"), "parity")
    roots = stage(components(links(members(leaders), bits, sets, permille, shared)))
    linked = classes.join(roots, "node").select("node", "root", F.struct(F.col("least").isNull().alias("none"), "least", "node").alias("one"))
    whole = linked.groupBy("root").agg(F.min("one").alias("one"))
    named = linked.join(whole.select("root", F.col("one").alias("to")), "root").select(
        "node", F.col("to.least").alias("to"), F.col("to.node").alias("first")
    )
    named = classes.join(named, "node", "left").select(
        *DIGEST, "copies", F.expr("if(first is null, least, to)").alias("component"), F.coalesce("first", "node").alias("first")
    )
    named = stage(named)
    total = sketched.count()
    common = F.broadcast(named.where(F.col("copies") >= max(2.0, COMMON * total)).drop("copies"))
    plain = sketched.select("line", "id", *DIGEST)
    hot = plain.join(common, DIGEST)
    other = plain.join(common, DIGEST, "left_anti")
    other = other.where("n > 0").join(named.drop("copies"), DIGEST)
    none = plain.where("n = 0").select("*", F.col("id").alias("component"), F.col("line").alias("first"))
    return hot.unionByName(other).unionByName(none).select("line", "id", "n", "component", "first")
