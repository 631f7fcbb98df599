"""Exact similarity join of texts on the Jaccard similarity of word n-gram sets.

Two documents link when 100 * |A & B| >= 75 * |A | B|, A and B being their sets of 5-word
shingles. Nothing is sampled; all steps below only leave out pairs that provably don't link.

1. Equal sets are one class. From here on a class is one node with n shingles.
2. Slack. Take any order of all shingles and the first common shingle of two nodes in it. If
   r shingles of x stand before it, all r are missed by the other node. Linked nodes miss at
   most (n(x) + n(y)) / 7 of each other's shingles in all, so their slacks n - 7 r add up to 0
   or more. A shingle that no other node holds comes first, then the rarest.
   A group is a shingle and a band of sizes; in it each node needs a fit partner, which is the
   one with the largest slack or nobody. This takes one row a node and shingle, no pairs.
3. First the slack is taken over regions: a node's shingles whose hash lies in the lowest
   quarter of hashes, and at least the n // 4 + 1 lowest. Nodes without a partner go; of
   the others (the texts are read again, through a filter of their classes) the whole sets are
   kept in a table, and the slack is taken again over all shingles. All nodes that attach to
   one largest node in one band are a block.
4. Tiles: a block is cut into tiles of bounded count and bytes, each with the largest node. A
   tile makes a bitmap of one length, fixed by its band of sizes, of each set. Bits
   that x has and y lacks bound the overlap from above; pairs still in reach are decided by
   intersecting their sorted arrays. Of the links only a spanning forest leaves the tile.
5. Pairs of different tiles of a block: once components are known, the nodes outside the largest
   component of the block meet all others of the block, in tiles again.
6. Components of the links; a component's label is its smallest document id.

Shingles are compared by 64-bit hashes: a pair of texts with n shingles each takes a false
common shingle with a chance of n * n / 2**64.

Edge cases: A-Z are lower-cased; fewer than 5 words make one shingle of them all; null or
wordless texts have no shingle, link with nothing and are their own component; very long
texts are shingled whole, and one that exceeds a tile's bytes is handled with as few others as
possible; repeated rows are separate documents of one class; a null id never labels a component
that has another id, and a document with a null id that links with nothing has a null
component; ties don't matter, as labels are the smallest id; an empty table gives an empty
result; extra columns are carried, whatever their names, and replaced where they clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .npbytes import BLOCK, IS_SPACE, TO_LOWER, blocks, hashes, mixed, runs, tidy

SHINGLE = 5
#: Odd multipliers of the words of a shingle, by place, and of its length.
PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
LOWEST_QUARTER = -(1 << 62)
#: Sizes of a band differ by a factor of less than BAND, which is more than sizes of linked sets do (4/3).
BAND = 1.35
#: Nodes and bytes of sets of a side of a tile.
TILE, TILE_BYTES = 1024, 8 << 20
#: Bits of a bitmap for each shingle of the largest set that it is made for, at least.
BITS = 4


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (signed) of each text."""
    start, end, text = runs(~IS_SPACE[data], offsets)
    words = hashes(TO_LOWER[data], start, end)
    first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(offsets) - 1))))
    n = max(len(words) - SHINGLE + 1, 0)
    total = np.zeros(n, np.uint64)
    for k, factor in enumerate(PLACES):
        total += words[k : k + n] * np.uint64(factor)
    total = mixed(total).view(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(total[a : b - SHINGLE + 1]))
        elif b > a:
            own = (words[a:b] * np.array(PLACES[: b - a], np.uint64)).sum(keepdims=True)
            out.append(mixed(own + np.uint64(b - a)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two columns of 64."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, m, s1, s2, region): m is the number of shingles in the lowest quarter, s1 and s2 the signature."""
    for batch in batches:
        for begin, end, data, offsets in blocks(batch.column("__text"), BLOCK):
            sets = shingles(data, offsets)
            n = np.array([len(s) for s in sets], np.int32)
            m = np.array([np.searchsorted(s, LOWEST_QUARTER) for s in sets], np.int32)
            take = np.minimum(np.maximum(m, n // 4 + 1), n)
            sig = signatures(sets)
            region = lists([s[:k] for s, k in zip(sets, take.tolist(), strict=True)])
            columns = [batch.column("__id").slice(begin, end - begin), pa.array(n), pa.array(m), pa.array(sig[:, 0]), pa.array(sig[:, 1]), region]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "n", "m", "s1", "s2", "region"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of the text: n, s1 and s2."""
    for batch in batches:
        for begin, end, data, offsets in blocks(batch.column("__text"), BLOCK):
            sets = shingles(data, offsets)
            sig, rest = signatures(sets), batch.slice(begin, end - begin)
            columns = [rest.column("__id"), rest.column("__rest"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "__rest", "n", "s1", "s2"])


def _whole_sets(wanted):
    """(text) to (s1, s2, own) of the texts whose signature may be wanted: whole sorted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = wanted.value
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("__text"), BLOCK):
                sets = shingles(data, offsets)
                sig = signatures(sets)
                at = np.flatnonzero(common.is_member(filled, np.ascontiguousarray(sig[:, 0])))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[at, 0]), pa.array(sig[at, 1]), lists([sets[i] for i in at])], ["s1", "s2", "own"])

    return run


def _met(slacks: DataFrame) -> DataFrame:
    """(node, lead, band): of (h, node, n, slack), the nodes with a fit partner in a group of shingle and band, and its lead.

    A band's group has the nodes of its sizes (low) and of the next band's (high). The
    lead is the node of most slack. A low node fits if its slack and that of the lead, or of the next
    where it is the lead, add up to 0; a high node needs a low one.
    """
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    both = slacks.select("h", "node", "slack", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("low")), F.struct((band - 1).alias("band"), F.lit(False).alias("low")))).alias("b"))
    both = both.select("h", "node", "slack", "b.*")
    tops = both.groupBy("h", "band").agg(
        F.max(F.struct("slack", "node")).alias("top"), F.max(F.when(F.col("low"), F.col("slack"))).alias("low_slack"), F.count(F.lit(1)).alias("members")
    ).where("low_slack is not null and members > 1").select("h", "band", F.col("top.node").alias("lead"), F.col("top.slack").alias("lead_slack"), "low_slack")
    tops = common.cut(tops)  # read from a table, as in _shared
    fit = both.join(tops, ["h", "band"]).where("node != lead and slack + if(low, lead_slack, low_slack) >= 0").select("node", "lead", "band").distinct()
    met = common.cut(fit.union(fit.select(F.col("lead").alias("node"), "lead", "band")).distinct())
    common.drop(tops)
    return met


def _shared(postings: DataFrame) -> DataFrame:
    """``postings`` (h, ...) of shingles that two nodes or more hold, with their number cnt.

    Counts are added up before their shuffle and read from a table, so that Spark can split the join where a third of the postings are of one shingle.
    """
    counts = common.cut(postings.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("cnt")).where("cnt > 1"))
    common.release(postings.sparkSession)
    shared = common.cut(postings.join(counts, "h"))
    common.drop(counts)
    common.release(postings.sparkSession)
    return shared


def _of_regions(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slacks by region, the table of shared postings that they are read from). Of the shingles of the lowest quarter it is known who shares them; the others come after them, by hash."""
    shared = _shared(classes.select("node", F.posexplode("region").alias("i", "h")))
    placed = shared.join(classes.select("node", "n", "m"), "node").withColumn("high", F.expr(f"h >= {LOWEST_QUARTER}"))
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("high", "cnt", "h"))
    before = F.when(F.col("high"), F.col("i")).otherwise(F.col("m") - F.count_if(~F.col("high")).over(own) + place - 1)
    return placed.select("h", "node", "n", before.alias("r")).where("r <= n div 4").select("h", "node", "n", F.expr("n - 7 * r").alias("slack")), shared


def _of_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slacks by the whole sets, and the table of shared postings."""
    shared = _shared(sets.select("node", "n", F.explode("own").alias("h")))
    own = Window.partitionBy("node")
    before = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("cnt", "h")) - 1
    return shared.select("h", "node", "n", before.alias("r")).where("r <= n div 4").select("h", "node", "n", F.expr("n - 7 * r").alias("slack")), shared


def bitmaps(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each of the sets that ``flat`` lists, of one length for all."""
    bits = max(64, 1 << int(BITS * int(sizes.max()) - 1).bit_length())
    out = np.zeros((len(sizes), bits), bool)
    out[np.repeat(np.arange(len(sizes)), sizes), ((flat.view(np.uint64) >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


class Tile:
    """The sets of a tile, by place."""

    def __init__(self, own: pa.Array, n: np.ndarray, low: np.ndarray) -> None:
        self.flat, self.n, self.low = own.values.to_numpy()[own.offsets[0].as_py() : own.offsets[-1].as_py()], n.astype(np.int64), low
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.bits = bitmaps(self.flat, self.n)

    def fits(self, a: int) -> np.ndarray:
        return (self.low | self.low[a]) & (4 * self.n >= 3 * self.n[a]) & (4 * self.n[a] >= 3 * self.n)

    def linked(self, a: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that link with ``a``: bitmaps bound the overlap, then sorted arrays are intersected."""
        n, m = self.n[a], self.n[others]
        lacking = np.bitwise_count(self.bits[a] & ~self.bits[others]).sum(axis=1, dtype=np.int64), np.bitwise_count(self.bits[others] & ~self.bits[a]).sum(axis=1, dtype=np.int64)
        others = others[7 * np.minimum(n - lacking[0], m - lacking[1]) >= 3 * (n + m)]
        if not len(others):
            return others
        left, right = self.flat[self.first[a] : self.first[a + 1]], np.concatenate([self.flat[self.first[b] : self.first[b + 1]] for b in others])
        at = np.searchsorted(left, right)
        same = left[np.minimum(at, n - 1)] == right
        m = self.n[others]
        overlap = np.add.reduceat(same, np.concatenate(([0], np.cumsum(m)[:-1])), dtype=np.int64)
        return others[7 * overlap >= 3 * (n + m)]


def _array(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _tile_of(t: pa.Table) -> Tile:
    own = t.column("own").combine_chunks()
    return Tile(own.chunk(0) if isinstance(own, pa.ChunkedArray) else own, _array(t, "n"), _array(t, "low"))


def _forest(t: pa.Table) -> pa.Table:
    """Links (a, b) that connect what the rows (role not 2) and columns (role not 1) of a tile connect, components being known."""
    made_a, made_b = [], []
    tile, node, role, of = _tile_of(t), _array(t, "node"), _array(t, "role"), np.array(_array(t, "component"))
    place = np.arange(len(node))
    for a in np.flatnonzero(role < 2).tolist():
        others = np.flatnonzero(tile.fits(a) & (of != of[a]) & (role != 1) & ((role != 0) | (place > a)))
        if not len(others):
            continue
        for b in tile.linked(a, others).tolist():
            if of[b] != of[a]:
                made_a.append(node[a])
                made_b.append(node[b])
                of[of == of[b]] = of[a]
    return pa.table({"a": pa.array(made_a, pa.int64()), "b": pa.array(made_b, pa.int64())})


def _degrees(t: pa.Table) -> pa.Table:
    """(node, linked): documents that a node's class links with, of the pairs of this tile; a pair counts in the first block that both are in."""
    tile, node, role, weight = _tile_of(t), _array(t, "node"), _array(t, "role"), _array(t, "class_size")
    lead, leads, place, total = t.column("lead")[0].as_py(), t.column("leads").to_pylist(), np.arange(len(node)), np.zeros(len(node), np.int64)
    several = np.array([len(x) > 1 for x in leads])
    for a in np.flatnonzero(role < 2).tolist():
        others = np.flatnonzero(tile.fits(a) & (node != node[a]) & (role != 1) & ((role != 0) | (place > a)))
        linked = tile.linked(a, others) if len(others) else others
        if several[a] and several[linked].any():
            own = set(leads[a])
            linked = linked[[min(own.intersection(leads[b])) == lead for b in linked]]
        total[a] += weight[linked].sum()
        total[linked] += weight[a]
    return pa.table({"node": node, "linked": total})


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` (node, lead, band, ...) with n, own, low and tiles, their number in the block."""
    placed = members.join(sets.select("node", "n"), "node")
    size = placed.groupBy("lead", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") * 8 / TILE_BYTES)).cast("int").alias("tiles"))
    low = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int") == F.col("band")
    return members.join(size, ["lead", "band"]).join(sets, "node").withColumn("low", low)


def _tile_number(column: str, tiles) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(3), F.col(column)), tiles).cast("int")


def _first_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within tiles. The lead is in all tiles of its block."""
    every = F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(_tile_number("node", F.col("tiles"))))
    placed = _blocks(members, sets).select("lead", "band", "node", "n", "own", "low", F.lit(0).alias("role"), F.col("node").alias("component"), F.explode(every).alias("tile"))
    return common.cut(placed.groupBy("lead", "band", "tile").applyInArrow(_forest, "a bigint, b bigint"))


def _later_links(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame | None:
    """Links between the tiles of a block, of nodes that are not yet in one component."""
    blocks_ = members.join(sets.select("node", "n"), "node").groupBy("lead", "band").agg(F.count(F.lit(1)).alias("cnt"), (F.sum("n") * 8).alias("bytes"))
    large = common.cut(members.join(blocks_.where(f"cnt > {TILE} or bytes > {TILE_BYTES}"), ["lead", "band"]))
    if large.isEmpty():
        return None
    of = components(found)
    large = large.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = large.groupBy("lead", "band", "component").agg(F.count(F.lit(1)).alias("size"))
    most = counts.groupBy("lead", "band").agg(F.max(F.struct("size", "component")).getField("component").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    large = large.join(most, ["lead", "band"]).select("node", "lead", "band", "component", (F.col("component") != F.col("main")).alias("minor"))
    placed = _blocks(common.cut(large), sets)
    kept = ["lead", "band", "node", "n", "own", "low", "component"]
    every, own = F.sequence(F.lit(0), F.col("tiles") - 1), _tile_number("node", F.col("tiles"))
    rows = placed.where("minor").select(*kept, F.lit(1).alias("role"), own.alias("row"), F.explode(every).alias("col"))
    cols = placed.select(*kept, F.lit(2).alias("role"), F.explode(every).alias("row"), own.alias("col"))
    return common.cut(rows.union(cols).groupBy("lead", "band", "row", "col").applyInArrow(_forest, "a bigint, b bigint"))


def _counted_links(members: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, linked) by comparing all pairs of each block, tile by tile."""
    leads = members.groupBy("node", "band").agg(F.collect_list("lead").alias("leads"))
    placed = _blocks(members.join(leads, ["node", "band"]).join(sizes, "node"), sets).withColumn("t", _tile_number("node", F.col("tiles")))
    kept = ["lead", "band", "node", "n", "own", "low", "class_size", "leads"]
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("t", k).alias("row"), F.greatest("t", k).alias("col")))
    placed = placed.select(*kept, "t", F.explode(pairs).alias("at")).select(*kept, "at.*", F.expr("if(at.row = at.col, 0, if(t = at.row, 1, 2))").alias("role"))
    return placed.groupBy("lead", "band", "row", "col").applyInArrow(_degrees, "node bigint, linked bigint").groupBy("node").agg(F.sum("linked").alias("linked"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_component: bool = False, with_links: bool = False) -> DataFrame:
    """``docs`` without the text, with n_shingles, class_size and component_id.

    With ``with_component`` also component: a number that the rows of one component of
    several rows share, null for a row alone. It tells components apart where ids are null or shared.
    With ``with_links`` also n_links: the number of other rows that the row links with; for that
    all pairs of each block are compared, not only those of different components.
    """
    whole = common.packed(docs, text_col, id_col)
    rows = whole.select("__id", "__text").mapInArrow(tidy(_regions), common.with_fields(whole, ["__id"], "n int, m int, s1 bigint, s2 bigint, region array<bigint>"))
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("__id").alias("rep"), F.count(F.lit(1)).alias("class_size"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("region").alias("region"))
    classes = common.cut(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes = common.cut(classes.drop("m", "region"))
    common.release(docs.sparkSession)

    slacks, shared = _of_regions(classes)
    able = _met(slacks)
    able_nodes = common.cut(able.select("node").distinct().join(nodes.select("node", "n", "s1", "s2"), "node"))
    common.drop(able, shared, classes)
    common.release(docs.sparkSession)
    wanted = common.members(able_nodes.select("s1"))
    sets = whole.select("__text").mapInArrow(tidy(_whole_sets(wanted)), "s1 bigint, s2 bigint, own array<bigint>").dropDuplicates(["s1", "s2"])
    sets = common.cut(able_nodes.join(sets, ["s1", "s2"]).select("node", "n", "own"))
    common.release(docs.sparkSession)

    slacks, shared = _of_sets(sets)
    members = _met(slacks)
    common.drop(shared)
    common.release(docs.sparkSession)
    links = _first_links(members, sets)
    if (more := _later_links(members, sets, links)) is not None:
        links = links.union(more)
    labels = nodes.select("node", "s1", "s2", "rep", "class_size").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = labels.join(labels.groupBy("component").agg(F.min("rep").alias("label"), F.sum("class_size").alias("rows")).where("rows > 1"), "component")
    if with_links:
        labels = labels.join(_counted_links(members, sets, nodes.select("node", "class_size")), "node", "left").withColumn("n_links", F.col("class_size") - 1 + F.coalesce("linked", F.lit(0)))
    else:
        labels = labels.withColumn("n_links", F.lit(0))
    labels = common.cut(labels.select("s1", "s2", "class_size", "label", "component", "n_links"))
    common.drop(nodes, able_nodes, sets, members)
    common.release(docs.sparkSession)
    made = {"n_shingles": F.col("n"), "class_size": F.coalesce("class_size", F.lit(1)).cast("long"), "component_id": F.coalesce("label", "__id")}
    if with_component:
        made["component"] = F.col("component")
    if with_links:
        made["n_links"] = F.coalesce("n_links", F.lit(0)).cast("long")
    signed = whole.mapInArrow(tidy(_signed), common.with_fields(whole, ["__id", "__rest"], "n bigint, s1 bigint, s2 bigint"))
    return signed.join(labels, ["s1", "s2"], "left").select(*common.unpacked(docs, text_col, made, id_col))
