"""Near-duplicate vectors by PCA-ordered tiled comparison (operator 13).

Vectors of one label are turned to length one and rotated by the principal axes of all vectors (an orthogonal
matrix, so products stay), the axes of most weight first. A tile of vectors meets another one: products of the
leading dimensions are accumulated, the rest is bounded by the norms of what is left of both (suffix norms), and a
tile stops as soon as no pair of it can reach the threshold; pairs that stay are finished, and those near the
threshold are confirmed on the vectors as given.

Equal vectors are one node with a count. The nodes of a label are cut by medians of leading coordinates into
leaves of a bounded number of vectors, and two leaves meet in a cell unless their boxes are further apart than
the threshold allows. A cell gives one row a node: its links there, and a node that it is joined with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components

#: numbers of one leaf's vectors; cells hold two leaves
LEAF = 1 << 19
#: vectors of a tile, dimensions added at once, coordinates (with the norm of the rest) that leaves are cut by
TILE, BAND, AXES = 512, 8, 7
#: products this near to the threshold are decided on the vectors as given; the slack of all bounds
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null or non-finite and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes; cosines are the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    s = scaled(x)
    return s / np.sqrt((s * s).sum(1))[:, None]


def _by_size(batch: pa.RecordBatch, col: int):
    """(vector length, rows of the batch with it)."""
    size = batch.column(col).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        yield int(d), batch.take(pa.array(np.flatnonzero(size == d)))


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """vector length d -> d x d orthogonal matrix whose columns are the axes of most weight first.

    From the second moments of all unit vectors, summed in each task; d * d sums of a length pass the driver.
    """
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, some in _by_size(b, 0):
                u = units(matrix(some.column(0)))
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d)), pa.array(m.ravel())], names=["d", "at", "m"])
    moments: dict[int, list] = {}
    for r in nodes.select("v").mapInArrow(run, "d int, at long, m double").groupBy("d", "at").agg(F.sum("m").alias("m")).collect():
        moments.setdefault(r["d"], []).append((r["at"], r["m"]))
    out = {}
    for d, m in moments.items():
        square = np.array([x for _, x in sorted(m)]).reshape(d, d)
        out[d] = np.linalg.eigh((square + square.T) / 2)[1][:, ::-1]
    return out


def coordinates(nodes: DataFrame, axes) -> DataFrame:
    """node, label, d, and c: the leading coordinates of its unit vector with the norm of the rest as the last."""
    def run(batches):
        for b in batches:
            for d, some in _by_size(b, 2):
                r = units(matrix(some.column(2))) @ axes.value[d]
                rest = np.sqrt((r[:, AXES:] ** 2).sum(1))
                c = np.zeros((len(r), AXES + 1))
                c[:, :min(d, AXES)], c[:, AXES] = r[:, :AXES], rest
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(np.full(len(r), d, np.int32)),
                     pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), AXES + 1).cast(pa.list_(pa.float64()))],
                    names=["node", "label", "d", "c"])
    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "v").mapInArrow(run, f"node long, label {kind}, d int, c array<double>")


def leaves(placed: DataFrame, room: int) -> DataFrame:
    """``placed`` (node, label, d, c) with ``leaf``: halved at a median, one coordinate after the other, until no
    leaf of a label holds more than ``room`` / d nodes. A coordinate that all share doesn't halve; after a round
    over all of them without progress, leaves are halved by the node's hash."""
    done = placed.withColumn("leaf", F.lit(1).cast("long"))
    depth = 0
    while True:
        at = depth % (AXES + 2)
        key = F.col("c")[at] if at <= AXES else F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(1 << 20)).cast("double")
        rows = done.withColumn("_x", key)
        wide = rows.groupBy("label", "d", "leaf").agg(
            F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", 0.5, 1000).alias("_cut"), F.max("_x").alias("_most"))
        wide = cut_lineage(wide.where(F.col("_n") * F.col("d") > room)
                           .select("label", "d", "leaf", F.when(F.col("_cut") < F.col("_most"), F.col("_cut")).alias("_cut")))
        if wide.isEmpty():
            return done
        right = F.coalesce(F.col("_x") > F.col("_cut"), F.lit(False)).cast("long")
        halved = rows.join(wide, ["label", "d", "leaf"], "left")
        done = cut_lineage(halved.select("node", "label", "d", "c", F.when(F.col("_cut").isNull(), F.col("leaf"))
                                         .otherwise(2 * F.col("leaf") + right).alias("leaf")))
        depth += 1


def meeting_leaves(placed: DataFrame, threshold: float) -> DataFrame:
    """(label, d, i, j), i <= j: leaves whose boxes are near enough; |x - y|^2 = 2 - 2 cos for unit vectors, and
    leading coordinates with the norm of the rest are never further apart than the vectors."""
    box = placed.groupBy("label", "d", "leaf").agg(
        F.array(*[F.min(F.col("c")[k]) for k in range(AXES + 1)]).alias("lo"),
        F.array(*[F.max(F.col("c")[k]) for k in range(AXES + 1)]).alias("hi"))
    box = cut_lineage(box)
    a = box.select("label", "d", F.col("leaf").alias("i"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = box.select("label", "d", F.col("leaf").alias("j"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    gaps = [F.greatest(F.lit(0.0), F.col("alo")[k] - F.col("bhi")[k], F.col("blo")[k] - F.col("ahi")[k]) for k in range(AXES + 1)]
    apart = sum((g * g for g in gaps), F.lit(0.0))
    return a.join(b, ["label", "d"]).where((F.col("i") <= F.col("j")) & (apart <= 2 - 2 * threshold + SLACK)) \
        .select("label", "d", "i", "j")


def linked_in_tile(a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray, threshold: float):
    """Pairs (rows, columns, product) of rotated unit vectors that may reach the threshold.

    ``rest_*``: norms of what follows each band of dimensions. Bands are added while a pair can still reach it;
    once few can, only those are finished.
    """
    d = a.shape[1]
    part = np.zeros((len(a), len(b)))
    for k, lo in enumerate(range(0, d, BAND)):
        part += a[:, lo:lo + BAND] @ b[:, lo:lo + BAND].T
        can = part + rest_a[:, k][:, None] * rest_b[:, k][None, :] >= threshold - SLACK
        many = np.count_nonzero(can)
        if not many:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if 32 * many < can.size and lo + BAND < d:
            rows, cols = np.nonzero(can)
            product = part[rows, cols]
            for m, at in enumerate(range(lo + BAND, d, BAND), k + 1):
                product = product + np.einsum("ij,ij->i", a[rows, at:at + BAND], b[cols, at:at + BAND])
                can = product + rest_a[rows, m] * rest_b[cols, m] >= threshold - SLACK
                rows, cols, product = rows[can], cols[can], product[can]
            return rows, cols, product
    rows, cols = np.nonzero(part >= threshold - SLACK)
    return rows, cols, part[rows, cols]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of doubles as given."""
    x, y = scaled(x), scaled(y)
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[k] and b[k] for all k; ``label`` names each row's class by its least row."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (label != label[label]).any():
            label[:] = label[label]


def compare_cell(given: np.ndarray, part: np.ndarray, weight: np.ndarray, axes: np.ndarray, threshold: float):
    """(summed weights of linked rows, class by least row) for each row; pairs are those of different parts,
    or all of them where there is one part."""
    order = np.lexsort((units(given) @ axes[:, 0], part))
    given, part, weight = given[order], part[order], weight[order]
    r = units(given) @ axes
    rest = np.stack([np.sqrt((r[:, end:] ** 2).sum(1)) for end in range(BAND, r.shape[1] + BAND, BAND)], 1)
    links, label = np.zeros(len(r), np.int64), np.arange(len(r))
    split = int((part == 0).sum())
    crossing = 0 < split < len(r)
    reach = np.sqrt(2 - 2 * threshold) + SLACK if threshold < 1 else SLACK * 100
    for i in range(0, split if crossing else len(r), TILE):
        a = slice(i, min(i + TILE, split if crossing else len(r)))
        for j in range(split if crossing else i, len(r), TILE):
            b = slice(j, min(j + TILE, len(r)))
            # rows are in order of the first coordinate within a part
            if r[b.start, 0] - r[a.stop - 1, 0] > reach or r[a.start, 0] - r[b.stop - 1, 0] > reach:
                continue
            rows, cols, product = linked_in_tile(r[a], r[b], rest[a], rest[b], threshold)
            if not crossing and i == j:
                upper = rows < cols
                rows, cols, product = rows[upper], cols[upper], product[upper]
            rows, cols = rows + i, cols + j
            unsure = np.flatnonzero(product < threshold + SLACK)
            sure = np.ones(len(rows), bool)
            sure[unsure] = cosines(given[rows[unsure]], given[cols[unsure]]) >= threshold
            rows, cols = rows[sure], cols[sure]
            if len(rows):
                np.add.at(links, rows, weight[cols])
                np.add.at(links, cols, weight[rows])
                merge(label, rows, cols)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return links[back], order[label][back]


def links_of_cells(dealt: DataFrame, axes, threshold: float) -> DataFrame:
    """(node, links, root): of every node in a cell with links there, the rows linked, and a node of its class."""
    def compare(d, rows):
        part, node, weight, v = (np.concatenate([r[k] for r in rows]) for k in range(4))
        links, root = compare_cell(v, part, weight, axes.value[d], threshold)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])],
                                          names=["node", "links", "root"])

    def run(batches):
        """Rows come cell after cell; a cell may go on in the next batch."""
        held, at = [], None
        for b in batches:
            cells = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            cuts = [0] + [k for k in range(1, len(cells)) if cells[k] != cells[k - 1]] + [len(cells)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and cells[lo] != at:
                    yield compare(at[1], held)
                    held = []
                at = cells[lo]
                piece = b.slice(lo, hi - lo)
                held.append([piece.column(k).to_numpy() for k in (4, 5, 6)] + [matrix(piece.column(7))])
        if held:
            yield compare(at[1], held)
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ["label", "d", "i", "j"]
    return dealt.select(*cell, "part", "node", "weight", "v").repartition(parts, *cell).sortWithinPartitions(*cell) \
        .mapInArrow(run, "node long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.98) -> DataFrame:
    """``id_col``, n_links, component_id, kept for every row of ``vectors``.

    Two rows are linked if their labels are equal and not null, their vectors have one length, and their cosine in
    double precision is at least ``threshold`` (between 0 and 1). Vectors that are null, empty, zero or hold a
    null or non-finite component are linked with nothing, not even with a copy. ``n_links`` counts the other rows
    linked directly, copies and repeated rows too; ``component_id`` is the least id reachable, its own included (a
    null id is greater than any other); ``kept`` is whether it is the row's own. An empty table gives no rows.
    Other columns aren't read.
    """
    v = F.col(vector_col)
    good = usable(v) & F.col(label_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), good.alias("good"))
    # the vector's identity: two 64-bit hashes, so that rows and nodes meet again without the vectors
    one, two = F.when(F.col("good"), F.xxhash64("v")).alias("one"), F.when(F.col("good"), F.xxhash64(F.lit(7), "v")).alias("two")
    nodes = rows.where("good").groupBy("label", F.xxhash64("v").alias("one"), F.xxhash64(F.lit(7), "v").alias("two")).agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"), F.first("v").alias("v"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes(nodes))

    placed = leaves(cut_lineage(coordinates(nodes, axes)), LEAF)
    meet = meeting_leaves(placed, threshold)
    # a leaf's cells: as the first of the two, or as the second
    sides = cut_lineage(meet).select(
        "label", "d", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("leaf"), F.lit(0).alias("part"))))
                                          .otherwise(F.array(F.struct(F.col("i").alias("leaf"), F.lit(0).alias("part")),
                                                             F.struct(F.col("j").alias("leaf"), F.lit(1).alias("part"))))).alias("s")) \
        .select("label", "d", "i", "j", "s.leaf", "s.part")
    dealt = placed.select("node", "label", "d", "leaf").join(sides, ["label", "d", "leaf"]) \
        .join(nodes.select("node", "weight", "v"), "node")
    found = cut_lineage(links_of_cells(dealt, axes, threshold))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where(F.col("node") != F.col("root")), "node", "root")
    told = nodes.select("node", "label", "one", "two", "weight", "least").join(links, "node", "left").join(classes, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    heads = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(heads, "component").select(
        F.col("label").alias("_label"), F.col("one").alias("_one"), F.col("two").alias("_two"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    keyed = rows.select("id", F.when(F.col("good"), F.col("label")).alias("label"), one, two)
    j = keyed.join(told, (F.col("label") == F.col("_label")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")), "left")
    head = F.when(F.col("_one").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return j.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    head.alias("component_id"), head.eqNullSafe(F.col("id")).alias("kept"))
