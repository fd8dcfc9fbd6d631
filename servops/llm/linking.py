"""Components of a similarity join whose candidates come from buckets.

Nodes (64-bit numbers) that share a bucket may be linked; a link is confirmed by an exact check. Buckets can be
large (a third of all nodes), so their pairs are never all emitted:

1. Each node is held against one node, of the least nodes of its buckets the one it shares most buckets with.
   Confirmed pairs give trees, and their roots name the components.
2. The nodes of buckets that still hold several components meet in blocks of the bucket, with their texts. There
   the pairs between components are looked at, by their sketches first and then exactly, until their
   components are linked: a group of two blocks gives fewer links than it has nodes. The links merge the
   components. Pairs inside a component need no check, they can't change it.

So the components are the same as with every pair of every bucket confirmed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .components import connected_components

#: nodes a block of a bucket; times that where blocks meet by sketches only, without texts: a node is sent once for each
#: block it meets
BLOCK, WIDE = 256, 4
#: buckets of a node that are compared to tell where a pair is looked at
FEW = 8


@dataclass(frozen=True)
class Measure:
    """How pairs are judged before they are confirmed.

    ``score`` gives whole numbers for rows of two byte arrays (higher: more alike), ``least`` the
    score below which no pair can be linked; ``fits`` says whether two sizes allow a link, for
    columns and, as ``fits_arrays``, for numpy.
    """
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    least: int
    fits: Callable[[Column, Column], Column]
    fits_arrays: Callable[[np.ndarray, int], np.ndarray]


def shared_buckets(members: DataFrame, needs: Column | None = None) -> DataFrame:
    """Rows (key, node, n) of buckets with several nodes, with the bucket's least node as ``first``.

    ``members``: key, node, n, one row a key and node. ``needs``: an aggregate that must hold for the bucket.
    """
    buckets = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("_last"),
                                         (needs if needs is not None else F.lit(True)).alias("_needs"))
    buckets = buckets.where((F.col("first.node") != F.col("_last")) & F.col("_needs")).select("key", "first")
    return cut_lineage(members.select("key", "node", "n").join(buckets, "key"))


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _with_score(pairs: DataFrame, sketches: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (x, y, ...) whose sketches agree well enough, with their score as ``same``."""
    @F.arrow_udf(T.IntegerType())
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.int32())
        return pa.array(measure.score(_rows_of(a), _rows_of(b)).astype(np.int32))
    s = sketches.select("node", "sketch")
    j = pairs.join(s.withColumnsRenamed({"node": "x", "sketch": "sx"}), "x") \
        .join(s.withColumnsRenamed({"node": "y", "sketch": "sy"}), "y")
    return j.select(*pairs.columns, score("sx", "sy").alias("same")).where(F.col("same") >= measure.least)


def _roots(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes b of links (a, b), each of which has one a < b; the component is the tree's root."""
    labels = cut_lineage(links.select(F.col("b").alias("node"), F.col("a").alias("component")))
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = labels.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"),
                                                           F.col("above").isNotNull().alias("moved"))
        step = cut_lineage(step)
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            return labels


def _opened(rows: DataFrame) -> DataFrame:
    """Rows (key, node, n, component) of buckets with several components, with the component most of the bucket's
    nodes have as ``main``, its nodes there n_main, and the others n_rest."""
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")) \
        .groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("many"), F.count(F.lit(1)).alias("parts")) \
        .where(F.col("parts") > 1)
    return cut_lineage(rows.join(counts.select(
        "key", F.col("m.component").alias("main"), F.col("m.c").alias("n_main"), (F.col("many") - F.col("m.c")).alias("n_rest")), "key"))


def _grouped(rows: DataFrame, columns: list[str], block: int, order: tuple[str, ...] = ()) -> DataFrame:
    """(key, i, j, columns) of the groups of two blocks of a bucket's nodes, group after group in each partition, inside them by ``order``.

    Nodes outside the main component meet each other and those of the main one; blocks of the main
    component never meet.
    """
    inside = F.col("component") == F.col("main")
    r = rows.withColumn("_a", F.ceil(F.col("n_rest") / block).cast("int")).withColumn("_m", F.ceil(F.col("n_main") / block).cast("int"))
    r = r.withColumn("_own", F.pmod(F.xxhash64("node"), F.when(inside, F.col("_m")).otherwise(F.col("_a"))).cast("int"))
    # group (i, j): i a block of the rest, j another one from i on, or from _a on a block of the main component
    with_rest = F.transform(F.sequence(F.lit(0), F.col("_a") - 1),
                            lambda i: F.struct(i.alias("i"), (F.col("_a") + F.col("_own")).alias("j")))
    with_all = F.transform(F.sequence(F.lit(0), F.col("_a") + F.col("_m") - 1),
                           lambda j: F.struct(F.least(j, F.col("_own")).alias("i"), F.greatest(j, F.col("_own")).alias("j")))
    r = r.select("key", *columns, F.explode(F.when(inside, with_rest).otherwise(with_all)).alias("g")) \
        .select("key", "g.i", "g.j", *columns)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return r.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", *order)


def _with_partner(rows: DataFrame, measure: Measure) -> DataFrame:
    """The rows of groups (key, i, j) that have a pair to confirm there: of different components, and sizes and
    sketches allow a link. A pair doesn't count where a lesser bucket is among the ``keys`` of both, the least ``FEW``
    buckets of each, so one that shares many buckets is looked at in a few of them.

    ``rows``: key, i, j, node, n, component, sketch, keys, one group after the other, each in order of n: so a node
    whose size doesn't allow a link with the one d rows on needs no more of its group.
    """

    def marked(table):
        """Rows of whole groups; neighbours at every distance are compared for all groups at once."""
        column = {f: table.column(f).combine_chunks() for f in table.column_names}
        group = [column[f].to_numpy() for f in ("key", "i", "j")]
        n, component = column["n"].to_numpy(), column["component"].to_numpy()
        sketch = _rows_of(column["sketch"])
        keys = column["keys"].flatten().to_numpy().reshape(-1, FEW)
        found = np.zeros(len(n), bool)
        apart = np.arange(len(n))
        for d in range(1, len(n)):
            apart = apart[apart + d < len(n)]
            apart = apart[np.logical_and.reduce([*[g[apart] == g[apart + d] for g in group], measure.fits_arrays(n[apart], n[apart + d])])]
            if not len(apart):
                break
            x = apart[component[apart] != component[apart + d]]
            x = x[measure.score(sketch[x], sketch[x + d]) >= measure.least] if len(x) else x
            for some in np.array_split(x, len(x) // 4096 + 1):
                one = keys[some][:, :, None]
                lesser = ((one == keys[some + d][:, None, :]) & (one < group[0][some][:, None, None])).any((1, 2))
                some = some[~lesser]
                found[some] = found[some + d] = True
        return table.filter(pa.array(found)).to_batches()

    def run(batches):
        held, many = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            many += b.num_rows
            last = [b.column(f).to_numpy() for f in ("key", "i", "j")]
            cut = int(np.flatnonzero(np.logical_or.reduce([g != g[-1] for g in last]))[-1]) + 1 if any((g != g[-1]).any() for g in last) else 0
            if many >= 8192 and cut:
                held[-1] = b.slice(0, cut)
                yield from marked(pa.Table.from_batches(held))
                held, many = [b.slice(cut)], b.num_rows - cut
        if held:
            yield from marked(pa.Table.from_batches(held))
    return rows.mapInArrow(run, rows.schema)


def _block_links(rows: DataFrame, measure: Measure, prepare: Callable[[list[str]], list],
                 linked: Callable[[list, list], np.ndarray], once: bool = False) -> DataFrame:
    """Links between components of a bucket, confirmed where the blocks meet; ``rows`` have the nodes' text.

    In a group, a pair is only looked at while its components haven't been linked there, so a group gives
    fewer links than it has nodes. With ``once``, ``rows`` are those of ``_with_partner`` in groups, with its rule for
    pairs that share many buckets.
    """
    r = rows if once else _grouped(rows, ["node", "n", "component", "sketch", "text"], BLOCK)

    def compare(key, node, n, component, sketch, text, keys=None):
        own = [frozenset(k) for k in keys] if once else []
        sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(node), -1)
        n, component = np.array(n), np.array(component)
        found, made = [], {}

        def known(which):
            """What ``prepare`` makes of the texts, once a group and only of those that are looked at."""
            new = [k for k in which if k not in made]
            made.update(zip(new, prepare([text[k] for k in new])) if new else ())
            return [made[k] for k in which]
        many = 1 if once else 32  # asked for at once; dear ones singly, as a link spares the others of its component
        for i in range(len(node) - 1):
            asked = np.zeros(len(node), bool)
            while True:
                rest = np.flatnonzero(~asked[i + 1:]) + i + 1
                rest = rest[(component[rest] != component[i]) & measure.fits_arrays(n[rest], n[i])]
                same = measure.score(sketch[rest], sketch[i][None, :]) if len(rest) else np.zeros(0)
                rest = rest[same >= measure.least]
                if once:
                    rest = np.array([k for k in rest.tolist() if min(own[i] & own[k], default=key) >= key], np.int64)
                hit = -1
                for at in range(0, len(rest), many):
                    some = rest[at:at + many].tolist()
                    ok = linked(known([i]) * len(some), known(some))
                    asked[some] = ~ok
                    if ok.any():
                        hit = some[int(ok.argmax())]
                        break
                if hit < 0:
                    break
                a, b = component[i], component[hit]
                found.append((int(a), int(b)))
                component[component == max(a, b)] = min(a, b)
        return found

    def run(batches):
        at, held, found = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != at:
                    found += compare(at[0], *zip(*held)) if len(held) > 1 else []
                    at, held = row[:3], []
                held.append(row[3:])
            if found:
                yield pack(found)
                found = []
        found += compare(at[0], *zip(*held)) if len(held) > 1 else []
        if found:
            yield pack(found)

    def pack(found):
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return r.mapInArrow(run, "a long, b long").distinct()


def confirm_in_cells(pairs: DataFrame, texts: DataFrame, blocks: int, prepare: Callable[[list[str]], list],
                     linked: Callable[[list, list], np.ndarray]) -> DataFrame:
    """Of pairs (x, y, a, b) the (a, b) for which ``linked`` holds on what ``prepare`` makes of the texts.

    ``texts``: node, text. The nodes are dealt into ``blocks`` blocks, and a pair goes to the cell of its
    two blocks, to which each text that the cell needs is sent once, however many pairs ask for it.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = pairs.withColumn("i", F.least(block("x"), block("y"))).withColumn("j", F.greatest(block("x"), block("y")))
    needed = placed.select("i", "j", F.col("x").alias("node")).distinct() \
        .unionByName(placed.select("i", "j", F.col("y").alias("node")).distinct()).distinct().join(texts.select("node", "text"), "node")
    none = F.lit(None).cast("long")
    rows = needed.select("i", "j", "node", "text", none.alias("y"), none.alias("a"), none.alias("b")) \
        .unionByName(placed.select("i", "j", F.col("x").alias("node"), F.lit(None).cast("string").alias("text"), "y", "a", "b"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "i", "j").sortWithinPartitions("i", "j", F.col("y").isNotNull())

    def check(known, todo):
        ok = linked([known[x] for x, *_ in todo], [known[y] for _, y, *_ in todo])
        kept = [t[2:] for t, k in zip(todo, ok) if k]
        return pa.RecordBatch.from_arrays([pa.array([t[k] for t in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        cell, names, held, known, todo = None, [], [], {}, []
        for batch in batches:
            for i, j, node, text, y, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if (i, j) != cell:
                    if todo:
                        yield check(known, todo)
                    cell, names, held, known, todo = (i, j), [], [], {}, []
                if y is None:
                    names.append(node)
                    held.append(text)
                    continue
                if held:  # the cell's texts come before its pairs
                    known, held = dict(zip(names, prepare(held))), []
                todo.append((node, y, a, b))
                if len(todo) >= 4096:
                    yield check(known, todo)
                    todo = []
        if todo:
            yield check(known, todo)
    return rows.mapInArrow(run, "a long, b long")


def linked_components(shared: DataFrame, sketches: DataFrame, measure: Measure, blocks: int, prepare: Callable[[list[str]], list],
                      linked: Callable[[list, list], np.ndarray], once: bool = False) -> DataFrame:
    """(node, component) of the nodes whose component is named by another node, its least one along links.

    ``shared``: from ``shared_buckets``; ``sketches``: node, sketch (bytes, of one length) and text of its nodes. For two
    lists of what ``prepare`` makes of texts, ``linked`` says which are linked. ``blocks``: see ``confirm_in_cells``;
    ``once``: see ``_block_links``, for pairs that share many buckets and are dear to confirm. All inputs are read several times.
    """
    first = F.col("first.node")
    # the least node that a node shares most buckets with
    stars = shared.where((F.col("node") != first) & measure.fits(F.col("n"), F.col("first.n"))) \
        .groupBy(first.alias("x"), F.col("node").alias("y")).agg(F.count(F.lit(1)).alias("c")) \
        .groupBy("y").agg(F.max_by("x", F.struct("c", "x")).alias("x"))
    best = _with_score(stars.select("x", "y", F.col("x").alias("a"), F.col("y").alias("b")), sketches, measure).drop("same")
    component = _roots(confirm_in_cells(best, sketches, blocks, prepare, linked))

    opened = _opened(shared.select("key", "node", "n").join(component, "node", "left")
                     .withColumn("component", F.coalesce("component", "node")))
    if once:
        def together(rows: DataFrame) -> DataFrame:
            parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        most = F.array_repeat(F.lit((1 << 63) - 1), FEW)
        keys = opened.groupBy("node").agg(F.slice(F.concat(F.sort_array(F.collect_set("key")), most), 1, FEW).alias("keys"))
        rows = opened.join(sketches.select("node", "sketch"), "node").join(keys, "node")
        rows = cut_lineage(_with_partner(_grouped(rows, ["node", "n", "component", "sketch", "keys"], WIDE * BLOCK, ("n",)), measure))
        rows = together(rows.join(sketches.select("node", "text"), "node").select("key", "i", "j", "node", "n", "component", "sketch", "text", "keys"))
    else:
        rows = opened.join(sketches.select("node", "sketch", "text"), "node")
    links = cut_lineage(_block_links(rows, measure, prepare, linked, once))
    if links.isEmpty():
        return component
    merged = connected_components(links, "a", "b").where(F.col("node") != F.col("component"))
    above = merged.select(F.col("node").alias("component"), F.col("component").alias("above"))
    return cut_lineage(component.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
                       .unionByName(above.select(F.col("component").alias("node"), F.col("above").alias("component"))))
