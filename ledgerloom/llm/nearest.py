"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on a sample of bounded size and broadcast. Every vector goes down the tree to one leaf; leaves with
many vectors or many queries are cut into blocks, so no leaf is one task. A query walks the tree with a priority queue of
nodes by distance to their centres and meets the leaves it takes out first. How many leaves is calibrated: a sample of
vectors is compared with every other, and the number of leaves grows until the true neighbours lie in them often enough.
Distances are computed anew from the original vectors in double precision.

Equal vectors are one class that keeps its smallest ids, more of which could never be among the nearest. So neither a
vector copied into a third of all rows nor a query copied as often is a hot leaf.
"""

from __future__ import annotations

import heapq
import logging
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.scratch import Scratch

#: Bounds of the sample the tree is fitted on, in rows and in bytes of doubles.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
BRANCHES = 8
#: Sampled vectors a leaf has at least, on the average.
LEAF_SAMPLE = 8
#: A cell compares at most so many bytes of vectors with as many of queries.
CELL_BYTES = 8 << 20
AUDIT = 256
RECALL = 0.98
#: Distances that a task holds at once.
BLOCK = 1 << 20
LARGE = 1e150
_TOP = "class long, other long, score double"


@dataclass
class Tree:
    """Centres of all nodes; node i has children first[i] to first[i] + count[i] - 1, or is leaf number leaf[i]."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.count == 0).sum())

    def _children(self, node: int) -> range:
        return range(int(self.first[node]), int(self.first[node] + self.count[node]))

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        node = np.zeros(len(vectors), np.int64)
        todo = np.arange(len(vectors))
        while len(todo):
            todo = todo[self.count[node[todo]] > 0]
            for parent in np.unique(node[todo]).tolist():
                at = todo[node[todo] == parent]
                children = self._children(parent)
                node[at] = children.start + _squares(vectors[at], self.centre[children.start:children.stop]).argmin(1)
        return self.leaf[node]

    def walk(self, vector: np.ndarray, most: int) -> list[int]:
        """The first leaves out of a priority queue of nodes, nearest centre first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while self.count[node]:
                children = self._children(node)
                far = _squares(vector[None], self.centre[children.start:children.stop])[0].tolist()
                best = min(range(len(far)), key=far.__getitem__)
                for i, child in enumerate(children):
                    if i != best:
                        heapq.heappush(queue, (far[i], child))
                node = children.start + best
            out.append(int(self.leaf[node]))
        return out


def _tame(vectors: np.ndarray) -> np.ndarray:
    """Within the range whose squares are finite; only the tree sees this."""
    return np.clip(vectors, -LARGE, LARGE)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the product; good to about 1e-15 of the squared lengths."""
    return np.maximum(np.einsum("nd,nd->n", a, a)[:, None] + np.einsum("nd,nd->n", b, b) - 2 * (a @ b.T), 0)


def _means(vectors: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centres, label of each vector) of a few rounds of k-means, seeded far apart."""
    centres = [vectors[rng.integers(len(vectors))]]
    near = _squares(vectors, centres[0][None])[:, 0]
    while len(centres) < k and near.sum() > 0:
        centres.append(vectors[rng.choice(len(vectors), p=near / near.sum())])
        near = np.minimum(near, _squares(vectors, centres[-1][None])[:, 0])
    centre = np.array(centres)
    for _ in range(8):
        label = _squares(vectors, centre).argmin(1)
        held = np.bincount(label, minlength=len(centre))
        centre = centre[held > 0]
        label = (np.cumsum(held > 0) - 1)[label]
        for i in range(len(centre)):
            centre[i] = vectors[label == i].mean(0)
    return centre, _squares(vectors, centre).argmin(1)


def fit(vectors: np.ndarray, leaves: int, seed: int = 12) -> Tree:
    """A tree of about `leaves` leaves: the largest node is split until there are enough."""
    rng = np.random.default_rng(seed)
    centre, first, count = [vectors.mean(0)], [0], [0]
    queue, found = [(-len(vectors), 0, np.arange(len(vectors)))], 1
    while queue and found < leaves:
        _, node, rows = heapq.heappop(queue)
        parts, label = _means(vectors[rows], min(BRANCHES, leaves - found + 1, len(rows)), rng)
        if len(parts) < 2:
            continue
        first[node], count[node] = len(centre), len(parts)
        for i, c in enumerate(parts):
            held = rows[label == i]
            centre.append(c)
            first.append(0)
            count.append(0)
            if len(held) > 1:
                heapq.heappush(queue, (-len(held), first[node] + i, held))
        found += len(parts) - 1
    count = np.array(count)
    leaf = np.where(count == 0, np.cumsum(count == 0) - 1, -1)
    return Tree(np.array(centre), np.array(first), count, leaf)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _fit(leaves: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        order = np.lexsort((table["class"].to_numpy(), table["least"].to_numpy()))
        body = pickle.dumps(fit(_tame(_matrix(table["vector"])[order]), leaves[dim]))
        return pa.table({"dim": pa.array([dim], pa.int32()), "body": pa.array([body], pa.binary())})
    return run


def _leaves(trees):
    """Adds the leaf to (dim, class, vector, least)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees.value
        for batch in batches:
            dims = batch.column(0).to_numpy()
            leaf = np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                leaf[at] = known[dim].assign(_tame(_matrix(batch.column(2).take(pa.array(at)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["dim", "class", "vector", "least", "leaf"])
    return run


def _walks(trees, visits: dict[int, int]):
    """(dim, class, vector, leaves): the leaves that each query meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees.value
        for batch in batches:
            dims = batch.column(0).to_pylist()
            walks = [known[d].walk(_tame(np.array(v, np.float64)), visits[d]) for d, v in zip(dims, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(walks, pa.list_(pa.int32()))], names=["dim", "class", "vector", "leaves"])
    return run


def _nearest(query: np.ndarray, least: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, distance) of the `most` nearest vectors of each query, ties to the smaller id of `least`."""
    rows, places, scores = [], [], []
    step = max(1, BLOCK // max(1, len(vectors)))
    with np.errstate(all="ignore"):
        squares = np.einsum("nd,nd->n", vectors, vectors).max(initial=0)
        large = max(np.abs(query).max(initial=0), np.abs(vectors).max(initial=0)) > LARGE
        for i in range(len(query)):
            if i % step == 0:
                rough = _squares(query[i:i + step], vectors)
            far = rough[i % step]
            if large or len(vectors) <= most:
                some = np.arange(len(vectors))
            else:
                slack = 1e-12 * (squares + query[i] @ query[i])
                some = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1] + slack)
            # Added up in the order of the components.
            exact = np.sqrt(np.cumsum((vectors[some] - query[i]) ** 2, axis=1)[:, -1])
            order = np.lexsort((least[some], exact))[:most]
            rows.append(np.full(len(order), i))
            places.append(some[order])
            scores.append(exact[order])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(scores)


def _cell(most: int):
    """The nearest classes of each query in one cell: more rows than `most` could not come before them."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"class": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        asked, names = left["class"].to_numpy(), right["class"].to_numpy()
        row, place, score = _nearest(_matrix(left["vector"]), right["least"].to_numpy(), _matrix(right["vector"]), most)
        return pa.table({"class": asked[row], "other": names[place], "score": score})
    return run


def _audit(most: int, asked):
    """Nearest vectors of the sampled queries in one task's part of the index: (dim, class, other, leaf, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                names, query = asked.value[dim]
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                row, place, score = _nearest(query, part.column(3).to_numpy(), _matrix(part.column(2)), most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dim, np.int32)), pa.array(names[row]), part.column(1).take(pa.array(place)),
                     part.column(4).take(pa.array(place)), pa.array(score)], names=["dim", "class", "other", "leaf", "score"])
    return run


def _visits(trees: dict[int, Tree], indexed: DataFrame, k: int, recall: float) -> dict[int, int]:
    """Leaves to visit, by length of vectors: widened until the true neighbours of sampled vectors lie in them often enough."""
    spark = indexed.sparkSession
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vector", F.lit(12)), "class"))
    sampled = indexed.select("dim", "class", "vector").withColumn("place", place).where(F.col("place") <= AUDIT).collect()
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in trees:
        held = [r for r in sampled if r["dim"] == dim]
        asked[dim] = np.array([r["class"] for r in held]), np.array([r["vector"] for r in held], np.float64)
    near = indexed.mapInArrow(_audit(k + 1, spark.sparkContext.broadcast(asked)), "dim int, class long, other long, leaf int, score double")
    order = F.row_number().over(Window.partitionBy("dim", "class").orderBy("score", "other"))
    truth = near.where("class != other").withColumn("place", order).where(F.col("place") <= k).select("dim", "class", "leaf").collect()
    out = {}
    for dim, tree in trees.items():
        walks = {int(c): {leaf: i for i, leaf in enumerate(tree.walk(_tame(v), tree.leaves))} for c, v in zip(*asked[dim])}
        ranks = [walks[r["class"]][r["leaf"]] for r in truth if r["dim"] == dim]
        most = 1
        while most < tree.leaves and sum(r < most for r in ranks) < recall * len(ranks):
            most = min(tree.leaves, 1 + most + most // 8)
        out[dim] = most
        logging.getLogger(__name__).info("length %d: %d of %d leaves, recall %.4f of %d neighbours", dim, most, tree.leaves,
                                         sum(r < most for r in ranks) / max(1, len(ranks)), len(ranks))
    return out


def _usable() -> Column:
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists(wide, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, asked: Column, k: int = 10, recall: float = RECALL, visits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found of every row for which `asked` holds.

    `vectors` has vec_id and embedding, score is the Euclidean distance in double precision; nearest first, ties to the
    smaller vec_id. `recall` is the share of true neighbours, of AUDIT vectors of each length, that must lie in the
    leaves met; `visits` sets their number instead.

    Null, empty and zero vectors, those with null or non-finite components and rows without vec_id take no part; vectors
    meet only those of their length. Rows that share a vec_id are rows of their own, as are equal rows: a query leaves out
    only itself. Distances beyond the range of doubles are infinite and come last. With fewer than k candidates all are
    returned. An empty table or no query gives no rows; other columns are dropped.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    kind = vectors.schema["embedding"].dataType.elementType
    # Adding zero makes -0.0 and 0.0 one value.
    rows = vectors.where(_usable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: (x.cast("double") + 0.0).cast(kind)).alias("vector"),
        F.coalesce(asked, F.lit(False)).alias("asked"))
    held_as = f"vector array<{kind.simpleString()}>"
    same = Window.partitionBy("vector").orderBy("vec_id")
    # The limit on the row number reaches Spark's group limit, which cuts large groups before the shuffle.
    low = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    classes = scratch.keep(low.groupBy("vector").agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
                           .withColumn("dim", F.size("vector"))
                           .withColumn("class", F.monotonically_increasing_id()), "classes")
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    answer = "query_id long, rank int, vec_id long, score double"
    if not counts:
        return spark.createDataFrame([], answer)

    share = {d: min(1.0, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)) / n) for d, n in counts.items()}
    leaves = {d: int(min(max(2, 2 * n ** 0.5), max(1, share[d] * n / LEAF_SAMPLE))) for d, n in counts.items()}
    cuts = spark.createDataFrame([(d, share[d]) for d in counts], "dim int, share double")
    draw = F.pmod(F.xxhash64("vector", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = classes.join(F.broadcast(cuts), "dim").where((draw < F.col("share")) | (F.col("share") >= 1))
    fitted = sample.select("dim", "class", "vector", "least").groupBy("dim").applyInArrow(_fit(leaves), "dim int, body binary")
    trees = {r["dim"]: pickle.loads(r["body"]) for r in fitted.toLocalIterator()}
    # A sample of few rows may miss a length; all of its vectors are one leaf then.
    for dim in counts.keys() - trees.keys():
        trees[dim] = fit(np.zeros((1, dim)), 1)
    sent = spark.sparkContext.broadcast(trees)
    indexed = scratch.keep(classes.select("dim", "class", "vector", "least").mapInArrow(_leaves(sent), f"dim int, class long, {held_as}, least long, leaf int"), "indexed")
    wanted = scratch.keep(rows.where("asked").join(classes.select("vector", "class", "dim"), "vector").select("dim", "class", "vec_id"), "wanted")
    queries = scratch.keep(classes.join(wanted.select("class").distinct(), "class", "left_semi").select("dim", "class", "vector"), "queries")
    met = {d: visits for d in counts} if visits else _visits(trees, indexed, k, recall)

    walks = scratch.keep(queries.mapInArrow(_walks(sent, met), f"dim int, class long, {held_as}, leaves array<int>"), "walks")
    asks = walks.select("dim", "class", "vector", F.explode("leaves").alias("leaf"))
    # Blocks of a leaf by its vectors and by its queries; the table has a row a leaf.
    size = F.lit(CELL_BYTES / 8) / F.col("dim")
    grid = scratch.keep(
        indexed.groupBy("dim", "leaf").agg((F.floor(F.count("*") / F.first(size)) + 1).cast("int").alias("blocks"))
        .join(asks.groupBy("dim", "leaf").agg((F.floor(F.count("*") / F.first(size)) + 1).cast("int").alias("turns")), ["dim", "leaf"]), "grid")
    left = (asks.join(grid, ["dim", "leaf"]).withColumn("turn", F.pmod(F.xxhash64("class", F.lit(3)), F.col("turns")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "leaf", "block", "turn", "class", "vector"))
    right = (indexed.join(grid, ["dim", "leaf"]).withColumn("block", F.pmod(F.xxhash64("class", F.lit(4)), F.col("blocks")).cast("int"))
             .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("dim", "leaf", "block", "turn", "class", "vector", "least"))
    cell = ("dim", "leaf", "block", "turn")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k + 1), _TOP)
    # The k + 1 nearest rows of a class, itself among them; classes of one distance come by their ids.
    held = found.join(classes.select(F.col("class").alias("other"), "ids"), "other").select("class", "score", F.explode("ids").alias("vec_id"))
    nearest_rows = F.row_number().over(Window.partitionBy("class").orderBy("score", "vec_id"))
    top = held.withColumn("place", nearest_rows).where(F.col("place") <= k + 1).select("class", "score", "vec_id", "place")
    lists = scratch.keep(top.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("near")), "lists")
    answers = wanted.select("class", F.col("vec_id").alias("query_id")).join(lists, "class")
    # One row of the query's own id at distance zero is the query itself.
    own = F.array_position(F.transform("near", lambda n: (n["vec_id"] == F.col("query_id")) & (n["score"] == 0)), True)
    others = F.when(own > 0, F.concat(F.slice("near", F.lit(1), own.cast("int") - 1), F.slice("near", own.cast("int") + 1, F.lit(k + 1)))).otherwise(F.col("near"))
    return (answers.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "n"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score")))
