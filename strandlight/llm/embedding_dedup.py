"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut into halves with a codebook each; the product of the codebooks is a grid of cells, and
a vector lives in the cell of its halves' nearest codewords.  From each vector, the multi-sequence algorithm visits cells
nearest first (a heap over the two sorted lists of codewords; near is how far a neighbour would have to move to lie in a cell),
until the recall measured on a sample reaches the target.  All members of visited cells are verified by cosine in double precision, in blocks.

The grid grows with the table: a cell holds about CELL vectors of a label, however many there are.  The
codebooks and the recall are taken from a bounded sample (SAMPLE vectors, or 16 for each codeword if that is more); every vector is
indexed.  Recall counts neighbours at the threshold itself, made from the sample's vectors, and the sample's own links.

Equal vectors are compared once and counted by their number.  Of two vectors one is the query, and the
pair counts for both.  Blocks give counts and a spanning forest of their links, never pairs.

A vector that is null, zero, or has null or non-finite components, or whose label or vec_id is null, links with
nothing.  Components of any size are fine: vectors are scaled by their largest one first.  Vectors of different lengths do not link.
Rows that repeat a vec_id, or are repeated whole, are vectors of their own: each has a row, and its
links count rows.  Ties cannot occur: a link is a comparison with the threshold.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import connected_components, cut_lineage

COSINE = 0.93
RECALL = 0.995  # of neighbours at the threshold itself; nearer ones are found more surely
SAMPLE = 10_000  # vectors that the codebooks are fitted on, unless there are more than SAMPLE / 16 codewords
PROBES = 400  # vectors of the sample that recall is measured from
CELL = 256  # members of a cell aimed at, for each label: comparing within a cell costs less than sending a vector to more cells
BLOCK = 1024  # members or queries of a block
MOST_SIZES = 200_000  # rows of the table of cell sizes up to which it is broadcast


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's method from evenly spaced starts; fewer than ``k`` where points repeat."""
    points = np.unique(points, axis=0)
    k = max(1, min(k, len(points)))
    rng = np.random.default_rng(0)
    centres = points[rng.choice(len(points), k, replace=False)].copy() if len(points) else np.zeros((1, points.shape[1]))
    for _ in range(rounds):
        near = (((centres**2).sum(1))[None, :] - 2 * points @ centres.T).argmin(1)
        for j in range(k):
            own = points[near == j]
            if len(own):
                centres[j] = own.mean(0)
    return centres


def crossing(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance to the border of each centre's cell along the line between the two)."""
    squares = ((centres**2).sum(1))[None, :] - 2 * points @ centres.T
    home = squares.argmin(1)
    gaps = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(-1), 1e-30))
    ahead = (squares - squares[np.arange(len(points)), home][:, None]) / (2 * gaps[home])
    ahead[np.arange(len(points)), home] = 0
    return home, np.maximum(ahead, 0)


def multi_sequence(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(cost, i, j) of all cells, cost left[i]² + right[j]², nearest first.  A cell enters the heap once a
    neighbour of it in one of the sorted lists has left it, so that no more is ordered than is asked for."""
    rows, columns = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    a, b = (left[rows] ** 2).tolist(), (right[columns] ** 2).tolist()
    heap = [(a[0] + b[0], 0, 0)] if rows and columns else []
    while heap:
        cost, i, j = heapq.heappop(heap)
        yield cost, rows[i], columns[j]
        if j + 1 < len(columns):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def visited(left: np.ndarray, right: np.ndarray, stop: float) -> list[tuple[int, int]]:
    """The cells that are visited, nearest first, up to the cost ``stop`` at which the target recall is reached."""
    near_left, near_right = np.flatnonzero(left**2 <= stop), np.flatnonzero(right**2 <= stop)
    out = []
    for cost, i, j in multi_sequence(left[near_left], right[near_right]):
        if cost > stop:
            break
        out.append((int(near_left[i]), int(near_right[j])))
    return out


def stop_cost(points: np.ndarray, labels: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES) -> float:
    """The cost up to which cells are visited: for ``recall`` of the neighbours of the first ``probes`` points their own cell costs no more.

    Measured over neighbours that are made at the threshold, eight of each point in random directions,
    and, where the sample holds a hundred links at least, over those; the larger of the two counts.
    """
    rng = np.random.default_rng(1)
    asked, width = points[:probes], points.shape[1]
    half = width // 2
    side = rng.normal(size=(8, *asked.shape))
    side -= (side * asked).sum(2, keepdims=True) * asked
    side /= np.maximum(np.linalg.norm(side, axis=2, keepdims=True), 1e-30)
    made = cosine * asked + math.sqrt(max(0.0, 1 - cosine * cosine)) * side
    ways = [crossing(asked[:, :half], books[0])[1], crossing(asked[:, half:], books[1])[1]]

    def costs(query: np.ndarray, found: np.ndarray) -> np.ndarray:
        homes = crossing(found[:, :half], books[0])[0], crossing(found[:, half:], books[1])[0]
        return ways[0][query, homes[0]] ** 2 + ways[1][query, homes[1]] ** 2

    own = []
    for at in range(0, len(asked), 50):
        close = (asked[at : at + 50] @ points.T >= cosine) & (labels[at : at + 50, None] == labels[None, :])
        query, found = np.nonzero(close)
        other = query + at != found
        own.append(costs(query[other] + at, points[found[other]]))
    known = [costs(np.tile(np.arange(len(asked)), 8), made.reshape(-1, width)), np.concatenate(own)]
    return max(float(np.quantile(c, recall, method="higher")) for c in known if len(c) >= 100 or c is known[0]) + 1e-12


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows, in double precision."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def embedding_links(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    given = dict(vectors.dtypes)["embedding"]
    given = given if given in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(given).alias("v"), F.col("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & fine & F.col("vec_id").isNotNull(), F.lit(False))
    keyed = rows.withColumn("v", F.when(good, F.transform("v", lambda x: F.when(x != 0, x).otherwise(F.lit(0))).cast(given)))  # one kind of zero
    # rep: a number of each distinct vector, fixed once the rows are kept
    classes = keyed.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    own = cut_lineage(classes.withColumn("rep", F.monotonically_increasing_id()))
    shape = own.agg(F.count(F.lit(1)), F.count_distinct("label"), F.max(F.size("v"))).first()
    n, labels, width = shape[0], max(1, shape[1]), shape[2] or 2
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    codes = max(1, round(math.sqrt(n / labels / CELL)))
    sample = own.where(F.size("v") == width).orderBy(F.xxhash64("first", "v")).limit(max(SAMPLE, 16 * codes)).select(F.xxhash64("label").alias("label"), "v").toPandas()
    points = _unit(np.stack([np.asarray(v, float) for v in sample["v"]]))
    half = width // 2
    fitted = codebook(points[:, :half], codes), codebook(points[:, half:], codes)
    books = spark.sparkContext.broadcast(fitted)
    grid = len(fitted[1])
    bound = stop_cost(points, sample["label"].to_numpy(), fitted, cosine, recall)

    def cells(batches):
        left_book, right_book = books.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                sizes = part.column(2).value_lengths().to_numpy()
                # other lengths have a cell for each length
                home, visits = np.full(len(part), -1), [[-1]] * len(part)
                index = np.flatnonzero(sizes == width)
                if len(index):
                    unit = _unit(_matrix(part.column(2).take(pa.array(index)), width))
                    home_l, left = crossing(unit[:, :half], left_book)
                    home_r, right = crossing(unit[:, half:], right_book)
                    home[index] = home_l * grid + home_r
                    for k, i in enumerate(index.tolist()):
                        visits[i] = [a * grid + b for a, b in visited(left[k], right[k], bound)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int64()), pa.array(visits, pa.list_(pa.int64()))], names=[*part.schema.names, "home", "visits"])

    kind = dict(own.dtypes)["label"]
    spread = own.select("label", "rep", "v", "copies", F.size("v").alias("w")).mapInArrow(cells, f"label {kind}, rep long, v {given}, copies long, w int, home long, visits array<long>")
    spread = cut_lineage(spread)  # a row for each vector; cells are unfolded where they are used
    cell = ["label", "w", "cell"]
    homes = spread.groupBy("label", "w", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    visitors = spread.select("label", "w", F.explode("visits").alias("cell")).groupBy(*cell).agg(F.count(F.lit(1)).alias("q"))
    sizes = homes.join(visitors, cell)
    # a full cell is cut into blocks of members by blocks of queries, each a task's unit of work
    sizes = cut_lineage(sizes.select(*cell, F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb")))
    known = F.broadcast(sizes) if sizes.count() <= MOST_SIZES else sizes

    def dealt(df: DataFrame, own_blocks: str, others: str) -> DataFrame:
        placed = df.join(known, cell).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col(own_blocks)).cast("int"))
        return placed.select(*cell, "rep", "v", "copies", "mine", F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other"))

    members = spread.select("label", "w", F.col("home").alias("cell"), "rep", "v", "copies")
    queries = spread.select("label", "w", F.explode("visits").alias("cell"), "rep", "v", "copies")
    m = dealt(members, "mb", "qb").withColumnsRenamed({"mine": "mi", "other": "qi"})
    m = m.select(*[F.col(c).alias(c) for c in m.columns])  # columns of their own, told apart from those of q
    q = dealt(queries, "qb", "mb").withColumnsRenamed({"mine": "qi", "other": "mi"})
    block = [*cell, "mi", "qi"]

    def verify(key, these: pa.Table, those: pa.Table) -> pa.Table:
        node, links, root = [], [], []
        if len(these) and len(those):
            matrices = [_unit(_matrix(t.column("v").combine_chunks(), len(t.column("v")[0]))) for t in (these, those)]
            ids = [t.column("rep").to_numpy() for t in (these, those)]
            copies = [t.column("copies").to_numpy() for t in (these, those)]
            found = (matrices[1] @ matrices[0].T >= cosine) & (ids[1][:, None] < ids[0][None, :])  # query by member
            if found.any():
                for own_ids, weights in ((ids[1], found @ copies[0]), (ids[0], found.T @ copies[1])):
                    some = np.flatnonzero(weights)
                    node += own_ids[some].tolist()
                    links += weights[some].tolist()
                    root += [None] * len(some)
                parent: dict[int, int] = {}

                def find(x: int) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for r in np.flatnonzero(found.any(axis=1)).tolist():
                    for other in ids[0][found[r]].tolist():
                        a, b = find(int(ids[1][r])), find(other)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                for x in list(parent):
                    if find(x) != x:
                        node.append(x)
                        links.append(0)
                        root.append(find(x))
        return pa.table({"rep": pa.array(node, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    found = cut_lineage(m.groupBy(*block).cogroup(q.groupBy(*block)).applyInArrow(verify, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = own.join(links, "rep", "left").join(components, own.rep == components.node, "left").withColumn("root", F.coalesce("root", "rep"))
    named = named.select("label", "v", "first", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "root").select("label", "v", "n_links", "component_id")
    linked = keyed.where("v is not null").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
