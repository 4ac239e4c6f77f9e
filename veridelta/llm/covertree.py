"""Operator 10: embedding near-duplicates by dual traversal of cover trees.

Vectors of one label are compared by cosine. Equal vectors are one class first, so copies cost nothing. The top of each
large label's cover tree is a set of centres, a bounded sample; every class goes to the cell of its nearest centre, and a
cell's covering radius is the distance of its farthest class. Two cells whose centres are farther apart than the threshold
and both radii never meet. A cell is one block, or several by a hash if it is large, and each block becomes a cover tree:
nested levels of centres whose radii halve, every point within its centre's radius. Each pair of blocks that may hold a
link meets in one task, which walks both trees together: a pair of nodes is dropped when its centres are farther apart than
the threshold and both covering radii, taken whole when all its points must link, and opened otherwise. A task returns, for
each class, how many vectors it links with and the least class it is connected to there; pairs are never returned. Exact:
bounds are on distances between unit vectors, with a margin for rounding, and single pairs are decided by their cosine in
double precision.

Vectors that are null, zero or hold null or non-finite components, rows without a label, and rows without an id link with
nothing. Vectors of different lengths don't link. Rows that share an id share its component. An empty table gives no rows;
only the three columns named are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.llm.common import read, written
from veridelta.operators.components import connected_components
from veridelta.llm.topk import usable

COSINE = 0.93
#: Classes of a block, on average.
BLOCK = 2048
#: Cells of a label at most, and classes that are dealt to their cells together.
MOST_CELLS, DEALT = 256, 8192
#: Links held in a task before they are contracted.
MOST_HELD = 1 << 20
#: Pairs of nodes opened at once.
MOST_OPENED = 4096
#: Rounding margin of distances.
MARGIN = 1e-6
CELLS = "label long, dim int, node long, class long, copies long, embedding {}, cell int, far double"
PARTNERS = "label long, dim int, cell int, first int, parts int, others array<int>"
TREE = "label long, dim int, cell int, block int, ids binary, classes binary, copies binary, vectors binary, nodes binary"
FOUND = "node long, class long, links long, low long"
#: Columns of a tree's node table.
CENTRE, LOW, HIGH, FIRST, CHILDREN, RADIUS = range(6)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def build(points: np.ndarray, least_radius: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """A cover tree of unit vectors: an order of the points, and the node table.

    A node's points are a run [LOW, HIGH) of the order and begin with its centre; its children are a run of nodes. The
    radius of a level is half that of the level above; RADIUS is the true distance of the farthest point."""
    n = len(points)
    order, nodes = np.arange(n), []

    def node(low, high):
        centre = points[order[low]]
        far = float(_distance(points[order[low:high]] @ centre).max()) if high - low > 1 else 0.0
        nodes.append([low, low, high, 0, 0, far])
        return len(nodes) - 1

    waiting = [(node(0, n), 2.0)] if n else []
    while waiting:
        at, radius = waiting.pop()
        low, high = nodes[at][LOW], nodes[at][HIGH]
        while radius > nodes[at][RADIUS]:  # levels at which the node would be its own only child
            radius /= 2
            if radius < least_radius:
                break
        if high - low < 2 or radius < least_radius:
            continue
        left, groups = order[low:high], []
        while len(left):
            near = _distance(points[left] @ points[left[0]]) <= radius
            near[0] = True
            groups.append(left[near])
            left = left[~near]
        order[low:high] = np.concatenate(groups)
        first, start = len(nodes), low
        for g in groups:
            node(start, start + len(g))
            start += len(g)
        nodes[at][FIRST], nodes[at][CHILDREN] = first, len(groups)
        waiting += [(c, radius / 2) for c in range(first, first + len(groups)) if nodes[c][HIGH] - nodes[c][LOW] > 1]
    return order, np.array(nodes, float).reshape(-1, 6)


def _by_width(nodes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Nodes of a single point, and the others."""
    single = nodes[at, HIGH] - nodes[at, LOW] == 1
    return [part for part in (at[single], at[~single]) if len(part)]


def _contracted(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n members' component over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def dual(a, b, cosine: float):
    """Walk two trees (points in tree order, nodes, copies) together.

    Returns the number of b's vectors linked with each point of a, a's with each of b, and (i, j) pairs, i in a and j in
    b, that connect what all links connect."""
    (pa_, na, ca), (pb, nb, cb) = a, b
    to_a, to_b = np.zeros(len(pa_), np.int64), np.zeros(len(pb), np.int64)
    reach = float(np.sqrt(2 - 2 * cosine))
    held_i, held_j, held = [], [], 0

    def keep(i, j):
        nonlocal held_i, held_j, held
        held_i.append(i)
        held_j.append(j)
        held += len(i)
        if held > MOST_HELD:
            i, j = np.concatenate(held_i), np.concatenate(held_j)
            label = _contracted(i, j + len(pa_), len(pa_) + len(pb))
            # a point and its root on the other side, or a point of the other side for both
            hub = np.full(len(label), -1)
            hub[label[j + len(pa_)]] = j
            spoke = np.full(len(label), -1)
            spoke[label[i]] = i
            own_a = np.nonzero(hub[label[: len(pa_)]] >= 0)[0]
            own_b = np.nonzero(spoke[label[len(pa_) :]] >= 0)[0]
            held_i = [own_a, spoke[label[len(pa_) + own_b]]]
            held_j = [hub[label[own_a]], own_b]
            held = len(own_a) + len(own_b)

    def compare(xs, ys, similar):
        """Decide pairs of nodes: linked, apart, linked as a whole, or to be opened."""
        alone = (na[xs, HIGH] - na[xs, LOW] == 1) & (nb[ys, HIGH] - nb[ys, LOW] == 1)
        # two single points are decided by their cosine
        near = alone & (similar >= cosine)
        i, j = na[xs[near], LOW].astype(int), nb[ys[near], LOW].astype(int)
        np.add.at(to_a, i, cb[j])
        np.add.at(to_b, j, ca[i])
        keep(i, j)
        apart, spread = _distance(similar), na[xs, RADIUS] + nb[ys, RADIUS]
        within = ~alone & (apart + spread <= reach - MARGIN)
        for i, j in zip(xs[within], ys[within]):
            lx, hx, ly, hy = (int(v) for v in (*na[i, [LOW, HIGH]], *nb[j, [LOW, HIGH]]))
            to_a[lx:hx] += cb[ly:hy].sum()
            to_b[ly:hy] += ca[lx:hx].sum()
            keep(np.arange(lx, hx), np.full(hx - lx, ly))
            keep(np.full(hy - ly, lx), np.arange(ly, hy))
        open_ = ~alone & ~within & (apart - spread <= reach + MARGIN)
        if open_.any():
            waiting.append((xs[open_], ys[open_]))

    def opened(nodes, at):
        """First and number of a node's children, or the node itself."""
        first, count = nodes[at, FIRST].astype(int), nodes[at, CHILDREN].astype(int)
        return np.where(count > 0, first, at), np.maximum(count, 1)

    waiting = [(np.zeros(1, int), np.zeros(1, int))] if len(na) and len(nb) else []
    while waiting:
        xs, ys = waiting.pop()
        if len(xs) > MOST_OPENED:
            waiting.append((xs[MOST_OPENED:], ys[MOST_OPENED:]))
            xs, ys = xs[:MOST_OPENED], ys[:MOST_OPENED]
        leaves = (na[xs, CHILDREN] == 0) & (nb[ys, CHILDREN] == 0)
        for x, y in zip(xs[leaves], ys[leaves]):  # two leaves: their points
            lx, hx, ly, hy = (int(v) for v in (*na[x, [LOW, HIGH]], *nb[y, [LOW, HIGH]]))
            near = pa_[lx:hx] @ pb[ly:hy].T >= cosine
            to_a[lx:hx] += near @ cb[ly:hy]
            to_b[ly:hy] += ca[lx:hx] @ near
            i, j = np.nonzero(near)
            keep(i + lx, j + ly)
        xs, ys = xs[~leaves], ys[~leaves]
        (first_x, n_x), (first_y, n_y) = opened(na, xs), opened(nb, ys)
        wide = n_x * n_y > 4096
        for k in np.nonzero(wide)[0]:
            # many children: one product; single points and wider nodes apart, as single points must be very similar
            for some in _by_width(na, np.arange(first_x[k], first_x[k] + n_x[k])):
                for others in _by_width(nb, np.arange(first_y[k], first_y[k] + n_y[k])):
                    similar = pa_[na[some, CENTRE].astype(int)] @ pb[nb[others, CENTRE].astype(int)].T
                    limit = reach + na[some, RADIUS].max() + nb[others, RADIUS].max() + MARGIN
                    i, j = np.nonzero(similar >= (min(cosine, 1 - limit * limit / 2) if limit < 2 else -2))
                    if len(i):
                        compare(some[i], others[j], similar[i, j])
        few = ~wide
        first_x, n_x, first_y, n_y = first_x[few], n_x[few], first_y[few], n_y[few]
        size = n_x * n_y
        if size.sum():
            pair = np.repeat(np.arange(len(size)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            xs, ys = first_x[pair] + place // n_y[pair], first_y[pair] + place % n_y[pair]
            for at in range(0, len(xs), 1 << 16):
                i, j = xs[at : at + (1 << 16)], ys[at : at + (1 << 16)]
                a_i, b_j = pa_[na[i, CENTRE].astype(int)], pb[nb[j, CENTRE].astype(int)]
                compare(i, j, np.einsum("ij,ij->i", a_i, b_j))
    i = np.concatenate(held_i) if held_i else np.zeros(0, int)
    j = np.concatenate(held_j) if held_j else np.zeros(0, int)
    return to_a, to_b, i, j


def _unit(table: pa.Table, dim: int) -> np.ndarray:
    raw = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    scaled = raw / np.abs(raw).max(1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def _celled(key, rows, centres):
    """Some classes of a label with the number of the nearest of its centres, and the distance."""
    dim = key[1].as_py()
    centres = centres.sort_by([("rank", "ascending")])
    points, tops = _unit(rows, dim), _unit(centres, dim)
    similar = points @ tops.T
    cell = similar.argmax(1)
    far = _distance(similar[np.arange(len(points)), cell])
    is_top = dict(zip(zip(centres["node"].to_pylist(), centres["class"].to_pylist()), range(len(tops))))
    for i, name in enumerate(zip(rows["node"].to_pylist(), rows["class"].to_pylist())):
        if name in is_top:  # equal to a centre but for rounding: its own cell
            cell[i], far[i] = is_top[name], 0.0
    return pa.table(
        {n: rows[n] for n in ("label", "dim", "node", "class", "copies", "embedding")}
        | {"cell": pa.array(cell, pa.int32()), "far": far}
    )


def _partners(cosine: float):
    """The cells of a label to the blocks of each, and the blocks that it may link with."""

    def partners(key, table):
        label, dim = (k.as_py() for k in key)
        table = table.sort_by([("cell", "ascending")])
        parts = np.maximum(1, -(-table["n"].to_numpy() // BLOCK))
        first = np.cumsum(parts) - parts
        tops, radius = _unit(table, dim), table["radius"].to_numpy()
        limit = float(np.sqrt(2 - 2 * cosine)) + radius[:, None] + radius + MARGIN
        near = (_distance(tops @ tops.T) <= limit) | np.eye(len(tops), dtype=bool)
        others = [np.concatenate([np.arange(first[j], first[j] + parts[j]) for j in np.nonzero(row)[0]]) for row in near]
        return pa.table(
            {
                "label": pa.array([label] * len(tops), pa.int64()),
                "dim": pa.array([dim] * len(tops), pa.int32()),
                "cell": table["cell"],
                "first": pa.array(first, pa.int32()),
                "parts": pa.array(parts, pa.int32()),
                "others": pa.array(others, pa.list_(pa.int32())),
            }
        )

    return partners


def _tree(key, table):
    label, dim, cell, block = (k.as_py() for k in key)
    ids = table["node"].to_numpy()
    # by id, so that a block's tree is the same however its rows arrive
    by_id = np.lexsort((table["class"].to_numpy(), ids))
    points = _unit(table, dim)[by_id]
    order, nodes = build(points)
    by_id = by_id[order]
    return pa.table(
        {
            "label": pa.array([label], pa.int64()),
            "dim": pa.array([dim], pa.int32()),
            "cell": pa.array([cell], pa.int32()),
            "block": pa.array([block], pa.int32()),
            "ids": [ids[by_id].astype(np.int64).tobytes()],
            "classes": [table["class"].to_numpy()[by_id].astype(np.int64).tobytes()],
            "copies": [table["copies"].to_numpy()[by_id].astype(np.int64).tobytes()],
            "vectors": [np.ascontiguousarray(points[order]).tobytes()],
            "nodes": [nodes.tobytes()],
        }
    )


def _meet(cosine: float):
    def meet(key, table):
        dim = key[1].as_py()
        trees = []
        for row in sorted(table.to_pylist(), key=lambda r: r["block"]):
            ids, classes, copies = (np.frombuffer(row[n], np.int64) for n in ("ids", "classes", "copies"))
            points = np.frombuffer(row["vectors"], float).reshape(-1, dim)
            trees.append((ids, classes, (points, np.frombuffer(row["nodes"], float).reshape(-1, 6), copies)))
        (ids, classes, a), (ids_b, classes_b, b) = trees[0], trees[-1]
        to_a, to_b, i, j = dual(a, b, cosine)
        if len(trees) == 1:
            # each pair was met from both sides, and each class met itself: copies of a class are counted elsewhere
            links = to_a - a[2] * _meets_itself(a[0], cosine)
        else:
            ids, classes = np.concatenate([ids, ids_b]), np.concatenate([classes, classes_b])
            links, j = np.concatenate([to_a, to_b]), j + len(to_a)
        rank = np.empty(len(ids), int)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        low = np.sort(ids)[_contracted(rank[i], rank[j], len(ids))[rank]]
        use = (links > 0) | (low != ids)
        return pa.table(
            {
                "node": pa.array(ids[use], pa.int64()),
                "class": pa.array(classes[use], pa.int64()),
                "links": pa.array(links[use], pa.int64()),
                "low": pa.array(low[use], pa.int64(), mask=(low == ids)[use]),
            }
        )

    return meet


def _meets_itself(points: np.ndarray, cosine: float) -> np.ndarray:
    """1 for every point: a unit vector's cosine with itself is 1 but for rounding."""
    return np.full(len(points), int(cosine < 1 - 1e-9), np.int64)


def meetings(classes: DataFrame, cosine: float) -> DataFrame:
    """The trees of all blocks, each once for every block that it meets: (one, two) are the two blocks' numbers."""
    label = ["label", "dim"]
    sizes = classes.groupBy(*label).agg(F.count("*").alias("size"))
    cells = F.when(F.col("size") <= BLOCK, 1).otherwise(F.least(F.lit(MOST_CELLS), F.ceil(F.col("size") * 2 / BLOCK)))
    sized = classes.join(sizes.withColumn("cells", cells), label)
    # at most MOST_CELLS rows of a label
    by_hash = Window.partitionBy(*label).orderBy(F.xxhash64("class", F.lit(1)), "node")
    centres = sized.withColumn("rank", F.row_number().over(by_hash)).where("rank <= cells and rank <= %d" % MOST_CELLS)
    centres = written(centres.select(*label, "node", "class", "embedding", "rank", "size"), "centres")
    deals = F.ceil(F.col("size") / DEALT).cast("int")
    dealt = sized.withColumn("deal", F.pmod(F.xxhash64("class", "node"), deals).cast("int"))
    shown = centres.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    schema = CELLS.format(classes.schema["embedding"].dataType.simpleString())
    placed = dealt.groupBy(*label, "deal").cogroup(shown.groupBy(*label, "deal")).applyInArrow(_celled, schema)
    placed = written(placed, "cells")
    by_cell = placed.groupBy(*label, "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    tops = centres.select(*label, (F.col("rank") - 1).alias("cell"), "embedding")
    # a centre's cell holds the centre at least
    partners = by_cell.join(tops, [*label, "cell"]).groupBy(*label).applyInArrow(_partners(cosine), PARTNERS)
    partners = written(partners, "partners")
    blocked = placed.join(partners.select(*label, "cell", "first", "parts"), [*label, "cell"])
    own = F.pmod(F.xxhash64("node", "class"), F.col("parts")).cast("int")
    trees = blocked.withColumn("block", F.col("first") + own).groupBy(*label, "cell", "block").applyInArrow(_tree, TREE)
    met = trees.join(partners.select(*label, "cell", "others"), [*label, "cell"])
    met = met.withColumn("other", F.explode("others")).drop("others")
    return met.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    good = usable(vector_col) & F.exists(vector_col, lambda x: x != 0)
    good &= F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(good, F.col(vector_col)).alias("embedding"),
        F.when(good, F.col(label_col)).cast("long").alias("label"),
    )
    classes = rows.where("embedding is not null").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies")
    )
    classes = classes.withColumn("class", F.xxhash64("label", "embedding")).withColumn("dim", F.size("embedding"))
    classes = written(classes, "classes")
    met = meetings(classes, cosine)
    found = written(met.groupBy("label", "dim", "one", "two").applyInArrow(_meet(cosine), FOUND), "links")
    sums = found.groupBy("node", "class").agg(F.sum("links").alias("links"))
    edges = found.where("low is not null").select("node", "low")
    members = connected_components(edges, "node", "low").select(F.col("node").alias("member"), "component")
    known = classes.join(sums, ["node", "class"], "left")
    known = known.join(members, known.node == members.member, "left").select(
        F.col("label").alias("k_label"),
        F.col("embedding").alias("k_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    # rows that link with nothing pass by: without keys they would all meet in one task
    usable_rows = rows.where("embedding is not null")
    joined = usable_rows.join(known, (rows.label == known.k_label) & (rows.embedding == known.k_embedding))
    joined = joined.select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        (F.col("vec_id") == F.col("component")).alias("kept"),
    )
    alone = rows.where("embedding is null")
    return joined.unionByName(
        alone.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    )


def op10_covertree(spark, sf_dir: str) -> DataFrame:
    """Links, component and fate of every vector."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {COSINE}),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
