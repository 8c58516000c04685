"""Near-duplicate vectors by NN-descent: a neighbour graph refined until its recall holds.

Equal vectors are one node with a mass. Random projections sort the nodes into cells, and the best
pairs of each cell are the first graph. Each round joins, at every node, its neighbours with its
reverse neighbours, keeps what improves their lists, and enlarges lists that are saturated with
links (cosine at or above the threshold). Then a bounded sample of nodes outside crowded groups is
compared with all others, and rounds with longer lists and cells of new projections follow until the
nodes have, on the mean, enough of their links. Lists that
would grow without bound, as in a large group of near copies, keep a part of their links, enough to
hold the group together; the links of such groups are then counted exactly. Vectors within half the
threshold's angle of a group's centre are all linked with each other, so they are only counted, as a group of near
copies is as a whole; those farther out are compared with the group, block against block.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.graph import components
from quillspark.session import Scratch

_LOG = logging.getLogger(__name__)
THRESHOLD = 0.9
#: Cosines as near to the threshold as this are taken pair by pair.
NEAR = 1e-9
#: Rounds without a new link after which the graph is taken as it is, whatever the audit says; that is logged as an error.
STALLED = 4
LIST = 14
TREES, CELL = 4, 80
ROUNDS = 3
#: Nodes of the recall audit, and the mean recall of a node at which the descent may stop.
AUDIT, RECALL = 256, 0.985
#: Nodes with links that an audit should see; with fewer it is repeated with up to so many nodes.
LINKED, AUDIT_MOST = 64, 4096
#: Of a saturated list the nearest and so many random links are kept; groups with such lists are counted by blocks.
KEEP = 96
BLOCK = 1024
#: Vectors of one centre within this angle are linked; a little less than half the threshold's, for rounding.
CONE = float(np.arccos(THRESHOLD)) / 2 - 1e-7
#: Crowded groups up to which a row for each is sent to every task.
SENT = 20_000
#: Members of a node's neighbourhood that are joined at once.
JOIN = 96
EDGES = "u long, v long, sim double"


def _raw(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one length in double precision, each scaled by a power of two, which changes no cosine, so no square
    leaves the range. A byte behind the components tells that they are doubles."""
    if len(vectors[0]) % 4:
        x = np.frombuffer(b"".join(v[:-1] for v in vectors), dtype="<f8").reshape(len(vectors), -1)
    else:
        x = np.frombuffer(b"".join(vectors), dtype="<f4").reshape(len(vectors), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of two matrices. Those next to the threshold are taken pair by pair, product by product, so
    a pair is decided alike wherever it is met. One root is taken of both squares, so exact sums give an exact tie: of
    (0, 1, 3) and (3, 0, 9) the squares' product has the root 30, while the product of their roots is above it."""
    a, b = _squares(x), _squares(y)
    sim = (x @ y.T) / np.sqrt(a[:, None] * b[None, :])
    i, j = np.nonzero(np.abs(sim - THRESHOLD) < NEAR)
    for at in range(0, len(i), 65_536):
        p, q = i[at : at + 65_536], j[at : at + 65_536]
        sim[p, q] = (x[p] * y[q]).sum(axis=1) / np.sqrt(a[p] * b[q])
    return sim


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, as wide as they come; null where one is null, empty, zero, or has a null or non-finite component."""
    for batch in batches:
        column = batch.column(1)
        wide = pa.types.is_float64(column.type.value_type)
        if not wide and not pa.types.is_float32(column.type.value_type):
            column, wide = column.cast(pa.list_(pa.float64())), True
        sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        x = column.flatten().to_numpy(zero_copy_only=False).astype("<f8" if wide else "<f4") + 0  # null components are NaN, and no zero is negative
        bad, some = (np.concatenate([[0], np.cumsum(c)]) for c in (~np.isfinite(x), x != 0))
        ok = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
        out = [x[a:b].tobytes() + b"d" * wide if good else None for a, b, good in zip(at[:-1], at[1:], ok, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def _project(batches: Iterator[pa.RecordBatch], bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, vec = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        sizes = np.array([len(v) for v in vec])
        for size in np.unique(sizes):
            k = np.flatnonzero(sizes == size)
            x = _raw([vec[i] for i in k])
            x /= np.sqrt(_squares(x))[:, None]
            for tree in range(TREES):
                side = x @ np.random.default_rng([seed, tree, int(size)]).normal(size=(x.shape[1], bits + 1))
                code = ((side[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(k), tree * 100_003 + int(size), dtype=np.int64)), pa.array(code.astype(np.int64)), pa.array(side[:, bits]),
                        pa.array(node[k]), pa.array([vec[i] for i in k], pa.binary()),
                    ],
                    names=["tree", "code", "side", "node", "vec"],
                )


def _best(x: np.ndarray, node: np.ndarray, floor: np.ndarray, fresh: np.ndarray | None, most: int) -> tuple[np.ndarray, ...]:
    """Pairs of a small group that would improve the list of the first: the ``most`` best, and all links."""
    sim = _cosines(x, x)
    ok = sim > floor[:, None]
    if fresh is not None:
        ok &= fresh[:, None] | fresh[None, :]
    ok &= node[:, None] != node[None, :]
    shown = np.where(ok, sim, -2.0)
    if len(node) > most + 1:
        least = np.partition(shown, -most, axis=1)[:, -most]
        ok &= (shown >= least[:, None]) | (sim >= THRESHOLD)
    a, b = np.nonzero(ok)
    return node[a], node[b], sim[a, b]


def _edges(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    u, v, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.minimum(sim, 1.0))], names=["u", "v", "sim"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pairs, from runs of neighbours in the order of the projections."""
    held = None

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, node, vec = t["tree"].to_numpy(), t["node"].to_numpy(), t["vec"].to_pylist()
        cuts = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(tree)]
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(a, b, CELL):
                to = min(b, at + CELL)
                parts.append(_best(_raw(vec[at:to]), node[at:to], np.full(to - at, -1.0), None, 6))
        if parts:
            yield _edges(parts)

    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        whole = held.num_rows // (16 * CELL) * 16 * CELL
        if whole:
            yield from out(pa.Table.from_batches([held.slice(0, whole)]))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield from out(pa.Table.from_batches([held]))


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates from members that share a node, given in the order of (node, salt)."""

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.column_stack([t["node"].to_numpy(), t["salt"].to_numpy()])
        member, floor, fresh, vec = t["member"].to_numpy(), t["floor"].to_numpy(), t["fresh"].to_numpy(), t["vec"].to_pylist()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(a, b, 2 * JOIN):
                to = min(b, at + 2 * JOIN)
                if to - at > 1 and fresh[at:to].any():
                    parts.append(_best(_raw(vec[at:to]), member[at:to], floor[at:to], fresh[at:to], 4))
        if parts:
            yield _edges(parts)

    held: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= 20_000:
            t = pa.Table.from_batches(held)
            node = t["node"].to_numpy()
            cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if (node != node[-1]).any() else 0
            if cut:
                yield from out(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                many = len(node) - cut
    if held:
        yield from out(pa.Table.from_batches(held))


def _merged(edges: DataFrame, size: int) -> DataFrame:
    """The lists: the ``size`` nearest of each node, and its links; of very many links a part."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    near = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    dice = Window.partitionBy("u", F.col("sim") >= THRESHOLD).orderBy(F.xxhash64("u", "v"))
    ranked = once.withColumn("rank", F.row_number().over(near)).withColumn("dice", F.row_number().over(dice))
    link = (F.col("sim") >= THRESHOLD) & ((F.col("rank") <= KEEP) | (F.col("dice") <= KEEP))
    return ranked.filter((F.col("rank") <= size) | link).select("u", "v", "sim", "fresh", "rank")


def _round(edges: DataFrame, nodes: DataFrame, size: int, k: int) -> DataFrame:
    """Candidates of round ``k`` of neighbours-of-neighbours joins; a large neighbourhood is cut otherwise at each node and round."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    floors = edges.groupBy("u").agg(F.min(F.when(F.col("rank") == size, F.col("sim"))).alias("floor"))
    sides = edges.select(
        F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("member"), "fresh"), F.struct(F.col("v").alias("node"), F.col("u").alias("member"), "fresh"))).alias("x")
    ).select("x.*")
    members = sides.groupBy("node", "member").agg(F.max("fresh").alias("fresh"))
    crowds = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any")).filter("any and n > 1").drop("any")
    salted = members.join(crowds, "node").select(
        "node", "member", "fresh", F.pmod(F.xxhash64("member", "node", F.lit(k)), F.ceil(F.col("n") / JOIN)).alias("salt")
    )
    known = nodes.select(F.col("node").alias("member"), "vec").join(floors.withColumnRenamed("u", "member"), "member", "left")
    full = salted.join(known.withColumn("floor", F.coalesce("floor", F.lit(-1.0))), "member").select("node", "salt", "member", "fresh", "floor", "vec")
    return full.repartition(n, "node", "salt").sortWithinPartitions("node", "salt").mapInArrow(_neighbourhoods, EDGES)


def _audit(nodes: DataFrame, edges: DataFrame, k: int = 0) -> float:
    """Mean part of its links that the graph has, over a sample of nodes; every listed link is a true one.

    Nodes with a list of KEEP links or more are left out: their groups are counted by blocks, and
    would hide the others. The sample has AUDIT nodes, by a hash with ``k``, and more of them while
    fewer than LINKED have a link, AUDIT_MOST at most; so sending it to all tasks costs the same at any size.
    """
    found = edges.filter(F.col("sim") >= THRESHOLD).groupBy("u").agg(F.count(F.lit(1)).alias("found"))
    some = nodes.select("node", "vec").join(found, F.col("node") == F.col("u"), "left").select("node", "vec", F.coalesce("found", F.lit(0)).alias("found"))
    size = AUDIT
    while True:
        sample = some.filter(F.col("found") < KEEP).orderBy(F.xxhash64("node", F.lit(k)), "node").limit(size).collect()
        if not sample:
            return 1.0
        true = _true_links(nodes, sample)
        shares = [min(1.0, r["found"] / true[r["node"]]) for r in sample if true[r["node"]]]
        if len(shares) >= LINKED or len(sample) < size or size >= AUDIT_MOST:
            return sum(shares) / len(shares) if shares else 1.0
        size = min(AUDIT_MOST, 4 * size)


def _true_links(nodes: DataFrame, sample: list) -> dict[int, int]:
    """Number of links of each node of a sample, by comparison with all nodes."""
    ids = np.array([r["node"] for r in sample])
    vecs = [bytes(r["vec"]) for r in sample]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            own, vec = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vec])
            for size in np.unique(sizes):
                k = np.flatnonzero(sizes == size)
                x = _raw([vec[i] for i in k])
                q = np.array([i for i, v in enumerate(vecs) if len(v) == size], dtype=np.int64)
                for at in range(0, len(q), AUDIT):
                    part = q[at : at + AUDIT]
                    hit = (_cosines(_raw([vecs[i] for i in part]), x) >= THRESHOLD) & (ids[part][:, None] != own[k][None, :])
                    n[part] += hit.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["node", "n"])

    rows = nodes.select("node", "vec").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()  # the sample's rows
    return {r["node"]: r["n"] for r in rows}


def graph(nodes: DataFrame, scratch: Scratch, *, seed: int = 7) -> DataFrame:
    """Neighbour lists ``u, v, sim`` of all nodes, by NN-descent."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = nodes.count()
    bits = max(1, min(40, int(np.ceil(np.log2(max(2, many / CELL))))))

    def in_cells(own: int) -> DataFrame:
        placed = nodes.select("node", "vec").mapInArrow(lambda it: _project(it, bits, own), "tree long, code long, side double, node long, vec binary")
        return placed.repartitionByRange(n, "tree", "code", "side").sortWithinPartitions("tree", "code", "side").mapInArrow(_cells, EDGES)

    size = LIST
    edges = scratch.table(_merged(in_cells(seed).withColumn("fresh", F.lit(True)), size), "edges-0")
    most, idle = 0, 0
    for k in itertools.count(1):
        if k > ROUNDS:
            recall = _audit(nodes, edges, k)
            _LOG.info("recall after %d rounds: %.4f", k - 1, recall)
            if recall >= RECALL:
                break
            links = edges.filter(F.col("sim") >= THRESHOLD).count()
            idle = 0 if links > most else idle + 1
            most = max(most, links)
            if idle >= STALLED:
                _LOG.error("recall %.4f is below %.4f and %d rounds found no new link", recall, RECALL, idle)
                break
        size += LIST // 2 if k > ROUNDS else 0
        found = _round(edges, nodes, size, k)
        if k > ROUNDS:  # new projections reach what the descent can't, so the recall holds in the end
            found = found.unionByName(in_cells(seed + k))
        # Pairs known before are not fresh, however they are found again.
        old = edges.select("u", "v", "sim", F.lit(False).alias("fresh"))
        edges = scratch.table(_merged(old.unionByName(found.withColumn("fresh", F.lit(True))), size), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
    return edges.select("u", "v", "sim")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each group, given in the order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and tuple(key[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _cone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their group's centre in the last column: whether they are near enough to it that all such are linked."""
    for batch in batches:
        if batch.num_rows:
            vec, centre = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            core = np.empty(len(vec), dtype=bool)
            sizes = np.array([len(v) for v in vec])
            for size in np.unique(sizes):
                k = np.flatnonzero(sizes == size)
                x, y = _raw([vec[i] for i in k]), _raw([centre[i] for i in k])
                cos = (x * y).sum(axis=1) / np.sqrt(_squares(x) * _squares(y))
                core[k] = np.arccos(np.clip(cos, -1.0, 1.0)) <= CONE
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(core)], names=["node", "component", "mass", "vec", "core"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between far nodes of one block (side 0) and the nodes of another (1: far, 2: near the centre), given in the order
    of (component, i, j). Links of far nodes count at them, with whomever; near nodes get only those with far ones here."""
    for t in _groups(batches, ["component", "i", "j"]):
        side, node, mass, vec = t["side"].to_numpy(), t["node"].to_numpy(), t["mass"].to_numpy(), t["vec"].to_pylist()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        if not len(a) or not len(b):
            continue
        got, back = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        sizes = np.array([len(v) for v in vec])
        for size in np.unique(sizes):
            p, q = np.flatnonzero(sizes[a] == size), np.flatnonzero(sizes[b] == size)
            if len(p) and len(q):
                hit = (_cosines(_raw([vec[i] for i in a[p]]), _raw([vec[i] for i in b[q]])) >= THRESHOLD) & (node[a[p]][:, None] != node[b[q]][None, :])
                got[p], back[q] = hit @ mass[b[q]], mass[a[p]] @ hit
        near = side[b] == 2
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[a], node[b][near]])), pa.array(np.concatenate([got, back[near]]))], names=["node", "n"])


def _crowded_links(label: DataFrame, counted: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, exact``: links of every node of a group in which a list may be cut, by mass."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = counted.select(F.col("u").alias("node"), "lists")
    heads = label.select("node", "component").join(lists, "node").groupBy("component").agg(F.max("lists").alias("most"), F.max_by("node", F.struct("lists", "node")).alias("node"))
    heads = scratch.table(heads.filter(F.col("most") >= KEEP).join(nodes.select("node", F.col("vec").alias("centre")), "node").select("component", "centre"), "heads")
    few = heads.count() <= SENT
    sent = F.broadcast if few else (lambda df: df)  # one group may hold a third of all nodes; joins by group are for very many groups
    inside = label.join(sent(heads), "component").join(nodes.select("node", "vec"), "node").select("node", "component", "mass", "vec", "centre")
    coned = scratch.table(inside.mapInArrow(_cone, "node long, component long, mass long, vec binary, core boolean"), "coned")
    far = F.count_if(~F.col("core"))
    sizes = coned.groupBy("component").agg(F.ceil(far / BLOCK).cast("int").alias("far_blocks"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.sum(F.when(F.col("core"), F.col("mass"))).alias("core_mass"))
    placed = coned.join(sent(sizes), "component")
    sure = placed.filter("core").select("node", (F.col("core_mass") - F.col("mass")).alias("n"))
    compared = placed.filter("far_blocks > 0")
    own = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rows = ["node", "mass", "vec"]
    sides = compared.filter("not core").select("component", own("far_blocks").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"), *rows).unionByName(
        compared.select("component", every("far_blocks").alias("i"), own("blocks").alias("j"), F.when(F.col("core"), 2).otherwise(1).alias("side"), *rows)
    )
    met = sides.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_blocks, "node long, n long")
    return sure.unionByName(met).groupBy("node").agg(F.sum("n").alias("exact"))


def near_duplicates(vectors: DataFrame, scratch: Scratch, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows that are null, zero, or have a null or non-finite component link with nothing; so do
    vectors of different lengths. Cosines are of double precision whether the components are floats or doubles, and
    one of exactly the threshold links. Equal vectors are linked with each other. A row with a null id
    takes part, but no component is named after it. Repeated rows count each; an empty table
    gives no rows; other columns are ignored.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(_clean, "vec_id long, vec binary")
    rows = scratch.table(clean.withColumn("node", F.xxhash64("vec")), "rows")
    nodes = scratch.table(
        rows.filter("vec is not null").groupBy("node").agg(F.count(F.lit(1)).alias("mass"), F.min("vec_id").alias("least"), F.first("vec").alias("vec")), "nodes"
    )
    edges = graph(nodes, scratch).filter(F.col("sim") >= THRESHOLD)
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    links = scratch.table(both, "links")
    cc = scratch.table(components(links.filter("u < v").select(F.col("u").alias("a"), F.col("v").alias("b")), scratch), "components")
    label = nodes.select("node", "mass", "least").join(cc, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = scratch.table(label, "labels")
    named = label.groupBy("component").agg(F.min("least").alias("component_id"))
    counted = links.join(nodes.select(F.col("node").alias("v"), "mass"), "v").groupBy("u").agg(F.sum("mass").alias("linked"), F.count(F.lit(1)).alias("lists"))
    exact = _crowded_links(label, counted, nodes, scratch)
    done = (
        label.join(named, "component")
        .join(counted.select(F.col("u").alias("node"), "linked"), "node", "left")
        .join(exact, "node", "left")
        .select("node", "component_id", (F.coalesce("exact", "linked", F.lit(0)) + F.col("mass") - 1).alias("n_links"))
    )
    return rows.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("node")).alias("node")).join(done, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
