"""Hard negatives by a block matrix product: rows and dimensions are cut into blocks, partial tiles are summed by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import Scratch

#: Components become whole numbers of 1 / SCALE.
SCALE = 256
#: Anchors of a block, rows of a block, dimensions of a chunk.
ANCHORS, ROWS, CHUNK = 128, 1024, 32
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Every ANCHOR_EVERY-th id is an anchor.
ANCHOR_EVERY = 50
#: Largest sum of squares of a row: by Cauchy and Schwarz no score, nor a part of one, leaves 64 bits.
MOST = 9.0e18
_BLOCK = "block long, chunk int, dims int, least long, greatest long, ids array<long>, labels array<long>, cells binary"
_TILE = "a long, r long, chunk int, n_a int, width int, cells binary, ids_a array<long>, labels_a array<long>, windows array<long>, ids_r array<long>, labels_r array<long>"
_META = ("ids_a", "labels_a", "windows", "ids_r", "labels_r")


def scaled(vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, label, cells`` of the rows that take part: whole numbers floor(scale * x) for each component.

    Rows with a null id, label or vector, with a null or non-finite component, or so long that a score could leave
    64 bits take no part. Of rows with one id the least by label and vector takes part.
    """
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    long_ = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.floor(v * scale).cast("double"), 2)) > MOST
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).filter(~bad).filter(~long_)
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("cells")).alias("x")
    )
    return rows.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.label", "x.cells")


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows, a row for each chunk of dimensions; shorter vectors are filled with zeros."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    held: list[tuple[int, int, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        nonlocal made
        dims = max(1, max(len(c) for _, _, c in held))
        cells = np.zeros((len(held), dims), dtype="<i8")
        for k, (_, _, c) in enumerate(held):
            cells[k, : len(c)] = c
        labels = [x[1] for x in held]
        meta = [[x[0] for x in held], labels]
        number = (part << 32) + made
        made += 1
        held.clear()
        cuts = range(0, dims, chunk)
        n = len(cuts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([min(chunk, dims - c) for c in cuts], pa.int32()),
                pa.array([min(labels)] * n, pa.int64()), pa.array([max(labels)] * n, pa.int64()), *[pa.array([x, *[None] * (n - 1)], pa.list_(pa.int64())) for x in meta],
                pa.array([np.ascontiguousarray(cells[:, c : c + chunk]).tobytes() for c in cuts], pa.binary()),
            ],
            names=["block", "chunk", "dims", "least", "greatest", "ids", "labels", "cells"],
        )

    for batch in batches:
        at = batch.column(2).offsets.to_numpy()
        flat = batch.column(2).values.to_numpy()
        for k, (i, label) in enumerate(zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), strict=True)):
            held.append((i, label, flat[at[k] : at[k + 1]]))
            if len(held) == rows:
                yield block()
    if held:
        yield block()


def blocks(rows: DataFrame, size: int, chunk: int) -> DataFrame:
    """Rows in order of label and id, in blocks of ``size``: block, chunk, dims, ids, labels, cells; the first chunk has ids and labels."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("id", "label", "cells").repartitionByRange(n, "label", "id").sortWithinPartitions("label", "id")
    return ordered.mapInArrow(lambda it: _blocks(it, size, chunk), _BLOCK)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers; floating point is used where it is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _narrow(tile: np.ndarray) -> tuple[int, bytes]:
    """A tile's bytes, in whole numbers as wide as its values need."""
    most = int(np.abs(tile).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return width, tile.astype(f"<i{width}").tobytes()


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for row in range(batch.num_rows):
            # Blocks of unlike dimensions: what one lacks is zero.
            a, b = (np.frombuffer(col["cells" + s][row].as_py(), dtype="<i8").reshape(-1, col["dims" + s][row].as_py()) for s in ("_a", "_r"))
            d = min(a.shape[1], b.shape[1])
            width, cells = _narrow(_product(a[:, :d], b[:, :d]))
            own = [col[c].slice(row, 1) for c in ("a", "r", "chunk")]
            said = [pa.array([len(a)], pa.int32()), pa.array([width], pa.int32()), pa.array([cells], pa.binary())]
            meta = [col[c].slice(row, 1) for c in _META]
            yield pa.RecordBatch.from_arrays([*own, *said, *meta], names=["a", "r", "chunk", "n_a", "width", "cells", *_META])


def partial_tiles(anchors: DataFrame, rows: DataFrame, shape: tuple[int, int], wanted: DataFrame | None) -> DataFrame:
    """A partial tile of scores for each block of anchors, block of rows and chunk of dimensions.

    ``wanted`` (``a, r``) names the tiles to make. Without it all are made but those within one label: blocks are
    dealt to a grid of ``shape``, blocks of anchors to a row and blocks of rows to a column of it, so each block is
    stored once a cell of its row or column and each cell is a task's work.
    """
    of_a = [F.col("block").alias("a"), "chunk", *[F.col(c).alias(c + "_a") for c in ("dims", "least", "greatest", "ids", "labels", "cells")], "windows"]
    of_r = [F.col("block").alias("r"), "chunk", *[F.col(c).alias(c + "_r") for c in ("dims", "least", "greatest", "ids", "labels", "cells")]]
    left, right = anchors.select(*of_a), rows.select(*of_r)
    if wanted is None:
        line, column = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in zip(("a", "r"), shape, strict=True))
        left = left.withColumn("line", line).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))))
        right = right.withColumn("column", column).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1))))
        one = (F.col("least_a") == F.col("greatest_a")) & (F.col("least_r") == F.col("greatest_r")) & (F.col("least_a") == F.col("least_r"))
        met = left.join(right, ["line", "column", "chunk"]).filter(~one)
    else:
        met = left.join(wanted, "a").join(right, ["r", "chunk"])
    return met.select("a", "r", "chunk", "dims_a", "cells_a", "dims_r", "cells_r", *_META).mapInArrow(_multiply, _TILE)


def _positives(ids_a: np.ndarray, labels_a: np.ndarray, ids_r: np.ndarray, labels_r: np.ndarray, tile: np.ndarray, said: dict, most: int) -> Iterator[tuple]:
    for k in range(len(ids_a)):
        at = np.flatnonzero((labels_r == labels_a[k]) & (ids_r != ids_a[k]))
        for j in at[np.lexsort((ids_r[at], -tile[k, at]))[:most]]:
            yield ids_a[k], ids_r[j], tile[k, j]


def _negatives(ids_a: np.ndarray, labels_a: np.ndarray, ids_r: np.ndarray, labels_r: np.ndarray, tile: np.ndarray, said: dict, most: int) -> Iterator[tuple]:
    for k in range(len(ids_a)):
        windows = said.get(int(ids_a[k]))
        if not windows:
            continue
        least, greatest = min(w[1] for w in windows), max(w[2] for w in windows)
        at = np.flatnonzero((labels_r != labels_a[k]) & (tile[k] >= least) & (tile[k] <= greatest))
        at = at[np.lexsort((ids_r[at], -tile[k, at]))]
        scores = -tile[k, at]
        for positive, low, high in windows:
            first, end = np.searchsorted(scores, -high, side="left"), np.searchsorted(scores, -low, side="right")
            for j in at[first : min(end, first + most)]:
                yield ids_a[k], positive, ids_r[j], tile[k, j]


def _reduce(batches: Iterator[pa.RecordBatch], pick, most: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums the chunks of each tile, which come one after another, and gives what ``pick`` takes from the whole tile."""
    key, tile, meta = None, None, None

    def found() -> pa.RecordBatch:
        said: dict[int, list] = {}
        for anchor, positive, low, high in meta["windows"].reshape(-1, 4).tolist():
            said.setdefault(anchor, []).append((positive, low, high))
        out = list(pick(*[meta[c] for c in ("ids_a", "labels_a", "ids_r", "labels_r")], tile, said, most))
        return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in out], pa.int64()) for k in range(len(names))], names=names)

    for batch in batches:
        col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for row in range(batch.num_rows):
            at = (col["a"][row].as_py(), col["r"][row].as_py())
            if at != key:
                if key is not None:
                    yield found()
                key, tile, meta = at, 0, None
            tile = tile + np.frombuffer(col["cells"][row].as_py(), dtype=f"<i{col['width'][row].as_py()}").reshape(col["n_a"][row].as_py(), -1).astype(np.int64)
            if col["ids_a"][row].is_valid:
                meta = {c: np.array(col[c][row].as_py() or [], dtype=np.int64) for c in _META}
    if key is not None:
        yield found()


def _summed(tiles: DataFrame, pick, most: int, names: list[str]) -> DataFrame:
    """Partial tiles are dealt by tile, so a task adds the chunks of a tile up and only its best rows go on."""
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(n, "a", "r").sortWithinPartitions("a", "r", "chunk")
    return dealt.mapInArrow(lambda it: _reduce(it, pick, most, names), ", ".join(f"{c} long" for c in names))


def _first(found: DataFrame, by: list[str], item: str, most: int) -> DataFrame:
    ranked = Window.partitionBy(*by).orderBy(F.desc("score"), item)
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most)


def mine(
    vectors: DataFrame,
    scratch: Scratch,
    *,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    is_anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    anchor_block: int = ANCHORS,
    row_block: int = ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor its best rows of the
    same label, and for each of those the best rows of other labels with scores within ``low`` to ``high`` hundredths.

    Scores are inner products of whole numbers (``scaled``), summed in 64 bits; ties go to the smaller id. ``is_anchor`` is a
    condition on ``id``. Vectors of unlike length are filled with zeros. Rows that take no part are those that ``scaled``
    names; an anchor without other rows of its label, or a positive without a row in its window, gives none; an empty
    table gives no rows; other columns, whatever their names, are ignored.

    Rows lie in blocks by label. Positives come from the tiles of blocks that share a label, negatives from all tiles
    but those within one label, so a tile is made about once. A tile is reduced to the best few of each anchor and window
    before anything else is shuffled.
    """
    rows = scratch.table(scaled(vectors, id_col=id_col, label_col=label_col, vec_col=vec_col), "rows")
    anchors = rows.filter(F.pmod("id", F.lit(ANCHOR_EVERY)) == 0 if is_anchor is None else is_anchor)
    of_rows = scratch.table(blocks(rows, row_block, chunk), "row_blocks")
    of_anchors = scratch.table(blocks(anchors, anchor_block, chunk), "anchor_blocks")

    none = F.lit(None).cast("array<long>")
    labels = [x.filter("chunk = 0").select(F.col("block").alias(c), F.explode(F.array_distinct("labels")).alias("label")) for x, c in ((of_anchors, "a"), (of_rows, "r"))]
    shared = labels[0].join(labels[1], "label").select("a", "r").distinct()
    tiles = partial_tiles(of_anchors.withColumn("windows", none), of_rows, (1, 1), shared)
    best = _first(_summed(tiles, _positives, positives, ["anchor", "positive", "score"]), ["anchor"], "positive", positives)
    best = scratch.table(best.drop("rank"), "positives")

    score = F.col("score").cast("decimal(20,0)")
    ends = [F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")]
    windows = best.select("anchor", F.array("anchor", "positive", *ends).alias("x")).filter(F.col("x")[2] <= F.col("x")[3])
    home = of_anchors.filter("chunk = 0").select(F.col("block"), "chunk", F.explode("ids").alias("anchor"))
    windows = windows.join(home, "anchor").groupBy("block", "chunk").agg(F.flatten(F.collect_list("x")).alias("windows"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Copies are fewest if the grid's sides are as the numbers of blocks.
    n_a, n_r = (max(1, x.filter("chunk = 0").count()) for x in (of_anchors, of_rows))
    lines = max(1, min(n, round((n * n_a / n_r) ** 0.5)))
    tiles = partial_tiles(of_anchors.join(windows, ["block", "chunk"], "left"), of_rows, (lines, -(-n // lines)), None)
    found = _summed(tiles, _negatives, negatives, ["anchor", "positive", "negative", "score"])
    found = _first(found, ["anchor", "positive"], "negative", negatives)
    scores = best.select("anchor", "positive", F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
