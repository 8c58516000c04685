"""Best-fit packing of documents into sequences of bounded length, bulk-synchronously.

Documents are tokenised and cut into pieces where they lie; only a narrow row per piece moves on. Pieces
go by bands of length, the longest first; a piece of over half a sequence opens one. In each round
of a band its pieces and the gaps of all open sequences are sorted together by size, in runs that tasks share, and swept
from the largest down: a gap raises the level and a piece lowers it. A piece's successor, the smallest gap that holds it
and that no longer piece takes, is the last gap before it that crossed its level upwards, so levels, running sums
over the runs plus ranks in them, settle all conflicts at once. Matched gaps shrink and the next round follows. Where
few pieces of the band still find a gap, as many sequences are opened as their tokens need. A gap that holds several pieces
of the band is several gaps in a round.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillspark.llm.tokens import encoder
from quillspark.session import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"
#: Bands of length are halved down to this one, which also holds all shorter pieces.
LAST_BAND = 16
#: Runs into which the units of a size are cut.
SHARES = 64
#: Part of a band's pieces left that must find a gap in a round, or sequences are opened.
ENOUGH = 0.05


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    enc = encoder(tokenizer)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    item = part << 40  # rows of one task are numbered from here
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            keys = batch.column(0).slice(at, 512).to_pylist()
            rows: list[tuple] = []
            for key, ids in zip(keys, enc.encode(batch.column(1).slice(at, 512).to_pylist()), strict=True):
                wide = np.frombuffer(ids + end, dtype=enc.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(wide), size)):
                    own = wide[start : start + size]
                    rows.append((key, piece, start, len(own), zlib.crc32(own.tobytes()), item))
                    item += 1
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "item"],
            )


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, size: int, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token pieces of every document, without their ids; ``item`` is a number of each."""
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        lambda it: _pieces(it, tokenizer, end_id, size), PIECES
    )


def match(left: DataFrame, gaps: DataFrame, most: int, least: int) -> DataFrame:
    """Best fit of every piece (``item, length``, all of ``least`` to ``most``) among the gaps (``seq, gap``), each used once:
    ``item, length, seq, sub, gap``, with null where no gap is left that holds the piece.

    ``sub`` numbers the parts of a gap that is several gaps of at least ``most``. Units of one size and kind are cut into
    SHARES runs by a hash, so no task holds a whole size; the runs, at most 2 * SHARES for each size, are put in order, and
    their running sum is the level at which each begins. A run crosses a level once, so a level has an event per run at most.
    """
    parts = F.greatest(F.lit(1), F.floor(F.col("gap") / most)).cast("int")
    split = gaps.filter(F.col("gap") >= least).select("seq", "gap", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("sub"))
    units = split.select(F.floor(F.col("gap") / F.col("parts")).alias("size"), F.lit(False).alias("piece"), F.col("seq").alias("id"), "sub", "gap").unionByName(
        left.select(F.col("length").alias("size"), F.lit(True).alias("piece"), F.col("item").alias("id"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("gap"))
    )
    run = ["size", "piece", "share"]
    units = units.withColumn("share", F.pmod(F.xxhash64("id", "sub"), F.lit(SHARES)).cast("int"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "piece", "share")
    runs = (
        units.groupBy(*run).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("at", F.row_number().over(order))
        .withColumn("base", F.coalesce(F.sum(F.when(F.col("piece"), -F.col("n")).otherwise(F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    rank = F.row_number().over(Window.partitionBy(*run).orderBy("id", "sub"))
    events = units.withColumn("rank", rank).join(F.broadcast(runs.drop("n")), run)
    events = events.withColumn("edge", F.col("base") + F.when(F.col("piece"), -F.col("rank")).otherwise(F.col("rank") - 1))
    last = F.lag(F.when(~F.col("piece"), F.struct("id", "sub", "gap"))).over(Window.partitionBy("edge").orderBy("at"))
    return events.withColumn("g", last).filter("piece").select(
        F.col("id").alias("item"), F.col("size").alias("length"), F.col("g.id").alias("seq"), F.col("g.sub").alias("sub"), F.col("g.gap").alias("gap")
    )


def place(items: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """A sequence for every piece given as ``item, length``: ``item, length, seq, round, sub``.

    The pieces of a sequence lie in it in the order of round and sub.
    """
    spark = items.sparkSession
    count = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    done = [items.filter(2 * F.col("length") > size).select("item", "length", F.col("item").alias("seq"), F.lit(0).alias("round"), F.lit(0).alias("sub"))]
    gaps = scratch.table(done[0].filter(F.col("length") < size).select("seq", (F.lit(size) - F.col("length")).alias("gap")), "gaps-0")
    upper, k = size // 2, 0
    while upper:
        lower = upper // 2 if upper > LAST_BAND else 0
        own = {x: n for x, n in count.items() if lower < x <= upper}
        left = items.filter((F.col("length") > lower) & (F.col("length") <= upper))
        n, tokens, most, least = sum(own.values()), sum(x * c for x, c in own.items()), max(own, default=0), min(own, default=0)
        room = n  # places that the gaps may have, at most
        while n:
            k += 1
            if room < ENOUGH * n:  # as many as what the gaps can't take needs at least; ids of opened sequences are negative, those of pieces are not
                need = max(1, -(-(tokens - room * most) // size), -(-(n - room) // (size // least)))
                opened = spark.range(need).select((-F.col("id") - 1 - F.lit(k << 40)).alias("seq"), F.lit(size).cast("long").alias("gap"))
                gaps = gaps.unionByName(opened)
            missed, shrunk = Observation(), Observation()
            length = F.when(F.col("seq").isNull(), F.col("length"))
            found = match(left, gaps, most, least).observe(
                missed, F.count(length).alias("n"), F.sum(length).alias("tokens"), F.max(length).alias("most"), F.min(length).alias("least")
            )
            found = scratch.table(found, f"round-{k}")
            n, tokens, most, least = (missed.get[x] or 0 for x in ("n", "tokens", "most", "least"))
            placed = found.filter("seq is not null").select("item", "length", "seq", F.lit(k).alias("round"), "sub")
            done.append(placed)
            used = placed.groupBy("seq").agg(F.sum("length").alias("used"))
            gaps = gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).filter("gap > 0")
            places = F.when(F.col("gap") >= least, F.greatest(F.lit(1), F.floor(F.col("gap") / max(1, most))))
            gaps = scratch.table(gaps.observe(shrunk, F.sum(places).alias("room")), f"gaps-{k}")
            room = shrunk.get["room"] or 0
            scratch.drop(f"gaps-{k - 1}")
            left = found.filter("seq is null").select("item", "length")
        upper = lower
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    scratch: Scratch,
    *,
    end_id: int = 1,
    size: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document; one row per piece with its sequence and the place in it.

    A null text counts as empty, so its piece is the end id alone; a null key stays null;
    repeated rows are packed each; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    cut = scratch.table(pieces(docs, tokenizer, end_id, size, id_col=id_col, text_col=text_col), "pieces")
    placed = scratch.table(place(cut.select("item", "length"), size, scratch), "placed")
    before = Window.partitionBy("seq").orderBy("round", "sub").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.select("item", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return cut.join(at, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sweeps(classes: list[tuple[int, int]], size: int) -> list[tuple]:
    """Best-fit decreasing, one length after another, for pieces given as (length, number): runs (length, rank_lo, n, per, seq_lo, n_seq, gap).

    It is what the rounds are compared with. A step takes all pieces of the longest length left. Its sweep goes over the gaps sorted by size,
    from the successor of the length on; ranks decide which pieces get the gaps of a size, and each
    shrunk gap takes its place in the order before the next step, so it can be the successor again.
    Pieces that no gap holds open sequences, each filled with as many of them as fit.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size to runs (first sequence, number)
    order: list[int] = []
    out: list[tuple] = []
    opened = 0

    def give(gap: int, seq: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((seq, n))

    for length, count in sorted(((int(x), int(n)) for x, n in classes), reverse=True):
        rank = 0
        while rank < count:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                whole, rest = divmod(count - rank, size // length)
                for per, seqs in ((size // length, whole), (rest, 1)):
                    if per and seqs:
                        out.append((length, rank, per * seqs, per, opened, seqs, size))
                        give(size - per * length, opened, seqs)
                        rank, opened = rank + per * seqs, opened + seqs
                continue
            gap = order[at]
            runs, shrunk = gaps[gap], []
            while runs and rank < count:
                seq, n = runs.pop()
                took = min(n, count - rank)
                out.append((length, rank, took, 1, seq, took, gap))
                shrunk.append((seq, took))
                rank += took
                if took < n:
                    runs.append((seq + took, n - took))
            if not runs:
                del gaps[gap], order[at]
            for seq, n in shrunk:
                give(gap - length, seq, n)
    return out
