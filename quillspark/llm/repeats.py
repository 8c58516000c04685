"""Exact repeats across documents: enhanced suffix arrays over the places where texts may repeat.

A repeat of ``size`` bytes is found in four steps, none of which moves whole texts.

1. Every window of ``size`` bytes has an anchor: the substring of ``K`` bytes with the least hash in
   it. Windows of equal content have equal anchors. Neighbouring windows share theirs, so a
   document is a chain of contexts: an anchor and the bytes of the windows that it serves. The
   texts are kept in part files meanwhile, one per input split.
2. Anchors, as numbers, are range-sorted by (anchor, context, place). A context seen before is
   covered whole. Contexts that share only their anchor go on; those of range borders too.
3. The bytes of these few contexts are fetched from the part files and grouped by anchor. For each
   group a suffix array with longest common prefixes is scanned with a stack into the tree of
   common-prefix intervals; an interval with different left neighbours is a maximal repeat, and
   all its occurrences but the first are covered. Anchors with more contexts than one task should
   hold are compared window by window, by hash, through aggregations.
4. Covered spans reach the part files, are merged, and cut from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.files import commit
from quillspark.session import Scratch

K = 24
#: Contexts of one anchor that one task compares; anchors with more go window by window.
CROWD = 8_000
#: Contexts whose suffixes are sorted at once, where their groups allow.
SORTED = 1_500
#: Bytes of text in a row group of a part file.
GROUP_BYTES = 8_000_000
#: Bytes of text handled at once.
SLICE = 1_000_000
_POS = np.uint64((1 << 23) - 1)
NULL_KEY = -(2**63)
ANCHORS = "h long, ctx long, doc long, start int, span int, part int, row int"


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _hashes(buf: bytes) -> np.ndarray:
    """64-bit hash of the K = 24 bytes at every place of a buffer."""
    n = len(buf) - K + 1
    padded = buf + bytes(16)
    words = np.empty(len(buf) + 8, dtype=np.uint64)
    for r in range(8):
        own = np.frombuffer(padded, dtype="<u8", offset=r, count=(len(padded) - r) // 8)
        words[r : r + 8 * len(own) : 8] = own[: len(words[r::8])]
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h << np.uint64(23)) | (h >> np.uint64(41))
    h += words[16 : n + 16] * np.uint64(0x165667B19E3779F9)
    return _mix(h)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[: len(keys) - have], keys[have:])
        have *= 2
    if have < width:
        keys = np.minimum(keys[: len(keys) - (width - have)], keys[width - have :])
    return keys


def contexts(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that together are below 8 MB: text number, first window, further windows, anchor hash, content hash."""
    import xxhash

    buf = b"".join(texts)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lens)])[:-1]
    counts = np.maximum(lens - size + 1, 0)
    if not counts.any():
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none
    h = _hashes(buf)
    keys = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    least = _least(keys, size - K + 1)
    number = np.repeat(np.arange(len(texts)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[number]
    anchor = (least[window] & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1])]))
    first = window[new]
    span = np.diff(np.concatenate([new, [len(window)]])) - 1
    digest, view = xxhash.xxh3_64_intdigest, memoryview(buf)
    ctx = np.fromiter(
        (digest(view[a:b]) for a, b in zip(first.tolist(), (first + span + size).tolist(), strict=True)), dtype=np.uint64, count=len(first)
    )
    of = number[new]
    return of, first - begins[of], span, h[anchor[new]].view(np.int64), ctx.view(np.int64)


def _slices(lens: list[int]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(lens):
        j, total = i, 0
        while j < len(lens) and (j == i or total + lens[j] < SLICE):
            total += lens[j]
            j += 1
        yield i, j
        i = j


def _long_contexts(text: bytes, size: int) -> tuple:
    """As ``contexts`` for one text of any length, in overlapping stretches."""
    parts, step = [], SLICE
    for at in range(0, max(1, len(text) - size + 1), step):
        of, first, span, h, ctx = contexts([text[at : at + step + size - 1]], size)
        parts.append((of, first + at, span, h, ctx))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchor_rows(batches: Iterator[pa.RecordBatch], uri: str, size: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs
    from pyspark import TaskContext

    part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/.docs-{part:06d}-{attempt}"
    schema = pa.schema([("doc", pa.int64()), ("text", pa.binary())])
    at_row, held = 0, []
    with fs.open_output_stream(temp) as sink, pq.ParquetWriter(sink, schema, compression="zstd", use_dictionary=False) as out:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys = pa.array([NULL_KEY if k is None else k for k in batch.column(0).slice(at, 256).to_pylist()], pa.int64())
                texts = [b"" if t is None else t for t in batch.column(1).slice(at, 256).cast(pa.binary()).to_pylist()]
                held.append(pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.binary())], schema=schema))
                if sum(b.nbytes for b in held) > GROUP_BYTES:
                    out.write_table(pa.Table.from_batches(held))
                    held = []
                keys = keys.to_numpy()
                for i, j in _slices([len(t) for t in texts]):
                    of, first, span, h, ctx = contexts(texts[i:j], size) if len(texts[i]) <= SLICE else _long_contexts(texts[i], size)
                    row = (of + i).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h), pa.array(ctx), pa.array(keys[row]), pa.array(first.astype(np.int32)), pa.array(span.astype(np.int32)),
                            pa.array(np.full(len(of), part, dtype=np.int32)), pa.array((row + at_row).astype(np.int32)),
                        ],
                        names=["h", "ctx", "doc", "start", "span", "part", "row"],
                    )
                at_row += len(texts)
        if held:
            out.write_table(pa.Table.from_batches(held))
    commit(fs, temp, f"{root}/docs-{part:06d}")
    yield pa.RecordBatch.from_pydict(
        # A mark of the part: its file counts even if no text of it has a window.
        {"h": [0], "ctx": [0], "doc": [0], "start": [-1], "span": [0], "part": [part], "row": [at_row]},
        schema=pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("span", pa.int32()), ("part", pa.int32()), ("row", pa.int32())]),
    )


def _sorted_scan(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (h, ctx, doc, row, start): covers of repeated contexts, and what goes on."""
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    t = pa.Table.from_batches([first, *batches])
    h, ctx, doc, start, span, part, row = (t[c].to_numpy() for c in ("h", "ctx", "doc", "start", "span", "part", "row"))
    if not len(h):
        return
    same_h = np.concatenate([[False], h[1:] == h[:-1]])
    again = same_h & np.concatenate([[False], ctx[1:] == ctx[:-1]])
    run = np.cumsum(~same_h) - 1
    heads = np.bincount(run[~again], minlength=run[-1] + 1)
    onward = ~again & ((heads[run] > 1) | (run == 0) | (run == run[-1]))
    for pick, kind in ((again, 0), (onward, 1)):
        k = np.flatnonzero(pick)
        for at in range(0, len(k), 50_000):
            i = k[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), kind, dtype=np.int32)), *(pa.array(x[i]) for x in (h, doc, part, row, start)), pa.array(start[i] + span[i] + np.int32(size))],
                names=["kind", "h", "doc", "part", "row", "start", "end"],
            )


def _part_texts(uri: str, part: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{root}/docs-{part:06d}") as f:
        at = 0
        for batch in pq.ParquetFile(f).iter_batches(batch_size=1024):
            yield at, batch
            at += batch.num_rows


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Rows of each part, given in the order of (part, row)."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[int, dict[str, np.ndarray]]:
        t = pa.Table.from_batches(held)
        return int(t["part"][0].as_py()), {c: t[c].to_numpy() for c in t.column_names}

    for batch in batches:
        parts = batch.column(batch.schema.get_field_index("part")).to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own = batch.slice(a, b - a)
            if held and held[-1].column(held[-1].schema.get_field_index("part"))[0] != own.column(own.schema.get_field_index("part"))[0]:
                yield out()
                held = []
            held.append(own)
    if held:
        yield out()


def _fetch(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts, from the part files."""
    for part, rows in _by_part(batches):
        at = 0
        for base, batch in _part_texts(uri, part):
            to = int(np.searchsorted(rows["row"], base + batch.num_rows))
            if to == at:
                continue
            i = np.arange(at, to)
            at = to
            texts = batch.column(1)
            have: dict[int, bytes] = {}
            own = []
            for r, a, b in zip((rows["row"][i] - base).tolist(), rows["start"][i].tolist(), rows["end"][i].tolist(), strict=True):
                if r not in have:
                    have = {r: texts[r].as_py()}
                own.append(have[r][a:b])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(rows[c][i]) for c in ("h", "doc", "part", "row", "start")), pa.array(own, pa.binary())],
                names=["h", "doc", "part", "row", "start", "text"],
            )


def maximal_repeats(pieces: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of at least ``size`` bytes among pieces: (length, piece numbers, starts).

    The suffixes with ``size`` bytes or more are sorted; their longest common prefixes are
    scanned with a stack, whose frames are the open intervals of the common-prefix tree. An
    interval is given with all its occurrences if two of them have different left neighbours;
    the start of a piece counts as different, since what is left of it is not known here.
    """
    lens = np.array([len(p) for p in pieces], dtype=np.int64)
    counts = np.maximum(lens - size + 1, 0)
    total = int(counts.sum())
    if total < 2:
        return
    longest = int(lens.max())
    buf = np.frombuffer(b"".join(pieces) + bytes(longest), dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum(lens)])[:-1]
    piece = np.repeat(np.arange(len(pieces)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    rest = lens[piece] - start
    at = begins[piece] + start
    suffix = np.lib.stride_tricks.sliding_window_view(buf, longest)[at].copy()
    suffix[np.arange(longest) >= rest[:, None]] = 0
    order = np.argsort(suffix.view(f"S{longest}").ravel(), kind="stable")
    ranked = suffix[order]
    differ = ranked[1:] != ranked[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    lcp = np.minimum(lcp, np.minimum(rest[order[1:]], rest[order[:-1]]))
    left = np.where(start[order] > 0, buf[np.maximum(at[order] - 1, 0)].astype(np.int64), -1 - np.arange(total))
    lcp_list = np.where(lcp >= size, lcp, 0)
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    for a, b in _runs(lcp_list > 0):
        stack: list[tuple[int, int]] = []  # (common prefix, first rank)
        values = lcp_list[a:b].tolist() + [0]
        for k, value in enumerate(values):
            low = a + k
            while stack and stack[-1][0] > value:
                length, low = stack.pop()
                high = a + k
                if change[high] != change[low]:
                    own = order[low : high + 1]
                    yield length, piece[own], start[own]
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, low))


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def _tree_scan(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Covers from the contexts of whole anchor groups, given in the order of the anchor."""

    def covers(rows: pa.Table) -> pa.RecordBatch:
        doc, part, row, begin = (rows[c].to_numpy() for c in ("doc", "part", "row", "start"))
        place = np.lexsort((begin, row, part, doc))
        rank = np.empty(len(place), dtype=np.int64)
        rank[place] = np.arange(len(place))
        got: list[tuple[np.ndarray, np.ndarray]] = []
        ends: list[np.ndarray] = []
        for length, piece, start in maximal_repeats(rows["text"].to_pylist(), size):
            first = np.lexsort((start, rank[piece]))[0]
            keep = np.arange(len(piece)) != first
            got.append((piece[keep], start[keep]))
            ends.append(start[keep] + length)
        if not got:
            piece = start = end = np.empty(0, dtype=np.int64)
        else:
            # Nested intervals cover the same bytes again and again: one row per stretch of a context.
            piece, start, end = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), np.concatenate(ends)
            wide = int(end.max()) + 1
            order = np.argsort(piece * wide + start, kind="stable")
            low, high = _merged((piece * wide + start)[order], (piece * wide + end)[order])
            piece, start, end = low // wide, low % wide, high - low // wide * wide
        return pa.RecordBatch.from_arrays(
            [pa.array(part[piece]), pa.array(row[piece]), pa.array((begin[piece] + start).astype(np.int32)), pa.array((begin[piece] + end).astype(np.int32))],
            names=["part", "row", "start", "end"],
        )

    def cover_all(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h = t["h"].to_numpy()
        at = 0
        while at < len(h):
            to = len(h) if len(h) - at <= 2 * SORTED else int(np.searchsorted(h, h[at + SORTED]))
            if to <= at:
                to = int(np.searchsorted(h, h[at], side="right"))
            yield covers(t.slice(at, to - at))
            at = to

    held: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        if many > SORTED:  # cut before the last anchor of what is held: its group may go on
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from cover_all(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                many = len(h) - cut
        held.append(batch)
        many += batch.num_rows
    if held:
        yield from cover_all(pa.Table.from_batches(held))


def _window_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).to_pylist()
        n = np.array([len(t) - size + 1 for t in text])
        of = np.repeat(np.arange(len(text)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = [xxhash.xxh3_128_digest(text[i][a : a + size]) for i, a in zip(of.tolist(), at.tolist(), strict=True)]
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy()[of] for c in ("doc", "part", "row", "start")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.binary()), *(pa.array(c) for c in cols[:3]), pa.array((cols[3] + at).astype(np.int32))],
            names=["key", "doc", "part", "row", "start"],
        )


def repeated_spans(
    docs: DataFrame, scratch: Scratch, *, size: int = 100, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD
) -> tuple[DataFrame, str]:
    """Spans ``part, row, start, end`` of bytes covered by strings that start earlier as well, a
    row with start -1 for each part, and the folder of the part files."""
    spark: SparkSession = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = scratch.path("texts")
    anchors = scratch.table(
        docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lambda it: _anchor_rows(it, uri, size), ANCHORS), "anchors"
    )
    marks = anchors.filter("start = -1").select("part", F.lit(-1).alias("row"), "start", F.lit(0).alias("end"))
    found = scratch.table(
        anchors.filter("start >= 0")
        .repartitionByRange(n, "h", "ctx", "doc", "row", "start")
        .sortWithinPartitions("h", "ctx", "doc", "part", "row", "start")
        .mapInArrow(lambda it: _sorted_scan(it, size), "kind int, h long, doc long, part int, row int, start int, end int"),
        "found",
    )
    onward = found.filter("kind = 1").drop("kind")
    fetched = scratch.table(
        onward.repartition(n, "part").sortWithinPartitions("part", "row", "start").mapInArrow(
            lambda it: _fetch(it, uri), "h long, doc long, part int, row int, start int, text binary"
        ),
        "contexts",
    )
    crowded = fetched.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("h")
    crowded = scratch.table(crowded.coalesce(1), "crowded")
    kinds = "part int, row int, start int, end int"
    covers = found.filter("kind = 0").select("part", "row", "start", "end")
    usual = fetched
    if not crowded.isEmpty():
        usual = fetched.join(crowded, "h", "left_anti")
        windows = fetched.join(crowded, "h", "left_semi").mapInArrow(
            lambda it: _window_rows(it, size), "key binary, doc long, part int, row int, start int"
        )
        windows = scratch.table(windows, "windows")
        place = F.struct("doc", "part", "row", "start")
        first = windows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        late = windows.join(first, "key").filter(place != F.col("first"))
        covers = covers.unionByName(late.select("part", "row", "start", (F.col("start") + size).cast("int").alias("end")))
    tree = usual.repartition(n, "h").sortWithinPartitions("h").mapInArrow(lambda it: _tree_scan(it, size), kinds)
    return covers.unionByName(tree).unionByName(marks), uri


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans given in the order of their starts."""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], np.maximum.reduceat(end, new)


def _cut(batches: Iterator[pa.RecordBatch], uri: str, with_text: bool) -> Iterator[pa.RecordBatch]:
    for part, rows in _by_part(batches):
        begin = int(np.searchsorted(rows["row"], 0))
        row, start, end = rows["row"][begin:], rows["start"][begin:].astype(np.int64), rows["end"][begin:].astype(np.int64)
        for base, batch in _part_texts(uri, part):
            out: list[tuple] = []
            at = np.searchsorted(row, np.arange(base, base + batch.num_rows + 1))
            for i, text in enumerate(batch.column(1).to_pylist()):
                a, b = at[i], at[i + 1]
                removed, spans, kept = 0, 0, text
                if b > a:
                    s, e = _merged(start[a:b], end[a:b])
                    removed, spans = int((e - s).sum()), len(s)
                    edges = [0, *np.column_stack([s, e]).ravel().tolist(), len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
            cols = list(zip(*out, strict=True))
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, mask=keys == NULL_KEY), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def remove_repeats(
    docs: DataFrame,
    scratch: Scratch,
    *,
    size: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    crowd: int = CROWD,
) -> DataFrame:
    """Each document without the bytes of strings of ``size`` bytes that start earlier as well.

    Earlier is a smaller key, or an earlier start in the same document; documents of one key are
    ordered by where they lie in the input. A null text counts as empty, a null key is the
    smallest. ``kept`` is the remaining text, without the halves of characters that were cut, if
    ``with_text``. Rows that repeat are returned as often; an empty table gives no rows.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans, uri = repeated_spans(docs, scratch, size=size, id_col=id_col, text_col=text_col, crowd=crowd)
    return spans.repartition(n, "part").sortWithinPartitions("part", "row", "start").mapInArrow(
        lambda it: _cut(it, uri, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )
