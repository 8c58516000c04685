"""Secret scans with corpus-wide ownership frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.columns import free_names
from quillspark.session import Scratch

# The kinds in their order, their patterns, the group that holds the secret
# and the least number of characters that this group needs.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
}
GROUPS = {"assign": 2, "access": 0, "hex": 0}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Candidates without a keyword or prefix: long runs that have both letters and digits.
GENERIC = "[A-Za-z0-9+/_-]{24,}"
#: A value that this many owners or more share is a copied example, not somebody's secret.
EXAMPLE_OWNERS = 3
#: A value that more than this part of all candidates share is joined to its counts by broadcast: there are at most 1 / HOT of them.
HOT = 0.001
#: Spans to mask, over the corpus, up to which they are sent to every task.
SENT = 500_000
_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"


def _parts(text: Column, pattern: str) -> Column:
    """The text cut before each match; every part but the first begins with a match and its end mark.

    The two marks are control characters that no pattern can match; where a text has them, they are
    first replaced by another one of the same length, so places stay.
    """
    cut = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)
    return F.when(text.rlike(pattern), cut).otherwise(F.array(text))  # most texts have no match: none is built for them


def _measured(parts: str, order: int) -> Column:
    """Number, match and length of each part of a cut text; none where nothing matched."""

    def measure(part: Column, i: Column) -> Column:
        match = F.when(i > 0, F.substring_index(part, _CLOSE, 1))
        return F.struct(F.lit(order).alias("ord"), i.alias("i"), match.alias("match"), (F.char_length(part) - (i > 0).cast("int")).alias("n"))

    none = F.expr("cast(array() as array<struct<ord:int,i:int,match:string,n:int>>)")
    return F.when(F.size(parts) > 1, F.transform(parts, measure)).otherwise(none)


def _value(match: Column, kind: str) -> Column:
    group = GROUPS.get(kind, 0)
    return F.regexp_extract(match, PATTERNS[kind], group) if group else match


def candidates(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """Every row (``rid, doc_id, text_hash, owner, repository``) and every span (``rid, ord, start, end, kind, value``).

    One pass over the texts cuts them before each match and keeps the matches and the lengths of the parts. Places
    are running sums over a row's parts, and overlaps come from a running maximum over its spans, so the
    time of a text with very many matches grows in proportion to it.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _OPEN + _CLOSE, _OTHER + _OTHER)
    kinds = (*KINDS, "generic")
    cut = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        owner.alias("owner"),
        repository.alias("repository"),
        text.alias("text"),
    )
    for kind in kinds:
        cut = cut.withColumn(f"p_{kind}", _parts(F.col("text"), PATTERNS.get(kind, GENERIC)))
    parts = F.concat(*[_measured(f"p_{kind}", k) for k, kind in enumerate(kinds)])
    cut = scratch.table(cut.select("rid", "doc_id", "text_hash", "owner", "repository", parts.alias("parts")), "cut")
    before = Window.partitionBy("rid", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        cut.filter("size(parts) > 0").select("rid", F.explode("parts").alias("p")).select("rid", "p.*")
        .withColumn("start", F.sum("n").over(before).cast("int")).filter("i > 0")
        .select("rid", "ord", "start", (F.col("start") + F.char_length("match")).alias("end"), "match")
    )
    value = F.lit(None).cast("string")
    kind_name = F.lit("generic")
    good = F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]")
    for k, kind in enumerate(KINDS):
        mine = F.col("ord") == k
        value, kind_name = F.when(mine, _value(F.col("match"), kind)).otherwise(value), F.when(mine, F.lit(kind)).otherwise(kind_name)
        good = F.when(mine, F.char_length(_value(F.col("match"), kind)) >= LEAST[kind]).otherwise(good)
    value = F.coalesce(value, "match")
    found = placed.filter(good).select("rid", "ord", "start", "end", kind_name.alias("kind"), value.alias("value"))
    # A generic span overlaps a base span if, of the base spans that start before its end, the last end is behind its start.
    generic = F.col("ord") == len(KINDS)
    upto = Window.partitionBy("rid").orderBy(F.when(generic, F.col("end")).otherwise(F.col("start")), F.when(generic, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("reach", F.max(F.when(~generic, F.col("end"))).over(upto)).filter(~generic | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    return cut.drop("parts"), scratch.table(found.drop("reach"), "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(
    docs: DataFrame,
    scratch: Scratch,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
) -> DataFrame:
    """Secrets of every row, with what the whole corpus says about who uses each value.

    Owners default to ``source`` and repositories to ``source/lang``; a null counts as one
    owner of its own. Every candidate's hash is counted by distinct repositories and owners
    (pairs first, so a value in a third of all rows is combined before it moves). A value of
    ``EXAMPLE_OWNERS`` owners or more is a widely copied example, others look live; a live-looking
    one in several repositories of its owners is in use across them (``n_spread``), one in a single repository is not. Spans by
    pattern stay whatever their class; long runs of letters and digits without a keyword are added where they
    look live and overlap no other span.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_spread,
    live`` (array of start and end of live-looking spans), ``text_hash`` and ``rid``, one row per
    input row. A null text counts as empty; a null
    key stays null; rows that repeat are returned as often; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    owner = F.coalesce((F.col("source") if owner is None else owner).cast("string"), F.lit(""))
    if repository is None:
        repository = F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit("")))
    rows, spans = candidates(docs, scratch, id_col=id_col, text_col=text_col, owner=owner, repository=repository)
    each = scratch.table(
        spans.join(rows.select("rid", "owner", "repository"), "rid")
        .select("rid", "owner", "repository", F.sha2("value", 256).alias("hash"), F.struct("start", "ord", "end", "kind").alias("s")),
        "each",
    )
    used = scratch.table(
        each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n")),
        "used",
    )
    total = used.agg(F.sum("n")).first()[0] or 0
    hot = used.filter(F.col("n") > HOT * total)  # 1 / HOT rows at most, so no task gets all rows of one value
    judged = (
        each.join(F.broadcast(hot), "hash")
        .unionByName(each.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(used.filter(F.col("n") <= HOT * total), "hash"))
        .withColumn("live", F.col("owners") < EXAMPLE_OWNERS)
        .groupBy("rid")
        .agg(
            F.array_sort(F.collect_list(F.when((F.col("s.ord") < len(KINDS)) | F.col("live"), F.col("s")))).alias("all"),
            F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("s.start", "s.end")))).alias("live"),
            *[F.count_if(F.col("s.ord") == k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
            F.count_if("live").alias("n_live"),
            F.count_if(~F.col("live")).alias("n_example"),
            F.count_if(F.col("live") & (F.col("repositories") > 1)).alias("n_spread"),
        )
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    base = F.filter("all", lambda x: x["ord"] < len(KINDS))
    counts = [*[f"n_{k}" for k in KINDS], "n_live", "n_example", "n_spread"]
    return rows.select("rid", "doc_id", "text_hash").join(judged, "rid", "left").select(
        "rid",
        "doc_id",
        "text_hash",
        F.sha2(F.coalesce(_joined(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("live", none).alias("live"),
    )


def redact(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every live-looking secret replaced by a mask; all rows stay, and
    ``n_chars``, where there is one, follows the text.

    Each row's own text is cut at its spans, merged where they overlap, and the pieces are joined with the mask. The
    spans reach their row by key and text hash; equal rows have equal spans. Null texts and texts without such a
    secret stay as they are; an empty table gives no rows; columns of any name are kept as they are.
    """
    cols = docs.columns
    own_id, own_hash, own_live = free_names(docs, 3)
    spans = scan(docs, scratch, id_col=id_col, text_col=text_col).filter("size(live) > 0").select("doc_id", "text_hash", "rid", F.explode("live").alias("s"))
    # Overlapping spans become one: a span begins one if no earlier span reaches behind its start.
    earlier = Window.partitionBy("rid").orderBy("s.start", "s.end").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("rid").orderBy("s.start", "s.end").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        spans.withColumn("new", F.coalesce(F.col("s.start") >= F.max("s.end").over(earlier), F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(whole))
        .groupBy("rid", "run").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.min("s.start").alias("start"), F.max("s.end").alias("end"))
        .groupBy("rid").agg(F.min("doc_id").alias(own_id), F.min("text_hash").alias(own_hash), F.array_sort(F.collect_list(F.struct("start", "end"))).alias(own_live))
    )
    hit = scratch.table(merged.drop("rid").dropDuplicates([own_id, own_hash]), "hit")
    size = hit.agg(F.sum(F.size(own_live) + 4)).first()[0] or 0
    hit = F.broadcast(hit) if size <= SENT else hit  # texts stay where they are while few have secrets
    # The text between two spans, by place: what is before the first span, between each and the next, and behind the last.
    pieces = F.transform(
        F.arrays_zip(
            F.concat(F.array(F.lit(0)), F.col(own_live)["end"]).alias("from"), F.concat(F.col(own_live)["start"], F.array(F.char_length(text_col))).alias("upto")
        ),
        lambda z: F.substring(F.col(text_col), z["from"] + 1, z["upto"] - z["from"]),
    )
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash))
    out = docs.join(hit, same, "left")
    out = out.withColumn(text_col, F.when(F.col(own_live).isNull(), F.col(text_col)).otherwise(F.array_join(pieces, mask)))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col(own_live).isNull(), F.col("n_chars")).otherwise(F.char_length(text_col).cast("long")))
    return out.select(*cols)


__all__ = ["EXAMPLE_OWNERS", "KINDS", "candidates", "redact", "scan"]
