"""Mixing sources to target weights by hierarchical budgets; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.columns import free_names
from quillspark.session import Scratch

#: Hexadecimal digits that name a slice of a leaf's hash order (4096 slices with three): only the
#: slice where the budget ends is ordered row by row.
DIGITS = 3
_SPACE = " \t\n\u000b\u000c\r"


def word_tokens(text: Column) -> Column:
    """Tokens of a text as the weights count them: white space marks and the last word; at least 1."""
    text = F.coalesce(text, F.lit(""))
    return (F.char_length(text) - F.char_length(F.translate(text, _SPACE, "")) + 1).cast("long")


def _fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Share ``budget`` of each parent among its children by ``weight``, none above its ``cap``.

    What a child cannot take goes to its siblings in proportion to their weights. With the
    children in the order of cap / weight, those before a point are full and the others share the
    rest at one level; the point is the first whose cap reaches that level.
    """
    order = [(F.col("cap") / F.col("weight")).asc(), *[F.col(c).asc() for c in children.columns if c in ("domain", "lang", "source")]]
    w = Window.partitionBy(*parent).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    whole = Window.partitionBy(*parent)
    at = children.withColumn("level", level).withColumn("reached", F.col("level") * F.col("weight") < F.col("cap"))
    at = at.withColumn("final", F.min(F.when(F.col("reached"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(whole))
    share = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("final.level") * F.col("weight"))))
    return at.withColumn("share", share.cast("long")).drop("level", "reached", "final")


def budgets(leaves: DataFrame, *, fraction: float, temperature: float) -> DataFrame:
    """Budget of each ``domain, lang, source`` leaf given as ``tokens`` and ``cap``.

    The weight of a node is the size of what is below it to the power of ``temperature``, so
    small domains, languages and sources get more than their part. Budgets go down the tree: a
    shortage is made up by siblings first, and only what a whole branch cannot take is left to
    the branch's own siblings, since a branch's cap is the sum of its leaves' caps.
    """
    langs = leaves.groupBy("domain", "lang").agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"))
    weigh = F.pow(F.col("tokens").cast("double"), F.lit(temperature))
    rooted = domains.withColumn("root", F.lit(0)).withColumn("weight", weigh)
    total = F.floor(F.sum("tokens").over(Window.partitionBy("root")) * F.lit(fraction))
    top = _fill(rooted.withColumn("budget", total.cast("double")), ["root"])
    mid = langs.join(top.select("domain", F.col("share").cast("double").alias("budget")), "domain").withColumn("weight", weigh)
    mid = _fill(mid, ["domain"])
    low = leaves.join(mid.select("domain", "lang", F.col("share").cast("double").alias("budget")), ["domain", "lang"]).withColumn("weight", weigh)
    return _fill(low, ["domain", "lang"]).select("domain", "lang", "source", "tokens", "cap", "share")


def _identity(id_col: str, text_col: str, domain: Column | None) -> dict[str, Column]:
    """What a row is to the mixing: key, leaf and size; rows that agree in all of them are taken alike."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    if domain is None:  # two-level names: the last digit of a source's number stands for its domain
        domain = F.concat(F.lit("domain"), F.pmod(F.coalesce(F.nullif(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("")), F.lit("0")).cast("int"), F.lit(4)))
    return {
        "doc_id": F.col(id_col).cast("long"),
        "domain": domain,
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "source": source,
        "n_tokens": word_tokens(F.col(text_col)),
    }


def mix(
    docs: DataFrame,
    scratch: Scratch,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Column | None = None,
    temperature: float = 0.7,
    epochs: int = 2,
    fraction: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """How often each document is taken: ``doc_id, domain, lang, source, n_tokens, epochs``.

    A leaf's budget is taken from seeded epochs: whole passes over the leaf, then a prefix of the last
    pass in its seeded order, up to the document in whose first half the budget ends; so a leaf misses
    its budget by half a document at most, to either side. A leaf is cut
    into slices of its hash order; slices are summed before rows are, and only the slice where
    the budget ends is ordered, so a source with a third of all rows needs no task for itself.
    The total budget is ``fraction`` of all tokens; a leaf gives at most ``epochs`` passes.

    Nulls in lang or source are a group of their own (empty string); a null text has one token;
    repeated rows are taken alike; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(*[c.alias(name) for name, c in _identity(id_col, text_col, domain).items()])
    rows = scratch.table(rows, "rows")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * epochs)
    shares = budgets(leaves, fraction=fraction, temperature=temperature)
    plan = scratch.table(
        shares.select(
            *leaf,
            F.floor(F.col("share") / F.col("tokens")).cast("int").alias("passes"),
            (F.col("share") - F.floor(F.col("share") / F.col("tokens")) * F.col("tokens")).alias("rest"),
        ).coalesce(1),
        "plan",
    )
    # A row per leaf: a few hundred, however many documents; joined by key, not broadcast by force.
    keyed = rows.join(plan, leaf).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "passes", "doc_id", "n_tokens")))
    keyed = keyed.withColumn("slice", F.substring("h", 1, DIGITS))
    sums = keyed.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("in_slice"))
    before = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
    placed = keyed.join(sums, [*leaf, "slice"])
    edge = (F.col("base") <= F.col("rest")) & (F.col("base") + F.col("in_slice") > F.col("rest"))
    inside = Window.partitionBy(*leaf, "slice").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ended = placed.filter(edge).withColumn("upto", F.col("base") + F.sum("n_tokens").over(inside)).withColumn("more", 2 * F.col("upto") - F.col("n_tokens") <= 2 * F.col("rest")).drop("upto")
    others = placed.filter(~edge).withColumn("more", F.col("base") + F.col("in_slice") <= F.col("rest"))
    return others.unionByName(ended).select(
        "doc_id", *leaf, "n_tokens", (F.col("passes") + F.col("more").cast("int")).cast("int").alias("epochs")
    )


def apply(
    docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, **options  # noqa: ANN003
) -> DataFrame:
    """The mixed documents: a row for each epoch that takes a document, none for those left out.

    Rows are told apart by key, leaf and size, so rows that share a key, or have none, are taken at the rate of their own
    leaf; those that agree in all three are taken alike. An empty table gives no rows; columns of any name are kept as they are.
    """
    identity = _identity(id_col, text_col, domain)
    names = free_names(docs, 2 * len(identity) + 2)
    own, other = (dict(zip(identity, names[k * len(identity) :], strict=False)) for k in (0, 1))
    times, epoch = names[-2:]
    taken = mix(docs, scratch, id_col=id_col, text_col=text_col, domain=domain, **options)
    taken = taken.groupBy(*[F.col(c).alias(name) for c, name in other.items()]).agg(F.max("epochs").alias(times)).filter(F.col(times) > 0)
    same = F.col(own["doc_id"]).eqNullSafe(F.col(other["doc_id"]))
    for c in list(identity)[1:]:
        same = same & (F.col(own[c]) == F.col(other[c]))
    keyed = docs.withColumns({own[c]: column for c, column in identity.items()})  # computed once, where the texts are read
    return keyed.join(taken, same).withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
