"""How far sources of one language diverge in their use of terms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import Scratch

#: Documents of a language from which it keeps a term, and the count that each kept term has besides its own.
LEAST, PRIOR = 30, 5
#: Probabilities are whole numbers of this unit.
UNIT = 1_000_000_000
#: Ranks of the part ``term``.
TERMS = 50
#: Groups (language, source) up to which a row for each is sent to every task.
SENT = 200_000
#: Parts of a language's groups that meet apart, so that no task has all pairs of a language.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _share(count: Column | str, total: str, terms: str) -> Column:
    """``1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms))``, in whole numbers of 38 digits."""
    count = F.col(count) if isinstance(count, str) else count
    up = (count + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    down = (F.col(total) + PRIOR * F.col(terms)).cast("decimal(20,0)")
    return F.call_function("div", up, down) + 1


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group, and documents with it. Terms are counted within
    the row first, so a row is made for each distinct term of a document and partial sums are shuffled."""
    said = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    rows = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"), F.sort_array(said).alias("said"))
    starts = F.array_compact(F.transform("said", lambda x, i: F.when((i == 0) | (F.get(F.col("said"), i - 1) != x), i)))
    rows = rows.select("lang", "source", "said", starts.alias("starts"))
    runs = F.transform(
        "starts", lambda s, j: F.struct(F.get(F.col("said"), s).alias("term"), (F.coalesce(F.get(F.col("starts"), j + 1), F.size("said")) - s).cast("long").alias("n"))
    )
    each = rows.select("lang", "source", F.explode(runs).alias("x")).select("lang", "source", "x.term", "x.n")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def _sent(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SENT else small


def pair_distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, other, value`` for each two sources of a language, both ways.

    ``postings``: ``lang, source, term, p``, terms that occur in the group; ``groups``: ``lang, source, zero, terms``, all
    groups with the share of a term that does not occur and the number of the language's terms.

    Where neither source has a term, both are at their baseline, so a pair starts with the number of terms times the
    difference f of the baselines, and only postings correct it:

    * a term of s alone counts |p_s - zero_t| instead of f. Summed over all terms of s that is a piecewise linear
      function of zero_t, read from running sums over the shares of s in order, in which the baselines of the others
      take their places; no term of s meets a source;
    * a term of both counts |p_s - p_t| where the two sums above gave |p_s - zero_t| + |p_t - zero_s| - f.
    """
    spread = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_other"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = spread.join(others, ["lang", "salt"]).filter(F.col("source") != F.col("other")).select("lang", "source", "other", "zero", "zero_other", "terms")

    shares = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    line = shares.select("lang", "source", F.col("p").alias("at"), "n", none.alias("other")).unionByName(
        pairs.select("lang", "source", F.col("zero_other").alias("at"), F.lit(0).cast("long").alias("n"), "other")
    )
    # Shares equal to a baseline add nothing to its distance, so ties may fall on either side.
    upto = Window.partitionBy("lang", "source").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum("n").over(upto).alias("n_low"), F.sum(F.col("n") * F.col("at")).over(upto).alias("low")]
    totals = shares.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("p")).alias("all"))
    read = line.select("lang", "source", "other", "at", *sums).filter("other is not null").join(totals, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    n_all, all_ = F.coalesce("n_all", zero), F.coalesce("all", zero)
    alone = read.select(
        "lang", "source", "other", (F.col("at") * F.col("n_low") - F.col("low") + all_ - F.col("low") - F.col("at") * (n_all - F.col("n_low"))).alias("alone"), n_all.alias("n_own")
    )

    ends = postings.join(groups.select("lang", "source", "zero"), ["lang", "source"])
    a = ends.select("lang", "term", "source", F.col("p").alias("pa"), F.col("zero").alias("za"))
    b = ends.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    both = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("other"))
    fix = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zb")) - F.abs(F.col("pb") - F.col("za")) + F.abs(F.col("za") - F.col("zb"))
    both = both.groupBy("lang", "source", "other").agg(F.sum(fix).alias("fix"))

    half = pairs.filter(F.col("source") < F.col("other"))
    back = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("alone").alias("alone_b"), F.col("n_own").alias("n_b"))
    of = ["lang", "source", "other"]
    met = half.join(alone, of).join(back, of).join(both, of, "left")
    f = F.abs(F.col("zero") - F.col("zero_other"))
    value = F.col("terms") * f + F.col("alone") - F.col("n_own") * f + F.col("alone_b") - F.col("n_b") * f + F.coalesce("fix", zero)
    met = met.select("lang", "source", "other", value.alias("value"))
    ways = F.explode(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other"))))
    return met.select("lang", "value", ways.alias("x")).select("lang", "x.source", "x.other", "value")


def audit(docs: DataFrame, scratch: Scratch, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of each source from the others of its language (part ``pair``),
    and the terms that it uses more than the language does (part ``term``, ``terms`` of them).

    A term is a run of letters (beyond ASCII: of any characters), only A-Z lower-cased. A language keeps the terms that
    ``least`` of its documents have. Null texts, languages and sources count as empty strings, which are a language and a
    source of their own; each row is a document, so repeated rows count each; a group without terms has all terms
    at its baseline; a language without kept terms has pairs of value 0 and no ``term`` rows; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counts = scratch.table(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= least).drop("docs")
    held = scratch.table(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "held")
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = held.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "total_lang")])
    base = F.when(F.col("terms") > 0, _share(zero, "total", "terms")).otherwise(zero)
    groups = scratch.table(groups.withColumn("zero", base), "groups")
    small = _sent(groups, groups.count())
    shares = held.join(small, ["lang", "source"])
    shares = shares.select("lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("n_lang", "total_lang", "terms").alias("q"))
    shares = scratch.table(shares, "shares")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = ["lang", "source", "part", "item", "value", F.row_number().over(ranked).alias("rank")]
    pairs = pair_distances(shares.drop("q"), groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.select(*named).unionByName(above.select(*named).filter(F.col("rank") <= terms))
