"""I-Match fingerprints over randomised parts of a mid-frequency lexicon; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import Scratch

#: The band of document frequencies, as parts of all documents, whose terms count. A document
#: has some hundred distinct terms, so at most (that number / LOW) terms can be in the band,
#: however large the corpus.
LOW, HIGH = 0.002, 0.25
#: Terms of the lexicon, and groups of equal texts, up to which they are sent to every task; more are joined by their hash.
SENT = 500_000
#: Of a document's terms at or above the band, the part that its fingerprint has at least, and the
#: least number. Where the band gives less, its terms nearest above the band are added: near copies
#: that are many enough to lift their common terms out of the band would share nothing otherwise.
PART, LEAST = 4, 4
#: Scales of lexicon subsets: of so many random parts of the lexicon, PER_SCALE are used. Fine
#: parts suit long documents, coarse ones short documents.
SCALES, PER_SCALE = (16, 64, 256, 1024), 16
NULL_KEY = -(2**63)
_SPACE = "\t\n\u000b\u000c\r"


def _terms(text: Column) -> Column:
    return F.split(F.lower(F.translate(text, _SPACE, " " * len(_SPACE))), " ")


def lexicon(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``word_hash, above, digest`` (56 bits of the md5) of the terms in the band, and with their document frequency in
    ``above`` those of higher frequency, at most (terms of a document / HIGH).

    Frequencies are over distinct texts, so copies, few or many, move no term: of equal texts the row of the least key
    counts, once if it is repeated. Only hashes move, and the texts that more than SENT groups of copies would need.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    rows = texts.groupBy("h", "key").agg(F.count(F.lit(1)).alias("same"))
    groups = rows.groupBy("h").agg(F.sum("same").alias("rows"), F.min(F.struct("key", "same")).alias("least"))
    copied = F.col("rows") > 1
    n, sent, repeated = groups.agg(F.count(F.lit(1)), F.count_if(copied) <= SENT, F.coalesce(F.max("least.same"), F.lit(0)) > 1).first()
    copies = groups.filter(copied).select("h", F.col("least.key").alias("first"), (F.col("least.same") > 1).alias("again"))
    own = texts.join(F.broadcast(copies) if sent else copies, "h", "left").filter(F.col("first").isNull() | (F.col("first") == F.col("key")))
    if repeated:  # rows that share key and text
        again = F.coalesce("again", F.lit(False))
        own = own.filter(~again).unionByName(own.filter(again).dropDuplicates(["h"]))
    return (
        own.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("word"))
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
        .filter(F.col("df") >= max(2, low * n))
        .select(
            F.xxhash64("word").alias("word_hash"),
            F.when(F.col("df") > max(2, high * n), F.col("df")).otherwise(F.lit(0)).alias("above"),
            F.conv(F.substring(F.md5("word"), 1, 14), 16, 10).cast("long").alias("digest"),
        )
    )


def _entries(digests: Column) -> Column:
    """Subset (the upper bits) and digest of terms: of each scale one part, by its own 14 bits of the digest, if that part is used."""

    def places(m: Column) -> Column:
        parts = [F.shiftright(m, 14 * k).bitwiseAND(s - 1) for k, s in enumerate(SCALES)]  # the scales are powers of two
        return F.array_compact(F.array(*[F.when(p < PER_SCALE, F.shiftleft(p + k * PER_SCALE, 56).bitwiseOR(m)) for k, p in enumerate(parts)]))

    return F.sort_array(F.flatten(F.transform(digests, places)))


def _chosen(terms: Column) -> Column:
    """Of a document's sorted terms (above, digest) those in the band; where they are few, the terms nearest above it as well."""
    inside = F.size(F.filter(terms, lambda x: x["above"] == 0))
    return F.slice(terms, F.lit(1), F.greatest(inside, F.lit(LEAST), F.ceil(F.size(terms) / PART).cast("int")))["digest"]


def _fingerprint(digests: Column) -> Column:
    """Subsets and their hashes, as strings of two and eight digits: the distinct terms of each subset are sorted by
    digest and hashed together, so order and repeats don't count."""
    none = F.expr("cast(array() as array<string>)")

    def closed(state: Column) -> Column:
        hashed = F.concat(F.lpad(state["subset"].cast("string"), 2, "0"), F.substring(F.md5(state["said"]), 1, 8))
        return F.when(state["subset"] < 0, state["out"]).otherwise(F.array_append(state["out"], hashed))

    def step(state: Column, entry: Column) -> Column:
        subset, said = F.shiftright(entry, 56).cast("int"), entry.bitwiseAND((1 << 56) - 1).cast("string")
        more = F.struct(subset.alias("subset"), F.concat(state["said"], F.lit(","), said).alias("said"), state["out"].alias("out"))
        return F.when(state["subset"] == subset, more).otherwise(F.struct(subset.alias("subset"), said.alias("said"), closed(state).alias("out")))

    zero = F.struct(F.lit(-1).alias("subset"), F.lit("").alias("said"), none.alias("out"))
    return F.aggregate(_entries(digests), zero, step, closed)


def fingerprint_texts(texts: DataFrame, keys: list[str], columns: list[str], terms: DataFrame, *, sent: bool = True) -> DataFrame:
    """One row per key with terms in the lexicon, and for each text column its fingerprint
    (``_fingerprint``) under the column's name, null without any term."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.array_distinct(_terms(F.col(c))).alias("words")) for k, c in enumerate(columns)]))
    words = texts.select(*keys, each.alias("x")).select(*keys, "x.which", F.explode("x.words").alias("word")).filter("word <> ''")
    known = words.select(*keys, "which", F.xxhash64("word").alias("word_hash")).join(F.broadcast(terms) if sent else terms, "word_hash")
    own = [F.collect_list(F.when(F.col("which") == k, F.struct("above", "digest"))).alias(c) for k, c in enumerate(columns)]
    found = known.groupBy(*keys).agg(*own)
    # Each step uses its input more than once, so the steps are kept apart.
    for of in (F.sort_array, _chosen, _fingerprint, lambda fp: F.when(F.size(fp) > 0, fp)):
        found = found.select(*keys, *[of(F.col(c)).alias(c) for c in columns])
    return found


def likeness(a: Column, b: Column) -> Column:
    """Part of the subsets with a term on either side on which two fingerprints agree."""
    subset = lambda x: F.substring(x, 1, 2)
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(F.transform(a, subset), F.transform(b, subset)))


def _text_of(fp: Column) -> Column:
    """All subsets in order, a dash for those without a term."""
    subset = lambda x: F.substring(x, 1, 2).cast("int")
    step = lambda st, x: F.struct(subset(x).alias("at"), F.concat(st["out"], F.repeat(F.lit("-"), subset(x) - st["at"] - 1), F.substring(x, 3, 8)).alias("out"))
    every = len(SCALES) * PER_SCALE
    return F.aggregate(fp, F.struct(F.lit(-1).alias("at"), F.lit("").alias("out")), step, lambda st: F.concat(st["out"], F.repeat(F.lit("-"), F.lit(every - 1) - st["at"])))


def _numbers(values: list[int]) -> Column:
    """An array as one constant, however many numbers it has; it is folded, so equal plans stay equal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.expr("cast(array() as array<bigint>)")


def _in_buckets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in ranges of the key, each range followed by the row that comes after it.

    Ranges are cut at approximate quantiles of the keys, so their sizes are alike; a handful of
    numbers per range is all that the driver sees. Rows run from the largest key to the least;
    ``halo`` marks the copy of the first row of the following range, and in the last range of
    the first row of all. Null keys come last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ranges = 4 * n
    cuts = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda c: c < F.col("key")
    skip = F.size(F.filter(_numbers(cuts[step - 1 :: step]), below)) * step
    rows = rows.withColumn("bucket", skip + F.size(F.filter(F.slice(_numbers(cuts), skip + 1, F.lit(step)), below)))
    first = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.max("key").alias("first")).collect()}
    order = sorted(first, reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    firsts = _numbers([first.get(b, 0) for b in range(len(cuts) + 1)])  # ranges without rows are never asked for
    targets = _numbers([before.get(b, 0) for b in range(len(cuts) + 1)])
    # Never null, so that no plan filters it before the exchange, which both branches of a plan then share.
    own = F.struct(F.coalesce("bucket", F.lit(0)).alias("bucket"), F.lit(False).alias("halo"))
    halo = F.struct(F.coalesce(targets[F.col("bucket")].cast("int"), F.lit(0)).alias("bucket"), F.lit(True).alias("halo"))
    places = F.when(F.col("key") == firsts[F.col("bucket")], F.array(own, halo)).otherwise(F.array(own))
    return rows.select("key", "text", F.explode(places).alias("at")).select("key", "text", "at.bucket", "at.halo").repartition(n, "bucket")


def compare(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half replaced by the start of the next document's, in
    descending order of the key. Texts move once, in an exchange that the plan's two branches share
    (both read the same columns of it); everything after that stays in the task
    that holds the range. A null text counts as empty; null keys come last; equal keys are
    ordered by text; texts without a lexicon term have the hash of the text as fingerprint and
    are alike only if equal; an empty table gives no rows; other columns are ignored.
    """
    terms = scratch.table(lexicon(docs, id_col=id_col, text_col=text_col), "lexicon")
    sent = terms.count() <= SENT
    in_order = Window.partitionBy("bucket").orderBy("halo", F.desc("key"), F.desc(F.xxhash64("text")), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        _in_buckets(docs, id_col, text_col)
        .withColumn("rn", F.row_number().over(in_order))
        .withColumn("next", F.lead("text").over(in_order))
        .withColumn("n_chars", F.char_length("text"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next", F.lit(1), half)))
        .withColumn("edited", F.coalesce("edited", F.lit("")))
    )
    fps = fingerprint_texts(rows, ["bucket", "rn"], ["text", "edited"], terms, sent=sent).withColumnsRenamed({"text": "fp", "edited": "fp_edited"})
    by_row = Window.partitionBy("bucket").orderBy("rn")
    out = (
        rows.select(
            "bucket", "rn", "halo", F.nullif("key", F.lit(NULL_KEY)).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            F.md5("text").alias("whole"), F.md5("edited").alias("whole_edited"),
        )
        .join(fps, ["bucket", "rn"], "left")
        .withColumn("fp_next", F.lead("fp").over(by_row))
        .withColumn("whole_next", F.lead("whole").over(by_row))
        .filter(~F.col("halo"))
    )

    def near(a: str, whole_a: str, b: str, whole_b: str) -> Column:
        alike = F.when(F.col(whole_a) == F.col(whole_b), F.lit(1.0)).when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.0))
        return alike.otherwise(likeness(F.col(a), F.col(b)))

    def shown(fp: str, whole: str) -> Column:
        return F.when(F.col(fp).isNull(), F.substring(whole, 1, 16)).otherwise(_text_of(F.col(fp)))

    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("fp", "whole").alias("fingerprint"),
        shown("fp_edited", "whole_edited").alias("edited_fingerprint"),
        near("fp", "whole", "fp_edited", "whole_edited").alias("near_edited"),
        near("fp", "whole", "fp_next", "whole_next").alias("near_next"),
    )
