"""Papers, collections, tags, attachments, figures and saved searches, as folds of events and keyed rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import search
from quillspark.operators.numbering import numbered

SCHEMES = ("http", "https")


def fetchable(url: Column) -> Column:
    """Whether a url may be fetched: a known scheme, a host, no credentials in it."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)"
    host = F.regexp_extract(url, shape, 2)
    return F.coalesce(F.lower(F.regexp_extract(url, shape, 1)).isin(*SCHEMES) & (host != "") & ~F.contains(host, F.lit("@")), F.lit(False))


# ---------------------------------------------------------------- papers


def fold_papers(events: DataFrame) -> DataFrame:
    """Papers from their history: ``paper_id, metadata, citation_key, deleted_at``.

    ``events``: paper_id, seq, action (create, update, delete, restore), metadata (map), citation_key,
    at. Updates merge their keys into the metadata, later values win; the last delete or restore counts.
    """
    each = events.filter("metadata is not null").select("paper_id", "seq", F.explode("metadata").alias("k", "v"))
    last = each.groupBy("paper_id", "k").agg(F.max_by("v", "seq").alias("v"))
    data = last.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    toggles = F.when(F.col("action").isin("delete", "restore"), F.col("seq"))
    state = events.groupBy("paper_id").agg(
        F.max_by("citation_key", F.when(F.col("citation_key").isNotNull(), F.col("seq"))).alias("citation_key"),
        F.max_by(F.struct("action", "at"), toggles).alias("_t"),
    )
    out = state.join(data, "paper_id", "left")
    return out.withColumn("deleted_at", F.when(F.col("_t.action") == "delete", F.col("_t.at"))).drop("_t")


def citation_key_clashes(papers: DataFrame) -> DataFrame:
    """Citation keys of more than one live paper."""
    live = papers.filter("deleted_at is null and citation_key is not null")
    return live.groupBy("citation_key").agg(F.array_sort(F.collect_set("paper_id")).alias("papers")).filter(F.size("papers") > 1)


def audit_trail(before: DataFrame, after: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows that changed between two versions of a table, with both as JSON."""
    cols = [c for c in after.columns if c != key]
    b = before.select(key, F.to_json(F.struct(*cols)).alias("before_json"))
    a = after.select(key, F.to_json(F.struct(*cols)).alias("after_json"))
    j = b.join(a, key, "full_outer").filter(~F.col("before_json").eqNullSafe(F.col("after_json")))
    action = F.when(F.col("before_json").isNull(), "create").when(F.col("after_json").isNull(), "delete").otherwise("update")
    return j.withColumn("action", action).withColumn("at", at)


# ---------------------------------------------------------------- collections and tags


def add_links(links: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Links after adding; adding one twice changes nothing."""
    return links.unionByName(new.select(*links.columns)).dropDuplicates(list(keys))


def remove_links(links: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return links.join(gone.select(*keys), list(keys), "left_anti")


def listed(links: DataFrame, names: DataFrame, name_key: str) -> DataFrame:
    """Links with their names: both directions are a filter on it."""
    return links.join(names, name_key)


# ---------------------------------------------------------------- attachments and figures


def preferred(attachments: DataFrame) -> DataFrame:
    """Attachments of each paper in reading order: the preferred first, then the oldest; rank 1 is primary."""
    w = Window.partitionBy("paper_id").orderBy(F.desc(F.col("is_preferred").cast("int")), "created_at", "attachment_id")
    return attachments.withColumn("rank", F.row_number().over(w))


def set_preferred(attachments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Attachments after choosing some: a choice clears the flag of the paper's others."""
    c = chosen.select("paper_id", F.col("attachment_id").alias("_c"))
    j = attachments.join(c, "paper_id", "left")
    return j.withColumn("is_preferred", F.when(F.col("_c").isNotNull(), F.col("attachment_id") == F.col("_c")).otherwise(F.col("is_preferred"))).drop("_c")


def import_attachments(incoming: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New assets and attachments: the same bytes twice are one asset and two attachments."""
    named = incoming.withColumn("sha256", F.sha2("content", 256))
    fresh = named.dropDuplicates(["sha256"]).join(assets.select("sha256"), "sha256", "left_anti")
    return fresh.select("sha256", F.length("content").alias("size")), named.select("paper_id", "sha256", "role")


#: Rows that a task of a replacement sorts, about.
ROWS_A_TASK = 1_000_000


def replace_rows(stored: DataFrame, new: DataFrame, *scope: str) -> DataFrame:
    """Table after replacing all rows of the scopes that ``new`` has rows of."""
    return delete_rows(stored, new, *scope).unionByName(new.select(*stored.columns))


def delete_rows(stored: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Table without the rows of the keys that ``gone`` has. Both sides are dealt out by their rows: packed keys make a
    partition's bytes few, however many rows a task would sort."""
    parts = max(1, -(-max(stored.count(), gone.count()) // ROWS_A_TASK))
    return stored.repartition(parts, *keys).join(gone.select(*keys).repartition(parts, *keys), list(keys), "left_anti")


def figures_of(figures: DataFrame, **where) -> DataFrame:  # noqa: ANN003
    """Figures of a paper or an attachment, in page order, with their boxes parsed."""
    for k, v in where.items():
        figures = figures.filter(F.col(k) == v)
    return figures.withColumn("bbox", F.from_json("bbox_json", "array<double>")).orderBy("page", "figure_id")


def figure_search(figures: DataFrame, queries: DataFrame, papers: DataFrame) -> DataFrame:
    """Captions by any term, best first, then paper and page; figures of deleted papers never show."""
    own = search.live(figures, papers)
    post = search.postings(own, F.col("caption"), doc="figure_id")
    scored = search.bm25(post, search.query_terms(queries, F.col("q")), own.select(F.col("figure_id").alias("doc")), require_all=False)
    place = own.select(F.col("figure_id").alias("doc"), F.struct("paper_id", "page", "figure_id").alias("place"))
    return search.top(scored.join(place, "doc"), search.PAGE, tie="place")


# ---------------------------------------------------------------- saved searches


def save_search(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved searches after saving some; a name is kept once, its newest query counts."""
    w = Window.partitionBy("name").orderBy(F.desc("saved_at"))
    return saved.unionByName(new.select(*saved.columns)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def delete_search(saved: DataFrame, *names: str) -> DataFrame:
    """Saved searches without the named ones; a name that is not there changes nothing."""
    return saved.filter(~F.col("name").isin(*names)) if names else saved


def batches(ids: DataFrame, size: int, order: str) -> DataFrame:
    """Ids in numbered batches, for requests that take so many at once.

    Numbers are dense over all ids.
    """
    return numbered(ids, "batch", order).withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))


# ---------------------------------------------------------------- synthetic papers

VOCABULARY = "aspirin placebo cohort mortality sepsis insulin glucose renal cardiac stroke asthma cancer trial dose risk hazard survey model immune vaccine".split()


def synthetic_papers(spark: SparkSession, n: int) -> DataFrame:
    """Papers made from their numbers alone: the same at any number of partitions."""
    k = F.col("paper_id")
    words = F.array(*[F.lit(w) for w in VOCABULARY])
    pick = lambda m: F.element_at(words, (k * m % len(VOCABULARY) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("paper_id")).select(
        "paper_id", F.concat_ws(" ", pick(3), pick(7), pick(11), F.lit("study"), k.cast("string")).alias("title"), F.concat(F.lit("Journal "), (k % 17).cast("string")).alias("journal"),
        F.concat((1990 + k % 35).cast("string"), F.lit("-01")).alias("publication_date"), F.concat_ws(" ", *[pick(m) for m in (1, 3, 7, 9, 11, 13, 17, 19)]).alias("abstract"),
    )


def stem_table(words: DataFrame, column: str) -> DataFrame:
    """Each distinct word and its stem."""
    d = words.select(F.col(column).alias("word")).distinct()
    return d.withColumn("stem", F.try_element_at(T.terms(F.col("word"), True), F.lit(1)))
