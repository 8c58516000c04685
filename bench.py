"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``index_rebuild`` and ``chunk_index`` build their tables anew; the searches run warm over the built
index, the median of three runs. The others are catalog queries, run once after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

REPO = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillspark.functions.text import analyze_text  # noqa: E402
from quillspark.operators import search  # noqa: E402
from quillspark.plans import catalog  # noqa: E402
from quillspark.plans.adapters import entity  # noqa: E402
from quillspark.session import Scratch, ship_package  # noqa: E402

D = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CATALOG = ("a_facet_counts", "a_funnel", "a_resolve_verdicts", "a_stage_rollup", "d_doctor", "j_semi", "v_assemble", "v_verify_spans", "w_change_feed", "w_last_per_task", "x_similar")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    ship_package(spark)
    scratch = Scratch(spark, "bench")
    papers = scratch.table(entity(spark, D, "papers").repartition(int(CPUS)), "papers")
    sources = entity(spark, D, "sources").withColumn("content_hash", F.sha2("text", 256))
    took: dict[str, float] = {}

    def timed(name: str, run, runs: int = 1) -> None:  # noqa: ANN001
        each = []
        for _ in range(runs + 1):  # the first run compiles
            t = time.perf_counter()
            run()
            each.append(time.perf_counter() - t)
        took[name] = round(statistics.median(each[1:]), 4)

    metadata = F.concat_ws(" ", "title", "journal", "lang", "source")
    timed("index_rebuild", lambda: scratch.table(search.postings(papers, metadata, doc="paper_id", stem=True), "metadata"))
    # The table is one file, so its texts are dealt to the cores first, within the time.
    timed("chunk_index", lambda: scratch.table(search.chunk_table(sources.repartition(int(CPUS))).withColumn("doc", F.concat_ws("#", "source_id", "start")), "chunks"))
    chunks = spark.read.parquet(scratch.path("chunks")).cache()
    timed("chunk_postings", lambda: scratch.table(search.postings(chunks, F.col("text"), doc="doc").repartitionByRange(int(CPUS), "term", "doc").sortWithinPartitions("term"), "chunk_postings"))
    meta, post = spark.read.parquet(scratch.path("metadata")).cache(), spark.read.parquet(scratch.path("chunk_postings")).cache()
    ids, cids = papers.select(F.col("paper_id").alias("doc")).cache(), chunks.select("doc").cache()
    for df in (chunks, meta, post, ids, cids):
        df.count()

    # Corpus statistics belong to an index: one row each, written with it.
    known = {id(meta): scratch.table(search.corpus_stats(meta, ids), "meta-stats").cache(), id(post): scratch.table(search.corpus_stats(post, cids), "post-stats").cache()}

    def keyword(words: str, stem: bool, table, docs, require_all: bool, keep=None):  # noqa: ANN001, ANN202
        own = list(dict.fromkeys(analyze_text(words) if stem else words.split()))
        q = spark.createDataFrame([(1, w) for w in own], "query int, term string")
        keep = None if keep is None else keep.select(F.col("paper_id").alias("doc"))
        scored = search.bm25(table, q, docs, require_all=require_all, stats=known[id(table)], keep=keep, words=own)
        return scored.orderBy(F.desc("score"), "doc").limit(20).collect()

    years, journal = search.filter_papers(papers, years=(2000, 2010)), search.filter_papers(papers, journal="src1")
    timed("keyword_common", lambda: keyword("the journal", True, meta, ids, True), 3)
    timed("keyword_year", lambda: keyword("the journal", True, meta, ids, True, years), 3)
    timed("keyword_journal", lambda: keyword("the journal", True, meta, ids, True, journal), 3)
    timed("filtered_listing", lambda: search.listing(years, 20).collect(), 3)
    timed("chunk_bm25_any", lambda: keyword("the thing then", False, post, cids, False), 3)
    timed("chunk_all_terms", lambda: search.matching_all(post, ["the", "and", "of"]).count(), 3)
    for name in CATALOG:
        timed(name, lambda n=name: catalog.QUERIES[n](spark, D).write.format("noop").mode("overwrite").save())
    scratch.close()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(D.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
