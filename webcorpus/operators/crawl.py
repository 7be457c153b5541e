"""Breadth-first link expansion over stored pages (JON1-3, SET3, TOP4, WIN8).

Semantics of one crawl (per seed): a FIFO queue of (url, depth); a URL is visited the
first time it is taken from the queue if it is stored, on the seed's registrable
domain and ``depth < max_depth``; a visited page enqueues its first 20 links when
``depth < max_depth - 1``; the crawl stops after ``max_pages`` visited pages.

Spark form: one round per depth (at most ``max_depth``, a small constant), each a
join of the frontier with the link table, an anti join with the pages already
visited, a first-occurrence aggregate per (seed, page) and a per-seed cut to the pages
still allowed. FIFO order is reproduced exactly by the ``path`` of link positions from
the seed (depth first, then lexicographic path). Every crawl is bounded by
``max_pages``, so per-seed windows are bounded no matter how large the corpus is.
Each round's visited set is checkpointed to the session's checkpoint folder, which
cuts lineage and lets a lost executor recompute only the last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import ensure_checkpoint_dir

# --- fixed values -----------------------------------------------------------------
DEFAULT_MAX_DEPTH = 2
# ---------------------------------------------------------------------------------


def crawl(seeds: DataFrame, pages: DataFrame, edges: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH,
          max_pages: int | None = None, same_domain_only: bool = True,
          checkpoint: bool = True, links_per_page: int | None = None) -> DataFrame:
    """Crawl from every seed. ``seeds(seed_id, page_id)``, ``pages(page_id, url)``,
    ``edges(src_id, pos, dst_id)``. ``max_pages`` per seed and ``links_per_page`` bound the
    crawl only where given. Returns ``(seed_id, page_id, depth, crawl_order)``."""
    spark = seeds.sparkSession
    if checkpoint:
        ensure_checkpoint_dir(spark)
    nodes = pages.select("page_id", U.registrable_domain(F.col("url")).alias("domain"))
    # EXT10 keeps the first occurrence of each target; WIN8 then numbers the links by position.
    distinct_links = edges.groupBy("src_id", "dst_id").agg(F.min("pos").alias("pos"))
    w_links = Window.partitionBy("src_id").orderBy("pos", "dst_id")
    links = (distinct_links.withColumn("link_no", F.row_number().over(w_links))
             .filter(F.lit(True) if links_per_page is None else F.col("link_no") <= links_per_page)
             .select("src_id", "link_no", "dst_id"))
    bounded = max_pages is not None
    if checkpoint and max_depth > 1:
        # every round reads these: materialise them once instead of re-reading the pages
        # and re-ranking the links per round
        nodes, links = nodes.checkpoint(), links.checkpoint()
    seed_dom = seeds.join(nodes, "page_id").select("seed_id", "page_id", F.col("domain").alias("seed_domain"))
    visited = (seed_dom.filter(F.lit(max_depth) > 0)
               .select("seed_id", "page_id", "seed_domain", F.lit(0).alias("depth"),
                       F.array().cast("array<int>").alias("path")))
    if checkpoint:
        visited = visited.checkpoint()
    frontier = visited
    for depth in range(1, max_depth):
        counts = visited.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_visited"))
        cand = (frontier.join(links, frontier.page_id == links.src_id)
                .select("seed_id", "seed_domain", F.col("dst_id").alias("page_id"),
                        F.concat("path", F.array(F.col("link_no").cast("int"))).alias("path")))
        cand = cand.join(nodes, "page_id")  # only stored pages succeed
        if same_domain_only:
            cand = cand.filter(F.col("domain") == F.col("seed_domain"))
        cand = cand.join(visited.select("seed_id", "page_id"), ["seed_id", "page_id"], "left_anti")  # JON2 / SET3
        first = (cand.groupBy("seed_id", "page_id", "seed_domain")
                 .agg(F.min("path").alias("path")))
        w = Window.partitionBy("seed_id").orderBy("path", "page_id")
        new = (first.join(counts, "seed_id")
               .withColumn("rn", F.row_number().over(w))
               .filter(F.col("rn") <= F.lit(max_pages) - F.col("n_visited") if bounded else F.lit(True))
               .select("seed_id", "page_id", "seed_domain", F.lit(depth).alias("depth"), "path"))
        visited = visited.unionByName(new)
        if checkpoint:
            visited = visited.checkpoint()
        frontier = visited.filter(F.col("depth") == depth)
    w_all = Window.partitionBy("seed_id").orderBy("depth", "path")
    return (visited.withColumn("crawl_order", F.row_number().over(w_all))
            .filter(F.col("crawl_order") <= max_pages if bounded else F.lit(True))
            .select("seed_id", "page_id", F.col("depth").cast("int").alias("depth"),
                    F.col("crawl_order").cast("int").alias("crawl_order")))


def site_rollup(crawled: DataFrame) -> DataFrame:
    """AGG12 for a crawl: pages per seed and deepest level reached (total_pages)."""
    return crawled.groupBy("seed_id").agg(F.count(F.lit(1)).alias("total_pages"),
                                          F.max("depth").alias("max_depth_reached"))
