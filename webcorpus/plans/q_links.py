"""Crawl queries over stored pages and the derived link table (JON1-3, TOP4, WIN8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl as CR
from ..sources import derived, tables
from . import duck as D
from .catalog import register

MAX_DEPTH = 5
MAX_PAGES = 50
LINKS_PER_PAGE = 20


def _crawl_sql(max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES) -> str:
    ctes = [
        derived.duck_cte("link_edges")[len("WITH "):],
        f"nodes AS (SELECT page_id, {D.registrable_domain('url')} AS domain FROM pages)",
        "l AS (SELECT src_id, dst_id, row_number() OVER (PARTITION BY src_id ORDER BY pos, dst_id) AS link_no "
        "FROM (SELECT src_id, dst_id, min(pos) AS pos FROM link_edges GROUP BY 1, 2))",
        "v0 AS (SELECT page_id AS seed_id, page_id, domain AS seed_domain, 0 AS depth, []::INT[] AS path FROM nodes)",
    ]
    for k in range(1, max_depth):
        prev = f"v{k - 1}"
        front = "v0" if k == 1 else f"n{k - 1}"
        ctes.append(
            f"c{k} AS (SELECT f.seed_id, f.seed_domain, l.dst_id AS page_id, "
            f"list_append(f.path, CAST(l.link_no AS INT)) AS path FROM {front} f JOIN l ON f.page_id = l.src_id "
            f"JOIN nodes n ON n.page_id = l.dst_id WHERE n.domain = f.seed_domain AND l.link_no <= {LINKS_PER_PAGE} "
            f"AND NOT EXISTS (SELECT 1 FROM {prev} x WHERE x.seed_id = f.seed_id AND x.page_id = l.dst_id))")
        ctes.append(
            f"n{k} AS (SELECT seed_id, page_id, seed_domain, {k} AS depth, path FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY path, page_id) AS rn FROM "
            f"(SELECT seed_id, page_id, seed_domain, min(path) AS path FROM c{k} GROUP BY ALL) "
            f"JOIN (SELECT seed_id, count(*) AS n_visited FROM {prev} GROUP BY 1) USING (seed_id)) "
            f"WHERE rn <= {max_pages} - n_visited)")
        ctes.append(f"v{k} AS (SELECT * FROM {prev} UNION ALL SELECT * FROM n{k})")
    last = f"v{max_depth - 1}"
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT seed_id, page_id, CAST(depth AS INT) AS depth, CAST(crawl_order AS INT) AS crawl_order FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY depth, path) AS crawl_order FROM {last}) "
            f"WHERE crawl_order <= {max_pages}")


def _crawl(spark, sf_dir):
    pages = tables.pages(spark, sf_dir).select("page_id", "url")
    seeds = pages.select(F.col("page_id").alias("seed_id"), "page_id")
    edges = derived.view(spark, sf_dir, "link_edges")
    return CR.crawl(seeds, pages, edges, max_depth=MAX_DEPTH, max_pages=MAX_PAGES, links_per_page=LINKS_PER_PAGE)


@register("crawl_bfs", oracle=_crawl_sql())
def crawl_bfs(spark, sf_dir):
    return _crawl(spark, sf_dir)


@register("crawl_site_totals", oracle=f"""
{_crawl_sql()[:_crawl_sql().rindex('SELECT seed_id, page_id, CAST(depth')]}
SELECT seed_id, count(*) AS total_pages, max(depth) AS max_depth_reached FROM (
SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY depth, path) AS crawl_order FROM v{MAX_DEPTH - 1})
WHERE crawl_order <= {MAX_PAGES} GROUP BY 1""")
def crawl_site_totals(spark, sf_dir):
    return CR.site_rollup(_crawl(spark, sf_dir))
