"""SQL access: every catalogue query as a temporary view, so SQL users can write
``SELECT ... FROM page_overview JOIN url_domain USING (page_id)``. Views are lazy (the
plan runs when queried); stream queries and ``page_record``, which writes a table, are left
out because they run on creation."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import catalog


def register_views(spark: SparkSession, sf_dir: str, names=None) -> list[str]:
    catalog.load_all()
    chosen = names or [n for n in catalog.QUERIES if not (n.startswith("stream_") or n.endswith("_stream") or n == "page_record")]
    for name in chosen:
        catalog.QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
    return list(chosen)
