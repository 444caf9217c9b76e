"""contactlake: business-contact analytics as Spark DataFrame jobs.

Layout
------
functions/   Column -> Column expressions (validators, URL and HTML text helpers,
             similarity terms).  All JVM-side, no Python UDFs.
operators/   DataFrame -> DataFrame operators (extraction, enrichment joins,
             ordered dedup, reports, crawl-log and freshness operators).
sources/     readers for the driver tables, derived fixtures, URL lists,
             business JSON and archived local-listing pages.
sinks/       CSV / JSON Lines / JSON array / TXT exports.
plans/       named end-to-end queries (the ``queries()`` registry) and the
             DuckDB oracle SQL used by the correctness gate.
streaming/   Structured Streaming variants (incremental accumulation,
             freshness).
"""

from contactlake.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
