"""All queries of the analytics operators with their oracle SQL."""

from bazaarlake.operators import browse, curation, demand, duty, economics, hashjoin, ingest, history, matching, media, monitoring, ordering, picture_files, prefix_rules, rebuild, resolution, rollup, search, sourcing, views
from bazaarlake.sources import elements, saved_site
from bazaarlake.streaming import catalog_store, gate, rollups, translations

QUERIES, ORACLES = {}, {}
for _group in (rollup, browse, history, economics, matching, media, monitoring, search, curation, ordering, resolution, duty, demand, media, ingest, sourcing, catalog_store, gate, hashjoin, saved_site, picture_files, rollups, rebuild, prefix_rules, elements, translations, views):
    QUERIES |= _group.QUERIES
    ORACLES |= _group.ORACLES
