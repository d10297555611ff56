"""All registered queries of the library and their SQL."""

from quillon.plans import answering, catalog, claims, corpus, hybrid, jobs, operations, retrieval, shaping, work
from quillon.streaming import tasks

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (retrieval, hybrid, answering, corpus, claims, shaping, catalog, work, operations, jobs, tasks):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
