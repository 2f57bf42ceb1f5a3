from plantmetrics.plans import demand, finance, inventory, learning, oee, passports, planning, quality, reports, retrieval, sinks, streams, trade  # noqa: F401  (imports register the queries)
from plantmetrics.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
