"""All registered queries of the event engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import boards, core, files, formats, links, prose, streams, vehicles

_PLANS = (core, links, boards, prose, formats, files, vehicles, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for plan in _PLANS for name, query in plan.Q.items()}
ORACLE: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.O.items()}
