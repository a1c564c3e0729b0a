"""All queries of the engine's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import accounts, devices, expressions, facts, flow, logs, places, programfacts, programs, reports, states, subsystems, syntax, traces

_MODULES = (traces, facts, accounts, expressions, programfacts, subsystems, reports, logs, programs, devices, syntax, flow, places, states)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
