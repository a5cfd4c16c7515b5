"""The queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pagewright.operators import schema_drift, snapshot_diff, timestamps
from pagewright.plans import oracles, queries_scalar, queries_sets

PARTS = [queries_scalar.R, queries_sets.R]


def queries() -> dict:
    out = {
        "p1_found": snapshot_diff.p1_found,
        "p4_found": timestamps.p4_found,
        "p7_found": schema_drift.p7_found,
        "p7_renames": schema_drift.p7_renames,
        "p7_configs": schema_drift.p7_configs,
        "p7_records": schema_drift.p7_records,
    }
    for part in PARTS:
        out |= part.run
    return out


def oracle_sql() -> dict:
    out = {"p1_found": oracles.SNAPSHOT_DIFF, "p7_found": oracles.SCHEMA_DRIFT}
    for part in PARTS:
        out |= part.sql
    return out
