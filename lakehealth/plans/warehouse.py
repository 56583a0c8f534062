"""Warehouse-style scan: data checks over a folder of tables -> findings."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import result_text
from ..operators import quality
from . import dataset
from .catalog import builtin_rules
from .findings import assemble, union_all
from .. import schemas


def check_view(checks: DataFrame) -> DataFrame:
    """Compact result of a check: location, finding text and anomaly flag."""
    return checks.select("rule_id", "table_name", "column_name",
                         result_text("detail", "is_anomaly").alias("result"), "is_anomaly")


def data_checks(tables: Mapping[str, DataFrame], *, older_than: str = "1996-01-01",
                exact_distinct: bool = True, keys=None, fks=None, skew_keys=None) -> DataFrame:
    """All per-table data checks; the column profile is computed once and shared."""
    keys = dataset.PRIMARY_KEYS if keys is None else keys
    fks = dataset.FOREIGN_KEYS if fks is None else fks
    skew_keys = dataset.SKEW_KEYS if skew_keys is None else skew_keys
    prof = quality.column_profile(tables, exact_distinct=exact_distinct, older_than=older_than)
    parts = [quality.profile_checks(prof, [
        quality.null_values_entry(), quality.column_sizing_entry(), quality.column_stats_entry(),
        quality.cardinality_entry(), quality.text_types_entry(), quality.data_retention_entry(older_than),
    ])]
    present = set(tables)
    k = {t: v for t, v in keys.items() if t in present}
    f = [x for x in fks if x[0] in present and x[2] in present]
    s = {t: v for t, v in skew_keys.items() if t in present}
    # one shared key-count aggregate (one scan per table) for Q4, Q2 and L12
    sets = ([(t, tuple(ks)) for t, kss in k.items() for ks in kss if quality._narrow(tables[t], ks)]
            + [(c, tuple(ck)) for c, ck, _, _ in f] + [(p, tuple(pk)) for _, _, p, pk in f]
            + [(t, (c,)) for t, cols in s.items() for c in cols])
    kc = quality.KeyCounts(tables, sets) if sets else None
    if k:
        parts.append(quality.duplicates(tables, k, kc))
    if f:
        parts.append(quality.fk_orphans(tables, f, kc))
    if s:
        parts.append(quality.key_skew(tables, s, counts=kc))
    return union_all(parts, schemas.CHECKS)


def warehouse_findings(spark: SparkSession, tables: Mapping[str, DataFrame], *,
                       source_name: str, source_id: str | None = None,
                       workspace_name: str | None = None, workspace_id: str | None = None,
                       scan_ts: datetime | str, rules: DataFrame | None = None, **kw) -> DataFrame:
    """Data checks of one warehouse as findings."""
    rules = builtin_rules(spark) if rules is None else rules
    src = {"source_name": source_name, "source_id": source_id or "N/A",
           "workspace_name": workspace_name, "workspace_id": workspace_id}
    return assemble(data_checks(tables, **kw), rules, scan_ts=scan_ts, source=src)


__all__ = ["check_view", "data_checks", "warehouse_findings"]
