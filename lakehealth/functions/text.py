"""Column expressions for finding text (indicator, anomaly flag, templates).

All helpers return ``Column`` objects built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's output format -----------------
INDICATOR_LABEL = "Indicator:"
OPTIMIZED = "Optimized - OPT_2001"
ANOMALY = "Anomaly - ERR_1001"
DEFAULT_INDICATOR_SUFFIX = "\n\nIndicator: Optimized - OPT_2001"
METADATA_MISSING = "Parquet metadata not available for this table"
GUIDANCE_ONLY = "General guidance - no query executed"
FOUND_ISSUE_PREFIX = "Found issue with "
QUERY_ERROR_PREFIX = "Error executing query: "
CONNECTION_ERROR_PREFIX = "Connection error: "
NOT_AVAILABLE = "N/A"
DEFAULT_SCHEMA = "dbo"
UNKNOWN = "unknown"
SCAN_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# -----------------------------------------------------------------------------


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def indicator(is_anomaly: str | Column) -> Column:
    """``Indicator: Anomaly - ERR_1001`` or ``Indicator: Optimized - OPT_2001``."""
    return F.concat(F.lit(INDICATOR_LABEL + " "),
                    F.when(col_(is_anomaly), F.lit(ANOMALY)).otherwise(F.lit(OPTIMIZED)))


def result_text(detail: str | Column, is_anomaly: str | Column) -> Column:
    """Detail text, a blank line, then the indicator line (NULL detail -> indicator only)."""
    return F.concat_ws("\n\n", col_(detail), indicator(is_anomaly))


def with_default_indicator(text: str | Column) -> Column:
    """Text without an indicator line gets the Optimized one appended."""
    t = col_(text)
    return F.when(t.contains(INDICATOR_LABEL), t).otherwise(F.concat(t, F.lit(DEFAULT_INDICATOR_SUFFIX)))


def anomaly_flag(text: str | Column) -> Column:
    """A result is an anomaly iff it contains ``Anomaly - ERR_1001``."""
    return F.coalesce(col_(text).contains(ANOMALY), F.lit(False))


def strip_ws(text: str | Column) -> Column:
    """Strip leading/trailing whitespace of any kind (Spark ``trim`` only removes blanks)."""
    return F.regexp_replace(col_(text), r"^\s+|\s+$", "")


def is_blank(text: str | Column) -> Column:
    """NULL, empty or whitespace only."""
    t = col_(text)
    return t.isNull() | ~t.rlike(r"\S")


def now_scan_ts() -> datetime:
    """One UTC timestamp per run, truncated to milliseconds."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return now.replace(microsecond=(now.microsecond // 1000) * 1000)


def scan_date(ts: datetime | str) -> Column:
    """ISO-8601 text with milliseconds and ``Z`` for a fixed run timestamp."""
    if isinstance(ts, datetime):
        ts = ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.date_format(F.lit(ts).cast("timestamp_ntz"), SCAN_DATE_FORMAT)


def fill_template(template: str | Column, values: Mapping[str, str | Column]) -> Column:
    """Replace ``{key}`` placeholders one after another, in mapping order.

    A NULL value is replaced by the empty string, so one missing name never
    turns the whole script NULL.
    """
    out = col_(template)
    for key, value in values.items():
        v = F.lit(value) if isinstance(value, str) else value
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def pct_text(part: str | Column, whole: str | Column) -> Column:
    """``12.34%`` from integer counts, exact integer arithmetic (basis points, floor)."""
    p, w = col_(part).cast("long"), col_(whole).cast("long")
    bp = F.when(w > 0, idiv(p * 10000, w)).otherwise(F.lit(0).cast("long"))
    return F.concat(idiv(bp, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((bp % 100).cast("string"), 2, "0"), F.lit("%"))


def idiv(a: str | Column, b: str | Column) -> Column:
    """Integral division (SQL ``div``), exact for longs and decimals."""
    return F.call_function("div", col_(a), col_(b))


def ratio_text(num_: str | Column, den: str | Column, suffix: str = "x") -> Column:
    """``12.34x`` = floor(100 * num / den) / 100, in decimal arithmetic (no overflow)."""
    d = col_(den).cast("decimal(38,0)")
    hundredths = F.when(d > 0, idiv(col_(num_).cast("decimal(38,0)") * 100, d)).otherwise(F.lit(0))
    return F.concat(idiv(hundredths, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(suffix))


def num(c: str | Column) -> Column:
    """Integer as text."""
    return col_(c).cast("long").cast("string")
