"""Label, key and number Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Bug-type labels as exported -> short labels used in reports.
BUG_LABEL_MAP = {
    "Type Error": "Type Error",
    "Missing Cases": "Missing Case",
    "Missing Features": "Missing Feature",
    "API Misuse": "API Misuse",
    "Logic Error": "Logic Error",
    "Exception Handling": "Error Handling",
    "Runtime Exception": "Runtime Exception",
    "Tooling / Configuration Issue": "Tooling / Config",
    "UI Behavior Bug": "UI Bug",
    "Test Fault": "Test Fault",
    "Asynchrony / Event Handling Bug": "Async / Event",
}
# Report order of the short labels (conceptual clusters).
BUG_ORDER = [
    "Async / Event", "Error Handling", "Missing Case", "Missing Feature",
    "Runtime Exception", "Tooling / Config", "Type Error",
    "Logic Error", "API Misuse", "Test Fault", "UI Bug",
]
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_literal(mapping: dict) -> Column:
    return F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])


def recode_label(label, mapping: dict | None = None) -> Column:
    """Trim; replace when the trimmed label is a key (case-sensitive),
    otherwise keep the trimmed label. NULL stays NULL."""
    mapping = BUG_LABEL_MAP if mapping is None else mapping
    t = F.trim(_col(label))
    return F.coalesce(F.try_element_at(map_literal(mapping), t), t)


def normalize_key(name) -> Column:
    """Trim, lowercase, keep only a-z, 0-9 and '-'."""
    return F.regexp_replace(F.lower(F.trim(_col(name))), "[^a-z0-9-]", "")


def parse_grouped_number(text) -> Column:
    """T14: '1,234' -> 1234.0; anything unparsable -> NULL."""
    return F.regexp_replace(_col(text), ",", "").try_cast("double")


def years_since(start_date, as_of: str) -> Column:
    """Age in years between a start date and a fixed as-of date."""
    return F.datediff(F.to_date(F.lit(as_of)), _col(start_date)) / F.lit(365.25)


def to_numeric(df, cols=None):
    """Cast columns to double; bad values become NULL."""
    cols = cols or df.columns
    return df.select(*[_col(c).try_cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def r_name(name: str) -> str:
    """S6 helper: R-style column name mangling, e.g. 'Size (LOC)' -> 'Size..LOC.'."""
    import re
    return re.sub(r"[^A-Za-z0-9._]", ".", name)


def round_half_even(x, digits: int) -> Column:
    """Half-to-even rounding (1.125 -> 1.12)."""
    return F.bround(_col(x), digits)


def edge_width(rho, scale: float = 5.0) -> Column:
    """Edge width abs(r) * scale."""
    return F.abs(_col(rho)) * F.lit(scale)


def edge_sign(rho) -> Column:
    """Sign class of an edge."""
    return F.when(_col(rho) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def strip_suffix(name, suffix: str) -> Column:
    """Drop a fixed suffix such as ``_median`` from a name column."""
    import re
    return F.regexp_replace(_col(name), re.escape(suffix) + "$", "")


def relabel(name, mapping: dict) -> Column:
    """Rename values by a dictionary, others unchanged."""
    return F.coalesce(F.try_element_at(map_literal(mapping), _col(name)), _col(name))


def rename_columns(df, mapping: dict):
    """Rename columns by a dictionary (pretty names for a sink)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
