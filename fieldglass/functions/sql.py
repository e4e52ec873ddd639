"""The scalar expressions as SQL functions of a session. They are SQL-bodied, so Catalyst inlines them: no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .exprs import EARTH_KM
from .fixed import EVENT_TYPES, LOW_WITHOUT_LOSSES, REPORT_STOPWORDS, TYPE_HINTS

_quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
_hints = " ".join(f"WHEN {' OR '.join(f"contains(lower(raw), '{w}')" for w in words)} THEN '{name}'" for words, name in TYPE_HINTS)

#: name: (parameters, result type, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "event_type_of": ("raw STRING", "STRING", f"CASE WHEN raw IN ({_quote(EVENT_TYPES)}) THEN raw {_hints} ELSE 'other' END"),
    "severity_of": ("kind STRING, magnitude INT", "STRING", f"CASE WHEN coalesce(magnitude, 0) >= 25 OR (kind = 'explosion/remote' AND magnitude >= 10) THEN 'critical' WHEN magnitude >= 5 THEN 'high' WHEN magnitude >= 1 THEN 'medium' WHEN kind IN ({_quote(LOW_WITHOUT_LOSSES)}) THEN 'low' ELSE 'info' END"),
    "haversine_km": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", f"2 * {EARTH_KM}D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "robust_z": ("v DOUBLE, median DOUBLE, mad DOUBLE", "DOUBLE", "CASE WHEN mad > 0 THEN (v - median) / (1.4826D * mad) WHEN v <= median THEN 0D ELSE 3D * (v - median) / greatest(median, 1D) END"),
    "saturate": ("ratio DOUBLE", "DOUBLE", "CASE WHEN ratio <= 1 THEN 0D ELSE 100D * (1 - exp(-(ratio - 1) / 1.5D)) END"),
    "text_tokens": ("t STRING", "ARRAY<STRING>", f"array_distinct(filter(regexp_extract_all(lower(coalesce(t, '')), '([a-z0-9]+)', 1), w -> length(w) >= 2 AND w NOT IN ({_quote(REPORT_STOPWORDS)})))"),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0D)"),
    "strip_html": ("t STRING", "STRING", r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' '), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', "'"), '&amp;', '&'), '\\s+', ' '))"""),
    "url_host": ("url STRING", "STRING", r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"),
}


def register(spark: SparkSession, prefix: str = "fg_") -> list[str]:
    """Create all functions in the session, under a prefix; their names."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({params}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in FUNCTIONS]
