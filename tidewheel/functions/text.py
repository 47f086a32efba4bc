"""Text to value: column functions without Python on the executors."""

from __future__ import annotations

from pyspark.sql import functions as F


def to_number(c):
    """Safe numeric parse; bad text is null."""
    return c.try_cast("double")


def precipitation(c):
    """Category text of rain or snow to a number: none 0, "under x" 0.5, a range its lower bound, else the number before its unit."""
    t = F.trim(c)
    return (
        F.when(t.isin("none", "0", "-"), F.lit(0.0))
        .when(t.startswith("under"), F.lit(0.5))
        .when(t.contains("~"), F.trim(F.regexp_extract(t, r"^([0-9.]+) *(?:mm|cm)? *~", 1)).try_cast("double"))
        .otherwise(F.nullif(F.regexp_extract(t, r"^([0-9.]+) *(?:mm|cm)?$", 1), F.lit("")).try_cast("double"))
    )


def masked(c):
    """`*` is null, else the number."""
    return F.nullif(F.trim(c), F.lit("*")).try_cast("double")


def identity(c):
    """Trimmed, runs of blanks collapsed."""
    return F.regexp_replace(F.trim(c), " +", " ")


def content_id(*cols):
    """SHA-256 of the canonical JSON array of the values."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 256)


def station_number(c):
    """Five digits, zero-padded; anything that is no whole number is null."""
    return F.lpad(c.try_cast("int").cast("string"), 5, "0")


def strict_boolean(c):
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1", "y", "yes"), True).when(t.isin("false", "0", "n", "no"), False)


def window_of_key(c):
    """Epoch text yyyy-MM-ddTHH:mm of a key dt=.../hh=.../HHMM; null if hour and minute part disagree."""
    dt, hh, hm = (F.regexp_extract(c, r"dt=(\d{4}-\d{2}-\d{2})/hh=(\d{2})/(\d{4})", k) for k in (1, 2, 3))
    return F.when((dt != "") & (F.substring(hm, 1, 2) == hh), F.concat(dt, F.lit("T"), hh, F.lit(":"), F.substring(hm, 3, 2)))


def label(c, labels: dict):
    """Code to label; unknown codes are null."""
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(c == k, v).otherwise(out)
    return out
