"""Checks on a climatology, and its fingerprint."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .climatology import DAYS
from .grid import cell_key
from .skew import exact_percentile

# --- fixed values -----------------------------------------------------------
SCHEMA_VERSION = "1"
REQUIRED_ATTRS = ["clim_start", "clim_end", "pctile", "window_half_width", "smooth_width"]
NULL_SHARE_LIMITS = (30.0, 90.0)  # percent: warn above, error above
RANGES = {  # warn below, warn above, error below, error above (°C)
    "seas": (-5.0, 40.0, -20.0, 60.0),
    "thresh": (-3.0, 45.0, -20.0, 60.0),
}
VIOLATION_LIMITS = (5.0, 25.0)  # percent: warn above, error above
JUMP_LIMITS = (0.5, 1.0)  # °C: warn from, error from
MIN_SPAN_YEARS = 10
UNITS = "degC"
LIGHT_NULL_SHARE = 0.5
# ----------------------------------------------------------------------------


def largest_jump(clim: DataFrame) -> DataFrame:
    """Largest step of ``seas`` between consecutive days per cell, not around the year."""
    by_day = W.partitionBy("cell").orderBy("doy")
    step = F.abs(F.col("seas") - F.lag("seas").over(by_day))
    return clim.select(cell_key(), "doy", "seas").select("cell", step.alias("step")).groupBy(
        "cell"
    ).agg(F.max("step").alias("jump"))


def _level(value, warn, error):
    return F.when(error, "error").when(warn, "warn").otherwise("ok")


def data_checks(clim: DataFrame) -> DataFrame:
    """``check, level, value`` for null shares, ranges, order and smoothness."""
    both = F.col("seas").isNotNull() & F.col("thresh").isNotNull()
    facts = clim.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doy").alias("n_doy"),
        *[f for v in RANGES for f in (
            F.count(v).alias(f"{v}_n"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")
        )],
        F.count_if(both).alias("both"),
        F.count_if(both & (F.col("thresh") < F.col("seas"))).alias("below"),
    ).withColumn("jump", exact_percentile(largest_jump(clim), "jump", 0.99, "p").scalar())
    rows = [F.struct(
        F.lit("dayofyear length").alias("check"),
        F.when(F.col("n_doy") == DAYS, "ok").otherwise("error").alias("level"),
        F.col("n_doy").cast("double").alias("value"),
    )]
    for v, (warn_lo, warn_hi, far_lo, far_hi) in RANGES.items():
        share = F.lit(100.0) * (F.col("n") - F.col(f"{v}_n")) / F.col("n")
        warn, error = NULL_SHARE_LIMITS
        rows.append(F.struct(
            F.lit(f"null share {v}").alias("check"), _level(share, share > warn, share > error).alias("level"),
            F.round(share, 2).alias("value"),
        ))
        lo, hi = F.col(f"{v}_min"), F.col(f"{v}_max")
        rows.append(F.struct(
            F.lit(f"{v} range").alias("check"),
            _level(lo, (lo < warn_lo) | (hi > warn_hi),
                   lo.isNull() | (lo < far_lo) | (hi > far_hi)).alias("level"),
            F.round(hi - lo, 2).alias("value"),
        ))
        rows += [F.struct(F.lit(f"{v} {end}").alias("check"), F.lit("ok").alias("level"), F.round(x, 2).alias("value"))
                 for end, x in (("lowest", lo), ("highest", hi))]
    violated = F.lit(100.0) * F.col("below") / F.nullif(F.col("both"), F.lit(0))
    warn, error = VIOLATION_LIMITS
    rows.append(F.struct(
        F.lit("thresh >= seas").alias("check"),
        _level(violated, violated.isNull() | (violated > warn), violated > error).alias("level"),
        F.round(violated, 2).alias("value"),
    ))
    warn, error = JUMP_LIMITS
    rows.append(F.struct(
        F.lit("doy continuity p99").alias("check"),
        _level(F.col("jump"), F.col("jump").isNull() | (F.col("jump") >= warn), F.col("jump") >= error).alias("level"),
        F.round("jump", 3).alias("value"),
    ))
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _attr_row(clim: DataFrame, attrs: dict) -> DataFrame:
    """One row with the attributes as text and the missing ones counted."""
    def text(name):
        return None if attrs.get(name) is None else str(attrs[name])

    box = attrs.get("bbox")
    sides = None if box is None else [str(b) for b in box] if isinstance(box, (list, tuple)) else [str(box)]
    lacking = sum(attrs.get(a) is None for a in REQUIRED_ATTRS)
    return clim.sparkSession.createDataFrame(
        [(text("clim_start"), text("clim_end"), text("created_utc"), text("schema_version"), text("units"), lacking, sides)],
        "first string, last string, created string, version string, units string, lacking int, box array<string>",
    ).select(
        "*", F.expr("try_cast(last AS INT) - try_cast(first AS INT) + 1").alias("span"),
        F.transform("box", lambda b: b.try_cast("double")).alias("sides"),
    )


def attr_checks(clim: DataFrame, attrs: dict) -> DataFrame:
    """``check, level, value`` for columns, types and attributes; reads no climatology rows.

    A table of rules over one row: name, when it applies, when it holds, the
    level otherwise, and the value shown.
    """
    types = {f.name: f.dataType for f in clim.schema.fields}
    number = (T.DoubleType, T.FloatType)
    years, span, box = F.col("first").isNotNull() & F.col("last").isNotNull(), F.col("span"), F.col("sides")
    west, south, east, north = (F.get(box, F.lit(i)) for i in range(4))
    inside = (
        (F.size(box) == 4) & (west < east) & (south < north)
        & (F.greatest(F.abs(west), F.abs(east)) <= 180) & (F.greatest(F.abs(south), F.abs(north)) <= 90)
    )
    always, nothing = F.lit(True), F.lit(None)
    rules = [
        ("required variables", always, F.lit({"seas", "thresh"} <= types.keys()), "error", nothing),
        *[(f"{v} type", always, F.lit(isinstance(types.get(v), number)), "error", nothing) for v in RANGES],
        ("units", always, F.col("units") == UNITS, "warn", nothing),
        ("required attributes", always, F.col("lacking") == 0, "error", F.col("lacking")),
        ("schema version", always, F.col("version") == SCHEMA_VERSION, "error", nothing),
        ("year order", years, span > 1, "error", span),
        ("year span", years & (span > 1), span >= MIN_SPAN_YEARS, "warn", span),
        ("created_utc", F.col("created") != "", F.try_to_timestamp(F.col("created")).isNotNull(), "error", nothing),
        ("bbox", F.col("box").isNotNull(), inside, "error", nothing),
    ]
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("check"), applies.alias("applies"),
            F.when(holds, "ok").otherwise(worse).alias("level"), value.cast("double").alias("value"),
        )
        for name, applies, holds, worse, value in rules
    ])
    return _attr_row(clim, attrs).select(F.explode(rows).alias("r")).where("r.applies").select("r.check", "r.level", "r.value")


def quality_report(clim: DataFrame, attrs: dict) -> DataFrame:
    """``check, level, value`` with levels ok, warn and error."""
    return attr_checks(clim, attrs).unionByName(data_checks(clim))


def light_check(clim: DataFrame, attrs: dict) -> DataFrame:
    """The short form: ``check, ok`` with looser limits."""
    facts = clim.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doy").alias("n_doy"),
        F.count("seas").alias("seas"), F.count("thresh").alias("thresh"),
    )
    ok_version = str(attrs.get("schema_version")) == SCHEMA_VERSION
    ok_attrs = all(attrs.get(a) is not None for a in REQUIRED_ATTRS)
    rows = [("schema version", F.lit(ok_version)), ("required attributes", F.lit(ok_attrs)),
            ("dayofyear length", F.col("n_doy") == DAYS)]
    rows += [(f"{v} null share", F.col(v) > F.col("n") * (1 - LIGHT_NULL_SHARE)) for v in ("seas", "thresh")]
    return facts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), ok.alias("ok")) for name, ok in rows
    ])).alias("r")).select("r.*")


MICRO = 1_000_000
PARTS = ("s0", "s1", "s2", "s3")


def fingerprint_parts(clim: DataFrame) -> DataFrame:
    """One row ``n, s0 .. s3``: a hash of the rows as a multiset.

    Every row is a text of its coordinates and values in millionths; its MD5 is
    cut in four numbers, which are summed. Sums need no order, so they do not depend
    on files or partitions, and those of parts add up to that of the whole.
    """
    def micro(c: str) -> Column:
        return F.coalesce(F.round(F.col(c) * MICRO).cast("long").cast("string"), F.lit(""))

    row = F.md5(F.concat_ws("|", micro("lat"), micro("lon"), F.col("doy").cast("string"), micro("seas"), micro("thresh")))
    numbers = clim.select(*[F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("long").alias(p) for k, p in enumerate(PARTS)])
    return numbers.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in PARTS])


def merged_fingerprint(parts: DataFrame, attrs: dict) -> DataFrame:
    """One row with a digest of all rows behind ``parts`` and of the attributes but the creation time."""
    kept = {k: v for k, v in sorted(attrs.items()) if k != "created_utc"}
    blob = json.dumps(kept, sort_keys=True, separators=(",", ":"), default=str)
    whole = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *PARTS)])
    return whole.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", *PARTS)], F.lit(blob)), 256).alias("fingerprint"))


def fingerprint_frame(clim: DataFrame, attrs: dict) -> DataFrame:
    return merged_fingerprint(fingerprint_parts(clim), attrs)


def fingerprint(clim: DataFrame, attrs: dict) -> str:
    return fingerprint_frame(clim, attrs).first()["fingerprint"]
