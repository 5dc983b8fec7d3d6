"""Changes to tables and checks of what people wrote: overrides, corrections, training examples, integrity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: list[str], columns: dict[str, str | None]) -> DataFrame:
    """rows with the non-null columns of their key's override, each one's confidence (columns[name]) set to 1.

    Overrides of unknown keys change nothing, and no other column changes: an extrapolated row keeps its status.
    `corrected` marks the rows that an override met. overrides: key + columns, one row a key.
    """
    o = overrides.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    both = rows.join(o, key, "left")
    touched = F.lit(False)
    for c, confidence in columns.items():
        new = F.col(f"__{c}").isNotNull()
        touched = touched | new
        if confidence:
            both = both.withColumn(confidence, F.when(new, 1.0).otherwise(F.col(confidence)))
    both = both.withColumn("corrected", touched)
    for c in columns:
        both = both.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)))
    return both.select(*rows.columns, "corrected")


#: The action that adds an event which was missed; every other one refers to an event. Fixed value.
ADD_MISSED = "add_missed"


def correction_errors(corrections: DataFrame) -> DataFrame:
    """corrections with `errors`, the columns that their action needs and that are empty; only rows without any may be appended.

    corrections: event_id, action, corrected_start_s and others.
    """
    missed = F.col("action") == ADD_MISSED
    no_event = ~missed & (F.coalesce(F.trim(F.col("event_id").cast("string")), F.lit("")) == "")
    rules = [(F.col("action").isNull(), "action"), (no_event, "event_id"), (missed & F.col("corrected_start_s").isNull(), "corrected_start_s")]
    return corrections.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), name) for r, name in rules))))


def training_examples(events: DataFrame, reviews: DataFrame, key: list[str]) -> DataFrame:
    """Reviewed events with the latest review of each and a `fingerprint` of what the example says.

    reviews: key + action, corrected_type, revision. Rejected events stay as negatives.
    """
    last = reviews.groupBy(*key).agg(F.max_by(F.struct("action", "corrected_type"), "revision").alias("r"))
    label = F.when(F.col("r.action") == "reject", "none").otherwise(F.coalesce("r.corrected_type", "event_type"))
    out = events.join(last, key).select(*events.columns, F.col("r.action").alias("action"), label.alias("label"))
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", *key, "label"), 256))


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: (rule, n_rows, n_broken), counted in one pass; an unknown condition isn't broken."""
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in rules.items()))
    return counts.select("n", F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_broken")) for name in rules)))).select(
        "rule", F.col("n").alias("n_rows"), "n_broken"
    )


def label_rules() -> dict[str, Column]:
    """Integrity of ball labels: visibility (visible, not_visible, outside_frame, ambiguous), centre_x, centre_y, width, height, radius,
    x1, y1, x2, y2, reason, sure. Limits of the radius are fixed values."""
    c = F.col
    seen, placed, boxed = c("visibility") == "visible", c("centre_x").isNotNull() & c("centre_y").isNotNull(), c("x1").isNotNull()
    return {
        "visible_without_centre": seen & ~placed,
        "centre_without_ball": c("visibility").isin("outside_frame", "not_visible") & placed,
        "x_outside": placed & ~c("centre_x").between(0, c("width")),
        "y_outside": placed & ~c("centre_y").between(0, c("height")),
        "radius_without_ball": c("radius").isNotNull() & ~seen,
        "radius_too_small": c("radius") < 1.0,
        "radius_too_large": c("radius") > 60.0,
        "empty_box": boxed & ((c("x2") <= c("x1")) | (c("y2") <= c("y1"))),
        "box_without_ball": boxed & ~seen,
        "ambiguous_without_reason": (c("visibility") == "ambiguous") & (F.coalesce(c("reason"), F.lit("")) == ""),
        "confidence_out_of_range": ~c("sure").between(0.0, 1.0),
    }


def box_rules() -> dict[str, Column]:
    """Integrity of true boxes: id, corners, and `same`, the rows of the frame with the same id. The aspect's limits are fixed values."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return {
        "missing_id": F.col("id").isNull(),
        "duplicate_id": F.col("same") > 1,
        "degenerate": (w <= 0) | (h <= 0),
        "aspect": (w > 0) & (h > 0) & ~(w / h).between(0.15, 3.0),
    }
