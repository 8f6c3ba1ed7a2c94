"""Scalar, date, array and text functions of the domain, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_fraction_ts(c: Column) -> Column:
    """Wall-clock time of the text before the first dot, any zone dropped; null where it is none."""
    plain = F.regexp_replace(F.split_part(c, F.lit("."), F.lit(1)), r"([+-]\d{2}:?\d{2}|Z)$", "")
    return F.try_to_timestamp(plain).cast("timestamp_ntz")


def questionnaire_ts(c: Column) -> Column:
    """Times in either of two formats; others, like the word NULL, become null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("M/d/yyyy H:mm"))).cast("timestamp_ntz")


def calendar_features(time: Column) -> dict[str, Column]:
    hour, weekday = F.hour(time), F.weekday(time)
    return {"hour": hour, "day_of_week": weekday, "is_working_hours": hour.between(9, 17).cast("int"), "is_weekend": (weekday >= 5).cast("int")}


def interaction_features() -> dict[str, Column]:
    c = F.col
    return {
        "hr_steps_ratio": c("hr_mean") / (c("steps_total") + 1), "stress_weighted_hr": c("hr_mean") * c("stress_mean"),
        "stress_steps_ratio": c("stress_mean") / (c("steps_total") + 1), "steps_hr_variability": c("steps_std") / (c("hr_std") + 1e-5),
    }


def participant_id(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)", 1)


def format_mean_std(mean: Column, std: Column) -> Column:
    return F.format_string("%.3f ± %.3f", mean, std)


def parse_mean_std(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, "±")
    return F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")


def hp_folder(uf: Column, k: Column, b: Column, t: Column, dr: Column) -> Column:
    """Folder name of a run's settings; a null T is left out."""
    return F.concat_ws("_", F.concat(F.lit("UF"), uf.cast("string")), F.concat(F.lit("K"), k.cast("string")), F.concat(F.lit("B"), b.cast("string")), F.concat(F.lit("T"), t.cast("string")), F.concat(F.lit("DR"), dr.cast("string")))


def parse_hp_folder(name: Column) -> dict[str, Column]:
    get = lambda p: F.regexp_extract(name, p, 1).try_cast("double")
    return {"UF": get(r"(?:^|_)UF([\d.]+)"), "K": get(r"_K(\d+)"), "B": get(r"_B(\d+)"), "T": get(r"_T(\d+)"), "DR": get(r"_DR([\d.]+)")}


def budget(uf: Column, n: Column, k: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(uf * n / k).cast("long"))


def zscore_seq(c: Column) -> Column:
    """Population z-scores of an array; a constant one becomes zeros."""
    from ..operators.clean import let, seq_mean, seq_std

    parts = F.struct(seq_mean(c).alias("m"), seq_std(c).alias("s"))
    return let(parts, lambda w: F.transform(c, lambda x: F.when(w["s"] > 1e-12, (x - w["m"]) / w["s"]).otherwise(0.0)))


def stack_channels(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.array(x, y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    from ..operators.clean import let

    return let(F.sqrt(dot(v, v)) + 1e-8, lambda norm: F.transform(v, lambda x: x / norm))


def parse_packed(text: Column) -> Column:
    """'k: v, k: v' as a map; a key that comes again takes its last value."""
    pairs = F.transform(F.split(text, ", "), lambda p: F.struct(F.split_part(p, F.lit(": "), F.lit(1)).alias("k"), F.substring_index(p, ": ", -1).alias("v")))
    whole = F.transform(F.split(text, ", "), lambda p: F.split_part(p, F.lit(": "), F.lit(1)))
    last = F.filter(pairs, lambda x, i: F.array_position(F.reverse(whole), x["k"]) == F.size(whole) - i)
    return F.map_from_entries(last)


def missing_as_null(value: Column) -> Column:
    """A packed number; -1 is missing."""
    number = value.try_cast("double")
    return F.when(number != -1, number)


def split_task(name: Column) -> tuple[Column, Column]:
    parts = F.split(name, "_", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def logistic_score(v: Column, weights: Column, bias: float) -> Column:
    return 1 / (1 + F.exp(-(dot(v, weights) + bias)))


def ordered_dedupe(text: Column) -> Column:
    """The trimmed tokens of a comma list, first occurrences, in order."""
    tokens = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(tokens)
