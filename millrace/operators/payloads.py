"""Checking the JSON that models return: parsed once a row to VARIANT, so that a number, a text, an object and nothing differ by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN")  # true counts as 1; decimals by their prefix


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, path: str, kind: str) -> Column:
    """Whether there is a value of this kind at the path: object, text, number, null or absent."""
    shown = F.schema_of_variant(_at(v, path))
    if kind == "absent":
        return shown.isNull()
    test = {
        "object": shown.startswith("OBJECT"), "text": shown == "STRING", "null": shown == "VOID",
        "number": shown.isin(*NUMBERS) | shown.startswith("DECIMAL"),
    }[kind]
    return F.coalesce(test, F.lit(False))


def parsed(df: DataFrame, payload: str, out: str = "parsed") -> DataFrame:
    """df with the payload as VARIANT; null where it is no JSON."""
    return df.withColumn(out, F.try_parse_json(payload))


def key_diff(v: Column, path: str, expected: Sequence[str]) -> tuple[Column, Column]:
    """Expected keys that the object at the path lacks, and keys it has besides; null where it is no object."""
    keys = F.map_keys(_at(v, path, "map<string,variant>"))
    wanted = F.array(*map(F.lit, expected))
    return F.array_except(wanted, keys), F.array_except(keys, wanted)


def coerced(df: DataFrame, v: str, aspects: Sequence[str], most: int = 3) -> DataFrame:
    """df with scores (map of aspect to struct(score, evidence) or null), confidence, n_coerced and rejected (why; null: accepted).

    An entry stands if it is an object with a number and a text of two characters or more without outer white space; its score is
    clamped to 0..10, which counts if it changes it, and its text is cut to 120 characters.  Null and missing entries are null;
    anything else is null and counts.  The confidence is clamped to 0..1; one that is absent is 0.5, and one that is no number
    (nor a text that reads as one) is 0.5 and counts.  Keys that nobody expects are left out.  More than `most` counts reject.

    Everything is read once, in steps (scores and confidence, entries, their values, what stands) that have columns of their own.
    """
    numbers = range(len(aspects))
    scores, told = _at(F.col(v), "$.scores", "map<string,variant>"), _at(F.col(v), "$.confidence")
    out = df.withColumns({"p_scores": scores, "p_told": told})
    out = out.withColumns({f"p_entry{i}": F.try_element_at("p_scores", F.lit(a)) for i, a in enumerate(aspects)})
    out = out.withColumns({f"p_fields{i}": _at(F.col(f"p_entry{i}"), "$", "struct<score:variant,evidence:variant>") for i in numbers})
    found = {}
    for i in numbers:
        score, evidence = F.col(f"p_fields{i}.score"), F.col(f"p_fields{i}.evidence")
        found[f"p_score{i}"] = F.when(_is(score, "$", "number"), _at(score, "$", "double"))
        found[f"p_evidence{i}"] = F.when(_is(evidence, "$", "text"), F.btrim(_at(evidence, "$", "string"), F.lit(" \t\n\x0b\f\r")))
    out = out.withColumns({**found, "p_sure": _at(F.col("p_told"), "$", "double")})
    entries, repairs = [], F.lit(0)
    for i, a in enumerate(aspects):
        entry, score, evidence = F.col(f"p_entry{i}"), F.col(f"p_score{i}"), F.col(f"p_evidence{i}")
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))
        good = score.isNotNull() & F.coalesce(F.length(evidence) >= 2, F.lit(False))
        entries += [F.lit(a), F.when(good, F.struct(clamped.alias("score"), F.substring(evidence, 1, 120).alias("evidence")))]
        silent = F.when(F.col(f"p_fields{i}").isNotNull(), False).otherwise(entry.isNull() | _is(entry, "$", "null"))
        repairs = repairs + F.when(good, (clamped != score).cast("int")).when(silent, 0).otherwise(1)
    odd = F.col("p_told").isNotNull() & F.col("p_sure").isNull()
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p_sure", F.lit(0.5))))
    usable = F.col("p_scores").isNotNull()
    out = out.withColumns({"scores": F.when(usable, F.create_map(*entries)), "confidence": confidence, "n_coerced": F.when(usable, repairs + odd.cast("int")).otherwise(0)})
    reason = (
        F.when(F.col(v).isNull(), "not_json").when(usable, F.when(F.col("n_coerced") > most, "too_malformed"))
        .when(~_is(F.col(v), "$", "object"), "not_an_object").otherwise("no_scores")
    )
    return out.withColumn("rejected", reason).drop("p_scores", "p_told", "p_sure", *(f"p_{n}{i}" for n in ("entry", "fields", "score", "evidence") for i in numbers))


def bridging_error(v: str, aspects: Sequence[str]) -> Column:
    """Why a bridging payload is invalid (null: it is valid): every aspect and no other, each with a score within 0..10 and a
    reasoning of 5 to 200 characters, and a confidence within 0..1; texts that read as numbers are numbers."""
    parsed_ = F.col(v)
    missing, unexpected = key_diff(parsed_, "$.scores", aspects)
    whole = F.lit(True)
    for a in aspects:
        score, reasoning = _at(parsed_, f"$.scores.{a}.score", "double"), _at(parsed_, f"$.scores.{a}.reasoning", "string")
        fine = score.between(0, 10) & _is(parsed_, f"$.scores.{a}.reasoning", "text") & F.length(reasoning).between(5, 200)
        whole = whole & F.coalesce(fine, F.lit(False))
    confidence = F.coalesce(_at(parsed_, "$.confidence", "double").between(0, 1), F.lit(False))
    return (
        F.when(parsed_.isNull(), "not_json").when(~_is(parsed_, "$.scores", "object"), "no_scores")
        .when(F.size(missing) > 0, "missing").when(F.size(unexpected) > 0, "unexpected").when(~whole, "bad_entry").when(~confidence, "bad_confidence")
    )


def coverage_error(v: str, aspects: Sequence[str], values: Sequence[str], least: int = 20) -> Column:
    """Why a coverage payload is invalid (null: it is valid): all aspects at least, every value one of `values`, a rewritten spec of `least` characters."""
    parsed_ = F.col(v)
    missing, _ = key_diff(parsed_, "$.coverage", aspects)
    states = F.map_values(_at(parsed_, "$.coverage", "map<string,variant>"))
    known = F.forall(states, lambda s: F.coalesce((F.schema_of_variant(s) == "STRING") & F.try_variant_get(s, "$", "string").isin(*values), F.lit(False)))
    long_enough = _is(parsed_, "$.improved_spec", "text") & (F.length(_at(parsed_, "$.improved_spec", "string")) >= least)
    return (
        F.when(parsed_.isNull(), "not_json").when(~_is(parsed_, "$.coverage", "object"), "no_coverage").when(F.size(missing) > 0, "missing")
        .when(~known, "bad_value").when(~F.coalesce(long_enough, F.lit(False)), "no_rewrite")
    )
