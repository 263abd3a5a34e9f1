"""Model responses: strict JSON to predictions, categories of invalid output, and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import let, normalised_label

EXCERPT = 200


def strict_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, else null."""
    value = F.try_parse_json(text)
    alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    return F.when(alone & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(), value)


def parse_response(text: Column, families: tuple[str, ...]) -> Column:
    """``outcome, fault_family, reason, rules, excerpt`` of a response text."""

    def fields(value: Column) -> Column:
        family = F.try_variant_get(value, "$.fault_family", "variant")
        return F.struct(
            value.isNotNull().alias("parsed"), F.schema_of_variant(value).startswith("OBJECT").alias("is_object"), F.try_variant_get(value, "$.prediction_type", "string").alias("kind"),
            F.when(F.schema_of_variant(family) == "STRING", normalised_label(F.try_variant_get(family, "$", "string"))).alias("label"),
        )

    def reason(f: Column) -> Column:
        return (
            F.when(~f["parsed"], "malformed_json").when(~f["is_object"], "not_an_object").when(f["kind"] == "abstention", "model_abstained")
            .when(F.coalesce(f["kind"] != "diagnosis", F.lit(True)), "unsupported_prediction_type").when(F.coalesce(f["label"] == "", F.lit(True)), "missing_fault_family")
            .when(~f["label"].isin(*families), "unknown_fault_family")
        )

    def prediction(f: Column, why: Column) -> Column:
        outcome = F.when(why.isNull(), "diagnosis").when(why == "model_abstained", "abstention").otherwise("invalid")
        return F.struct(
            outcome.alias("outcome"), F.when(why.isNull(), f["label"]).alias("fault_family"), why.alias("reason"), F.array().cast("array<string>").alias("rules"),
            F.when(outcome == "invalid", F.left(F.coalesce(text, F.lit("")), F.lit(EXCERPT))).alias("excerpt"),
        )

    return let(let(strict_json(text), fields), lambda f: let(reason(f), lambda why: prediction(f, why)))


def invalid_category(reason: Column, excerpt: Column) -> Column:
    """Diagnostic category of an invalid prediction; it never changes a score."""

    def category(text: Column) -> Column:
        count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
        repeats = F.lit(False)
        for period in (1, 2, 3, 4):
            repeats = repeats | ((F.length(text) >= 8 * period) & (F.left(text, F.lit(8 * period)) == F.repeat(F.left(text, F.lit(period)), 8)))
        return (
            F.when(reason.startswith("backend_"), "backend_failure").when(reason == "not_an_object", "non_object_json").when(reason == "missing_fault_family", "missing_required_field")
            .when(reason == "unknown_fault_family", "out_of_schema_value").when(reason == "unsupported_prediction_type", "unsupported_prediction_type")
            .when(text == "", "empty_output").when(repeats, "degenerate_repetition").when(text.startswith("{") & (count("{") > count("}")), "truncated_json")
            .when(text.startswith("{"), "malformed_other").when(F.contains(text, F.lit("{")), "prose_wrapped_json").otherwise("malformed_other")
        )

    return let(F.regexp_replace(F.coalesce(excerpt, F.lit("")), r"(?U)^\s+|\s+$", ""), category)


def response_schema(text: Column, families: tuple[str, ...]) -> Column:
    """Diagnostic validation: what of the schema a response meets."""

    def checked(value: Column) -> Column:
        is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        kind = F.try_variant_get(value, "$.prediction_type", "string")
        family = F.when(kind == "diagnosis", F.coalesce(normalised_label(F.try_variant_get(value, "$.fault_family", "string")).isin(*families), F.lit(False)))
        known = F.coalesce(is_object & kind.isin("diagnosis", "abstention"), F.lit(False))
        return F.struct(value.isNotNull().alias("parsed"), is_object.alias("is_object"), known.alias("type_valid"), family.alias("family_valid"), (known & F.coalesce(family, F.lit(True))).alias("compliant"))

    return let(strict_json(text), checked)


def training_input(observations: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"{instruction}\n\nObservations:\n"), observations, F.lit("\n\nAnswer:\n"))


def training_target(family: Column) -> Column:
    return F.to_json(F.struct(family.alias("fault_family"), F.lit("diagnosis").alias("prediction_type")))


def causal_labels(prefix: Column, target: Column, end: Column, most: int) -> Column:
    """Token ids and labels: the prefix is masked with -100; null if too long (an error, never a cut)."""
    ids = F.concat(prefix, target, F.array(end))
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(prefix)), target, F.array(end))
    return F.when(F.size(ids) <= most, F.struct(ids.alias("input_ids"), labels.alias("labels")))
