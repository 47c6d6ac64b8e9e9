"""Rules on names, claims and messages, as column expressions; what needs Unicode tables is a pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Slots of which one value holds at a time, and words that route an attribute.
EXCLUSIVE = ("choice.model", "config.model", "config.port", "preference.response_style", "preference.ui_theme", "state.service_health")
ATTRIBUTES = (("config.port", r"\bport [0-9]+"), ("preference.ui_theme", r"\b(dark|light) (mode|theme)"), ("state.service_health", r"\b(healthy|unhealthy|down)\b"), ("identity.name", r"\bmy name is\b"), ("choice.model", r"\b(use|switch to) model\b"))


@F.pandas_udf(StringType())
def entity_id(name: pd.Series) -> pd.Series:
    """NFKC, one space for white space, case folded: apply it to distinct names."""
    return name.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


def canonical(name: Column, aliases: Column) -> Column:
    """An alias's entity, else the name; ``aliases`` is a map."""
    return F.coalesce(F.try_element_at(aliases, name), name)


def invalid_subject(name: Column) -> Column:
    """Why a name can't be a subject; null if it can."""
    return (
        F.when(F.trim(name) == "", "empty")
        .when(name.rlike(r"^(/|[A-Za-z]:\\|[.]{1,2}/)"), "path")
        .when(name.rlike(r"^[\w-]+[.](py|js|ts|json|toml|md|txt|html)$"), "file")
        .when(name.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "environment_variable")
        .when(name.rlike(r"^([A-Z][a-z0-9]+){2,}$"), "type_name")
    )


def attribute(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, pattern in ATTRIBUTES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out


def protected(attribute_name: Column) -> Column:
    return F.coalesce((attribute_name == "memory.explicit") | attribute_name.startswith("identity."), F.lit(False))


def confidence_ceiling(confidence: Column, text: Column, most: float = 0.6) -> Column:
    """Statements that are not settled have a limited confidence."""
    return F.when(F.lower(text).rlike(r"\b(maybe|perhaps|might|probably|planning to|considering)\b"), F.least(confidence, F.lit(most))).otherwise(confidence)


def admission(kind: Column, confidence: Column, secret: Column, low_value: Column) -> Column:
    """The first reason not to admit a claim, else ``admit``."""
    return (
        F.when(~kind.isin("fact", "preference", "state", "plan"), "kind")
        .when(confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1), "confidence")
        .when(secret.isNotNull(), F.concat(F.lit("secret:"), secret))
        .when(low_value.isNotNull(), F.concat(F.lit("low_value:"), low_value))
        .otherwise("admit")
    )


def pre_filter(text: Column) -> Column:
    """Deterministic skips before extraction: notices, control frames, transient results, narration, status questions."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(low.rlike(r"^\[(system|runtime|notice)\]"), "runtime_notice")
        .when(low.rlike(r"^<(tool|function)[a-z_]*>"), "control_frame")
        .when(low.rlike(r"^(error|exception|traceback|exit code)\b"), "transient_error")
        .when(low.rlike(r"^(let me|i will now|now i)\b"), "narration")
        .when(low.rlike(r"^(is it|are we|status)\b.*[?]$"), "status_question")
    )


def contains_literal(text: Column, literal: str) -> Column:
    """A literal in any ASCII case, whatever signs it holds."""
    return F.contains(F.lower(text), F.lit(literal.lower()))


# What a message says of its writer or of a service, in the order in which the rules are tried.
EXTRACTION = (
    (r"现在(?:用|使用)\s*(.+?)(?:[。！!]|$)", "preference"),
    (r"我喜欢\s*(.+?)(?:[。！!]|$)", "preference"),
    (r"记住\s*(.+?)(?:[。！!]|$)", "explicit_memory"),
    (r"使用\s*(.+?)(?:[。！!]|$)", "uses"),
    (r"(.+?现在挂了)(?:[。！!]|$)", "service_status"),
)
NOW, DOWN = "现在", "现在挂了"


def extracted(text: Column) -> Column:
    """The fact of the first rule that matches: predicate, value, how long it holds and whether it changes a state; or null."""
    fact = F.lit(None)
    for pattern, predicate in reversed(EXTRACTION):
        value, status = F.trim(F.regexp_extract(text, pattern, 1)), predicate == "service_status"
        service = F.coalesce(F.nullif(F.trim(F.regexp_replace(value, f"{DOWN}$", "")), F.lit("")), F.lit("unknown")) if status else F.lit(None).cast("string")
        made = F.struct(
            F.lit(predicate).alias("predicate"), value.alias("value"), service.alias("service"), F.lit("ephemeral" if status else "stable").alias("volatility"),
            F.lit("temporal" if status else "permanent").alias("scope"), (F.lit(status) | text.startswith(NOW)).alias("state_change"),
        )
        fact = F.when(text.rlike(pattern), made).otherwise(fact)
    return fact
