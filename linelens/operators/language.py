"""The wording gate: no promise, no proven cause, no machine control."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import q


def _not_negated(pattern: str) -> str:
    """The phrase without any negation in the 16 characters before it (a bounded lookbehind)."""
    before = "|".join(f"{n}.{{0,{fixed.NEGATION_REACH - len(n)}}}" for n in fixed.NEGATIONS)
    return f"(?s)(?={pattern})(?<!{before}){pattern}"


#: Every forbidden phrase holds one of these.
_HINTS = ["will ", "guarante", "cause", "definitely", "ensure"]
_ANY = "|".join(f"(?:{p})" for p in fixed.FORBIDDEN_PHRASES)


def violations(text: Column) -> Column:
    """All positive forbidden phrases in a text. Texts without a hint cost a few plain searches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.concat(*[F.regexp_extract_all(low, F.lit(_not_negated(p)), F.lit(0)) for p in fixed.FORBIDDEN_PHRASES])
    hinted = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in _HINTS])
    return F.when(hinted & low.rlike(_ANY), hits).otherwise(F.array().cast("array<string>"))


def gate_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, violations, allowed) for every text of a table."""
    hits = violations(q(text))
    return df.select(q(key), F.size(hits).alias("violations"), F.array_join(F.array_sort(hits), "|").alias("phrases"))


def validate(recommendations: DataFrame) -> DataFrame:
    """Adds ``errors``: no evidence, machine control, unsupported claims or forbidden wording."""
    statements = F.flatten(F.transform("evidence", lambda e: F.array(e["statement"], e["detail"])))
    texts = F.concat(F.array("title", "why"), statements, F.coalesce("limitations", F.array().cast("array<string>")))
    wording = violations(F.array_join(texts, " \n "))
    errors = F.array_compact(F.array(
        F.when(F.size("evidence") == 0, F.lit("no evidence")),
        F.when(F.col("action_type").isin(fixed.CONTROL_VERBS), F.lit("implies machine control")),
        F.when((F.col("evidence_quality") == "INSUFFICIENT_EVIDENCE") & ~F.col("data_requirement"), F.lit("insufficient evidence without a data requirement")),
        F.when(F.size(wording) > 0, F.concat(F.lit("forbidden wording: "), F.array_join(wording, "|")))))
    return recommendations.withColumn("errors", errors)
