"""Language pairs, delivery states, searches and punctuation as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SOURCES, TARGETS = ("en", "ja", "ko"), ("zh-CN",)


def language_pair(source: Column, target: Column) -> Column:
    """Struct of source and target language; en and zh-CN where one is null; null where one isn't supported."""
    s = F.coalesce(F.lower(F.trim(source)), F.lit(SOURCES[0]))
    t = F.coalesce(F.trim(target), F.lit(TARGETS[0]))
    return F.when(s.isin(*SOURCES) & t.isin(*TARGETS), F.struct(s.alias("source_language"), t.alias("target_language")))


def delivery_state(risk_rate: Column, required_rate: Column, required: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.when((zero(risk_rate) >= 0.8) & (zero(required_rate) >= 0.5), "source_unreliable").when(zero(required) > 0, "review_required").otherwise("deliverable")


def mentions(query: str, *texts: Column) -> Column:
    """Whether the texts, one after another, hold what is asked for, case aside."""
    return F.lower(F.concat_ws(" ", *texts)).contains(query.strip().lower())


def is_unresolved(required: Column, state: Column) -> Column:
    return required & state.isin("pending", "review", "failed")


def full_width(text: Column) -> Column:
    """Chinese punctuation: commas, stops outside numbers, exclamation and question marks, colons and semicolons; none at the end."""
    steps = (
        (r"^\s+|\s+$", ""), (r"[.。]+$", ""), (r",\s*", "，"), (r"(?<!\d)\.(?!\d)\s*", "。"), (r"!\s*", "！"), (r"\?\s*", "？"), (r":\s*", "："), (r";\s*", "；"), (r"\.\.\.", "…"), (r"[.。]{3,}", "…"),
        ("！{2,}", "！"), ("？{2,}", "？"), ("[，。；：！？、]+$", ""), (r"^\s+|\s+$", ""),
    )
    return F.when(text.rlike(r"\S"), reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)).otherwise(text)
