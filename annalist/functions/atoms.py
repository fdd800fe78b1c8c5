"""Statements of persons about themselves, as (predicate, modality, retention, value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = r"([A-Z][a-z]+(?: [A-Z][a-z]+)?|[\x{4e00}-\x{9fff}]{2,4})"
_WAY = r"([A-Za-z ]{3,30}|[\x{4e00}-\x{9fff}]{2,8})"
#: predicate, modality, retention and the pattern a whole sentence has; its group is the value. The first that fits counts.
RULES = (
    ("home_city", "negated", "transient", rf"I (?:do not|don't) live in {_PLACE}"),
    ("home_city", "negated", "transient", rf"我(?:现在|目前)?不住在{_PLACE}"),
    ("home_city", "planned", "transient", rf"I (?:might|plan to|will) move to {_PLACE}(?: next (?:week|month|year))?"),
    ("home_city", "planned", "transient", rf"我(?:计划|可能|打算)(?:下周|下个月|明年)?搬到{_PLACE}"),
    ("home_city", "asserted", "durable", rf"(?:I (?:currently |now )?live in|[Mm]y home city is|[Hh]ome city is|I moved to) {_PLACE}(?: now| last (?:week|month|year).*)?"),
    ("home_city", "asserted", "durable", rf"我(?:现在|目前)?住在{_PLACE}"),
    ("answer_style", "asserted", "transient", rf"(?:For this (?:reply|answer), (?:please )?|This time )answer in {_WAY}"),
    ("answer_style", "asserted", "transient", rf"(?:这次|今天)(?:请)?用{_WAY}回答"),
    ("answer_style", "asserted", "durable", rf"(?:Always|From now on) answer in {_WAY}(?: when .*)?"),
    ("answer_style", "asserted", "durable", rf"(?:以后|始终)(?:请)?用{_WAY}回答"),
    ("answer_style", "asserted", "session", r"Please be (concise|brief|thorough)"),
)
#: What ends a sentence.
ENDS = r"[.。!！?？;；\n]+"


def sentences(text: str | Column) -> Column:
    """The sentences of a text without outer blanks; blank ones are left out."""
    return F.filter(F.transform(F.split(text, ENDS), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def statement(sentence: str | Column) -> Column:
    """What a sentence states, or null: predicate, modality, retention, value."""
    sentence = F.col(sentence) if isinstance(sentence, str) else sentence
    out = F.lit(None)
    for predicate, modality, retention, pattern in reversed(RULES):
        made = F.struct(F.lit(predicate).alias("predicate"), F.lit(modality).alias("modality"), F.lit(retention).alias("retention"), F.trim(F.regexp_extract(sentence, f"^{pattern}$", 1)).alias("value"))
        out = F.when(sentence.rlike(f"^{pattern}$"), made).otherwise(out)
    return out
