"""What a question asks for: its clauses, and the kinds of evidence it calls for beyond its own words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.text import anchors, folded, terms

# What separates the clauses of a question, unless it is quoted or in brackets.
SEPARATOR = r"and|versus|vs|以及|与|、|,|，|;|；"
#: A text as quotes, brackets, separators, words and other characters.
PARTS = r'(?s)"[^"\n]*"|\x{201c}[^\x{201d}\n]*\x{201d}|\x{2018}[^\x{2019}\n]*\x{2019}|\([^()]*\)|\[[^\[\]]*\]|\x{ff08}[^\x{ff08}\x{ff09}]*\x{ff09}|以及|与|、|[,，;；]|[A-Za-z0-9_]+|.'

# Words that speak of the asking person, ways to ask for advice and for a number, and words of preferences and of time.
PERSONAL = ("i", "me", "my", "mine", "we", "us", "our", "ours")
ADVICE = (
    r"\b(any|some|need|want|your)\s+(advice|suggestions?)\b|\b(can|could|would)\s+you\s+(recommend|suggest|help\s+(me|us)\s+(choose|select|decide))\b"
    r"|\b(what|which|how)\s+should\s+(i|we)\b|^\s*(please\s+)?(recommend|suggest)\b"
)
PREFERENCES = tuple("preference preferences prefer prefers preferred favorite favourite dislike dislikes avoid avoids constraint constraints requirement requirements".split())
COUNTING = r"\bhow\s+many\b|\b(number|count|total)\s+of\b"
COUNT_CONTEXT = tuple("number count total time times last next previous current recent recently today yesterday tomorrow day days week weeks month months year years since until before after ago past within".split())
ACTIONS = {
    "acquisition": tuple("acquire acquired acquires acquiring acquisition acquisitions buy buys buying bought purchase purchases purchased purchasing receive receives received receiving obtain obtains obtained obtaining get got gotten".split()),
    "completion": tuple("complete completes completed completing completion completions finish finishes finished finishing done".split()),
    "attendance": tuple("attend attends attended attending attendance visit visits visited visiting participate participates participated participating".split()),
}
NO_TRIGGER = ("get", "got", "gotten")


def clauses(text: str | Column) -> Column:
    """The clauses of a text, in order: cut at conjunctions and lists, not within quotes or brackets; blank ones are left out."""
    marked = F.transform(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), lambda p: F.when(F.lower(p).isin(*SEPARATOR.split("|")), F.lit("\x01")).otherwise(p))
    cut = F.transform(F.split(F.array_join(marked, ""), "\x01"), lambda c: F.regexp_replace(c, r"^[\s.?？]+|[\s.?？]+$", ""))
    return F.filter(cut, lambda c: F.length(c) > 0)


def topic_forms(words: Column) -> Column:
    """Terms and their singulars where they look like plurals of English words."""

    def both(t: Column) -> Column:
        word = t.rlike("^[a-z]+$")
        n = F.length(t)
        ies = word & (n > 4) & t.endswith("ies")
        plural = word & (n > 3) & t.endswith("s") & ~t.rlike("(ss|us|is)$")
        return F.when(ies, F.array(t, F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))).when(plural, F.array(t, F.substring(t, F.lit(1), n - 1))).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(words, both)))


def facet(text: str | Column) -> Column:
    """One more thing to look for besides the words of a question, or null: name, terms to look for, and groups of which each must be met.

    A question of a person for advice calls for that person's preferences, whatever their topic; a question for a number of things
    bought, completed or attended calls for words of that action together with its topic.
    """
    said = terms(text)
    low = folded(text)
    array = lambda words: F.array(*(F.lit(w) for w in words))
    made = lambda name, front, topic, groups: F.struct(F.lit(name).alias("name"), F.array_distinct(F.concat(array(front), topic)).alias("terms"), groups.alias("groups"))
    own = topic_forms(anchors(text))
    out = F.when(F.arrays_overlap(said, array(PERSONAL)) & low.rlike(ADVICE), made("personal_context", PREFERENCES, own, F.array(array(PREFERENCES))))
    for name, words in ACTIONS.items():
        beside = (*COUNT_CONTEXT, *words)
        topic = topic_forms(F.filter(anchors(text), lambda t: ~t.isin(*beside)))  # noqa: B023
        asked = low.rlike(COUNTING) & F.arrays_overlap(said, array([w for w in words if w not in NO_TRIGGER]))
        out = out.when(asked, F.when(F.size(topic) > 0, made(name, words, topic, F.array(array(words), topic))))
    return out
