"""Terms, anchors, token estimates, digests: text functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what the analyzer keeps of a text, runs of ASCII letters and digits and runs of Han characters.
RUNS = r"[a-z0-9]+|[\x{3400}-\x{9fff}]+"
# Words that say nothing about a topic, words that negate, and signs that quote.
FUNCTION_WORDS = tuple("""
a an the what when where who whom whose which why how much many often
do does did is are am was were be being been have has had
can could may might must shall should will would
i me my mine myself you your yours yourself yourselves
he him his himself she her hers herself it its itself
we us our ours ourselves they them their theirs themselves
this that these those any all some each every both either another
at in on to from for of by with about as into onto over under than
through between during up down out and or but if because while so
there here then now ever s d ll m re ve t
""".split())
NEGATIONS = ("no", "not", "never", "without", "neither", "nor", "none", "nobody", "nothing", "nowhere")
ARTICLES = ("a", "an", "the")
QUOTED = r'"[^"\n]+"|\x{201c}[^\x{201d}\n]+\x{201d}|\x{2018}[^\x{2019}\n]+\x{2019}'


def folded(text: str | Column) -> Column:
    """Lower case with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def terms(text: str | Column) -> Column:
    """The terms of a text in no particular order, repeats kept: ASCII runs; of Han runs each character and each pair.

    Empty for texts without any, null for null.
    """

    def of_run(run: Column) -> Column:
        n = F.length(run)
        singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(run, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run < "\u3400", F.array(run)).when(n == 1, singles).otherwise(F.concat(singles, pairs))

    return F.flatten(F.transform(F.regexp_extract_all(folded(text), F.lit(RUNS), F.lit(0)), of_run))


def anchors(text: str | Column) -> Column:
    """The distinct terms of a query that tell its topic, in order of appearance: no function words, negations or bare numbers.

    Words in quotes are kept whatever they are, but for an article that stands beside others.
    """

    def kept_in(quote: Column) -> Column:
        words = terms(quote)
        plain = F.filter(words, lambda t: ~t.isin(*ARTICLES))
        return F.when(F.size(plain) > 0, plain).otherwise(words)

    column = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")
    quoted = F.when(column.rlike('["\u201c\u2018]'), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), kept_in))).otherwise(none)
    topical = lambda t: ~t.isin(*FUNCTION_WORDS, *NEGATIONS) & ~t.rlike("^[0-9]+$")
    # within the outer transform so that it is computed once a text, not once a term
    kept = F.transform(F.array(quoted), lambda q: F.filter(F.array_distinct(terms(text)), lambda t: topical(t) | (F.size(q) > 0) & F.array_contains(q, t)))
    return F.when(column.isNotNull(), kept[0])


def token_estimate(text: str | Column) -> Column:
    """About how many tokens a text has: a quarter of its ASCII characters, rounded up, and every other one; at least 1, also for null."""
    text = F.col(text) if isinstance(text, str) else text
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.greatest(F.lit(1), F.ceil((F.length(text) - other) / 4).cast("int") + other)


def clipped(text: str | Column, most: int) -> Column:
    """White space collapsed, cut to most characters with an ellipsis as the last."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most - 1), F.lit("…")))


def alias_key(text: str | Column) -> Column:
    """A name as it is looked up: lower case, white space collapsed, no outer blanks."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def digest(*columns: str | Column) -> Column:
    """SHA-256 of the values, which are kept apart and told from null: each is preceded by its length, null by '-'."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in (F.col(x) if isinstance(x, str) else x for x in columns)]
    return F.sha2(F.concat(*parts), 256)
