"""Personal information in free text: find it behind its disguises, and replace it with typed placeholders.

A text passes through transducers that undo disguises (full-width and look-alike letters, invisible characters,
spelled-out digits, "(at)" and "[dot]"), each of which keeps for every character it writes the span of source characters it
stands for. Identifiers are detected in the normal form, and their spans are mapped back, so that a replacement
touches exactly the source characters of the mention and nothing else.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "id_number", "phone", "address", "name")
#: A lexicon of more terms than this is refused, as it is sent to every task.
MOST_TERMS = 100_000
#: Texts of at most so many characters are remembered with their mentions.
SHORT = 500
#: A word of more characters is no part of a name.
LONGEST_NAME = 60

# Letters that look like Latin ones, and what they look like.
_LOOKALIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονіıɡ", "ABESIJKMHOPCTYXaeijopcyxsdhqwABEZHIKMNOPTYXoving"[:47], strict=False))
_LOOKALIKE.update({"ı": "i", "ɡ": "g", "і": "i", "ο": "o", "ν": "v"})
# Letters that look like Latin ones less closely; they count as such in words that have Latin letters too.
_IN_MIXED_WORDS = {
    ord(pair[0]): pair[1]
    for pair in (
        "вb гr дd зz иu йu кk лn мm нh пn тt цu чy ьb ёe їi ґr ѵv ӏl "
        "αa βb γy δd εe ζz ηn θo ιi κk λl μu πn ρp σo ςs τt υu φo χx ψy ωw "
        "օo սu ոn հh ցg զq յj ɑa ɩi ɪi ʏy ʀr ɴn ʟl ʜh ɢg ʙb ᴀa ᴄc ᴅd ᴇe ᴊj ᴋk ᴍm ᴏo ᴘp ᴛt ᴜu ᴠv ᴡw ᴢz"
    ).split()
}
# Dashes, blanks and signs written in other ways, and characters that cannot be seen.
_SIGNS = {**dict.fromkeys("‐‑‒–—−﹣", "-"), **dict.fromkeys("              ", " "), "’": "'", "‘": "'", "﹫": "@", "．": ".", "｡": "."}
_UNSEEN = "­​‌‍‎‏⁠⁡⁢⁣﻿᠎͏"
# Words for digits, and for saying one twice or three times.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_TIMES = {"double": 2, "triple": 3, "treble": 3, "doppelt": 2, "zweimal": 2, "dreimal": 3}
_HAN_DIGITS = dict(zip("零〇幺一二三四五六七八九", "001123456789", strict=True))
# Words for the signs of an address. The last list has those that can stand without brackets.
_AT_WORDS = "at|ät|arobase|klammeraffe|chez|艾特"
_DOT_WORDS = "dot|punkt|point|点"
_BARE_AT = "at|ät|arobase|klammeraffe"


class _Fold(dict):
    """Each character as the one it stands for: compatibility forms, digits of any script, look-alikes, signs.

    One for one, so that positions stay what they are. Superscripts and subscripts are left, as they aren't part of a number.
    """

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        out = _LOOKALIKE.get(ch) or _SIGNS.get(ch)
        if out is None:
            out = ch
            raised = unicodedata.decomposition(ch).startswith(("<super>", "<sub>"))
            digit = unicodedata.digit(ch, None)
            plain = unicodedata.normalize("NFKC", ch)
            if digit is not None and not raised:
                out = str(digit)
            elif len(plain) == 1 and plain.isascii() and not raised:
                out = plain
        self[code] = out
        return out


_FOLD = _Fold()
_HAS_UNSEEN = re.compile(f"[{_UNSEEN}]").search
_LIGATURE = re.compile("[ﬀ-ﬄ]")
_HAS_MIXED = re.compile(f"[{''.join(map(chr, _IN_MIXED_WORDS))}]").search
_TOKEN = re.compile(r"[^\s,;:()<>\[\]]+")
_HAS_LATIN = re.compile("[A-Za-z]").search
_A_DIGIT_WORD = rf"(?<![^\W\d_])(?:{'|'.join(_DIGIT_WORDS)})(?![^\W\d_])"
_SPOKEN = rf"(?:(?<![^\W\d_])(?:{'|'.join(_TIMES)})[\s-]+)?{_A_DIGIT_WORD}"
_WORD_RUN = re.compile(rf"(?:{_SPOKEN}|(?<![\w.])\d{{1,4}}(?=[\s,.-]+(?:{_SPOKEN}|\d{{1,4}}[\s,.-]+{_SPOKEN})))(?:[\s,.-]+(?:{_SPOKEN}|\d{{1,5}}(?![\w])))+", re.I)
_SPOKEN_ITEM = re.compile(rf"(?:({'|'.join(_TIMES)})[\s-]+)?({'|'.join(_DIGIT_WORDS)}|\d+)", re.I)
_HAN_RUN = re.compile(f"(?:[{''.join(_HAN_DIGITS)}][ -]?|[0-9](?=[0-9 -]*[{''.join(_HAN_DIGITS)}])|(?<=[{''.join(_HAN_DIGITS)}])[0-9]+[ -]?){{7,}}")
_BRACKETED = re.compile(rf"(?<!\s)\s*[(\[{{<]\s*(?:({_AT_WORDS})|({_DOT_WORDS}))\s*[)\]}}>]\s*", re.I)
_AT = rf"\s*[(\[{{<]\s*(?:{_AT_WORDS}|@)\s*[)\]}}>]\s*|\s+(?:{_BARE_AT})\s+|\s*艾特\s*|\s*@\s*"
_DOT = rf"\s*[(\[{{<]\s*(?:{_DOT_WORDS}|\.)\s*[)\]}}>]\s*|\s+(?:dot|punkt|point)\s+|\s*点\s*|\."
_ADDRESS_LIKE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9_%+-]*(?:(?:{_DOT})[A-Za-z0-9_%+-]+)*?({_AT})[A-Za-z0-9-]+((?:(?:{_DOT})[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])", re.I)
_A_DOT = re.compile(_DOT, re.I)
_MAY_BE_AT = re.compile(rf"@|艾特|\b(?:{_BARE_AT}|chez)\b", re.I).search
# What is said before an address that is spelled with nothing but "at".
_OF_AN_ADDRESS = re.compile(r"(?:e-?mails?|mailbox|mail|write|reach|contact|courriel|adresse|écri\w+|schreib\w*|kontakt\w*|邮箱|邮件)(?:[\s:：=,-]|\b(?:address|is|to|the|my|lautet|an|ist|à|est|mon|meine)\b|是|地址)*$", re.I)
# Words that are no mailbox, though they stand before "at".
_NO_MAILBOX = frozenset("me us you him her it them this that here there am is are was were be been look arrive meet call now again available".split())


def _asked_for(text: str, m: re.Match) -> bool:
    """Whether something before an address that is spelled with a bare "at" speaks of one, and it doesn't go on as another."""
    if text[m.start() : m.start(1)].lower() in _NO_MAILBOX or re.match(rf"[\w.+-]*(?:{_AT})", text[m.end() :], re.I):
        return False
    return bool(_OF_AN_ADDRESS.search(text[max(0, m.start() - 40) : m.start()]))


def _spelled_signs(text: str) -> Iterator[tuple[int, int, str]]:
    """The spelled or bracketed signs of what reads like an e-mail address.

    Signs may be disguised each in its own way. An address whose dots are plain goes no further than these; one whose only
    disguise is a bare "at" or a blank beside the sign counts where something speaks of an address before it.
    """
    for m in _ADDRESS_LIKE.finditer(text):
        at, start = m[1], m.start(1)
        dots = list(_A_DOT.finditer(text, m.start(2), m.end()))
        plain = dots[0][0] == "."
        if plain and (at == "@" or not re.search(r"[(\[{<艾]", at) and not _asked_for(text, m)):
            continue
        last = text[dots[-1].end() : m.end()]
        if plain:
            dots = list(dict.fromkeys(dots[: next((k for k, x in enumerate(dots) if x[0] != "."), len(dots))]))
            last = text[dots[-1].end() : m.end()]
            last = re.match("[A-Za-z0-9-]*", last)[0]
        if not re.fullmatch("[A-Za-z]{2,}", last):
            continue
        if at != "@":
            yield start, m.end(1), "@"
        for x in [*_A_DOT.finditer(text, m.start(), start), *dots]:
            if x[0] != ".":
                yield *x.span(), "."


def _spoken_digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Numbers that are said in words, or in words and digits: six words or more, or seven digits of which two are said."""
    for m in _WORD_RUN.finditer(text):
        items = list(_SPOKEN_ITEM.finditer(m[0]))
        digits = [_DIGIT_WORDS.get(i[2].lower(), i[2]) * _TIMES.get((i[1] or "").lower(), 1) for i in items]
        said = sum(not i[2].isdigit() for i in items)
        if said < 2 or sum(map(len, digits)) < (6 if said == len(items) else 7):
            continue
        end = 0
        for i, new in zip(items, digits, strict=True):
            if i.start() > end:
                yield m.start() + end, m.start() + i.start(), ""
            if not i[2].isdigit():
                yield m.start() + i.start(), m.start() + i.end(), new
            end = i.end()


def normal_form(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """The text without disguises, and for each of its characters the source span it stands for (None: the same)."""
    edits: list[tuple[int, int, str]] = []
    folded = text
    if not text.isascii():
        folded = text.translate(_FOLD)
        if _HAS_MIXED(folded):
            folded = _TOKEN.sub(lambda m: m[0].translate(_IN_MIXED_WORDS) if not m[0].isascii() and _HAS_LATIN(m[0]) else m[0], folded)
        if _HAS_UNSEEN(folded):
            edits += [(i, i + 1, "") for i, ch in enumerate(folded) if ch in _UNSEEN]
        edits += [(m.start(), m.end(), unicodedata.normalize("NFKC", m[0])) for m in _LIGATURE.finditer(folded)]
        for m in _HAN_RUN.finditer(folded):
            if sum(ch in _HAN_DIGITS for ch in m[0]) >= 3:
                edits += [(i, i + 1, _HAN_DIGITS[folded[i]]) for i in range(*m.span()) if folded[i] in _HAN_DIGITS]
    if "(" in folded or "[" in folded or "{" in folded or "<" in folded:
        edits += [(*m.span(), "@" if m[1] else ".") for m in _BRACKETED.finditer(folded)]
    if _MAY_BE_AT(folded):
        edits += _spelled_signs(folded)
    edits += _spoken_digits(folded)
    if not edits:
        return folded, None
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for a, b, new in sorted(edits):
        if a < at:
            continue
        out.append(folded[at:a])
        spans += [(i, i + 1) for i in range(at, a)]
        if new:
            out.append(new)
            spans += [(a, b)] * len(new)
        at = b
    out.append(folded[at:])
    spans += [(i, i + 1) for i in range(at, len(folded))]
    return "".join(out), spans


_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")
_VERSION = re.compile(r"@(?:\d+\.)+[A-Za-z]+$")

# Words before a number that say it is one of a thing, not of a person (fixed values).
_OF_A_THING = re.compile(r"(?:trace|run|run id|build|ticket|checksum|version|commit|order|batch|job|span|request|inc|issue|session|event|rows?)[\s:#№=-]*(?:id|no\.?|number)?[\s:#=-]*$", re.I)
_PERSONAL = r"(?:passport|passeport|reisepass\w*|pass(?:nummer|-nr)?|ausweis\w*|personalausweis\w*|ssn|social security|national id|id card|identity|steuer-?id\w*|steuernummer|tax|tin|nino|national insurance|sécurité sociale|identité|carte d'identité|nir|sozialversicherung\w*|身份证|护照|证件|税号|社保|纳税)"
_OF_A_PERSON = re.compile(_PERSONAL + r"[^\n.;!?。！？]{0,28}$", re.I)
#: The same with nothing but connecting words between it and the number.
_ITS_NUMBER = re.compile(_PERSONAL + r"(?:[\s:：#=,-]|no\.?|nr\.?|num(?:ber|mer|éro)?|n°|is|are|lautet|est|ist|号码|号|是|为|card|code|my|the)*$", re.I)
_ID = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?P<ssn>\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})"
    r"|(?P<cn>\d{17}[\dXx])"
    r"|(?P<fr>[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2})"
    r"|(?P<tax>\d{2} \d{3} \d{3} \d{3})"
    r"|(?P<nino>[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d])"
    r"|(?P<pass>[A-Z]\d{8})"
    r"|(?P<frpass>\d{2}[A-Z]{2}\d{5})"
    r"|(?P<other>(?=[A-Z0-9 /-]*\d)[A-Z0-9](?:[ /-]?[A-Z0-9]){6,19})"
    r")(?![\w-]|\.\d)",
    re.A,
)
_PHONE = re.compile(r"(?<![\w.+/-])(?<![0-9A-Za-z]:)(?:\+ ?|\(\+|00)?\(?\d(?:[ \t().\-/]{0,3}\d){6,15}(?:\s*(?:ext\.?|x|extension|durchwahl|poste|转|分机)\s*\d{1,6})?(?!\w|[./-]\d|-[A-Za-z])", re.I | re.A)
_US_PHONE = re.compile(r"(?:\+?1[-. ]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[-. ])\d{3}[-. ]\d{4}")
_OF_A_PHONE = re.compile(r"(?<![A-Za-z])(?:tel|tél|phone|telephone|telefon|téléphone|mobile|mobil|handy|cell|fax|call me|call|text|ruf mich|ruf|anrufen|number is|appelez|joindre|电话|手机|拨打|致电|联系电话|传真)(?![a-z])\.?[^\n.;!?。！？\d]{0,16}$", re.I)

# Kinds of streets.
_EN_STREETS = "street|st|road|rd|lane|ln|close|way|avenue|ave|drive|dr|court|ct|terrace|row|place|pl|square|sq|crescent|boulevard|blvd|gardens|mews|walk|hill|grove|parade|highway|parkway"
_FR_STREETS = "rue|avenue|av|boulevard|bd|impasse|place|chemin|allée|allées|quai|route|cours|passage|square|sentier|ruelle"
_ES_STREETS = "calle|avenida|avda\\.|plaza|paseo|camino|via|viale|piazza|corso|rua|travessa|praça"
_ADDRESS = re.compile(
    r"(?<![\w-])(?:"
    rf"(?:(?:[Ff]lat|[Aa]pt\.?|[Aa]partment|[Uu]nit|[Ss]uite|FLAT) \d+[A-Za-z]?, )?\d{{1,5}}[A-Za-z]?,? (?:[A-ZÀ-Þ][\w'’-]* ){{1,4}}(?i:{_EN_STREETS})(?![\w'’-])(?:(?<=Rd|St|Ln|Dr|Ct|Pl|Sq)\.|(?<=Ave)\.)?(?:, [A-ZÀ-Þ][\w'’-]+(?: [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}(?!\w)|,? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?(?!\w)| \d{{4,6}})?)?"
    rf"|\b(?i:{_ES_STREETS}) (?:(?i:de las|de los|de la|della|dei|del|de|da|do|di) )?(?:[A-ZÀ-Þ][\w'’-]* ?){{1,3}}(?:,| n[.º°]?)? ?\d{{1,4}}(?!\w)(?:, (?:\d{{4,5}} )?[A-ZÀ-Þ][\w'’-]+)?"
    rf"|\d{{1,4}}(?: ?(?i:bis|ter|quater))?,? (?i:{_FR_STREETS})\.? (?:(?i:de la|de l'|du|des|de|d'|l'|la|le|les) ?)?[A-ZÀ-Þ][\w'’-]*(?: (?!\d)[A-ZÀ-Þ][\w'’-]+)?(?:, (?:\d{{5}} )?[A-ZÀ-Þ][\w'’-]+)?"
    r"|(?:(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Alter?|Neue?r?) )?[A-ZÄÖÜ][a-zäöüß-]*(?i:straße|strasse|str\.|weg|platz|gasse|allee|ufer|damm|ring|steig|stieg)(?:\s?\d{1,4} ?[a-z]?)(?!\w)(?:, \d{5} [A-ZÄÖÜ][\w-]+)?"
    r"|[A-ZÄÖÜ][a-zäöüß]+(?:er)? (?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ufer|Damm|Ring) \d{1,4} ?[a-z]?(?!\w)(?:, \d{5} [A-ZÄÖÜ][\w-]+)?"
    r")"
    r"|(?:(?![在到往于是])[一-鿿]{2,3}[市省])?(?:[一-鿿]{2}[区县])?[一-鿿]{2}(?:大道|胡同|路|街|巷|弄堂)\d{1,5}(?:弄\d+)?号(?:\d+(?:栋|幢|单元|号楼|楼|室|层|座))*",
)
_HAS_STREET = re.compile(rf"(?i:{_EN_STREETS}|{_FR_STREETS}|{_ES_STREETS}|stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ufer|damm|ring|ste?ieg|steig)(?![a-zà-ÿ])|[路街巷道同堂]\d")

# Titles, before a name or after one.
_TITLES = frozenset("dr mr mrs ms miss prof professor sir madam herr frau mme mlle monsieur madame fr hr dipl-ing".split())
_WORD = re.compile(r"[A-ZÀ-Þ][A-Za-zÀ-ÿ'-]*\.?|[a-zà-ÿ]+")
_CAPITAL = re.compile(r"(?<![A-Za-zÀ-ÿ0-9@_./-])[A-ZÀ-Þ](?:[A-Za-zÀ-ÿ]*(?:['-][A-ZÀ-Þ][A-Za-zÀ-ÿ]+)*)(?![A-Za-zÀ-ÿ0-9_@])")
# What a person's name follows, in whatever parts: someone introduces themselves, signs, is asked for, or has a task.
_INTRODUCED = re.compile(
    r"(?:(?:[Mm]y|[Hh]is|[Hh]er|[Tt]heir) name is|I am|I'm|[Mm]ein Name ist|[Ii]ch hei(?:ß|ss)e|[Ii]ch bin|[Jj]e m'appelle|[Jj]e suis|[Mm]on nom est"
    r"|[Ss]igned,|(?:[Rr]egards|[Ss]incerely|[Cc]heers|[Yy]ours|Gr(?:uß|üße|üßen)|[Cc]ordialement|[Ss]alutations),"
    r"|(?:[Aa]ssigned|[Hh]anded|[Ee]scalated) to|[Ww]ritten by|[Aa]pproved by|[Nn]ote (?:is|came) from|[Zz]uständig (?:ist|bleibt)|[Ff]ragen Sie|[Vv]erantwortlich ist|[Dd]emandez à|[Pp]révenez|[Cc]ontactez|[Rr]esponsable :"
    r"|我叫|我是|名字是|负责人[:：]|(?:请|可以)?联系|(?:昨天|今天|刚才)由?) ?$"
)
# Capitalised words that begin sentences or stand in headings, and are no part of a name.
_NOT_A_NAME = frozenset("The A An I We You He She It They This That And Or But If When Who What Why How Nothing Thanks Please Step Batch From Do Let Keep Only My Our No Yes Ich Wir Der Die Das Nur Eine Bitte Wer Warum Seit Je Nous Le La Les Une Il Qui Rien Depuis Retenez Call Phone Tel Meet Ship Contact Kontakt Adresse Lieferung Team".split())
# Characters that do not begin a Chinese name, and those that do not continue one.
_NOT_FAMILY = frozenset("我你他她它们叫是的了在和与同由让给向找请联系人天为到来去说问及或：，。、！？；")
_NOT_GIVEN = frozenset("的了在是和与会提先女同由让给向说问及或已将有没不我你他她它们")


# Where a Chinese name stands whose parts need not be known: after an introduction and before a title, something done or
# an end, or at the beginning as who has a task (fixed values).
_HAN_TITLE = "先生|女士|小姐|老师|博士|教授"
_HAN_DOES = "(?:会|将|已|来)?(?:提交|复核|审核|负责|确认|批准|回复|处理)"
_HAN_INTRODUCED = re.compile(rf"(?:(?:我叫|名字是|(?:请|可以)联系|负责人[:：] ?|昨天|今天|刚才)(?=[一-鿿]{{2,4}}?(?:{_HAN_TITLE}|{_HAN_DOES}|[。，！,!\s]|$))|(?:^|(?<=[\s。！？，,!?]))(?=[一-鿿]{{2,3}}(?:会|将)(?:提交|复核|审核|负责|确认|批准|回复|处理)))([一-鿿]{{2,4}}?)(?={_HAN_TITLE}|{_HAN_DOES}|[。，！,!\s]|$)")


class Lexicon:
    """Which words are parts of personal names: the known terms, and words put together as several of them are.

    A word counts as a part of a kind too if it splits into a beginning and an ending that each occur in at least
    three terms of that kind, as the lexicon isn't complete.
    """

    def __init__(self, terms: Iterable[tuple[str, str]]) -> None:
        self.known: dict[str, set[str]] = {"given": set(), "family": set()}
        for term, part in terms:
            if term and part in self.known:
                self.known[part].add(term.strip())
        self.han = {part: {t for t in words if not t.isascii() and "㐀" <= t[0] <= "鿿"} for part, words in self.known.items()}
        heads: dict[str, dict[str, set[str]]] = {}
        tails: dict[str, dict[str, set[str]]] = {}
        self.lower = {part: {t.lower() for t in words} for part, words in self.known.items()}
        for part, words in self.lower.items():
            heads[part], tails[part] = {}, {}
            for w in words - self.han[part]:
                for i in range(2, len(w) - 1):
                    heads[part].setdefault(w[:i], set()).add(w)
                    tails[part].setdefault(w[i:], set()).add(w)
        self.heads = {p: {k for k, v in d.items() if len(v) >= 3} for p, d in heads.items()}
        self.tails = {p: {k for k, v in d.items() if len(v) >= 3} for p, d in tails.items()}
        families = "".join(re.escape(t) for t in self.han["family"] if len(t) == 1)
        givens = "|".join(map(re.escape, sorted(self.han["given"], key=len, reverse=True)))
        options = [f"[一-鿿](?:{givens})"] if givens else []
        options += [f"[{families}][一-鿿]{{1,2}}"] if families else []
        self.han_name = re.compile("|".join(options)) if options else None
        self.part = lru_cache(200_000)(self._part)

    def _part(self, word: str) -> str:
        """'g', 'f', 'gf' or '' for a capitalised Latin word; of a double name all parts must fit."""
        if len(word) > LONGEST_NAME:
            return ""
        kinds = [self._simple(w) for w in word.lower().split("-")]
        return "".join(k for k in "gf" if all(k in x for x in kinds))

    def _simple(self, w: str) -> str:
        out = ""
        for k, part in (("g", "given"), ("f", "family")):
            if w in self.lower[part] or any(w[:i] in self.heads[part] and w[i:] in self.tails[part] for i in range(2, len(w) - 1)):
                out += k
        return out


def _looks_dated(number: str) -> bool:
    return "1900" <= number[6:10] <= "2029" and "01" <= number[10:12] <= "12" and "01" <= number[12:14] <= "31"


class Scanner:
    """Finds mentions in one text at a time; make one per task."""

    def __init__(self, terms: Iterable[tuple[str, str]]) -> None:
        self.lexicon = Lexicon(terms)
        self._short = lru_cache(20_000)(self._mentions)

    def mentions(self, text: str) -> tuple[tuple[str, int, int], ...]:
        """What _mentions finds. Short texts are remembered, as many are repeated; so what is held is of bounded size."""
        return self._short(text) if len(text) <= SHORT else self._mentions(text)

    def _mentions(self, text: str) -> tuple[tuple[str, int, int], ...]:
        """(kind, start, end) in source characters, in order, not overlapping."""
        norm, spans = normal_form(text)
        found: list[tuple[int, int, str]] = []

        def take(kind: str, hits: Iterable[tuple[int, int]]) -> None:
            nonlocal norm
            for a, b in hits:
                found.append((a, b, kind))
                norm = norm[:a] + "\x00" * (b - a) + norm[b:]

        if "@" in norm:
            take("email", [m.span() for m in _EMAIL.finditer(norm) if not _VERSION.search(m[0])])
        digits = any(ch in norm for ch in "0123456789")
        if digits:
            if _HAS_STREET.search(norm):
                take("address", [m.span() for m in _ADDRESS.finditer(norm)])
            take("id_number", self._ids(norm))
            take("phone", self._phones(norm))
        take("name", self._names(norm))
        found.sort()
        if spans is None:
            return tuple((k, a, b) for a, b, k in found)
        return tuple((k, spans[a][0], spans[b - 1][1]) for a, b, k in found)

    @staticmethod
    def _ids(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while m := _ID.search(text, at):
            at = m.end()
            kind, before = m.lastgroup, text[max(0, m.start() - 60) : m.start()]
            person = _OF_A_PERSON.search(before)
            if _OF_A_THING.search(before) and not _ITS_NUMBER.search(before):
                continue
            number = m[0].replace(" ", "")
            if kind == "ssn" or kind in ("nino", "frpass", "pass") and (person or " " not in m[0]):
                ok = True
            elif kind == "cn":
                ok = bool(person) or _looks_dated(number)
            elif kind == "fr":
                ok = len(number) == 15 and (bool(person) or " " in m[0])
            else:
                ok = bool(_ITS_NUMBER.search(before)) and sum(c.isdigit() for c in number) >= 6
            if ok:
                yield m.span()
            elif kind == "other":
                at = m.start() + max(1, len(re.match(r"\w+", m[0], re.A)[0]))

    @staticmethod
    def _phones(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while m := _PHONE.search(text, at):
            number = m[0]
            before = text[max(0, m.start() - 40) : m.start()]
            main = re.split(r"(?i)\s*(?:ext|x|durchwahl|poste|转|分机)", number)[0]
            n = sum(c.isdigit() for c in main)
            plain = main.isdigit()
            if us := _US_PHONE.match(text, m.start()):
                # a number that goes on after ten digits is no such number, unless it's an extension
                yield m.start(), max(us.end(), m.end() if n <= 11 else us.end())
                at = max(us.end(), m.end() if n <= 11 else us.end())
                continue
            at = m.end()
            if _OF_A_THING.search(before):
                continue
            if number.lstrip("(").startswith("+"):
                ok = 8 <= n <= 15
            elif main.startswith("00"):
                ok = 9 <= n <= 16 and (not plain or bool(_OF_A_PHONE.search(before)))
            elif main.lstrip("(").startswith("0"):
                ok = 9 <= n <= 12
            else:
                ok = 7 <= n <= 13 and bool(_OF_A_PHONE.search(before)) or plain and n == 11 and main[0] == "1" and main[1] in "3456789"
            if ok:
                yield m.span()

    def _names(self, text: str) -> Iterator[tuple[int, int]]:
        part = self.lexicon.part
        words = [m for m in _CAPITAL.finditer(text)]
        i, n = 0, len(words)
        while i < n:
            m = words[i]
            w, a = m[0], m.start()
            after = text[m.end() : m.end() + 2]
            end, used = 0, 0
            title = w.lower() in _TITLES and (after[:1] == " " or after == ". ")
            first = part(w) if len(w) > 1 else ""
            initial = len(w) == 1 and after[:1] == "."

            def follows(k: int, gap: str, start: int) -> bool:
                return k < n and text[start : words[k].start()] == gap

            if title or w == "M" and after == ". ":  # title, then a name in whatever parts
                k, stop = i + 1, m.end() + (after == ". ")
                while follows(k, " ", stop) and len(words[k][0]) == 1 and text[words[k].end() : words[k].end() + 1] == ".":
                    stop, k = words[k].end() + 1, k + 1
                if follows(k, " ", stop) and len(words[k][0]) > 1 and words[k][0] not in _NOT_A_NAME and (title or "f" in part(words[k][0])):
                    end, used = words[k].end(), k
                    if "f" in part(words[k][0]) and "g" not in part(words[k][0]) and follows(k + 1, ", ", end) and "g" in part(words[k + 1][0]):
                        end, used = words[k + 1].end(), k + 1
                    else:
                        end, used = self._rest(text, words, k, end, part)
            if not end and initial:
                stop, k = m.end() + 1, i + 1
                while follows(k, " ", stop) and len(words[k][0]) == 1 and text[words[k].end() : words[k].end() + 1] == ".":
                    stop, k = words[k].end() + 1, k + 1
                if follows(k, " ", stop) and "f" in part(words[k][0]):
                    end, used = words[k].end(), k
            if not end and "g" in first:
                end, used = self._rest(text, words, i, 0, part)
            if not end and "f" in first:
                if follows(i + 1, ", ", m.end()) and "g" in part(words[i + 1][0]):
                    taken, _ = self._rest(text, words, i + 1, 0, part)
                    if not taken:
                        end, used = words[i + 1].end(), i + 1
            if not end and len(w) > 1 and w not in _NOT_A_NAME and follows(i + 1, " ", m.end()):
                other = words[i + 1][0]
                if len(other) > 1 and ("f" in part(other) or other not in _NOT_A_NAME and _INTRODUCED.search(text[max(0, a - 24) : a])):
                    end, used = words[i + 1].end(), i + 1
            if end:
                yield a, end
                i = used + 1
            else:
                i += 1
        if not text.isascii() and self.lexicon.han_name:
            yield from self._han_names(text)

    @staticmethod
    def _rest(text: str, words: list[re.Match], k: int, end: int, part: object) -> tuple[int, int]:
        """How far a name that has a given part at word k goes on: initials and a family name; (end, k) if it doesn't."""
        stop, j, initials = words[k].end(), k + 1, False
        while j < len(words) and len(words[j][0]) == 1 and text[stop : words[j].start()] == " " and text[words[j].end() : words[j].end() + 1] == ".":
            stop, j, initials = words[j].end() + 1, j + 1, True
        if j < len(words) and len(words[j][0]) > 1 and text[stop : words[j].start()] == " ":
            if "f" in part(words[j][0]):
                return words[j].end(), j
        if initials:
            return stop, j - 1
        return end, k

    def _han_names(self, text: str) -> Iterator[tuple[int, int]]:
        known = self.lexicon.han
        at = 0
        while m := self.lexicon.han_name.search(text, at):
            a, b = m.span()
            at = a + 1
            if text[a] in _NOT_FAMILY:
                continue
            if text[a] in known["family"]:
                if text[a + 1 : a + 3] not in known["given"]:
                    b = a + 3 if b == a + 3 and text[a + 2] not in _NOT_GIVEN else a + 2
                    if text[a + 1] in _NOT_GIVEN:
                        continue
                else:
                    b = a + 3
            yield a, b
            at = b
        for m in _HAN_INTRODUCED.finditer(text):
            if not self.lexicon.han_name.search(m[1]) and m[1][0] not in _NOT_FAMILY:
                yield m.span(1)


def masked(text: str, mentions: Iterable[tuple[str, int, int]]) -> str:
    """The text with [EMAIL], [ID_NUMBER], ... in place of its mentions."""
    out, at = [], 0
    for kind, a, b in mentions:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def lexicon_terms(lexicon: DataFrame) -> list[tuple[str, str]]:
    """The terms of a name lexicon (term, name_part), which must be of bounded size."""
    rows = lexicon.select("term", "name_part").filter("term IS NOT NULL AND name_part IS NOT NULL").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a name lexicon may have at most {MOST_TERMS} terms")
    return [tuple(r) for r in rows]


def find_mentions(texts: DataFrame, terms: list[tuple[str, str]], key: str = "id", text: str = "text") -> DataFrame:
    """Every mention: key, kind, nth (from 1 per kind and text), from_char and to_char (source characters).

    Map-only: texts of any length are scanned where they lie, each whole. Null and empty texts have no mentions, null
    keys stay null, repeated rows give repeated mentions, other columns are ignored.
    """
    schema = f"`{key}` {dict(texts.dtypes)[key]}, kind string, nth bigint, from_char int, to_char int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(terms).mentions
        for batch in batches:
            rows, kinds, nth, a, b = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    seen = dict.fromkeys(KINDS, 0)
                    for kind, x, y in scan(t):
                        seen[kind] += 1
                        rows.append(i)
                        kinds.append(kind)
                        nth.append(seen[kind])
                        a.append(x)
                        b.append(y)
            if rows:
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(kinds, pa.string()), pa.array(nth, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=[key, "kind", "nth", "from_char", "to_char"])

    return texts.select(key, text).mapInArrow(run, schema)


def mask_mentions(texts: DataFrame, terms: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """texts with typed placeholders in place of the mentions in column ``text``; all else is unchanged, null stays null."""

    @F.pandas_udf("string")
    def mask(column):  # noqa: ANN001, ANN202
        scan = _scanner(tuple(terms)).mentions
        return column.map(lambda t: masked(t, scan(t)) if t else t, na_action="ignore")

    return texts.withColumn(text, mask(F.col(text)))


@lru_cache(4)
def _scanner(terms: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(terms)
