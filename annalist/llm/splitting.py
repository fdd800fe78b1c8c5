"""Cutting long texts into overlapping pieces under a token limit, at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.tokens import SPLIT, default_vocabulary, encoder

# White space as the tokenizer's split pattern sees it, and the part of it that ends lines (fixed values).
_NL = "\n\r\v\f\x85\u2028\u2029"
_WS = " \t\xa0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))) + _NL
# A segment begins with its white space, or after the marks that end a sentence of a script without blanks. So it begins
# where the tokenizer begins a new match, and the token counts of neighbours add up exactly.
_LINES = re.compile(rf"[{_WS}]*[{_NL}][{_WS}]*")
_MARKS = re.compile(r"[.!?…。！？；]+[\"'”’»)\]】」』]*")
_LATIN_MARK = re.compile(r"[^。！？；]*$")
_BLANKS = frozenset(_WS)
_BLANK = re.compile(rf"(?<=[^{_WS}])(?=[{_WS}])")
INSIDE, WORD, SENTENCE, LINE, PARAGRAPH, HEADING = range(6)
_MATCH = regex.compile(SPLIT)
#: Tokens of room left in the parts of a word that is cut, as a cut within a word changes the tokens beside it.
JOIN = 8
#: How many tokens more than a word the rest of it may have.
SURPLUS = 3
#: From how many characters on a word is long, so that only its parts near the right number of tokens are tried.
LONG = 64


def segments(text: str) -> list[tuple[int, int]]:
    """(start, strength of the boundary before it) of the atomic segments of a text, in order; the first has HEADING.

    Lines of fenced code and rows of a table hold together more than other lines do.
    """
    n = len(text)
    at = {0: HEADING}
    for m in _MARKS.finditer(text):
        k = m.end()
        # in a script with blanks, a mark within a word ends no sentence, as in 3.5 or a.b
        if k < n and (text[k] in _BLANKS or text[k].isalnum() and not _LATIN_MARK.match(m[0])):
            at[k] = SENTENCE
    fences = "```" in text
    fenced, seen = False, 0
    for m in _LINES.finditer(text):
        a, b = m.span()
        if a == 0 or b == n:
            continue
        strength = SENTENCE
        if fences:
            fenced ^= text.count("```", seen, a) % 2 == 1
            seen = a
        if not fenced:
            mark = text[b]
            if mark == "#":
                strength = HEADING
            elif b - a > 1 and sum(c in _NL for c in m[0]) - m[0].count("\r\n") > 1:
                strength = PARAGRAPH
            elif mark != "|":
                strength = LINE
        at[a] = strength
    return sorted(at.items())


class Atoms:
    """A text with its atomic segments and where its tokens lie; encoded once.

    tokens_before(at) is exact wherever the tokenizer begins a new match: at the segments' starts and before blanks.
    """

    def __init__(self, text: str, ids: list[int], width: np.ndarray) -> None:
        self.text = text
        self.ends = np.cumsum(width[ids])  # in bytes
        self.total = len(ids)
        self.bytes_before = None
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            self.bytes_before = np.concatenate([[0], np.cumsum(size)])

    def cut(self) -> Atoms:
        """Finds the segments."""
        marks = segments(self.text)
        self.starts = [a for a, _ in marks] + [len(self.text)]
        self.strengths = [s for _, s in marks]
        self.upto = self.tokens_before(self.starts).tolist()
        return self

    def tokens_before(self, at: list[int]) -> np.ndarray:
        """How many tokens end at or before each of the positions."""
        at = np.asarray(at, dtype=np.int64)
        return np.searchsorted(self.ends, at if self.bytes_before is None else self.bytes_before[at], side="right")

    def begin_of(self, token: int) -> tuple[int, bool]:
        """The first whole character from the beginning of a token on, and whether the token begins with it."""
        at = int(self.ends[token - 1]) if token else 0
        if self.bytes_before is None:
            return at, True
        begin = int(np.searchsorted(self.bytes_before, at))
        return begin, int(self.bytes_before[begin]) == at


class Splitter:
    """Cuts one text at a time."""

    def __init__(self, vocabulary: str) -> None:
        self.bpe = encoder(vocabulary)
        self.width = np.asarray([len(self.bpe.decode_single_token_bytes(t)) for t in range(self.bpe.max_token_value + 1)])

        self.short = lru_cache(50_000)(self.count)  # for parts of words

    def count(self, text: str) -> int:
        return len(self.bpe.encode_ordinary(text))

    def atoms(self, text: str) -> Atoms:
        return Atoms(text, self.bpe.encode_ordinary(text), self.width)

    def _refined(self, atoms: Atoms, limit: int, within: int) -> tuple[list[int], list[int], list[int]]:
        """Starts (and the end), strengths and tokens before the segments, those over the limit cut at blanks, or to ``within`` tokens inside words."""
        counts = np.diff(atoms.upto)
        if not len(counts) or counts.max() <= limit:
            return atoms.starts, atoms.strengths, atoms.upto
        starts, strengths, upto = [], [], [0]

        def add(a: int, s: int, n: int) -> None:
            starts.append(a)
            strengths.append(s)
            upto.append(upto[-1] + n)

        text = atoms.text
        for k, n in enumerate(counts.tolist()):
            a, b = atoms.starts[k], atoms.starts[k + 1]
            if n <= limit:
                add(a, atoms.strengths[k], n)
                continue
            cuts = [a, *(m.start() for m in _BLANK.finditer(text, a + 1, b)), b]
            for x, y, n in zip(cuts, cuts[1:], np.diff(atoms.tokens_before(cuts)).tolist(), strict=False):
                s = atoms.strengths[k] if x == a else WORD
                if n <= limit:
                    add(x, s, n)
                    continue
                for cut, n in self._within(atoms, x, y, within):
                    add(x, s, n)
                    x, s = cut, INSIDE
        return [*starts, len(text)], strengths, upto

    def _within(self, atoms: Atoms, a: int, b: int, limit: int) -> Iterator[tuple[int, int]]:
        """Where to cut a word of more than limit tokens, and the tokens up to there: as late as the limit permits.

        The tokens of the whole text say about where; each part is then counted by itself, as a cut changes its tokens.
        """
        text = atoms.text
        end = int(atoms.tokens_before([b])[0])
        while a < b:
            begin = int(atoms.tokens_before([a])[0])
            cut = b if end - begin <= limit else min(b, max(a + 1, atoms.begin_of(begin + limit)[0]))
            while (n := self.count(text[a:cut])) > limit and cut > a + 1:
                cut = max(a + 1, cut - max(1, (n - limit) // 4))
            yield cut, n
            a = cut

    def split(self, atoms: Atoms, capacity: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """(from, own, to, tokens, shared tokens) of the pieces: text[from:to], of which text[from:own] is shared.

        Adjacent segments are held in a heap, weakest boundary first and of equals the earliest; two neighbours are merged
        while together with the overlap they fit. A refused pair is never tried again, as its sides only grow.
        """
        overlap = min(overlap, capacity // 2)
        limit = capacity - overlap
        text = atoms.text
        starts, strengths, upto = self._refined(atoms, limit, max(1, limit - JOIN if overlap else limit))
        n = len(strengths)
        first, last = list(range(n)), list(range(n))  # of the group that ends, or begins, here
        heap = [strengths[k] << 32 | k for k in range(1, n) if strengths[k] > INSIDE]
        heapify(heap)
        while heap:
            k = heappop(heap) & 0xFFFFFFFF
            a, b = first[k - 1], last[k]
            if upto[b + 1] - upto[a] <= (limit if a else capacity):
                first[b], last[a] = a, b
        out = []
        a = 0
        floor = 0  # where the piece before begins
        while a < n:
            b = last[a]
            own, to, size = starts[a], starts[b + 1], upto[b + 1] - upto[a]
            begin, shared = own, 0
            if out and overlap:
                begin, shared = self._share(atoms, starts, upto, strengths, a, overlap, floor)
                if strengths[a] == INSIDE:  # counts don't add up here: count, and share less if it is too much
                    while begin < own and self.count(text[begin:to]) > capacity:
                        begin += 1
                    shared = self.count(text[begin:own])
                    size = self.count(text[begin:to]) - shared
            out.append((begin, own, to, size + shared, shared))
            floor = begin
            a = b + 1
        return out

    def _share(self, atoms: Atoms, starts: list[int], upto: list[int], strengths: list[int], a: int, overlap: int, floor: int) -> tuple[int, int]:
        """Where to begin so that overlap tokens before segment a are shared, and how many they are.

        Exactly overlap wherever a beginning between two characters gives it, else the most below it; never more than the
        piece before has.
        """
        j = a
        while j > 0 and starts[j] > floor and upto[a] - upto[j] < overlap:
            if strengths[j] == INSIDE:
                return self._counted(atoms, floor, starts[a], overlap)
            j -= 1
        return self._matched(atoms, floor, starts[a], overlap)

    def _matched(self, atoms: Atoms, x: int, y: int, want: int) -> tuple[int, int]:
        """Where in [x, y] to begin so that want tokens are left to y, which is where the tokenizer begins a match; and how many.

        The tokens of the text say in which match that is. Where its tokens begin is no help within it, since what is left of it
        is split anew; so its positions are tried one by one. Before it every position has too many. After it one can
        still do, where what is left of a word has more tokens than the word: by SURPLUS at most, so far as is tried.
        """
        text = atoms.text
        least, token = atoms.tokens_before([x, y]).tolist()
        token -= want
        if token <= least and (n := self.count(text[x:y])) <= want:
            return x, n
        begin, exact = atoms.begin_of(max(0, token))
        begin = max(x, begin)
        if exact and begin > x and text[begin] in _BLANKS and text[begin - 1] not in _BLANKS:
            return begin, want  # the tokenizer begins a match here: nothing to count
        at = begin
        while at > x and not (text[at] in _BLANKS and text[at - 1] not in _BLANKS):
            at -= 1
        best, most = y, 0
        end = token + want
        for m in _MATCH.finditer(text, at, y):
            lo, hi = m.span()
            if hi <= begin:
                continue
            before, after = atoms.tokens_before([lo, hi]).tolist()
            own, rest = after - before, end - after
            if want - rest - own > SURPLUS:
                break
            near = max(begin, lo)  # of a very long word, what is near is tried
            for at in range(max(x, lo, near - LONG), min(hi, near + LONG)):
                n = (self.short if hi - at <= LONG else self.count)(text[at:hi]) + rest
                if most < n <= want and self.count(text[at:y]) == n:
                    best, most = at, n
                    if n == want:
                        return best, most
        return best, most

    def _counted(self, atoms: Atoms, x: int, y: int, want: int) -> tuple[int, int]:
        """As _matched, where y or what is before it lies within a word, so that tokens have to be counted."""
        text = atoms.text
        at = max(x, atoms.begin_of(max(0, int(atoms.tokens_before([y])[0]) - want))[0])
        n = self.count(text[at:y])
        while n < want and at > x:
            at -= 1
            n = self.count(text[at:y])
        while n > want and at < y:
            at += 1
            n = self.count(text[at:y])
        return at, n


_FIELDS = [("spec", pa.string()), ("piece_no", pa.int64()), ("from_char", pa.int64()), ("own_char", pa.int64()), ("to_char", pa.int64()), ("tokens", pa.int64()), ("shared_tokens", pa.int64()), ("piece", pa.string())]


def split_texts(texts: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The pieces of each text of more tokens than a spec's capacity_tokens: key, spec, piece_no (from 1), spans, piece.

    Pieces are in order and cover the whole text: piece k adds text[own_char:to_char] and begins shared_tokens earlier, at
    from_char, within the piece before. No piece has more tokens than the capacity; shared_tokens is overlap_tokens, or
    less where the piece before has no more or no beginning between two characters gives exactly as many. Cuts
    are at headings, paragraphs, lines or sentences, at blanks only in sentences over the limit, within words only in
    words over it. A single character of more tokens than the capacity is a piece of its own.

    Map-only, one text at a time, each whole. Texts within the capacity, null and empty texts give no row. specs must be
    small (it is collected, at most 1,000 rows); those without a positive capacity are left out, a null overlap is none,
    and an overlap of more than half the capacity is half of it.
    """
    rows = specs.filter("capacity_tokens > 0 AND spec IS NOT NULL").groupBy("spec").agg(F.max(F.struct("capacity_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("o"))).alias("s")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("at most 1,000 container specs")
    wanted = sorted((r.spec, r.s.capacity_tokens, max(0, r.s.o)) for r in rows)
    path = vocabulary or default_vocabulary()
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        least = min((w[1] for w in wanted), default=0)
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            size = 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                nonlocal at, out, size
                cols = list(zip(*out, strict=True))
                made = pa.record_batch([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True))], names=[key, *(f for f, _ in _FIELDS)])
                at, out, size = [], [], 0
                return made

            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t or 4 * len(t) <= least:  # no text has more tokens than bytes
                    continue
                atoms = splitter.atoms(t)
                if atoms.total > least:
                    atoms.cut()
                for spec, capacity, overlap in wanted:
                    if atoms.total > capacity:
                        for k, (a, own, b, tokens, shared) in enumerate(splitter.split(atoms, capacity, overlap), 1):
                            out.append((spec, k, a, own, b, tokens, shared, t[a:b]))
                            at.append(i)
                            size += b - a
                if size > 4_000_000:
                    yield flush()
            if out:
                yield flush()

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, spec string, piece_no bigint, from_char bigint, own_char bigint, to_char bigint, tokens bigint, shared_tokens bigint, piece string")
