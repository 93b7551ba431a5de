"""Sentence units of documents in many scripts, by document-centred disambiguation.

A mark that could end a sentence is judged by its neighbourhood first (quotations, brackets, decimals, file names,
list marks, speaker labels, the terminators of the script at hand). What is left are periods behind a word or a
number. The document comes first: a word that has a comma behind its period somewhere in it (or a small letter, where
sentences don't start with one), and never a paragraph's end nor stands without a period, is an abbreviation; a word that stands there without a period
and never so is none, unless it is known as a title or the like, which are written both ways. Where the document has no such place, or is at odds with itself, the counts over ALL documents
decide: ``verdict`` weighs four kinds of words (titles, other abbreviations, those that may close a sentence, ordinary
words) by how likely each makes the counts, with what a short list of abbreviations says as the prior. No number of
occurrences switches anything; more of them only weigh more.

The word behind an abbreviation is judged in the same way: one that the document also has in small letters and never
capitalised inside a sentence is no proper name, one that it has capitalised inside sentences only is one; else the
corpus tells if it usually starts a sentence. A common word with a capital behind an abbreviation that isn't a title
starts a sentence; a small letter behind an abbreviation that may close one does so if the word usually starts one.

Counts: of every form, in how many documents it has a period, a period with a small letter, a digit or a comma behind
it, a period at a paragraph's end, no period, a capital at a sentence's start, and any place at all. All forms count.
Decisions other than those a form has by itself are sent to the executors if they are at most ``TABLE_ROWS``; beyond
that every document's forms are joined to them instead, with the same results.

Defined results: null, empty and blank documents have no sentences; spans never overlap, have no white space at
either end and together cover every other character; a document that is there twice gives its sentences twice;
texts of any length are handled whole; lang is not used, as it is often wrong; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from math import lgamma

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.session import written

TABLE_ROWS = 200_000
SPAN = "doc_id bigint, start_char int, end_char int"

# Common abbreviations. Never at the end of a sentence; and those that may close one.
INNER = frozenset("""dr prof mr mrs ms st no fig sec vol pp vs approx e.g i.e jr rev gen capt č čl odst str např tj tzv r ing mgr bc mudr sv
bzgl vgl ca nr z z.b d d.h u.a hr fr m mme mlle env chap c.-à-d p sr sra srta avda núm aprox pág ee
г ул д стр рис см им т гл np zob ul godz ok wg κ κα χλμ د ج.م डॉ रु कि.मी ดร น กม""".split())  # fmt: skip
CLOSING = frozenset("etc atd aj apod usw p.m a.m u.s co inc ltd itd itp т.д т.п руб мин κ.λπ μ.μ π.μ uu".split())

_WORD = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}\p{N}’'\-]*(?:\.[\p{L}\p{M}][\p{L}\p{M}\p{N}\-]*)*")
_BLOCK = regex.compile(r"\n[^\S\n]*\n\s*")
_MARK = regex.compile(
    r"\s*(?:\[[^\]\n]{1,24}\][ \t]*(?:[^\s:：\[\]]{1,40}(?: [^\s:：\[\]]{1,40})?[:：][ \t])?|<[^<>\n]{1,48}>[ \t]|[^\s:：]{1,40}(?: [^\s:：(]{1,40})?[ \t]?\([^()\n]{4,30}\)[:：][ \t]|(?P<name>[^\s:：]{1,40})[:：][ \t]|(?P<bullet>[-•*–·‣▪])[ \t]|(?P<num>\d{1,3}|[a-z])[.)][ \t])"
)
_OPEN = {"„": "“”", "«": "»", "「": "」", "『": "』", "“": "”“", "‚": "‘", "(": ")", "[": "]", "（": "）", '"': '"'}
_TAIL = regex.compile(r"(?:[\"”»」』’)\]）]|[^\S\n]?[”»](?=\s|$|\p{P}))*")
_EMOJI = regex.compile(r"(?:[^\S\n]*(?:[\p{Emoji_Presentation}\p{Extended_Pictographic}\p{RI}][️‍\U0001F3FB-\U0001F3FF\p{Extended_Pictographic}]*))+")
_THAI_END = regex.compile(r"(?:ครับ|ค่ะ|คะ|ค่า|จ้ะ|จ้า|นะ|ฮะ)$")
_STOPS = regex.compile(r"[.!?…。！？؟।॥;\n\"„“”«»「」『』()\[\]（）]|(?<=[฀-๿])[^\S\n]|[\p{Emoji_Presentation}\p{Extended_Pictographic}]")
_FINAL = regex.compile(r"[.!?…。！？؟।॥;:][\"”“»」』’)\]）]*(?:\s*[\p{Emoji_Presentation}\p{Extended_Pictographic}‍️\U0001F3FB-\U0001F3FF])*\s*$")
_ORDINAL_BEFORE = frozenset("am der die das den dem des vom zum im beim ab bis seit nach the na v ve od do".split())


#: Combining marks as ranges of a character class: letters of many scripts carry them.
_MARKS = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in (lambda xs: np.split(xs, np.flatnonzero(np.diff(xs) > 1) + 1))(np.array([c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"])))
_FORM = rf"(?:[^\W\d_]|[{_MARKS}])[\w{_MARKS}’'\-]*(?:\.(?:[^\W\d_]|[{_MARKS}])[\w{_MARKS}\-]*)*"
_DOTTED = re.compile(rf"(?<![\w{_MARKS}])({_FORM})\.(?!\.\.)(?=[\s\"”“»」)\],]|\Z)")
_UNDOTTED = re.compile(rf"(?<![\w{_MARKS}]){_FORM}(?=[^.\n\w{_MARKS}’'\-])")
_EVERY = re.compile(rf"(?<![\w{_MARKS}]){_FORM}")
_START = re.compile(rf"(?:\A|[!?…]|(?<=[^\W\d_]{{4}})\.(?=\s))[^\w.!?…]*({_FORM})")
_INSIDE = re.compile(rf"(?<=[\w,] )({_FORM})")
_SMALL_START = regex.compile(r"\A\s*\p{Ll}|[!?][\"”“»」)\]]*\s+\p{Ll}|(?m:^(?:\[[^\]\n]{1,24}\]|<[^>\n]{1,48}>|\d{1,3}[.)]|[-•*–])?[^\S\n]*(?:[^\n]{1,48}?[:>\]])?[^\S\n]+\p{Ll})")
_SMALL_WORD = regex.compile(r"\p{Ll}+(?=[\s,;:!?)]|$)")
_PARAGRAPH_END = regex.compile(r"[\"”“»)]*[^\S\n]*(?:\n\s*\n|$)")
_NUMBERED = re.compile(r"\d{1,2}\.")
_IS_MARK = regex.compile(r"\p{M}")


def _key(word: str) -> str:
    return word.lower().rstrip(".")


def _initial(w: str) -> bool:
    """One letter, or a doubled one as in EE. UU."""
    return len(w) == 1 or (len(w) == 2 and w[0] == w[1])


class Evidence:
    """What one text says about its forms: ``dotted`` (how often with a period, with more of the sentence behind it, at a
    paragraph's end, with what can only be more of the sentence), and the forms without a period, in small letters, capitalised inside and at starts of sentences."""

    def __init__(self, text: str):
        self.text = text
        self.dotted: dict[str, list[int]] = {}
        chain, last = "", -1
        for m in _DOTTED.finditer(text):
            word, e = m.group(1).lower(), m.end()
            form = chain + word if m.start() == last + 1 and text[last : last + 1] == " " else word
            rest = text[e : e + 60]
            body = rest.lstrip()
            ends = not body or bool(_PARAGRAPH_END.match(rest)) or rest[0] in ")»" or bool(_EMOJI.match(rest))
            inside = not ends and (rest[0] == "," or body[0].islower() or body[0].isdigit())
            firm = inside and (rest[0] == "," or (not self.small and bool(_SMALL_WORD.match(body))))
            for f in {form, word}:  # two initials may be one abbreviation, or two
                row = self.dotted.setdefault(f, [0, 0, 0, 0])
                self.dotted[f] = [row[0] + 1, row[1] + inside, row[2] + ends, row[3] + firm]
            chain, last = (f"{form}.", e) if _initial(word) else ("", -1)

    @cached_property
    def small(self) -> bool:
        """Whether a sentence starts in a small letter here, so that one behind a period tells nothing."""
        return bool(_SMALL_START.search(self.text))

    @cached_property
    def plain(self) -> set[str]:
        return set(_UNDOTTED.findall(self.text.lower()))

    @cached_property
    def exact(self) -> set[str]:
        return set(_EVERY.findall(self.text))

    @cached_property
    def inside(self) -> set[str]:
        """Forms, in small letters, that are capitalised behind a word or a comma."""
        return {w.lower() for w in _INSIDE.findall(self.text) if w[0].isupper()}

    @cached_property
    def starts(self) -> set[str]:
        return {w.lower() for w in _START.findall(self.text) if w[0].isupper()}

    def common(self, word: str) -> bool | None:
        """Whether the document has the word as an ordinary one (True) or as a proper name (False); None: it doesn't say."""
        low, name = word.lower() in self.exact, word.lower() in self.inside
        return None if low == name else low


_WHAT = ["dot", "inner", "end", "plain", "start", "any"]


def corpus_counts(documents: DataFrame) -> DataFrame:
    """(form, dot, inner, end, plain, start, any) over all documents: summed in each partition first, then by form."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {w: Counter() for w in _WHAT}

        def flush() -> pd.DataFrame:
            forms = list(set().union(*totals.values()))
            out = pd.DataFrame({"form": pd.Series(forms, dtype="object"), **{w: pd.Series([totals[w][f] for f in forms], dtype="int64") for w in _WHAT}})
            for c in totals.values():
                c.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                doc = Evidence(text)
                # in how many documents: one that repeats itself says no more
                totals["dot"].update(doc.dotted.keys())
                totals["inner"].update(f for f, x in doc.dotted.items() if x[1])
                totals["end"].update(f for f, x in doc.dotted.items() if x[2])
                totals["plain"].update(doc.plain)
                totals["start"].update(doc.starts)
                totals["any"].update(set(map(str.lower, doc.exact)))
            if len(totals["any"]) > 200_000:
                yield flush()
        yield flush()

    rows = documents.select("text").where(F.col("text").isNotNull()).mapInPandas(partial, "form string, " + ", ".join(f"`{w}` bigint" for w in _WHAT))
    return rows.groupBy("form").agg(*[F.sum(w).alias(w) for w in _WHAT])


TITLE, INSIDE, MAY_CLOSE, WORD = range(4)
#: By kind, how a form's shares are spread (parameters of beta distributions): of periods at a paragraph's end, of those
#: with more of the sentence behind them, and of places without a period. The last kind's paragraph ends are the corpus's own.
_SHARES = {TITLE: ((0.2, 60), (0.5, 20), (1, 8)), INSIDE: ((0.2, 60), (2, 2), (1, 8)), MAY_CLOSE: ((1, 10), (3, 3), (1, 8)), WORD: (None, (0.4, 4), (1, 1))}


def _likely(k: int, n: int, a: float, b: float) -> float:
    """Log likelihood of ``k`` of ``n`` where the share follows a beta distribution."""
    return lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)


def _priors(form: str) -> tuple[float, float, float, float]:
    """Log odds of the four kinds before any count."""
    if form in INNER:
        return 4.0, 5.0, 0.0, 0.0
    if form in CLOSING:
        return -8.0, -8.0, 2.0, 0.0
    if len(form) == 1 and form.isalpha():
        return 3.0, 3.0, 0.0, 0.0
    if "." in form:
        return 0.0, 2.0, 3.0, 0.0
    return -4.0, -4.0, -4.0, 0.0


def verdict(form: str, dot: int = 0, inner: int = 0, end: int = 0, plain: int = 0, ends: float = 0.2) -> int:
    """The kind of a form by its counts over all documents; ``ends``: the share of all periods at a paragraph's end."""
    best = []
    for kind, prior in enumerate(_priors(form)):
        e, i, p = _SHARES[kind]
        e = e or (4 * ends, 4 * (1 - ends))
        best.append(prior + _likely(end, dot, *e) + _likely(min(inner, dot), dot, *i) + _likely(plain, plain + dot, *p))
    return max(range(4), key=lambda k: (best[k], k))


def corpus_table(documents: DataFrame) -> DataFrame:
    """(form, kind, starts): decisions of the corpus that a form doesn't have by itself, as a written table."""
    counts = written(corpus_counts(documents), "forms")
    dots, ends_ = counts.agg(F.sum("dot"), F.sum("end")).first()
    share = min(0.9, max(0.02, (ends_ or 0) / dots)) if dots else 0.2

    @F.pandas_udf("int")
    def kind(form: pd.Series, dot: pd.Series, inner: pd.Series, end: pd.Series, plain: pd.Series) -> pd.Series:
        return pd.Series([verdict(*x, share) for x in zip(form, dot, inner, end, plain)], dtype="int32")

    @F.pandas_udf("int")
    def own(form: pd.Series) -> pd.Series:
        return pd.Series([verdict(f, ends=share) for f in form], dtype="int32")

    starts = F.col("start") > 0.5 * (F.col("any") + 2)
    judged = counts.where((F.col("dot") > 0) | starts).select("form", kind("form", "dot", "inner", "end", "plain").alias("kind"), own("form").alias("own"), starts.alias("starts"))
    return written(judged, "verdicts").where("kind <> own OR starts").select("form", "kind", "starts")


class Splitter:
    """Splits texts by the rules above; ``table``: form -> (kind, starts), the corpus's decisions."""

    def __init__(self, table: dict[str, tuple[int, bool]]):
        self.table = table
        self.memo: dict[str, int] = {}

    def _corpus(self, form: str) -> int:
        if form in self.table:
            return self.table[form][0]
        if form not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[form] = verdict(form)
        return self.memo[form]

    def _class(self, form: str, doc: Evidence) -> int:
        """The kind of a form in this document."""
        _, _, end, inner = doc.dotted.get(form, (0, 0, 0, 0))
        plain = form in doc.plain
        corpus = self._corpus(form)
        if inner and not end and not plain:
            return corpus if corpus != WORD else INSIDE
        if plain and not inner:  # titles are written both ways
            return corpus if ((corpus == TITLE or _initial(form)) and not end) or form in INNER or form in CLOSING else WORD
        if end and not inner:
            return corpus if corpus in (MAY_CLOSE, WORD) else MAY_CLOSE
        return corpus

    def _starts(self, word: str) -> bool:
        return self.table.get(_key(word), (WORD, False))[1]

    def _common(self, word: str, doc: Evidence) -> bool:
        """Whether a capitalised word is an ordinary one."""
        said = doc.common(word)
        return self._starts(word) if said is None else said

    # --- segments: what line breaks alone decide

    def _segments(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, start behind the list mark or label, end) of the pieces that line breaks separate."""
        lines = text.split("\n")
        width = max(map(len, lines))
        at = 0
        marks = [(_MARK.match(x) if x.strip() else None) for x in lines]
        full = sum(1 for x in lines if x.strip())
        named = sum(1 for m in marks if m and not m["num"] and not m["bullet"])
        first = next((m for x, m in zip(lines, marks) if x.strip()), None)
        labelled = named * 2 >= full or (first is not None and named * 3 >= full)
        start = body = None
        expected = None
        previous = ""
        for x, m in zip(lines, marks):
            s, e = at, at + len(x)
            at = e + 1
            if not x.strip():
                if start is not None:
                    yield start, body, s
                start = None
                expected = None
                previous = ""
                continue
            mark = None
            if m:
                if m["num"]:
                    n = int(m["num"]) if m["num"].isdigit() else ord(m["num"]) - 96
                    if (start is None and n <= 200) or (expected is not None and n == expected) or (n == 1 and self._deliberate(previous, x, width)):
                        mark, expected = m, n + 1
                elif m["bullet"]:
                    mark = m if start is None or expected == 0 or self._deliberate(previous, x, width) else None
                    expected = 0 if mark else expected
                elif labelled or x.lstrip()[:1] in "[<":
                    mark = m
            if start is None or mark or self._breaks(previous, x, width):
                if start is not None:
                    yield start, body, s
                start, body = s, s + (mark.end() if mark else 0)
            previous = x
        if start is not None:
            yield start, body, len(text)

    @staticmethod
    def _deliberate(line: str, following: str, width: int) -> bool:
        """Whether the next word would have had room in the line, so that the break wasn't made by wrapping."""
        word = following.split(None, 1)[0] if following.strip() else ""
        return len(line.rstrip()) + 1 + len(word) <= width

    def _breaks(self, line: str, following: str, width: int) -> bool:
        if _FINAL.search(line):
            return False  # the mark itself decides
        if line.rstrip()[-1:] in (",", "-", "–", "，", "、") or following.lstrip()[:1].islower():
            return False
        return len(line.strip()) < 60 and self._deliberate(line, following, width)

    # --- marks inside a segment

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        if not text or text.isspace():
            return []
        doc = Evidence(text)
        out: list[tuple[int, int]] = []
        for start, body, end in self._segments(text):
            cuts = self._cuts(text, body, end, doc)
            a = start
            for c in [*cuts, end]:
                piece = text[a:c]
                s, e = a + len(piece) - len(piece.lstrip()), c - (len(piece) - len(piece.rstrip()))
                if s < e:
                    if out and a == start and not _WORDLIKE.search(piece) and start > 0 and _EMOJI.fullmatch(piece.strip()):
                        out[-1] = (out[-1][0], e)  # emoji alone belong to the sentence before
                    else:
                        out.append((s, e))
                a = c
        return out

    def _cuts(self, text: str, body: int, end: int, doc: Evidence) -> list[int]:
        cuts: list[int] = []
        i = body
        first = body  # where the current sentence starts
        while m := _STOPS.search(text, i, end):
            c, p = m.group(), m.start()
            i = p + 1
            cut = None
            if c in _OPEN:
                close = self._closing(text, p, end)
                if close is None:
                    continue
                cut = self._after_group(text, first, p, close, end, doc)
                i = close + 1
            elif c in "!?。！？؟।॥":
                j = p + 1
                while j < end and text[j] in "!?！？؟":
                    j += 1
                if c in "!?" and j < end and not (text[j].isspace() or text[j] in "\"”“»」』)]）" or _EMOJI.match(text, j)):
                    if not (ord(text[p - 1]) > 0x2E80 or ord(text[j]) > 0x2E80 or self._run_on(text, p, j, end)):
                        i = j
                        continue
                cut = j
            elif c == ";":
                k = p - 1
                if k >= body and "Ͱ" <= text[k] <= "Ͽ" or "ἀ" <= text[k] <= "῿":
                    if p + 1 >= end or text[p + 1].isspace():
                        cut = p + 1
            elif c == "…":
                while i < end and text[i] in "….":
                    i += 1
                cut = self._ellipsis(text, i, end)
            elif c == ".":
                if text.startswith("..", p + 1):
                    j = p
                    while j < end and text[j] == ".":
                        j += 1
                    i = j
                    cut = self._ellipsis(text, j, end)
                elif p + 1 >= end or text[p + 1].isspace() or text[p + 1] in "\"”“»」』)]）" or _EMOJI.match(text, p + 1):
                    if self._period_ends(text, body, p, end, doc):
                        cut = p + 1
                elif self._run_on(text, p, p + 1, end) and self._period_ends(text, body, p, end, doc):
                    cut = p + 1
            elif c.isspace():
                before = text[max(body, p - 6) : p]
                if _THAI_END.search(before) and not _EMOJI.match(text, p):
                    cut = p
            elif "฀" <= text[max(body, p - 2)] <= "๿":
                cut = p  # emoji close a Thai sentence
            if cut is not None:
                cut = self._with_tail(text, cut, end)
                i = max(i, cut)
                if text[cut:end].strip():
                    cuts.append(cut)
                    first = cut
        return cuts

    @staticmethod
    def _run_on(text: str, p: int, j: int, end: int) -> bool:
        """A missing space: a word or number, the mark, and a word that starts with a capital or has no case."""
        back, ahead = text[max(0, p - 3) : p], text[j : min(end, j + 3)]
        if len(back) < 2 or len(ahead) < 2 or not (back[-1].isalnum() or _IS_MARK.match(back[-1])):
            return False
        if ahead[0].isupper():
            return not back[-1].isupper() and not back[-2] == "." and (ahead[1].islower() or ahead[1].isspace())
        uncased = lambda c: c.isalpha() and not c.isupper() and not c.islower()
        return uncased(ahead[0]) and uncased(back[-1]) and len(back) == 3 and all(x.isalpha() for x in back)

    @staticmethod
    def _with_tail(text: str, p: int, end: int) -> int:
        if t := _TAIL.match(text, p, end):
            p = t.end()
        while e := _EMOJI.match(text, p, end):
            p = e.end()
        return p

    @staticmethod
    def _closing(text: str, p: int, end: int) -> int | None:
        c = text[p]
        if c == '"' and p > 0 and not (text[p - 1].isspace() or text[p - 1] in "(["):
            return None
        closers = _OPEN[c]
        depth = 0
        for k in range(p + 1, end):
            if text[k] in closers:
                if depth == 0:
                    return k
                depth -= 1
            elif text[k] == c:
                depth += 1
        return None

    def _after_group(self, text: str, first: int, p: int, close: int, end: int, doc: Evidence) -> int | None:
        """A quotation or bracket with its own final mark: does the sentence end with it?"""
        inside = text[p + 1 : close].rstrip()
        if not inside or inside[-1] not in ".!?…。！？؟।" and not (inside[-1] == ";" and "Ͱ" <= inside[-2:-1] <= "Ͽ"):
            return None
        at_start = not text[first:p].strip()
        rest = text[close + 1 : end]
        ahead = rest.lstrip()
        if text[p] in "([（":
            if not at_start or text[first:p].strip():
                return None
            if inside[-1] == "." and not ahead:
                return None
            return close + 1
        if not ahead:
            return None
        if _EMOJI.match(text, close + 1):
            return close + 1
        if ahead[0] in ",;:—–-.!?。，、؛،":
            return None
        if at_start:
            return close + 1 if rest[:1].isspace() and ahead[0].isupper() else None
        lead = text[first:p].rstrip()
        if lead.endswith((":", "：")):
            return close + 1 if rest[:1].isspace() or ord(ahead[0]) > 0x2E80 or ahead[0] in "“„«「" else None
        if not rest[:1].isspace():
            return None
        return close + 1 if ahead[0].isupper() or ahead[0] in "„“«\"¿¡(" else None

    def _ellipsis(self, text: str, j: int, end: int) -> int | None:
        rest = text[j:end]
        ahead = rest.lstrip()
        if not ahead or not rest[0].isspace():
            return None
        return j if ahead[0].isupper() or ahead[0] in "¿¡„“«(" else None

    def _period_ends(self, text: str, body: int, p: int, end: int, doc: Evidence) -> bool:
        k = p
        while k > body and (text[k - 1].isalnum() or text[k - 1] in "-’'." or _IS_MARK.match(text[k - 1])):
            k -= 1
        token = text[k:p]
        ahead = text[p + 1 : end].lstrip()
        if not ahead:
            return False
        closers = text[p + 1] in "\"”“»」』)]）"
        plain = ahead.lstrip("\"”“»」』)]） ") if closers else ahead
        nxt = plain[:1]
        if not token:
            return nxt.isupper() or not nxt.islower()
        if token[-1].isdigit() and token.replace(".", "").isdigit():
            return self._number_ends(text, body, k, token, nxt, doc, plain)
        if "-" in token and not token.startswith("c.-"):
            tail = token.rsplit("-", 1)[1]
            token = token if "." in token else tail if len(tail) > 1 and token.lower() not in INNER else token
        form = _key(token)
        words = text[max(body, k - 40) : k].split()
        back = words[-1] if words else ""
        if back.endswith(".") and back[:-1].isalpha() and _initial(back[:-1].lower()):
            chain = f"{_key(back)}.{form}"
            if chain in self.table or chain in INNER or chain in CLOSING:
                form = chain
        kind = self._class(form, doc)
        if kind == WORD:
            return True
        word = _WORD.match(plain)
        if kind == TITLE:
            return False
        if kind == INSIDE:
            return bool(word) and nxt.isupper() and self._common(word.group(), doc) and self._starts(word.group())
        if nxt.isupper() or nxt.isdigit() or _EMOJI.match(ahead) or nxt in "„“«¿¡(\"[<":
            return True
        if nxt.islower():
            return bool(word) and self._starts(word.group())
        return not (nxt in ",;:—–-" or nxt.isalpha())

    def _number_ends(self, text: str, body: int, k: int, token: str, nxt: str, doc: Evidence, plain: str) -> bool:
        words = text[max(body, k - 40) : k].split()
        back = words[-1] if words else ""
        referred = back.endswith((".", "º", "№", "#")) and not back[:-1].isdigit() and self._class(_key(back[:-1]), doc) in (TITLE, INSIDE) or back.endswith(("º", "№"))
        if nxt.isdigit():
            return referred and not _NUMBERED.match(plain)
        if referred:
            return True
        if nxt.islower():
            word = _WORD.match(plain)
            return len(token) > 2 and bool(word) and self._starts(word.group())
        if nxt.isupper():
            return not (back.lower() in _ORDINAL_BEFORE and len(token) <= 3)
        return True


_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")


def _forms_of(text: str) -> list[str]:
    """The forms of a text that a decision of the corpus can concern."""
    doc = Evidence(text)
    return sorted(doc.dotted.keys() | {w.lower().rstrip(".") for w in _BEHIND.findall(text)} | {p for f in doc.dotted for p in f.rsplit("-", 1)[1:]})


_BEHIND = re.compile(rf"[.)\]\"”“»」]\s+({_FORM})")


def split_documents(documents: DataFrame, table: DataFrame, most: int = TABLE_ROWS) -> DataFrame:
    """One row per sentence of every document. ``table``: ``corpus_table``; more than ``most`` rows are joined."""
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull())

    def spans(splitter: Splitter, ids, texts) -> pd.DataFrame:
        found = [(d, s, e) for d, t in zip(ids, texts) for s, e in splitter.spans(t)]
        return pd.DataFrame(found, columns=["doc_id", "start_char", "end_char"])

    if table.count() <= most:
        sent = documents.sparkSession.sparkContext.broadcast({r["form"]: (r["kind"], r["starts"]) for r in table.collect()})

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            splitter = Splitter(sent.value)
            for batch in batches:
                yield spans(splitter, batch["doc_id"], batch["text"])

        return rows.mapInPandas(apply, SPAN)

    @F.pandas_udf("array<string>")
    def forms(texts: pd.Series) -> pd.Series:
        return pd.Series([_forms_of(t) for t in texts])

    # a text is known by its hashes: equal texts have equal forms
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("g", F.crc32("text"))
    asked = keyed.select("h", "g", F.explode(forms("text")).alias("form")).distinct()
    told = asked.join(table, "form").groupBy("h", "g").agg(F.collect_list(F.struct("form", "kind", "starts")).alias("told"))

    def apply_told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, t, own in zip(batch["doc_id"], batch["text"], batch["told"]):
                own = {} if own is None else {x["form"]: (x["kind"], x["starts"]) for x in own}
                yield spans(Splitter(own), [d], [t])

    return keyed.join(told, ["h", "g"], "left").select("doc_id", "text", "told").mapInPandas(apply_told, SPAN)
