"""Text that was decoded with a wrong character set: find it, and restore the original where it can still be had.

Method. For every pair (bytes written in A, read as B) the garbled sequences are computed beforehand: for UTF-8 read
as a one-byte set, each lead byte with each continuation byte, as they look in B (also in the other letter case, for
text that was lowered or raised afterwards). All of them go into one Aho-Corasick automaton; the characters of pairs of
one-byte sets go into a second one, which tells for each in which pairs it can stand. It runs over the tokens
(runs of letters and non-ASCII characters) of a text; a token in which it finds a sequence is decoded under the sets
concerned, repeatedly for text garbled more than once, and only the matched spans are replaced. Pairs of one-byte sets
change single letters, which say little by themselves, so those, sequences that lost their control characters and
single weak matches need support from a letter model: trigram counts over ALL texts of the columns concerned, hashed
into a table of 2**18 counts (the only thing sent to the executors; its size doesn't depend on the data).

Defined results: null, empty and ASCII-only text without escapes is not garbled; U+FFFD is garbled and stays as it is;
characters written as HTML or backslash escapes are judged as the characters; repeated rows are judged alike; whole
texts are judged, however long. ``garbled`` is false and ``restored`` equals the text where nothing was found.
"""

from __future__ import annotations

import codecs
import html
import re
import zlib
from functools import lru_cache
from itertools import product
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
#: Sets that UTF-8 was read as.
READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp1257", "iso8859-2", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman", "mac-latin2", "mac-cyrillic", "cp874"]
#: One-byte sets: what was written, and what it was read as.
WRITTEN = ["cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1256", "cp874", "cp1252", "mac-roman", "cp852", "cp850"]
ONE_BYTE_READ = ["latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "cp437", "cp850", "cp852", "mac-roman"]
#: Sets of several bytes a character: read as one-byte sets, and as what UTF-8 was read.
WIDE = ["shift_jis", "gbk", "big5", "euc_kr", "euc_jp"]
MEMO = 60_000  # tokens and trigrams whose results a process keeps
GAIN, GAIN_UTF8 = 1.2, 0.6  # nats a trigram that a restoration must gain without firm evidence

_TOKEN = re.compile(r"[A-Za-z\u0080-\U0010ffff]*[\u0080-\U0010ffff][A-Za-z\u0080-\U0010ffff]*")
_ESCAPE = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6});|\\u[0-9a-fA-F]{4}")
_CONTROL = re.compile("[\x80-\x9f\xad]")
_MESS = re.compile("[\x80-\xbf]|[Â-ô][^A-Za-z]")
_INNER_CAPITAL = re.compile("[a-zà-öø-ÿ][A-ZÀ-ÖØ-Þ\u0106\u010c\u010e\u0118\u011a\u0141\u0143\u0147\u0158\u015a\u0160\u0164\u016e\u0179\u017b\u017d]")
_C1 = re.compile("[\x80-\x9f]")
_CUT = re.compile("^[^A-Za-z]*(?:[Â-ô][¢-©¬®-¹¼-¾]|[ÐÑ]{3}|[ìëêíà-ï]{2}[¢-¹])[^A-Za-z]*$")
_PUNCTUATION = re.compile("^[\u2010-\u203a]*$")
_OTHER_SCRIPT = re.compile("1251|koi8|866|1253|8859-7|1256|874")
_SAME_KIND = re.compile("^(?!utf-8).* as (?:cp1251|koi8-r|cp866|cp1253)$")
_EMOJI_REST = re.compile("^[ðâïÂ¤-¿‍]*ð[ðâïÂ¤-¿‍]*$")
#: SQL: the tokens of a text, as the letter model counts them.
_NON_TOKEN = r"[\x00-@\[-`{-\x7f]+"


def _chars(codec: str) -> list[str | None]:
    """The characters of bytes 128..255; undefined bytes of Windows sets are C1 controls, as common decoders have it."""
    out: list[str | None] = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b) if codec.startswith("cp12") or codec == "cp874" else None)
    return out


class LetterModel:
    """Log probability of tokens by the hashed trigram counts of the corpus."""

    def __init__(self, counts: np.ndarray):
        total = float(counts.sum()) or 1.0
        self._log = np.log((counts + 0.3) / (total + 0.3 * BUCKETS)).astype("float32")
        self._memo: dict[str, float] = {}

    def trigram(self, t: str) -> float:
        x = self._memo.get(t)
        if x is None:
            if len(self._memo) > MEMO:
                self._memo.clear()
            x = self._memo[t] = float(self._log[zlib.crc32(t.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)])
        return x

    def mean(self, token: str) -> float:
        w = f"^{token.lower()}$"
        return sum(self.trigram(w[i : i + 3]) for i in range(len(w) - 2)) / (len(w) - 2)

    def gain(self, a: str, b: str) -> float:
        """How much likelier a trigram is in ``b`` than in ``a``, where they differ."""
        a, b = f"^{a.lower()}$", f"^{b.lower()}$"
        n = min(len(a), len(b))
        head = next((i for i in range(n) if a[i] != b[i]), n)
        tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
        score = []
        for w in (a, b):
            lo, hi = max(0, head - 2), min(len(w) - 2, len(w) - tail)
            score.append(sum(self.trigram(w[i : i + 3]) for i in range(lo, hi)) / (hi - lo) if hi > lo else self.mean(w[1:-1]))
        return score[1] - score[0]


class _Utf8As:
    """UTF-8 read as one set: finds the spans that decode, in either letter case."""

    def __init__(self, codec: str):
        self.codec = codec
        chars = _chars(codec)
        self.bytes: dict[str, list[int]] = {}
        latin = not re.search("1251|1253|1256|866|koi8|cyrillic|874", codec)  # in other scripts the other case is plain text
        for pick in (lambda c: c, str.lower, str.upper)[: 3 if latin else 1]:
            for i, c in enumerate(chars):
                if c == "\xa0" and i >= 0x40:
                    continue  # a no-break space that would be a lead byte is a no-break space
                if c and len(x := pick(c)) == 1 and ord(x) > 127 and 128 + i not in self.bytes.get(x, []):
                    self.bytes.setdefault(x, []).append(128 + i)
        of = lambda lo, hi: "".join(sorted(c for c, bs in self.bytes.items() if any(lo <= b <= hi for b in bs)))
        rest, esc = f"[{re.escape(of(0x80, 0xBF))}]", lambda lo, hi: f"[{re.escape(of(lo, hi))}]"
        parts = [(esc(0xF0, 0xF4), 3), (esc(0xE0, 0xEF), 2), (esc(0xC2, 0xDF), 1)]
        self.pattern = re.compile("|".join(f"{lead}{rest}{{{n}}}" for lead, n in parts if lead != "[]")) if rest != "[]" else None
        self.prefixes = {a + b for a, xs in self.bytes.items() if any(0xC2 <= x <= 0xF4 for x in xs) for b, ys in self.bytes.items() if any(0x80 <= y <= 0xBF for y in ys)}

    def _decoded(self, m: re.Match) -> str:
        for sequence in product(*[self.bytes[c] for c in m.group()]):
            try:
                out = bytes(sequence).decode("utf-8")
            except UnicodeDecodeError:
                continue
            self.count += 1
            # a control, or a capital after a small letter with a sign behind it
            self.control += bool(_CONTROL.search(m.group())) or (m.start() > 0 and m.string[m.start() - 1].islower() and m.group()[0].isupper() and not m.group()[1].isalpha())
            return out
        # a longer form that doesn't decode may hide a shorter one
        if len(m.group()) > 2 and (inner := self.pattern.sub(self._decoded, m.group()[1:])) != m.group()[1:]:
            return m.group()[0] + inner
        if len(m.group()) > 2:
            for sequence in product(*[self.bytes[c] for c in m.group()[:2]]):
                try:
                    out = bytes(sequence).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                self.count += 1
                self.control += bool(_CONTROL.search(m.group()[:2]))
                return out + self.pattern.sub(self._decoded, m.group()[2:])
        return m.group()

    def decode(self, token: str) -> tuple[str, int, int, bool]:
        """The token with its spans decoded, their number, those with control characters, and if no other high character is left."""
        self.count = self.control = 0
        out = self.pattern.sub(self._decoded, token) if self.pattern else token
        left = self.pattern.sub("", token) if self.pattern else token
        return out, self.count, self.control, not any(c in self.bytes for c in left)


@lru_cache(maxsize=1)
def _tables():
    """The automaton and decoding tables; built once a process, by rule."""
    import ahocorasick

    sets = [_Utf8As(c) for c in READ_AS]
    patterns: dict[str, int] = {}
    for i, s in enumerate(sets):
        for p in s.prefixes:
            patterns[p] = patterns.get(p, 0) | 1 << i
    automaton = ahocorasick.Automaton()
    for p, mask in patterns.items():
        automaton.add_word(p, mask)
    automaton.make_automaton()
    pairs, seen = [], set()
    for written in WRITTEN:
        for read in ONE_BYTE_READ:
            to = {ord(r): w for r, w in zip(_chars(read), _chars(written)) if r and w and ord(w) > 159} | {160: "\xa0"}
            key = tuple(sorted(to.items()))
            if all(chr(k) == v for k, v in to.items()) or key in seen:
                continue
            seen.add(key)
            pairs.append((f"{written} as {read}", to, {chr(k) for k, v in to.items() if chr(k) != v and v.isalpha()}))
    # the characters of one-byte pairs: in which pairs each can stand, and in which it changes
    stands: dict[str, int] = {}
    for i, (_, to, _) in enumerate(pairs):
        for k in to:
            stands[chr(k)] = stands.get(chr(k), 0) | 1 << i
    letters = ahocorasick.Automaton()
    for c, mask in stands.items():
        letters.add_word(c, mask)
    letters.make_automaton()
    lone: dict[str, list[str]] = {}
    for lead in range(0xC3, 0xE0):
        for rest in [*range(0x80, 0xA0), 0xAD]:
            lone.setdefault(chr(lead), []).append(bytes([lead, rest]).decode())
    lone["Ã"].append("à")  # its second half is a no-break space, often made a space
    lone["â"] = list("“”„’‘–—…€•")
    return sets, automaton, (pairs, letters), lone


class Restorer:
    """Judges tokens and texts. ``judge`` gives (restored, what it was) or None; results are kept by token."""

    def __init__(self, model: LetterModel):
        self.model = model
        self._memo: dict[str, tuple[str, str] | None] = {}

    def _utf8(self, token: str) -> tuple[str, str, bool] | None:
        """Decodes as often as it decodes: the result, the sets, and if the evidence is firm."""
        sets, automaton, _, _ = _tables()
        cur, names, firm = token, [], False
        while True:  # every round shortens the token
            mask = 0
            for _, m in automaton.iter(cur):
                mask |= m
            best = None
            for i, s in enumerate(sets):
                if mask >> i & 1:
                    out, n, control, whole = s.decode(cur)
                    if n and out != cur:
                        score = self.model.mean(out) + 0.5 * whole
                        if best is None or score > best[0]:
                            best = (score, out, s.codec, control > 0 or (n > 1 and whole))
            if best is None or len(best[1]) >= len(cur) or (names and self.model.gain(cur, best[1]) < (0 if _MESS.search(cur) else GAIN)):
                break
            cur, firm = best[1], firm or best[3]
            names.append(best[2])
        return (cur, "utf-8 as " + ", ".join(names), firm) if names else None

    def _lone(self, token: str) -> str:
        """Lead characters whose continuation was lost get the likeliest one."""
        lone = _tables()[3]
        cur = token
        for i in range(len(token) - 1, -1, -1):
            if token[i] in lone:
                best = max(lone[token[i]], key=lambda c: (self.model.mean(x := cur[:i] + c + cur[i + 1 :]), not _INNER_CAPITAL.search(x), c.islower()))
                if self.model.mean(trial := cur[:i] + best + cur[i + 1 :]) > self.model.mean(cur):
                    cur = trial
        return cur

    def _one_byte(self, token: str, own: float) -> tuple[float, str, str] | None:
        best = None
        high = [c for c in token if ord(c) > 127]
        ascii_too = len(high) < len(token)
        pairs, letters = _tables()[2]
        mask, seen = (1 << len(pairs)) - 1, 0
        for _, own_pairs in letters.iter(token):
            mask &= own_pairs
            seen += 1
        if seen < len(high):  # a character that no pair has
            return None
        while mask:
            name, to, changing = pairs[(mask & -mask).bit_length() - 1]
            mask &= mask - 1
            if ascii_too and _OTHER_SCRIPT.search(name.split(" as ")[0]):
                continue
            if not _PUNCTUATION.match("".join(c for c in high if c in changing)):
                out = token.translate(to)
                if _INNER_CAPITAL.search(out) and not _INNER_CAPITAL.search(token):
                    continue
                gain = self.model.mean(out) - own
                if best is None or gain > best[0]:
                    best = (gain, out, name)
        return best

    def _wide(self, token: str, own: float) -> tuple[float, str, str] | None:
        best = None
        trials = []
        if len(token) > 1 and all(ord(c) < 256 for c in token) and sum(ord(c) > 127 for c in token) * 2 >= len(token):
            trials += [(token, "latin-1", w) for w in WIDE]
        if any("⺀" < c < "퟿" for c in token):
            trials += [(token, w, "utf-8") for w in WIDE]
        for text, read, written in trials:
            try:
                out = codecs.decode(codecs.encode(text, read), written)
            except (UnicodeError, ValueError):
                continue
            gain = self.model.mean(out) - own
            if out != token and (best is None or gain > best[0]):
                best = (gain, out, f"{written} as {read}")
        return best

    def _judge(self, token: str) -> tuple[str, str] | None:
        if "�" in token:
            return token, "replaced"
        own = self.model.mean(token)
        one = self._one_byte(token, own)
        if found := self._utf8(token):
            out, name, firm = found
            gain = self.model.gain(token, out)
            if (gain > GAIN_UTF8 or (firm and gain > -1.5) or (len(token) - len(out) > 3 and not _OTHER_SCRIPT.search(name))) and not (one and one[0] > max(self.model.mean(out) - own + (2.0 if firm else 0.3), GAIN)):
                fixed = self._lone(out)
                return fixed if self.model.gain(out, fixed) > GAIN else out, name
        if _EMOJI_REST.match(token) or _CUT.match(token):
            return token, "cut"
        if "\xa0" in token:  # no part of a letter, then
            parts = token.split("\xa0")
            found = [self.judge(p) if _TOKEN.fullmatch(p) else None for p in parts]
            names = [f[1] for f in found if f and not _weak(f)]
            return ("\xa0".join(f[0] if f else p for f, p in zip(found, parts)), names[0]) if names else None
        tries = [t for t in (one, self._wide(token, own)) if t]
        if (fixed := self._lone(token)) != token:
            tries.append((self.model.mean(fixed) - own, fixed, "utf-8, controls lost"))
        if tries and (best := max(tries))[0] > GAIN:
            return best[1], best[2]
        if _C1.search(token):  # no one types controls: read as Latin-1 from the Windows set that suits best
            options = [(self.model.mean(out), out, f"{name} as latin-1") for name in ("cp1252", "cp1250", "cp1251") if (out := token.translate(dict(zip(range(128, 160), _chars(name)))))]
            return max(options)[1:]
        return None

    def judge(self, token: str) -> tuple[str, str] | None:
        if token not in self._memo:
            if len(self._memo) > MEMO:
                self._memo.clear()
            self._memo[token] = self._judge(token)
        return self._memo[token]

    def restore(self, text: str | None) -> tuple[str | None, str | None]:
        """The text with its garbled spans restored, and what they were; (text, None) where nothing is garbled."""
        if not text:
            return text, None
        plain, places = text, None
        if "&" in text or "\\u" in text:
            plain, places = _unescaped_with_places(text)
        # short tokens say too little by themselves: they follow a longer one of the same pair
        spans = [(m.start(), m.end(), f) for m in _TOKEN.finditer(plain) if (f := self.judge(m.group()))]
        found = {plain[i:j]: f for i, j, f in spans}
        names = [f[1] for t, f in found.items() if not _weak(f)]
        # letters of another script in place of letters: one token can be a misspelling, two can't
        firm = {n for n in names if not _SAME_KIND.search(n) or names.count(n) > 1 or any(f[1] == n and not t.isalpha() or any("a" <= c.lower() <= "z" for c in t) for t, f in found.items() if f[1] == n)}
        if not firm:
            return text, None
        # only what is garbled is replaced: escapes elsewhere stay as they were typed
        out, at = [], 0
        for i, j, f in spans:
            if f[1] in firm:
                i, j = (i, j) if places is None else (places[i], places[j])
                out += [text[at:i], f[0]]
                at = j
        return "".join([*out, text[at:]]), max(sorted(firm), key=[f[1] for f in found.values()].count)


def _unescaped_with_places(text: str) -> tuple[str, list[int]]:
    """The text with its escapes of characters outside ASCII resolved, and where each of its characters, and the end, lay."""
    out, places, at = [], [], 0
    for m in _ESCAPE.finditer(text):
        x = _unescaped(m.group())
        if ord(x[0]) > 127:
            out += [text[at : m.start()], x]
            places += [*range(at, m.start()), *[m.start()] * len(x)]
            at = m.end()
    return "".join([*out, text[at:]]), [*places, *range(at, len(text) + 1)]


def _weak(found: tuple[str, str]) -> bool:
    out, name = found
    if name.endswith("as latin-1") and _C1.search(out) is None and any(c in "‚ƒ„…†‡ˆ‰‹‘’“”•–—˜™›" for c in out):
        return False
    return not name.startswith(("utf-8 as", "replaced", "cut")) and sum(c.isalpha() for c in out) < 3


def _unescaped(s: str) -> str:
    return chr(int(s[2:], 16)) if s[0] == "\\" else html.unescape(s)


def letter_counts(texts: DataFrame) -> DataFrame:
    """Hashed trigram counts (bucket, n) over a frame with one column ``text``: at most ``BUCKETS`` rows."""
    tokens = texts.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(F.explode(F.split(F.lower("text"), _NON_TOKEN)).alias("w"))
    tokens = tokens.where(F.col("w").rlike(r"[^\x00-\x7F]")).groupBy("w").agg(F.count("*").alias("n"))
    w = F.concat(F.lit("^"), "w", F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    grams = tokens.select(F.explode(grams).alias("g"), "n")
    return grams.groupBy(F.crc32("g").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))


def fit_letters(texts: DataFrame) -> np.ndarray:
    """The letter model's table: ``BUCKETS`` counts, whatever the size of the corpus."""
    counts = np.zeros(BUCKETS, dtype="float32")
    for bucket, n in letter_counts(texts).collect():
        counts[bucket] = n
    return counts


_LOCAL: list[Restorer] = []


def local_restorer(table: np.ndarray) -> Restorer:
    """The process's restorer for a letter table; only the last is kept."""
    if not _LOCAL or _LOCAL[0].table is not table:
        _LOCAL[:] = [Restorer(LetterModel(table))]
        _LOCAL[0].table = table
    return _LOCAL[0]


def restored(text: Column, counts) -> Column:
    """struct<restored, pair>: ``pair`` is null where nothing is garbled. ``counts``: a broadcast of ``fit_letters``."""
    @F.pandas_udf("struct<restored:string,pair:string>")
    def apply(texts: pd.Series) -> pd.DataFrame:
        restorer = local_restorer(counts.value)
        pairs = [restorer.restore(t) for t in texts]
        return pd.DataFrame({"restored": [p[0] for p in pairs], "pair": [p[1] for p in pairs]}, dtype=object)

    return apply(text)


def find_garbled(df: DataFrame, key: str, text: str, counts) -> DataFrame:
    """(key, text, restored, pair) of the rows whose text is garbled."""
    rows = df.select(F.col(key).alias("record_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]|&[#A-Za-z]|\\u"))
    rows = rows.withColumn("r", restored(F.col("text"), counts))
    return rows.where(F.col("r.pair").isNotNull()).select("record_id", "text", "r.restored", "r.pair")
