"""Template residue, filler, error pages and script notices among messages.

Lines are normalised (case, digits, links) and counted by host over all records of several lines. A line that
stands with ``OTHERS`` different remainders at a host is recurrent boilerplate there and is subtracted, unless nothing
would be left. What is left is examined for four kinds of evidence:

``placeholder``  an unfilled slot, or a slot filled with undefined, null, NaN, None or [object Object]. A word like
                 ``null`` alone is evidence if its frame (the text with slots taken out) occurs elsewhere in the
                 corpus with an open slot or with another such filling; frames are counted over all records.
``filler``       pseudo-Latin or sample text.
``error``        an error page: a status code with an impersonal reason, a stack trace.
``script``       a request to switch on scripts or cookies.

Evidence has to be the form of the text (how it begins, what its slots hold), not a topic: people who talk about
errors, scripts or templates, or quote them in backquotes, are no case. Markup around words is taken off first; text
in a wrong encoding is restored first.

Defined results: null, empty and blank text has no evidence; the whole text is examined; repeated rows are judged
alike; a null host is a host of its own.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.garbled import local_restorer
from lorewell.session import written

OTHERS = 3

_HTML = "a|abbr|address|article|aside|at|audio|b|blockquote|body|br|button|caption|center|cite|code|col|dd|del|details|dfn|div|dl|dt|em|embed|fieldset|figure|font|footer|form|h[1-6r]|head|header|html|i|iframe|img|input|ins|kbd|label|legend|li|main|mark|meta|nav|noscript|object|ol|option|p|pre|q|s|samp|script|section|select|small|source|span|ss|strike|strong|style|sub|summary|sup|svg|table|tbody|td|textarea|tfoot|th|thead|tr|tt|u|ul|uriobject|var|video"
_TAG = regex.compile(rf"</?(?i:{_HTML})(?:\s[^<>%]{{0,400}})?/?>|<!--.*?-->|<!doctype[^<>]*>")
_LEAD = regex.compile(r"(?i)^\W*\[(?:preview|embed|link)\]\s*")
_URL = regex.compile(r"https?://\S+")
_SLOT = regex.compile(
    r"\{\{\s*[\w. ]{1,40}\s*\}\}|(?<![`\w])\$\{[\w. ]{1,40}\}(?![/\\])|<%=?\s*[\w. ]{1,40}\s*%>|%\([\w.]{1,40}\)[sd]|\[\[\s*[\w. ]{1,40}\s*\]\]|(?<![\w%])%[^\W\d][\w.]{2,40}%(?!\w)"
    r"|\[insert [\w. ]{1,40}\]|<[^\W\d][\w.]{1,40}>|<insert [\w. ]{1,40}>|(?<![\w{$`])\{[^\W\d][\w.]{1,40}\}(?![\w}])|#\{[\w. ]{1,40}\}|\*\|[\w.]{2,40}\|\*|__[a-z][\w.]{0,38}[a-z]__|@@[\w.]{2,40}@@"
)
_HOLLOW = regex.compile(r"\[object object\]|\(null\)|(?<![\w.])(?:undefined|null|nan|none)(?![\w(])")
_WORD = re.compile(r"[^\W\d_]+")
# what _SLOT, _HOLLOW, _GAP and _SCRIPT can't match without
_SLOT_MARK = re.compile(r"[{%<\[]|\*\||__|@@")
_HOLLOW_WORDS = ("null", "nan", "none", "undefined", "[object object]")
_GAP_MARK = re.compile(r"\s[,!.\s]|:|^has joined|^sent you|^\s")
_SCRIPT_WORDS = ("script", "js", "cookie", "skript", "скрипт", "сценари", "スクリプト", "クッキー", "脚本", "스크립트", "쿠키", "checking your browser")
_GAP = regex.compile(r"\p{L}\s+[,!.](?:\s|$)|:\s*$|\S\s{2,}\S|^\s+(?:has|sent)|^(?:has joined|sent you)|: (?:starts|$)")
_FIRM_HOLLOW = regex.compile(r"\[object object\]|\(null\)")
_QUOTED = regex.compile(r"`[^`]*`")
_ABOUT = regex.compile(r"\btemplates?\b|\bmail merge\b|\bvorlage|\bsablon|\bplantilla|\bmodele\b|шаблон|\bsyntax|\bpole\b|\bformular|\bfields?\b|\bfeld\b|\bcampo\b|\bchamp\b|\bregex|\bf-strings?\b")
_GREETING = regex.compile(r"^(?:dear|hi|hello|hey|hallo|liebe[rs]?|hola|bonjour|ahoj|dobry den|привет|здравствуйте|czesc|ola|ciao)[, ]+(?:undefined|null|nan|none)\s*[,!.:]")

# The words of the customary filler text.
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis
nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum felis quam risus porta ornare curabitur curat elementum
sodales tincidunt dapibus vexillum vestibulum mauris vitae ultricies pellentesque nec turpis egestas massa nibh ligula""".split()  # fmt: skip
_LOREM_HEADS = frozenset(w[:5] for w in LOREM if len(w) >= 5) | frozenset(w for w in LOREM if len(w) < 5)
_FILLER = regex.compile(
    r"^\W*(?:(?:sample|dummy|example|filler) (?:text|message|content|body)\b|placeholder (?:text|message|content|for)\b|.{0,40}\b(?:text|content|message|title|copy) goes here\b"
    r"|todo\s*[:\-–]|tbd\W*$|(?:test\W+){2,}(?:test|message|body|text|\d)|x{3,}\W.*\bx{3,}\W*$|x{3,}\W+(?:doplnit|fill|todo)|(?:asdf|qwer)\w*\W*$|blah(?:\W+blah){2,}\W*$|(?:insert|enter|type) (?:your )?(?:text|message|title) here\b|replace (?:this|me) before|(?:text\W+){3,}text\W*$|zde bude (?:text|obsah)|sem (?:vlozte|napiste|prijde)|hier (?:steht|kommt)\b.{0,20}\btext\b|(?:ihr|dein) text hier|text hier einfugen|(?:insira|digite|escreva|coloque|inserte|inserta|escriba|escribe|ingrese|inserisci)\b.{0,20}\bte(?:x|s)to\b|(?:tu|su|seu) texto aqui|texto aqui|(?:votre|saisissez|inserez|ecrivez).{0,12}texte? ?(?:ici)?\W*$|введите (?:сюда )?текст|здесь будет|текст здесь|wpisz (?:tutaj |tu )?(?:tekst|tresc)|tu (?:bedzie|wpisz)\b|ここに.{0,12}(?:テキスト|入力)|(?:在此|此处|这里|请)(?:输入|填写)|여기에.{0,12}(?:텍스트|입력)|ادخل النص|نص تجريبي|εισαγετε (?:το )?κειμενο|κειμενο εδω|platzhaltertext|blindtext|texte? factice|texto de (?:ejemplo|relleno|exemplo)|текст.заполнитель|ダミーテキスト|示例文本|占位)"
)
_KEY = r"(?:http|https|error|status|code|fehler|erreur|chyba|blad|erro|errore|ошибка|σφαλμα|エラー|错误|錯誤|오류|خطا)"
_REASON = (
    r"(?:the )?(?:requested )?(?:page|resource|url|content)(?: you(?: have)? requested)? (?:does|could|can|was|is|has|cannot)|the page you requested|the requested page|(?:this |the )?(?:content|page|link|message) (?:has been (?:moved|deleted|removed)|is (?:un|not |no longer )available|isn.t available|was (?:moved|deleted|removed))|the server (?:did|is|has|encountered)"
    r"|too many requests|not found|bad gateway|service (?:temporarily )?unavailable|forbidden|gateway time|internal server error|access (?:to|denied|forbidden)|bad request|unauthori[sz]ed|request timeout|moved permanently"
    r"|acces refuse|(?:la |cette )?page (?:demandee|introuvable)|(?:le )?serveur (?:ne|est)|die angeforderte|(?:die )?seite (?:wurde )?nicht|der server|dieser inhalt|zugriff verweigert|pozadovan|stranka (?:ne|nebyla)|server je|obsah byl|pristup (?:odepren|zamitnut)|prilis mnoho"
    r"|(?:la )?pagina (?:solicitada|no|nao|non)|(?:el )?servidor|acceso denegado|acesso negado|a pagina|il server|запрошенн|страница не|сервер|доступ запрещ|контент|слишком много|zadana strona|strona nie|serwer|dostep|zbyt wiele|ページ|サーバ|アクセス|页面|服务器|访问|페이지|서버|الصفحة|الخادم|η σελιδα|पृष्ठ|ไม่พบหน้า"
)
_LONG = (  # reasons that say enough without a code
    r"the page you requested|the requested page|(?:this |the )?content (?:has been (?:moved|deleted)|is (?:unavailable|not available)|isn.t available)|the server did not answer in time|too many requests from|la page demandee|die angeforderte seite|der server antwortet nicht|acces refuse a"
    r"|pozadovana stranka|server je docasne|obsah byl odstranen|la pagina solicitada|a pagina solicitada|la pagina richiesta|запрошенная страница|сервер временно|zadana strona|serwer nie odpowiada|お探しのページ|请求的页面|您访问的页面|요청하신 페이지|الصفحة المطلوبة"
)
_OH = r"(?:(?:\p{L}{2,9}|uh[ -]oh)\W+)?"  # oops, hoppla, ...
_TAILS = r"(?:[\W\d]*(?:try again(?: in \d+ seconds)?|request(?: id)?|ray id|guru id|contact the administrator|back to(?: the)? \w+(?: page)?|erneut versuchen|zpet na uvod|reessayer|volver|retour|повторить)[\W\d]*)*$"
_ERROR = regex.compile(
    rf"^\W*(?:(?:{_KEY}\W*){{1,2}}\d{{3,5}}\s*[:\-–—!.\n|]\s*\S|(?:{_KEY}\W*){{0,2}}[45]\d\d\W+(?:{_REASON})|traceback \(?most recent call|internal server error\b(?!.*\blol\b)|(?:this|the) (?:preview|page|content|message) could not be loaded\b|backend fetch failed"
    rf"|{_OH}(?:{_LONG})[^?]*$)"
)
_TALK = regex.compile(r"\blol\b|\bagain all\b|\?\s+\w|\bi (?:got|get|had|saw|have)\b|\bmy\b")
_TECH = r"(?:java ?script|\bscripting\b|\bjs\b|\bscripts?\b|\bcookies?\b|\bskripte?\b|скрипт\w*|сценари\w+|スクリプト|クッキー|脚本|스크립트|쿠키)"
_SWITCH = r"(?:\benable\b|\bactivate\b|\bturn on\b|\bswitch on\b|\ballow\b|\baktivieren sie\b|\bschalten sie\b|\bactivez\b|\bactiver\b|\bactiva\b|\bactive\b|\bative\b|\bhabilite?\b|\bzapnete\b|\bpovolte\b|\bwlacz\b|\bабилитуй|включите|разрешите|\babilita\b|\battiva\b|ενεργοποι|有効|启用|開啟|开启|활성화|تفعيل|فعل|सक्षम|चालू|เปิดใช้)"
_SCRIPT = regex.compile(
    rf"{_SWITCH}[^?]{{0,40}}{_TECH}|{_TECH}[^?]{{0,24}}(?:有効|启用|활성화|सक्षम|चालू|เปิดใช้|turn it on|\bis disabled|\bare disabled|\bis required|\brequired\b|\bdeaktiviert|\bdesactiv|\bdesativ|\bvypnut|\bwylaczon|отключен|выключен)|^\W*checking your browser\b"
)
_NOT_NOTICE = regex.compile(r"\?|\bmy (?:java ?script|scripts?)\b|\bi (?:can|had|have to)\b|\blol\b")


class _Folds(dict):
    """What a character becomes: nothing where it is an accent or invisible."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "" if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else {"ł": "l", "đ": "d"}.get(c, c)
        return out


_FOLDS = _Folds()


def folded(text: str) -> str:
    """Case, accents, width and invisible characters taken off; white space as single spaces."""
    if not text.isascii():
        return " ".join(unicodedata.normalize("NFKD", text).casefold().translate(_FOLDS).split())
    return " ".join(text.lower().split())


def evidence(text: str) -> tuple[str | None, str | None, bool]:
    """(kind, frame, firm): ``frame`` is set where a text has slots or hollow words; firm: it needs no other proof.

    Every text comes here, so what a pattern can't match without is looked for first; that changes no result.
    """
    bare = _TAG.sub(" ", text) if "<" in text else text
    bare = (_URL.sub(" ", bare) if "http" in bare else bare).strip()
    if "[" in bare:
        bare = _LEAD.sub("", bare)
    if "&" in bare:
        bare = html.unescape(bare)
    t = folded(bare)
    if not t:
        return None, None, False
    open_ = _QUOTED.sub(" ", t) if "`" in t else t
    slots = _SLOT.findall(open_) if _SLOT_MARK.search(open_) else []
    hollow = _HOLLOW.findall(open_) if any(w in open_ for w in _HOLLOW_WORDS) else []
    frame = None
    if slots or hollow:
        frame = regex.sub(r"\d+", "0", _HOLLOW.sub("¤", _SLOT.sub("¤", open_))).strip(" .!?,")
        about = _ABOUT.search(_SLOT.sub(" ", open_))
        if not about and (slots or _FIRM_HOLLOW.search(open_) or len(set(hollow)) > 1 or _GREETING.match(open_)):
            return "placeholder", frame, True
        if about:
            frame = None
    elif _GAP_MARK.search(bare) and _GAP.search(bare):  # a slot may have been filled with nothing
        frame = regex.sub(r"\d+", "0", t).strip(" .!?,")
    words = _WORD.findall(t)
    if not "".join(words).isalpha():  # numerals that are no digits
        words = regex.findall(r"\p{L}+", t)
    latin = sum(w[:5] in _LOREM_HEADS for w in words)
    if (len(words) >= 4 and latin >= 0.7 * len(words) and sum(len(w) >= 5 and w[:5] in _LOREM_HEADS for w in words) >= 2) or _FILLER.match(t):
        return "filler", frame, True
    if _ERROR.match(t) and not _TALK.search(t):
        return "error", frame, True
    if any(w in t for w in _SCRIPT_WORDS) and _SCRIPT.search(t) and not _NOT_NOTICE.search(t):
        return "script", frame, True
    return ("placeholder" if frame else None), frame, False


def _lines(rows: DataFrame) -> DataFrame:
    """(row_id, host, pos, line, form, total) of the records of several lines; ``total`` sums the hashes of all their lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    hashed = lambda x: F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"https?://([^/\s]+)\S*", "link $1"), r"\d+", "0"))
    several = rows.where(F.col("text").contains("\n")).select("row_id", "host", lines.alias("lines")).where(F.size("lines") > 1)
    several = several.select("row_id", "host", "lines", F.transform("lines", hashed).alias("forms"))
    total = F.aggregate("forms", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    placed = several.select("row_id", "host", total.alias("total"), F.posexplode(F.arrays_zip("lines", "forms")).alias("pos", "x"))
    return placed.select("row_id", "host", "pos", F.col("x.lines").alias("line"), F.col("x.forms").alias("form"), "total")


def recurrent(rows: DataFrame) -> DataFrame:
    """(host, form) of the lines that are boilerplate; only hashes are shuffled, counted before that."""
    # a remainder is known by the sum of the other lines' hashes
    counted = _lines(rows).groupBy("host", "form").agg(F.approx_count_distinct(F.col("total") - F.col("form")).alias("others"))
    return counted.where(F.col("others") >= OTHERS).select("host", "form", F.lit(True).alias("boiler"))


def residuals(rows: DataFrame) -> DataFrame:
    """(row_id, host, residual): the text without lines that are recurrent boilerplate at its host."""
    boiler, placed = recurrent(rows), _lines(rows)
    kept = placed.join(boiler, (placed["host"].eqNullSafe(boiler["host"])) & (placed["form"] == boiler["form"]), "left").select(placed["row_id"], "pos", "line", F.coalesce("boiler", F.lit(False)).alias("boiler"))
    left = kept.groupBy("row_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("boiler"), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("residual"),
    )
    left = left.where("residual <> ''")
    return rows.join(left, "row_id", "left").select("row_id", "host", F.coalesce("residual", "text").alias("residual"))


def judged(rows: DataFrame, counts) -> DataFrame:
    """(row_id, kind) of the records with evidence. ``rows``: row_id, host, text; ``counts``: the letter model's broadcast."""

    @F.pandas_udf("struct<kind:string,frame:string,firm:boolean>")
    def look(texts: pd.Series) -> pd.DataFrame:
        restorer = local_restorer(counts.value)
        memo: dict[str, tuple] = {}
        out = []
        for t in texts:
            if t not in memo:
                memo[t] = evidence(t if t.isascii() else restorer.restore(t)[0])
            out.append(memo[t])
        return pd.DataFrame(out, columns=["kind", "frame", "firm"])

    # every record is looked at; only those of several lines can have boilerplate
    several = F.col("text").contains("\n")
    whole = rows.where(~several).select("row_id", F.col("text").alias("residual"))
    left = residuals(written(rows.where(several).select("row_id", "host", "text"), "several")).select("row_id", "residual")
    seen = written(whole.unionByName(left).select("row_id", look("residual").alias("e")).select("row_id", "e.kind", "e.frame", "e.firm").where("kind IS NOT NULL"), "seen")
    firm = seen.where("firm").select("row_id", "kind")
    # slots may be filled with nothing: frames are compared without their slots
    seen = seen.withColumn("frame", F.trim(F.regexp_replace(F.regexp_replace("frame", "¤", " "), r"\s+", " "))).withColumn("frame", F.regexp_replace("frame", r"\s+([,.!?:])", "$1"))
    proven = seen.where("firm AND frame IS NOT NULL AND kind = 'placeholder'").where(F.length("frame") > 6).select("frame").distinct()
    weak = seen.where("NOT firm").join(proven, "frame", "left_semi").select("row_id", "kind")
    return firm.unionByName(weak)
