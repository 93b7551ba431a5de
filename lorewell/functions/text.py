"""Text functions as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters with a canonical decomposition to one base letter and marks, and their base letters."""
    src, dst = [], []
    for code in [*range(0xC0, 0x2000), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800)]:
        c = chr(code)
        if c.lower() != c:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


def fold(text: Column) -> Column:
    """Lower case, without diacritics. One function for index, query and lexicon, so they can't drift apart."""
    src, dst = _fold_table()
    return F.regexp_replace(F.translate(F.lower(text), src, dst), r"\p{Mn}+", "")


def fold_plain(text: str) -> str:
    """``fold`` for query strings on the driver."""
    src, dst = _fold_table()
    return "".join(c for c in text.lower().translate(str.maketrans(src, dst)) if unicodedata.category(c) != "Mn")


TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    """The searchable words of a text: folded runs of letters, numbers and private characters."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_text(words: Column) -> Column:
    """Tokens with a space around each, for phrase and prefix tests."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def demojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, repaired; any other text as it is."""
    raw = F.encode(text, "ISO-8859-1")
    valid = F.call_function("is_valid_utf8", raw)
    # nested, as a flat AND need not be evaluated in order and encode() fails beyond Latin-1
    return F.when(text.rlike(r"^[\x{00}-\x{FF}]*$"), F.when(valid, F.decode(raw, "UTF-8")).otherwise(text)).otherwise(text)


# The wording of reaction notices.
NOTICE = r"(?i)^\s*(\S+\s+)?(reacted\s+\S{1,8}\s+to\s+your\s+message|liked\s+a\s+message)\s*$"


def is_notice(text: Column) -> Column:
    """A machine's line that someone reacted; the cheap test first."""
    return F.coalesce(F.lower(text).contains("message") & text.rlike(NOTICE), F.lit(False))


def preview(text: Column, n: int = 160) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def name_like(name: Column, q: str) -> Column:
    """``%q%`` with % and _ as wildcards; case is ignored for ASCII letters only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(name, upper, lower).like(f"%{q.translate(str.maketrans(upper, lower))}%")


def negated(form: Column, lemma: Column) -> Column:
    """Whether a word form is the negated half of its paradigm: ``ne`` that the lemma doesn't have itself."""
    return F.when(lemma.startswith("ne"), F.lit(False)).otherwise(F.regexp_replace(form, "^nej", "").startswith("ne"))


def thread_kind(members: Column) -> Column:
    return F.when(members <= 2, "DM").otherwise("GROUP")


def thread_title(file_stem: Column) -> Column:
    return F.regexp_replace(file_stem, r"_\d+$", "")


# Media types that decide buckets and source keys.
MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic",
    "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "m4a": "audio/mp4", "mp3": "audio/mpeg", "ogg": "audio/ogg",
    "wav": "audio/wav", "opus": "audio/opus", "pdf": "application/pdf",
}


def media_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(table, suffix)


def media_bucket(mime: Column) -> Column:
    major = F.split_part(mime, F.lit("/"), F.lit(1))
    return F.when(major == "image", "photos").when(major == "video", "videos").when(major == "audio", "audio_files").otherwise("files")


def account_mri(value: Column) -> Column:
    """One spelling of an account id; null for those that name no one."""
    v = F.trim(value)
    full = F.when(v.rlike(r"^\d+:"), v).otherwise(F.concat(F.lit("8:"), v))
    bare = F.regexp_replace(full, r"^\d+:", "")
    return F.when(v.isNull() | (v == "") | bare.isin("", "*"), None).otherwise(full)


# Emoji of reaction shortcodes.
EMOJI = {
    "yes": "👍", "like": "👍", "likewithface": "👍", "no": "👎", "heart": "❤️",
    "laugh": "😆", "xd": "😆", "cwl": "😂", "rofl": "🤣", "giggle": "🤭",
    "ok": "👌", "surprised": "😮", "star": "⭐", "cry": "😢",
    "loudlycrying": "😭", "stareyes": "🤩", "hearteyes": "😍", "sad": "😞",
    "party": "🎉", "festiveparty": "🎉", "facepalm": "🤦", "clap": "👏",
    "clappinghands": "👏", "clappinghandsskype": "👏", "rock": "🤘",
    "dance": "💃", "discodancer": "🕺", "tongueout": "😛", "champagne": "🥂",
    "cheers": "🍻", "drink": "🍹", "redwine": "🍷", "monkey": "🐵",
    "coolmonkey": "🐵", "seenoevil": "🙈", "hearnoevil": "🙉",
    "highfive": "🙌", "handsinair": "🙌", "muscle": "💪", "fire": "🔥",
    "skull": "💀", "think": "🤔", "wink": "😉", "angry": "😠",
    "angryface": "😠", "smile": "🙂", "smileeyes": "😊", "happyface": "😀",
    "cool": "😎", "worry": "😟", "snowflake": "❄️", "hearthands": "🫶",
    "sun": "☀️", "fearful": "😨", "screamingfear": "😱", "praying": "🙏",
    "cake": "🎂", "music": "🎵", "flushed": "😳", "blush": "😊",
    "inlove": "🥰", "sleepy": "😴", "tired": "😫", "unamused": "😒",
    "pensive": "😔", "puke": "🤮", "sarcastic": "😏", "smirk": "😏",
    "nerdy": "🤓", "victory": "✌️", "crossedfingers": "🤞", "bow": "🙇",
    "nod": "👍", "whew": "😅", "sweatgrinning": "😅", "doh": "🤦",
    "fistbump": "👊", "vulcansalute": "🖖", "snowangel": "⛄",
    "snegovik": "⛄", "snowmanwithoutsnow": "⛄", "santa": "🎅",
    "xmastree": "🎄", "fireworks": "🎆", "movie": "🎬", "games": "🎮",
    "headphones": "🎧", "bicycle": "🚲", "desert": "🏜️", "goodluck": "🍀",
    "wonder": "🤔", "dull": "😐", "mmm": "😊", "tmi": "🙊", "solo": "🎸",
    "grinningfacewithsmilingeyes": "😄", "meltingface": "🫠",
    "peekingeye": "👀", "webheart": "❤️", "cactuslove": "🌵",
}


def emoji_for(key: Column) -> Column:
    """The emoji of a reaction shortcode; an unknown one stays legible."""
    k = F.trim(F.coalesce(key, F.lit("")))
    code = F.regexp_extract(k, r"^([0-9a-f]{4,6})_", 1)
    drawn = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    base = F.lower(F.regexp_replace(k, r"(-tone\d|MSER)$", ""))
    table = F.create_map(*[F.lit(x) for pair in EMOJI.items() for x in pair])
    named = F.coalesce(F.try_element_at(table, base), F.try_element_at(table, F.regexp_replace(base, "^xmas", "")))
    return (
        F.when(k == "", "?").when(code != "", drawn).when(named.isNotNull(), named)
        .when(k.rlike(r"^[\p{L}\p{N}]+$"), F.concat(F.lit(":"), k, F.lit(":"))).otherwise(k)
    )


def links(text: Column) -> Column:
    """The web links of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<]+"), F.lit(0))


def file_size(size: Column) -> Column:
    """A size for reading: 0 B, 1.5 KB, 20 MB."""
    step = F.least(F.floor(F.log2(F.greatest(size, F.lit(1))) / 10), F.lit(4))
    value = size / F.pow(F.lit(1024.0), step)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), (step + 1).cast("int"))
    shown = F.when((step == 0) | (value >= 10), F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    return F.concat(shown, F.lit(" "), unit)


def avatar_document(url: Column) -> Column:
    """The document id in a picture's address."""
    return F.nullif(F.regexp_extract(url, r"/objects/([^/?\s]+)", 1), F.lit(""))


def account_handle(mri: Column) -> Column:
    """The part of an account id that people read."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(mri, r"^\d+:", ""), "^live:", ""), r"^\.+", ""), r"^cid\.", "")
    return F.when(bare.startswith("unknown_user_"), F.concat(F.lit("Unknown account ("), F.substring(F.regexp_replace(bare, "^unknown_user_", ""), 1, 8), F.lit(")"))).otherwise(bare)
