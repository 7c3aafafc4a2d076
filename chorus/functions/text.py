"""Text expressions.

The reference's patterns use Python's Unicode ``\\w`` / ``\\s``; Java's are
ASCII-only, so the classes are spelled out: a word character is a letter, a
number or ``_``; whitespace is what ``str.isspace`` accepts.  The same
classes are valid RE2 syntax, so the DuckDB oracles reuse these strings.

Expressions that read every character of a text several times (P7–P10) are
Arrow functions of one text column: Java's matcher takes 5 to 15 ns a character
for each Unicode class, Python's about a tenth, so a text is handed over once
and all its passes run there.  They hold only compiled patterns and fixed
values, so Python workers need nothing but the function itself.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed character classes (Python's Unicode \w and \s).
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"
NON_SPACE = r"[^\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"

# Fixed patterns (same meaning as the reference's expressions).
URL = rf"https?://{NON_SPACE}+|www\.{NON_SPACE}+"
HTTP_URL = rf"https?://{NON_SPACE}+"
URL_STRICT = r"https?://[^\s<>\"{}|\\^`\[\]]+"
MENTION = rf"@{WORD}+"
UPPER = r"\p{Lu}"
DIGITS = r"\p{Nd}+"
HASHTAG = rf"#({WORD}+)"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"

# Emoji names used by the emoji score, with their code points.
POSITIVE_EMOJI = {
    ":smile:": "\U0001F604",
    ":grinning_face_with_big_eyes:": "\U0001F603",
    ":heart_eyes:": "\U0001F60D",
    ":thumbs_up:": "\U0001F44D",
    ":grinning:": "\U0001F600",
    ":blush:": "\U0001F60A",
    ":red_heart:": "❤",
}
NEGATIVE_EMOJI = {
    ":frowning_face:": "☹",
    ":angry_face:": "\U0001F620",
    ":thumbs_down:": "\U0001F44E",
    ":crying_face:": "\U0001F622",
    ":pensive_face:": "\U0001F614",
}
# Emoji code point ranges counted by ``num_emojis`` (an approximation of a
# full emoji table, which is not available offline).
EMOJI_RANGES = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F2FF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_space(text) -> Column:
    """``' '.join(text.split())``: whitespace runs → one space, trimmed."""
    return F.trim(F.regexp_replace(_c(text), f"{SPACE}+", " "))


def text_function(texts, make, returns: str) -> Column:
    """A column of one text column by an Arrow function: ``make()`` gives the function of one text (null: empty).

    ``make`` must return a nested function, which is sent by value.
    """
    each = make()

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([each(t) for t in batch.fill_null("").to_numpy(zero_copy_only=False)], kind)
    kind = {"string": pa.string()}.get(returns) or _arrow_type(returns)
    return F.arrow_udf(run, returns)(F.make_valid_utf8(_c(texts)))


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType
    return to_arrow_type(DataType.fromDDL(ddl))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point → 1 for a word character, + 2 for a decimal digit, + 4 for an upper-case letter, + 8 for an emoji as
    ``num_emojis`` counts them; the last entry stands for all code points beyond (none of these)."""
    out = np.zeros(0x33001, np.uint8)
    for c in range(len(out) - 1):
        kind = unicodedata.category(chr(c))
        out[c] = (kind[0] in "LN" or c == 95) + 2 * (kind == "Nd") + 4 * (kind == "Lu")
    for low, high in ((0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0x1F000, 0x1F2FF), (0x2300, 0x23FF), (0x2B00, 0x2BFF)):
        out[low:high + 1] |= 8
    return out


def url_dropper():
    """URLs dropped from one text; most texts have none or only ``http``, whose pattern starts with a literal."""
    both, http = re.compile(r"https?://\S+|www\.\S+"), re.compile(r"https?://\S+")

    def drop(t: str, www: bool = True) -> str:
        if www and "www." in t:
            return both.sub("", t)
        return http.sub("", t) if "http" in t else t
    return drop


def word_splitter(www: bool = True, digits: bool = True):
    """The words of one text without URLs (``www``: those without a scheme too) and mentions, ``#`` before a word
    dropped: runs of word characters, on request without their digits."""
    drop_urls, mentions, unhash, classes = url_dropper(), re.compile(r"@\w+"), re.compile(r"#(?=\w)"), _classes()
    space = np.uint32(32)
    ascii_words, no_digits = bytes(c if classes[c] & 1 else 32 for c in range(128)) + bytes(128), b"" if digits else b"0123456789"

    def words(t: str) -> str:
        t = drop_urls(t, www)
        t = mentions.sub("", t) if "@" in t else t
        t = unhash.sub("", t) if "#" in t else t
        if t.isascii():
            return t.encode().translate(ascii_words, no_digits).decode()
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        of = classes.take(codes, mode="clip")
        if not digits:
            codes, of = codes[of & 2 == 0], of[of & 2 == 0]
        return np.where(of & 1, codes, space).tobytes().decode("utf-32-le")
    return words


def normalizer():
    """P7 of one text: lower → drop URLs → drop mentions → unhash → word runs joined by one space."""
    words = word_splitter()

    def normalize(t: str) -> str:
        return " ".join(words(t.lower()).split())
    return normalize


def _hasher():
    normalize, sha256 = normalizer(), hashlib.sha256

    def digest(t: str) -> str:
        return sha256(normalize(t).encode()).hexdigest()
    return digest


def normalize_content(text) -> Column:
    """Lower → drop URLs → drop mentions → unhash → punctuation to space → collapse."""
    return text_function(text, normalizer, "string")


def content_hash(text) -> Column:
    """SHA-256 hex of the normalised text (empty text shares one hash)."""
    return text_function(text, _hasher, "string")


@lru_cache(maxsize=1)
def emoji_names() -> dict[str, str]:
    """Emoji → name.  The listed names, and by rule for every other code point with the Unicode property Emoji
    (beyond ASCII) its Unicode name in lower case with ``_``.  Where the reference's table uses another short
    name, pass a table."""
    try:
        import regex
        is_emoji = regex.compile(r"\p{Emoji}").match
    except ImportError:  # without the property: the symbols of the emoji blocks
        blocks = ((0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0x1F000, 0x1F2FF), (0x2300, 0x23FF), (0x2B00, 0x2BFF))
        is_emoji = lambda ch: unicodedata.category(ch) == "So" and any(a <= ord(ch) <= b for a, b in blocks)
    out = {chr(c): unicodedata.name(chr(c), "").lower().replace(" ", "_").replace("-", "_")
           for c in (*range(0xA0, 0x3300), *range(0x1F000, 0x1FB00)) if is_emoji(chr(c)) and not 0x1F3FB <= c <= 0x1F3FF}
    listed = {cp: name.strip(":") for name, cp in {**POSITIVE_EMOJI, **NEGATIVE_EMOJI}.items()}
    return {e: n for e, n in out.items() if n} | listed


#: Skin tone modifiers and what they add to a name.
SKIN_TONES = {"\U0001F3FB": "_light_skin_tone", "\U0001F3FC": "_medium_light_skin_tone", "\U0001F3FD": "_medium_skin_tone",
              "\U0001F3FE": "_medium_dark_skin_tone", "\U0001F3FF": "_dark_skin_tone"}
_SELECTOR = "\uFE0F"


def emoji_pattern(names: dict[str, str]) -> str:
    """One pattern for a whole table: sequences first, the longest first, then the single code points as a class, each
    with an optional selector and skin tone."""
    singles = sorted(ord(e) for e in names if len(e) == 1)
    ranges: list[list[int]] = []
    for c in singles:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    parts = [re.escape(e) for e in sorted((e for e in names if len(e) > 1), key=lambda e: (-len(e), e))]
    if ranges:
        parts.append("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges) + "]")
    return f"(?:{'|'.join(parts)})(?:[\\U0001F3FB-\\U0001F3FF]|{_SELECTOR})?"


def demojizer(names: dict[str, str] | None = None):
    """Emoji to names in one text, by a table (default: ``emoji_names()``).  Only places that hold an entry's first
    character are matched."""
    names, tones = emoji_names() if names is None else names, SKIN_TONES
    found = re.compile(emoji_pattern(names)) if names else None
    first = np.zeros(max((ord(e[0]) for e in names), default=0) + 2, bool)  # the last entry stands for all code points beyond
    first[[ord(e[0]) for e in names]] = True
    beyond_ascii = not any(e[0].isascii() for e in names)

    def replace(t: str) -> str:
        if found is None or beyond_ascii and t.isascii():
            return t
        parts, done = [], 0
        for at in np.flatnonzero(first.take(np.frombuffer(t.encode("utf-32-le"), np.uint32), mode="clip")).tolist():
            m = found.match(t, at) if at >= done else None
            if m:
                e = m[0]
                name = f" {names[e]} " if e in names else f" {names[e[:-1]]}{tones.get(e[-1], '')} "
                parts += [t[done:at], name]
                done = m.end()
        return "".join(parts) + t[done:] if parts else t
    return replace


def demojize(text, names: dict[str, str] | None = None) -> Column:
    """Replace the emoji of a table (emoji → name, sequences with joiners and skin tones included) by `` name ``
    (space delimited); by default ``emoji_names()``.

    The longest entry wins at each place; a skin tone behind an entry that the table has only without goes
    into the name, a variation selector goes.  Each text is matched once, whatever the table's size; ASCII
    texts are not searched for a table without ASCII entries.
    """
    t = _c(text)
    return F.when(t.isNotNull(), text_function(t, lambda: demojizer(names), "string"))


def char_count(text, ch: str) -> Column:
    """Occurrences of one character: length minus length without it (native, no regex)."""
    t = _c(text)
    return (F.char_length(t) - F.char_length(F.replace(t, F.lit(ch), F.lit("")))).cast("bigint")


def word_marks(names: dict[str, str] | None = None):
    """P9 of one text but for its white space."""
    emoji, drop_urls, at, unhash = demojizer(names), url_dropper(), re.compile(r"@(?=\w)"), re.compile(r"#(?=\w)")

    def unmark(t: str) -> str:
        t = drop_urls(emoji(t))
        t = at.sub("", t) if "@" in t else t
        return unhash.sub("", t) if "#" in t else t
    return unmark


def cleaner(names: dict[str, str] | None = None):
    """P9 of one text."""
    unmark = word_marks(names)

    def clean(t: str) -> str:
        return " ".join(unmark(t).split())
    return clean


def tokenizer(names: dict[str, str] | None = None):
    """The lower-case words of one cleaned text."""
    unmark = word_marks(names)

    def tokens(t: str) -> list[str]:
        return unmark(t).lower().split()
    return tokens


def clean_text(text, names: dict[str, str] | None = None) -> Column:
    """Emoji → names, drop URLs, ``@x`` → ``x``, ``#x`` → ``x``, collapse whitespace."""
    return text_function(text, lambda: cleaner(names), "string")


def hashtags_from_text(text) -> Column:
    """P1 fallback: ``#(\\w+)`` matches in order."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(HASHTAG), 1)


def mentions_from_text(text) -> Column:
    """P1 fallback: ``@(\\w+)`` matches in order."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(rf"@({WORD}+)"), 1)


def urls_from_text(text) -> Column:
    """P2 fallback: URL-like runs."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(URL_STRICT), 0)


def _features():
    classes, urls, mentions, hashtags = _classes(), re.compile(r"https?://\S|www\.\S"), re.compile(r"@\w+"), re.compile(r"#\w+")

    def features(t: str) -> tuple:
        of = classes.take(np.frombuffer(t.encode("utf-32-le"), np.uint32), mode="clip")
        return (("http" in t or "www." in t) and urls.search(t) is not None,
                len(mentions.findall(t)) if "@" in t else 0, len(hashtags.findall(t)) if "#" in t else 0,
                int(np.count_nonzero(of & 8)), len(t), len(t.split()), t.count("!"), t.count("?"),
                int(np.count_nonzero(of & 4)) / max(len(t), 1))
    return features


_FEATURES = ("has_urls boolean, num_mentions long, num_hashtags long, num_emojis long, text_length long, num_words long, "
             "exclamation_marks long, question_marks long, all_caps_ratio double")


def text_feature_columns(t: Column) -> list[Column]:
    """P10: the preprocessing features of one text (null: null)."""
    found = text_function(t, _features, "array<double>")
    kinds = [f.split() for f in _FEATURES.split(", ")]
    return [F.when(t.isNotNull(), found[i].cast(kind)).alias(name) for i, (name, kind) in enumerate(kinds)]
