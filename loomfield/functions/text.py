"""Text as indices see it: folded to ASCII, lower case, free of punctuation about words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_MANY = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ŋ": "ng", "Ŋ": "NG", "ĳ": "ij", "Ĳ": "IJ", "…": "...", "€": "EUR", "™": "tm", "½": "1/2", "¼": "1/4", "¾": "3/4", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_ONE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ĸ": "k", "ŧ": "t", "Ŧ": "T", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‐": "-", "×": "x", "·": ".", " ": " ", "«": "<", "»": ">"}

#: Greek and Cyrillic letters, lower case; the upper ones follow.
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяєіїґўђјљњћџ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia ie i yi g u dj j lj nj c dz".split(), strict=True))
for _letter, _latin in (_GREEK | _CYRILLIC).items():
    for _a, _b in ((_letter, _latin), (_letter.upper(), _latin.capitalize())):
        if len(_a) == 1:
            (_ONE if len(_b) == 1 else _MANY).setdefault(_a, _b)


def _folds() -> tuple[str, str, str]:
    """Letters that become one ASCII letter, what they become, and marks that vanish."""
    one = dict(_ONE)
    # Latin, Greek and Cyrillic with marks, letters in circles, of full width and for mathematics, digits of other scripts.
    for code in [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), *range(0x1E00, 0x2000), *range(0x2070, 0x20A0), *range(0x2100, 0x2190), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        base = "".join(one.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base.isdigit() and not base.isascii():
            base = str(unicodedata.digit(base))
        if c not in _MANY and c not in one and len(base) == 1 and base.isascii():
            one[c] = base
    return "".join(one), "".join(one.values()), "".join(map(chr, range(0x300, 0x370)))


_FROM, _TO, _MARKS = _folds()
_PUNCT = r"[!-/:-@\[-`{-~]+"
_RAGGED = rf"(?:^|\s){_PUNCT[:-1]}|{_PUNCT[:-1]}(?:\s|$)|[:/()\[\]]"


def ascii_fold(c: Column) -> Column:
    """Latin letters without marks, ligatures spelled out, Greek and Cyrillic in Latin letters, digits of other scripts; what else there is stays. All in the JVM."""
    given, spelled = c, c
    for a, b in _MANY.items():
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    # Most texts have nothing to be spelled out.
    c = F.when(c.rlike("[" + "".join(_MANY) + "]"), spelled).otherwise(c)
    # Of ASCII, nothing changes.
    return F.when(F.octet_length(given) == F.length(given), given).otherwise(F.translate(c, _FROM + _MARKS, _TO))


def tokens(c: Column) -> Column:
    """Words of a text, in order, as indices hold them."""
    c = F.lower(ascii_fold(c))
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    trimmed = F.transform(words, lambda w: F.coalesce(F.nullif(F.regexp_replace(w, f"^{_PUNCT}|{_PUNCT}$", ""), F.lit("")), w))
    parts = F.filter(F.flatten(F.transform(trimmed, lambda w: F.split(w, r"[:/()\[\]]"))), lambda w: w != "")
    # Most short texts have no word with punctuation at an end or a sign that words are split at.
    return F.when((F.octet_length(c) == F.length(c)) & ~c.rlike(_RAGGED), words).otherwise(parts)


def normalize(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def plain_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, for full-text search."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def prefixes(c: Column) -> Column:
    """All prefixes of a string but the empty one, shortest first."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def is_url(c: Column) -> Column:
    return c.rlike("^(https?|file)://")


def is_iri(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$")


def bare_iri(c: Column) -> Column:
    return F.regexp_replace(c, "^<|>$", "")
