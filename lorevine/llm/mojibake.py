"""Garbled text from wrong character encoding: finding it and restoring it where possible.

Characters are mapped back to the bytes of a legacy encoding, an automaton of well-formed UTF-8 finds the maximal multibyte spans, and only those spans are decoded; repeated until
nothing is left, as text may have gone through any number of times (each round shortens it, so the rounds end). A span of two or more characters is evidence by itself unless it reads as an ordinary word;
a span of one character must be a usual letter or sign that fits the letters beside it, or follow other spans of its script. The same is done for the double-byte encodings of
East Asia, read as a Western encoding, and for UTF-8 read as one of them.

One single-byte encoding read as another leaves no byte structure. There a line is suspect when its words have marks that no writing has (signs and capitals amid small letters, control characters) or
when no one language has all its letters; it is rewritten only if one mapping between encodings makes all its words those of one language. What is suspect but cannot
be mapped so stays as it is: with control characters inside words it is reported as ``unrestored``, with replacement characters as ``lost``.

Defined results: null and blank texts are not garbled; texts are processed whole; text that is only unusual (units, box drawings, foreign names) stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters beyond ASCII by language, lower case. They weigh evidence; no text is suspect for holding letters of a language that is not here, as long as a script is not Latin, Cyrillic or Greek.
ALPHABETS = {
    "fr": "àâæçéèêëîïôœùûüÿ", "de": "äöüß", "es": "áéíñóúü", "pt": "àáâãçéêíóôõúü", "it": "àèéìíîòóùú", "nl": "áéèêëïíóöúüĳ", "ca": "àçèéíïòóúü", "gl": "áéíñóúüï", "eu": "ñç", "oc": "áàçéèíïóòúü",
    "en": "éèêïöñçôâàäüî", "cy": "âêîôûŵŷáéíóúẃýàèìòùẁỳäëïöüẅÿ", "ga": "áéíóúḃċḋḟġṁṗṡṫ", "gd": "àèìòùáéó", "br": "âêîôûùüñéè", "lb": "äëéêèîïôöüûâß", "af": "áéèêëíîïóôúûŉ",
    "da": "æøåéáíóúǿ", "nb": "æøåéèêóòôàü", "sv": "åäöéàü", "fi": "åäöšž", "is": "áðéíóúýþæö", "fo": "áðíóúýæø", "se": "áčđŋšŧžåäöæø", "et": "äõöüšž", "lv": "āčēģīķļņšūžōŗ", "lt": "ąčęėįšųūž",
    "pl": "ąćęłńóśźż", "cs": "áčďéěíňóřšťúůýž", "sk": "áäčďéíĺľňóôŕšťúýž", "sl": "čšžćđ", "hr": "čćđšžǆǉǌ", "hu": "áéíóöőúüű", "ro": "ăâîșțşţ", "sq": "çë", "tr": "çğıöşüâîûi̇", "az": "çəğıöşüi̇",
    "mt": "àèìòùċġħżî", "eo": "ĉĝĥĵŝŭ", "mi": "āēīōū", "haw": "āēīōūʻ", "sm": "āēīōūʻ", "yo": "áàéèẹíìóòọúùṣńǹḿ", "ig": "ịọụṅñáàéèíìóòúù", "ha": "ɓɗƙƴ",
    "vi": "àáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "be": "абвгґдеёжзійклмнопрстуўфхцчшыьэюя", "bg": "абвгдежзийклмнопрстуфхцчшщъьюяѝ", "sr": "абвгдђежзијклљмнњопрстћуфхцчџш",
    "mk": "абвгдѓежзѕијклљмнњопрстќуфхцчџшѐѝ", "kk": "аәбвгғдеёжзийкқлмнңоөпрстуұүфхһцчшщъыіьэюя", "ky": "абвгдеёжзийклмнңоөпрстуүфхцчшщъыьэюя", "mn": "абвгдеёжзийклмноөпрстуүфхцчшщъыьэюя", "tt": "аәбвгдеёжҗзийклмнңоөпрстуүфхһцчшщъыьэюя",
    "tg": "абвгғдеёжзиӣйкқлмнопрстуӯфхҳчҷшъэюя", "uz": "абвгғдеёжзийкқлмнопрстуўфхҳцчшъэюя", "cu": "абвгдеєжзѕиіїйклмнопрстуѹфхѡцчшщъыьѣюѫѧ", "el": "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ",
}
_LANGUAGES = list(ALPHABETS)
#: Of each letter beyond ASCII, in either case, the languages that have it, as bits.
_HAS: dict[str, int] = {}
for _bit, _letters in enumerate(ALPHABETS.values()):
    for _c in {*_letters, *_letters.upper()}:
        if _c > "\x7f":
            _HAS[_c] = _HAS.get(_c, 0) | 1 << _bit
_HAS["İ"] = 1 << _LANGUAGES.index("tr") | 1 << _LANGUAGES.index("az")
_HAS["ẞ"] = _HAS["ß"]
_EVERY = (1 << len(_LANGUAGES)) - 1
#: Languages with so many letters that they fit anything: they count for a line only with one of their own letters in it.
_RICH = sum(1 << _LANGUAGES.index(x) for x in ("cy", "gd", "vi", "yo", "ig"))
_OWN = re.compile("[ŵŷẁẃẅỳăđơưẠ-ỹṣṄǹḿẹọịụĂĐƠƯŴŶ]")

#: Legacy encodings that UTF-8 is read as by mistake, the likeliest first.
LEGACY = ("cp1252", "cp1254", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859_2", "koi8_r", "cp866", "cp852", "cp1253", "cp1257", "cp1255", "cp1256")
#: Legacy encodings mistaken for one another.
SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp850", "cp437", "koi8_r", "cp866", "iso8859_2", "cp852", "iso8859_5", "cp1255", "cp1256", "cp1257")
#: Double-byte encodings of East Asia with the bytes of their characters.
WIDE = {
    "euc_kr": "[\xa1-\xfe][\xa1-\xfe]", "cp932": "[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]", "euc_jp": "[\xa1-\xfe][\xa1-\xfe]", "gbk": "[\x81-\xfe][\x40-\x7e\x80-\xfe]", "big5": "[\xa1-\xf9][\x40-\x7e\xa1-\xfe]",
}
_WIDE = {e: re.compile(f"(?:{p})+") for e, p in WIDE.items()}

UTF8 = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
RUN = re.compile("[^\x00-\x7f]{2,}")
BEYOND = re.compile("[^\x00-\x7f]")


class _Bytes(dict):
    """Characters of a legacy encoding to their bytes, undefined bytes as the control characters they become; others to a byte that is never well formed."""

    def __init__(self, encoding: str):
        super().__init__({b: chr(b) for b in range(0x80, 0xA0)} if encoding.startswith(("cp125", "iso")) else {})
        for b in range(0x80, 0x100):
            try:
                self[ord(bytes([b]).decode(encoding))] = chr(b)
            except UnicodeDecodeError:
                self[b] = chr(b)

    def __missing__(self, key: int) -> str:
        return "\x7f"


_MAPS = {e: _Bytes(e) for e in LEGACY}
_IDEOGRAPHIC = frozenset(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC", "BOPOMOFO", "FULLWIDTH", "HALFWIDTH"))


@lru_cache(maxsize=None)
def script(c: str) -> str:
    """The script of a letter or mark by its Unicode name; empty for other characters, ``?`` for what is no text."""
    kind = unicodedata.category(c)
    if kind in ("Cn", "Co", "Cs", "Cc"):
        return "?"
    if kind[0] not in "LM":
        return ""
    name = unicodedata.name(c, "?").split(" ")[0]
    return "IDEOGRAPHIC" if name in _IDEOGRAPHIC else "" if name in ("COMBINING", "MODIFIER", "FEMININE", "MASCULINE", "MICRO", "VARIATION") else name


def _scripts(text: str) -> set[str]:
    return {s for s in map(script, text) if s}


@lru_cache(maxsize=None)
def _sign(c: str) -> bool:
    """Signs that a single span may be: punctuation, currency, letterlike and mathematical signs, arrows, box drawings, pictures, spaces, marks of byte order and loss."""
    if not (c < "\u0100" or "\u02c6" <= c <= "\u02dd" or "\u2000" <= c <= "\u27bf" or "\u2b00" <= c <= "\u2b5f" or "\u3000" <= c <= "\u303f" or c >= "\ufe00"):
        return "̀" <= c <= "ͯ"  # signs of other scripts are no evidence by themselves
    return unicodedata.category(c)[0] in "PSNZ" or c in "­​‌‍‎‏﻿�"


@lru_cache(maxsize=200_000)
def _spans(run: str, encoding: str) -> tuple[tuple[int, int, str], ...]:
    """Well-formed spans of one run of characters beyond ASCII, with what they decode to."""
    return tuple((m.start(), m.end(), m[0].encode("latin-1").decode("utf-8")) for m in UTF8.finditer(run.translate(_MAPS[encoding])))


@lru_cache(maxsize=200_000)
def _encodings(run: str) -> tuple[str, ...]:
    """Encodings under which a run of characters holds a well-formed span."""
    return tuple(e for e in LEGACY if _spans(run, e))


#: Signs that follow a word in ordinary text.
_AFTER = frozenset("“”‘’‚„…–—•»«›‹™©®°ªº\u00a0\u202f\u00ad")


def _ordinary(old: str, before: str, after: str) -> bool:
    """Whether the characters of a span may be ordinary text: letters of one script in one case like those around, or a capital at a word's end with a sign after it."""
    letters = "".join(c for c in old if c.isalpha() and c not in "ªº")
    rest = old[len(letters):]
    if not letters or old[:len(letters)] != letters:
        return False
    if len(_scripts(letters)) > 1 or not (letters.isupper() or letters.islower() or letters[1:].islower()):
        return False
    if any(c and script(c) not in ("", "?") and script(c) not in _scripts(letters) for c in (before, after)):
        return False
    if rest[:1] == "\u00a0" and before not in ("", " ", "\n", "(", "«", "“", "„", "\""):
        return False
    if not rest:
        return not (before.islower() and letters[0].isupper()) and not (letters.isupper() and after.islower() and len(letters) > 1)
    return all(c in _AFTER for c in rest) and not after.isalpha() and not (before.islower() and letters[0].isupper())


def _judge(old: str, new: str, before: str, after: str, encoding: str) -> int:
    """2 for a span that is evidence by itself, 1 for one that needs others of its script, 0 for one that is no better than what stands there."""
    found = _scripts(new)
    again = _nested(new, encoding)
    if "?" in found:
        # control characters come of text that was misread before
        if any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in new) or not again:
            return 0
        found.discard("?")
    if len(found) > 1:
        return 0
    beside = {script(c) for c in (before, after) if c} - {"", "?"}
    if found and beside and not beside & found and (found != {"IDEOGRAPHIC"} or len(new) == 1):
        return 0
    if encoding in ("cp1251", "koi8_r", "cp866") and len(new) == 1 and {script(c) for c in (before, after) if c} & {"CYRILLIC"}:
        return 0  # a lone pair beside other Cyrillic letters
    if not again and _word(new)[0]:
        return 0
    inside = len(new) == 1 and new not in _JOIN and before.isalpha() and after.isalpha()
    usual = len(new) >= 2 or new in _HAS or not found and _sign(new) and not inside
    if not usual and not found:
        return 0
    if _ordinary(old, before, after):
        return 1 if usual else 0
    return 2 if usual and (len(new) >= 2 or not found or found == {"LATIN"} or beside) else 1


def _nested(text: str, encoding: str) -> bool:
    """Whether what was decoded is itself UTF-8 misread in the same way."""
    return bool(UTF8.search(text.translate(_MAPS[encoding])))


def _multibyte(text: str, encoding: str) -> tuple[str, int]:
    """``text`` with the spans of one encoding decoded, and the number of characters that the spans had."""
    strong: list[tuple[int, int, str]] = []
    weak: list[tuple[int, int, str]] = []
    for m in RUN.finditer(text):
        for start, end, new in _spans(m[0], encoding):
            a, b = m.start() + start, m.start() + end
            how = _judge(text[a:b], new, text[a - 1:a] if a else "", text[b:b + 1], encoding)
            if how:
                (strong if how == 2 else weak).append((a, b, new))
    if not strong:
        return text, 0
    known = _scripts("".join(new for _, _, new in strong))
    taken = sorted(strong + [w for w in weak if _scripts(w[2]) <= known])
    out, at = [], 0
    for a, b, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), sum(b - a for a, b, _ in taken)


# ---- double-byte encodings

@lru_cache(maxsize=100_000)
def _level(c: str) -> str:
    """Of a wide character: ``k`` kana, ``h`` Hangul, ``s`` a usual simplified and ``t`` a usual traditional ideograph (the first level of the national sets), ``p`` wide punctuation."""
    if "぀" <= c <= "ヿ":
        return "k"
    if "가" <= c <= "힣":
        return "h"
    if "　" <= c <= "〿" or "！" <= c <= "～":
        return "p"
    out = ""
    for mark, e, low, high in (("s", "gb2312", 0xB0, 0xD7), ("t", "big5", 0xA4, 0xC6), ("j", "euc_jp", 0xB0, 0xCF)):
        try:
            raw = c.encode(e)
        except UnicodeEncodeError:
            continue
        if len(raw) == 2 and low <= raw[0] <= high:
            out += mark
    return out


def _usual(text: str, encoding: str) -> float:
    """How far decoded text looks like the writing that an East Asian encoding is for, 0 to 1."""
    wide = [_level(c) for c in text if c > "\x7f"]
    letters = [x for x in wide if x != "p"]
    if len(letters) < 3:
        return 0
    share = lambda marks: sum(any(k in x for k in marks) for x in letters) / len(letters)
    if encoding in ("cp932", "euc_jp"):
        return share("kj") if share("k") >= 0.2 else 0
    return share({"gbk": "s", "big5": "t", "euc_kr": "h"}[encoding])


def _dense(line: str) -> bool:
    """Whether so much of a line is beyond ASCII that it may be of a double-byte encoding."""
    if line.isascii():
        return False
    beyond = len(BEYOND.findall(line))
    return beyond >= 6 and beyond >= 0.3 * (len(line) - line.count(" "))


def _wide_as_western(line: str) -> tuple[str, str]:
    """A line of a double-byte encoding that was read as a Western one, decoded, and the encoding; or the line and nothing."""
    raw = "".join(_MAPS["cp1252"][ord(c)] if c > "\x7f" else c for c in line)
    if "\x7f" in raw or any(sum(b - a for m in RUN.finditer(line) for a, b, _ in _spans(m[0], e)) >= 0.9 * len(BEYOND.findall(line)) for e in LEGACY):
        return line, ""
    total = len(BEYOND.findall(raw))
    best, how, most = line, "", 0.0
    for e, pattern in _WIDE.items():
        covered, out, at = 0, [], 0
        for m in pattern.finditer(raw):
            try:
                new = m[0].encode("latin-1").decode(e)
            except UnicodeDecodeError:
                new = None
            if new is None or len(new) < 2:
                continue
            out += [line[at:m.start()], new]
            at = m.end()
            covered += len(BEYOND.findall(m[0]))
        done = "".join([*out, line[at:]])
        mark = _usual("".join(out[1::2]), e)
        if covered >= 0.9 * total and mark > max(most, 0.85):
            best, how, most = done, e, mark
    return best, how


_HAN_RUN = re.compile("[^\x00-\x7f]{2,}")


def _utf8_as_wide(text: str) -> tuple[str, str]:
    """UTF-8 that was read as a double-byte encoding: runs whose bytes are well-formed UTF-8 throughout."""
    for e in ("gbk", "cp932", "big5", "euc_kr"):
        gained = 0

        def put(m: re.Match, e: str = e) -> str:
            nonlocal gained
            try:
                new = m[0].encode(e).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return m[0]
            found = _scripts(new)
            if "?" in found or len(found) > 1 or len(new) < 2:
                return m[0]
            gained += len(m[0])
            return new

        fixed = _HAN_RUN.sub(put, text)
        if gained >= 4:
            return fixed, e
    return text, ""


# ---- single-byte encodings

WORD = re.compile(r"[^\W\d_]+(?:[^\x00-\x7f\s]+[^\W\d_]*)*|[^\x00-\x7f\s]+[^\W\d_]+(?:[^\x00-\x7f\s]+[^\W\d_]*)*|[^\x00-\x7f\s]+")
#: Signs that stand inside or right at words in ordinary text.
_JOIN = frozenset("’‘“”«»„‚‹›…–—²³°ªº™®©¿¡•´ʼʻ·‐‑\u00a0\u00ad\u200b\u200c\u200d\u202f\u2009")
#: Signs that do not stand amid letters.
_AMID = frozenset("³¹¼¾½¸¨¯÷¬¤¦×±¶§†‡ˆ˜˝˛ˇ˘¢£¥‰∂∫≈√∑∏◊∞≠≤≥") | frozenset(chr(c) for c in range(0x2500, 0x25A0))
#: Raised figures before a letter, and signs and opening marks between letters.
MIDWORD = re.compile(r"[²³¹](?=[^\W\d_²³¹])|(?<=[^\W\d_])[¿¡°®©™„‚•](?=[^\W\d_])")
#: A small prefix before a capital, as Irish has it.
PREFIX = re.compile(r"(?:[bcdghmnpt]|bh|bp|dt|gc|mb|nd|ng|ts)[ÁÉÍÓÚ][^\W\d_]*")
#: Weight of a word that no writing has, and of one that is not of its line's language.
WRONG, FOREIGN = 3, 2


def _cased(word: str) -> bool:
    """Whether the capitals of a word are where words have them."""
    if len(word) < 2 or word.islower() or word.isupper() or (word[0].isupper() and word[1:].islower()) or not any(c.isupper() or c.islower() for c in word):
        return True
    return any(c.isupper() and c < "\x80" for c in word[1:]) or bool(PREFIX.fullmatch(word)) or word[1:].lower() == word[1:]


@lru_cache(maxsize=200_000)
def _word(word: str) -> tuple[int, int]:
    """How wrong a word is whatever its language, and the languages that have all its letters, as bits."""
    beyond = [c for c in word if c > "\x7f" and c not in _JOIN]
    if MIDWORD.search(word):
        return WRONG, _EVERY
    if not beyond:
        return 0, _EVERY
    if any("\x80" <= c <= "\x9f" for c in beyond):
        return WRONG, _EVERY
    letters = [c for c in word if c.isalpha() and c not in "ªºµʻʼ"]
    if letters and any(c in _AMID for i, c in enumerate(word) if not (i == 0 and c in "×±≤≥≈∞√∑∏∂∫§¶£¥¢")):
        return WRONG, _EVERY
    used = {c for c in letters if c > "\x7f"}
    found = {script(c) for c in letters} - {"", "?"}
    if len(found) > 1 and "IDEOGRAPHIC" not in found:
        return WRONG, _EVERY
    if not _cased("".join(letters)):
        return WRONG, _EVERY
    if not found <= {"LATIN", "CYRILLIC", "GREEK"}:
        return 0, _EVERY
    mask = _EVERY
    for c in used:
        mask &= _HAS.get(c, _EVERY if c >= "Ḁ" or unicodedata.combining(c) else 0)
    return 0, mask


@lru_cache(maxsize=200_000)
def _token(token: str) -> tuple[int, tuple[int, ...], bool]:
    """Wrongness and language bits of the words beyond ASCII of what stands between blanks, and whether one has the shape of a word that English has taken over, with other letters in the marked places."""
    words = [m[0] for m in WORD.finditer(token) if not m[0].isascii()]
    both = [_word(w) for w in words]
    return sum(w for w, _ in both), tuple(m for _, m in both if m != _EVERY), any(w.lower() not in LOANS and BEYOND.sub("?", w.lower()) in _SHAPES for w in words)


# Words that show a line to be English, which may hold names of any language.
ENGLISH = re.compile(r"\b(?:the|The|of|and|with|for|was|is|that)\b")
# Words with marks that English has taken over.
LOANS = frozenset("café cafés façade façades naïve naïvely naïveté résumé résumés cliché clichés fiancé fiancée protégé touché déjà voilà crème brûlée jalapeño piñata señor señora señorita mañana über doppelgänger rôle entrée entrées soirée exposé".split())
_SHAPES = frozenset(BEYOND.sub("?", w) for w in LOANS)
#: What dashes, blanks and quotation marks become: a letter alone between blanks that is no word of any language here, a letter stuck to the word after a colon, letters around a phrase.
STRAYS = re.compile("[ûùñîòìáÿóïôö]")
STRAY = re.compile(r"(?<=[\w.,;)] )[ûùñîòì](?= \w)|(?<=\w):[áÿ]\w|(?<!\w)ì\w[^ìî\n]*î(?!\w)|(?<!\w)ô\w[^ôö\n]*ö(?!\w)")


def line_state(line: str) -> tuple[int, int]:
    """How suspect a line is by its words alone, and by words that are not of the language that most of them are of (none in English lines)."""
    if line.isascii():
        return 0, 0
    wrong, masks = 0, []
    for t in line.split(" "):
        if not t.isascii():
            w, m, _ = _token(t)
            wrong += w
            masks += m
    odd = 0
    if masks and len(ENGLISH.findall(line)) < 2:
        able = _EVERY if _OWN.search(line) else _EVERY & ~_RICH
        common = able
        for m in masks:
            common &= m
        if not common:
            odd = FOREIGN * min(sum(not m >> i & 1 for m in masks) for i in range(len(_LANGUAGES)) if able >> i & 1)
    if STRAYS.search(line):
        wrong += len(STRAY.findall(line))
    return wrong, odd


def suspicion(text: str) -> int:
    return sum(sum(line_state(line)) for line in text.split("\n"))


def _pair(a: str, b: str) -> dict[int, str]:
    """Characters that a byte is in ``a`` to those that it is in ``b``."""
    out = {}
    for v in range(0x80, 0x100):
        try:
            x = bytes([v]).decode(a)
        except UnicodeDecodeError:
            x = chr(v)
        try:
            y = bytes([v]).decode(b)
        except UnicodeDecodeError:
            continue
        if x != y:
            out[ord(x)] = y
    return out


_PAIRS = {(a, b): _pair(a, b) for a in SINGLE for b in SINGLE if a != b}
#: Of each character beyond ASCII the encodings that have it, as bits.
_IN: dict[str, int] = {}
for _bit, _e in enumerate(SINGLE):
    for _v in range(0x80, 0x100):
        try:
            _c = bytes([_v]).decode(_e)
        except UnicodeDecodeError:
            _c = chr(_v)
        _IN[_c] = _IN.get(_c, 0) | 1 << _bit


def _readable(text: str) -> int:
    """Encodings, as bits, that have all characters of a text."""
    out = (1 << len(SINGLE)) - 1
    for c in set(BEYOND.findall(text)):
        out &= _IN.get(c, 0)
    return out


@lru_cache(maxsize=None)
def _liked(c: str) -> int:
    """How usual a character is: letters by how many languages have them, above them the signs of ordinary typing."""
    return 60 if c in "’‘“”–—…\u00a0«»„" else 40 if c in "±°²³×·€£" else _HAS.get(c, 0).bit_count() + 5 * (c in "оеаинтсрвл")


def _single(text: str) -> tuple[str, int]:
    """``text`` with lines of one legacy encoding read as another restored, and how much less suspect they are; 0 where no mapping is sure."""
    lines = text.split("\n")
    suspects = {}
    for i, line in enumerate(lines):
        if line.isascii():
            continue
        wrong, odd = line_state(line)
        loan = _loaned(line)
        if wrong or odd or loan:
            # without a word that no writing has, the whole line was read in one way
            marked = " ".join(t for t in line.split(" ") if not t.isascii() and (_token(t)[0] or _token(t)[2])) if wrong or loan else line
            suspects[i] = wrong, odd, loan, _readable(marked)
    best, gain, like = None, 0, 0
    for (a, _), table in _PAIRS.items():
        bit = 1 << SINGLE.index(a)
        won, fixed = 0, {}
        for i, (wrong, odd, loan, able) in suspects.items():
            if not able & bit:
                continue
            new = lines[i].translate(table)
            if new == lines[i]:
                continue
            left = sum(line_state(new))
            strayed = [m.span() for m in STRAY.finditer(lines[i])] if wrong and not odd else []
            sure = (_restored(lines[i], new) if wrong else left == 0) and not any(c.isalpha() and c != lines[i][x] for start, end in strayed for x, c in ((start, new[start]), (end - 1, new[end - 1])) if c > "\x7f")
            here = max(0, wrong + odd - left) if sure else 0
            if loan and left == 0 and _loan_gain(lines[i], new):
                here += FOREIGN
            if here > 0:
                won += here
                fixed[i] = new
        if won and any(script(c) in ("CYRILLIC", "GREEK") for line in fixed.values() for c in line) and len({c.isupper() for line in fixed.values() for c in line if c > "\x7f" and c.isalpha()}) < 2:
            won -= 1  # a writing with capitals that all letters or none are: rather one without
        liked = sum(_liked(y) for i, line in fixed.items() for x, y in zip(lines[i], line, strict=True) if x != y)
        if won > gain or (won == gain and won and liked > like):
            best, gain, like = fixed, won, liked
    if best is None:
        return text, 0
    for i, line in best.items():
        lines[i] = line
    return "\n".join(lines), gain


def _words(line: str) -> list[str]:
    return [m[0] for m in WORD.finditer(line)]


def _loaned(line: str) -> bool:
    return any(_token(t)[2] for t in line.split(" ") if not t.isascii())


def _loan_gain(old: str, new: str) -> bool:
    olds, news = _words(old), _words(new)
    return len(olds) == len(news) and any(x != y and y.lower() in LOANS for x, y in zip(olds, news, strict=True))


def _restored(old: str, new: str) -> bool:
    """Whether the words that a mapping changes become possible ones of one language."""
    olds, news = old.split(), new.split()
    if len(olds) != len(news):
        return sum(line_state(new)) == 0
    return sum(line_state(" ".join(y for x, y in zip(olds, news, strict=True) if x != y))) == 0


def restore(text: str | None) -> tuple[str | None, list[str]]:
    """The restored text and what was wrong: ``utf8 as <encoding>``, ``<encoding> as western``, ``single byte``, ``unrestored``, ``lost``; nothing for text in order."""
    if text is None or not BEYOND.search(text):
        return text, []
    found: list[str] = []
    now = text
    if any(_dense(line) for line in now.split("\n")):
        lines = now.split("\n")
        for i, line in enumerate(lines):
            if _dense(line):
                lines[i], how = _wide_as_western(line)
                if how:
                    found.append(f"{how} as western")
        now = "\n".join(lines)
    while True:  # each round shortens the text
        best, gained, how = now, 0, ""
        possible = {e for run in set(RUN.findall(now)) for e in _encodings(run)}
        for e in (x for x in LEGACY if x in possible):
            fixed, n = _multibyte(now, e)
            # the encoding of the round before is preferred, as text that went through twice mostly did so in one way
            n = n * 1.25 if found and found[-1].endswith(e) else n
            if n > gained or (n == gained and n and suspicion(fixed) < suspicion(best)):
                best, gained, how = fixed, n, e
        if not gained:
            break
        found.append(f"utf8 as {how}")
        now = best
    if _IDEOGRAM.search(now):
        now, how = _utf8_as_wide(now)
        if how:
            found.append(f"utf8 as {how}")
    if (s := suspicion(now)) or any(_loaned(line) for line in now.split("\n") if not line.isascii()):
        fixed, gain = _single(now)
        if gain >= 2 or (gain and gain == s):
            now = fixed
            found.append("single byte")
        elif _CONTROL.search(now):
            found.append("unrestored")
    if "�" in now:
        found.append("lost")
    return now, list(dict.fromkeys(found))


_IDEOGRAM = re.compile("[\u2e80-\u9fff\uac00-\ud7a3\ue000-\uf8ff]")
_CONTROL = re.compile("(?<=[^\\W\\d_])[\x80-\x84\x86-\x9f](?=[^\\W\\d_])")


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [restore(t if isinstance(t, str) else None) for t in batch["_text"]]
        yield pd.DataFrame({"key": batch["key"], "restored": [d[0] for d in done], "wrong": [d[1] for d in done]})


def restored(records: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, restored, wrong)`` for every row; ``wrong`` is empty for text in order. Narrow, without a shuffle.

    Texts without a character beyond ASCII stay on the JVM's side of the plan: they are passed on as they are.
    """
    plain = ~F.coalesce(F.col(text).rlike(r"[^\x00-\x7f]"), F.lit(False))
    same = records.where(plain).select(F.col(key).alias("key"), F.col(text).alias("restored"), F.array().cast("array<string>").alias("wrong"))
    return _looked_at(records.where(~plain), key, text).unionByName(same)


def _looked_at(records: DataFrame, key: str, text: str) -> DataFrame:
    kind = records.schema[key].dataType.simpleString()
    return records.select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInPandas(_run, f"key {kind}, restored string, wrong array<string>")


def garbled(records: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, restored, wrong)`` for garbled rows only; rows in plain ASCII are filtered out before Python sees them."""
    return _looked_at(records.where(F.col(text).rlike(r"[^\x00-\x7f]")), key, text).where(F.size("wrong") > 0)
