"""Texts that were decoded with the wrong character encoding, and their repair.

Round trips: a garbled part is encoded again under the legacy encoding it was
read with and strictly decoded as the encoding it was written in; layer after
layer, as long as the garbling cost drops. The cost is that of a text alone and
knows nothing of encodings: characters that ordinary text lacks, signs between
letters, scripts and cases mixed within a word, letters that are rare in their
script. A round trip that makes a text no cheaper isn't accepted.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache, wraps

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings with one byte a character that a text may have been read with, most usual first.
READERS = ("cp1252", "mac_roman", "cp437", "cp1251", "cp850", "koi8_r", "cp866", "cp1250", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "mac_cyrillic")
#: Encodings with several bytes a character that UTF-8 may have been read with.
WIDE = ("gb18030", "cp932", "cp949", "big5")
#: Encodings other than UTF-8 that a text may have been written in.
WRITERS = ("gb18030", "cp932", "cp949", "big5", "euc_jp", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp1253", "iso8859_7", "cp1252", "cp850", "cp437", "mac_roman", "cp1250", "cp1254", "cp1255", "cp1256")
MAX_LAYERS = 4
#: Drop of the cost from which a swap of encodings is accepted (UTF-8, whose sequences prove themselves, needs any), cost of
#: a change between garbled and right words, and what a right word may cost.
DROP, CHANGE, WORD_COST = 10.0, 3.0, 1.5
#: Cost that a word with a UTF-8 sequence has at least, unless its characters are common ones (see SUSPECT).
SEQUENCE_COST = 2.5
#: Characters of words that are remembered with what was found out about them.
SHORT = 64

# How often letters occur in Russian and in Greek, in percent.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ", (10.97, 8.45, 8.01, 7.35, 6.70, 6.26, 5.47, 4.73, 4.54, 4.40, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.90, 1.74, 1.70, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.40, 0.26, 0.80, 0.04)))
GREEK = dict(zip("αοιετσνηυρπκμλςωδγάίόέχθφήβύώξζψ", (9.0, 8.5, 7.5, 7.4, 7.4, 5.5, 6.2, 4.5, 4.0, 4.2, 4.2, 4.0, 3.5, 3.0, 4.0, 2.0, 1.8, 1.8, 2.1, 2.1, 1.8, 1.6, 1.3, 1.3, 0.9, 1.5, 0.8, 0.9, 0.9, 0.5, 0.4, 0.2)))
ARABIC = dict(zip("الينموتربهعدفسقأةكحجىشإصطذخضثزغءئؤظآ", (12.5, 11.6, 6.4, 6.4, 6.5, 6.0, 5.2, 4.8, 4.5, 4.2, 3.7, 3.3, 3.0, 2.9, 2.6, 2.6, 2.5, 2.4, 2.0, 1.5, 1.3, 1.2, 1.2, 1.0, 1.0, 1.0, 0.9, 0.7, 0.6, 0.6, 0.5, 0.4, 0.4, 0.2, 0.2, 0.2)))
HEBREW = dict(zip("יהולארמתבשנדחםקעטפכגןצךזסףץ", (11.1, 10.9, 10.4, 7.4, 6.3, 5.6, 5.5, 5.0, 4.7, 4.4, 3.5, 2.6, 2.5, 2.6, 2.1, 3.2, 1.2, 1.7, 2.4, 1.2, 1.8, 1.2, 0.8, 1.3, 1.5, 0.3, 0.1)))
# Frequent Han characters and Hangul syllables.
HAN = set("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天日事平形相全表間時数文字者目前後")
HANGUL = set("이다는에서의가을를한로고하기지도사리나인정자시스대은그라과있수어으일만년부제장해보전성여것들아주동연조니세면상")
#: Bits a letter of these scripts takes, and a little more.
LETTER_BITS = 5.0
# Accented letters of the languages written in Latin letters, the usual and the rarer ones.
USUAL = set("éèàùçêâîôûëïüöäßáíóúñãõìòıışğ’")
RARER = set("ÿœæøåðþýłąęśćżźńčšžřěůťďňőűșțăđľĺŕėįųūģķļņāēīōơưẽĩũỹ")
VOWELS = set("аеёиоуыэюя")
MIXED_BOXES = set("╒╓╕╖╘╙╛╜╞╟╡╢╤╥╧╨╪╫")
#: Kinds of letters (see ``traits``), of those in words with spaces between, and of these and digits.
LETTERS, SPELLED, SPELLED_9 = set("acgsohkn"), set("acgo"), set("acgo9")


@cache
def level_one(ch: str) -> bool:
    """Whether a Han character or Hangul syllable belongs to the first, usual level of a national character set."""
    for codec, lo, hi in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x97), ("big5", 0xA4, 0xC6), ("euc_kr", 0xB0, 0xC8)):
        try:
            raw = ch.encode(codec)
        except UnicodeEncodeError:
            continue
        if len(raw) == 2 and lo <= raw[0] <= hi:
            return True
    return False


@cache
def traits(ch: str) -> tuple[str, bool, bool, float]:
    """(kind, upper case, lower case, cost by itself) of a character.

    Kinds: a Latin, c Cyrillic, g Greek, s Semitic, h Han, k kana, n Hangul, o other letters or marks; 9 digits, . punctuation,
    + signs, | boxes, x what no text has, and a blank for blanks.
    """
    o = ord(ch)
    kind = unicodedata.category(ch)
    if ch == "\xa0" or kind == "Zs":
        return " ", False, False, 0.0
    if not o:
        return "x", False, False, 8.0
    if o < 0x80:
        return ("a" if ch.isalpha() else "9" if ch.isdigit() else "."), ch.isupper(), ch.islower(), 0.0
    if kind in ("Cc", "Co", "Cs", "Cn") or o == 0xFFFD:
        return "x", False, False, 8.0
    if 0x2500 <= o < 0x25A0:
        return "|", False, False, 0.0
    if o in (0xAA, 0xB5, 0xBA):
        return "9", False, False, 0.0
    if kind[0] in "LM":
        up, low = kind == "Lu", kind == "Ll"
        small = ch.lower()
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            return "a", up, low, 0.3 if small in USUAL else 1.5 if small in RARER or o >= 0x1E00 else 4.0
        if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
            return "g", up, low, -math.log2(GREEK.get(small, 0.15) / 100) - LETTER_BITS
        if 0x400 <= o < 0x530:
            return "c", up, low, -math.log2(RUSSIAN.get(small, 0.02 if small not in "іїєґўј" else 1.0) / 100) - LETTER_BITS
        if 0x5D0 <= o < 0x5EB:
            return "s", False, False, -math.log2(HEBREW[ch] / 100) - LETTER_BITS
        if 0x590 <= o < 0x700:
            return "s", False, False, 0.0 if 0x64B <= o < 0x656 else -math.log2(ARABIC.get(ch, 0.05) / 100) - LETTER_BITS
        if 0x3040 <= o < 0x3100:
            return "k", False, False, 0.0
        if 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4E00 or 0xF900 <= o < 0xFB00:
            return "h", False, False, -0.7 if ch in HAN else 0.2 if level_one(ch) else 4.0
        if 0xAC00 <= o < 0xD7B0:
            return "n", False, False, -0.7 if ch in HANGUL else 0.2 if level_one(ch) else 4.0
        if 0xFF60 <= o < 0xFFA0:
            return "k", False, False, 3.0
        return "o", up, low, 0.0 if 0x900 <= o < 0x1200 or 0x1780 <= o < 0x1800 else 3.0
    if kind[0] == "N":
        return ("9" if kind == "Nd" else "+"), False, False, 0.0
    if kind[0] == "P" and not 0xA0 <= o < 0xC0 and ch not in "†‡•":
        return ".", False, False, 0.0
    if ch in "«»§¶·":
        return ".", False, False, 0.0
    return "+", False, False, 0.0


def _boxes(ch: str, before: str) -> float:
    """Cost of a box sign: tables join corners by lines of one kind."""
    own = 2.0 if ch in MIXED_BOXES else 1.0 if ch >= "▀" else 0.0
    return own + (1.0 if "─" <= before < "■" and ch != before and not {ch, before} & set("─═━") else 0.0)


def _cyrillic(ch: str, before: str, alone: bool) -> float:
    """Cost of a letter where Russian spelling hardly has it."""
    if ch in "ьъы":
        return 5.0 * (not before or before in "ьъы" or ch != "ы" and before in VOWELS)
    if ch == "й":
        return 3.0 * (before != "" and before not in VOWELS)
    return 2.0 * (alone and ch not in "авикосуягрстмпе")


def remembered(size: int):
    """As ``lru_cache``, but for short words only: long ones hardly come again and would fill the memory."""

    def wrap(f):
        kept = lru_cache(size)(f)
        return wraps(f)(lambda word, *rest: kept(word, *rest) if len(word) <= SHORT else f(word, *rest))

    return wrap


@remembered(1 << 16)
def word_cost(word: str) -> float:
    """Cost of a word, however it came about; about 0 for one that is spelled as words of its script are."""
    if word.isascii() and "\0" not in word:
        return 0.0
    cost, letters, run = 0.0, 0.0, 0
    edge = ("", False, False, 0.0)
    at = [edge, *map(traits, word), edge]
    for i, ch in enumerate(word, 1):
        kind, up, _, own = at[i]
        before, after = at[i - 1], at[i + 1]
        last = word[i - 2] if i > 1 else ""
        if kind in ("c", "g", "s", "h", "n"):
            letters += own
        else:
            cost += own
        if kind in "hn" and before[2] and after[2]:
            cost += 2.0 * (last.isascii() and word[i].isascii())
        if kind == "c":
            small = ch.lower()
            joined = last.lower() if before[0] == "c" else ""
            cost += _cyrillic(small, joined, not joined and after[0] != "c")
            run = max(run, 0) + 1 if small in VOWELS else min(run, 0) - 1
            cost += 2.0 * (run > 2 or run < -3)
        else:
            run = 0
        if kind == "s" and after[0] == "s":
            cost += 4.0 * (ch in "ةىךםןףץ")
        if before[0] in LETTERS and kind in LETTERS:
            pair = {before[0], kind}
            if len(pair) > 1 and "o" not in pair:
                cost += 0.0 if pair == {"h", "k"} else 2.0 if pair <= set("ahkn") and (ch.isascii() or last.isascii() or "a" not in pair) else 4.0
            if kind == "a" and not ch.isascii() and not last.isascii():
                cost += 1.5
            if before[2] and up and not (ch.isascii() and last.isascii()):
                cost += 4.0
        elif kind == "+" or ch in "¿¡«»§¶„‚‹›":
            inner, left, right = before[0] in SPELLED and after[0] in SPELLED, before[0] in SPELLED, after[0] in SPELLED
            if inner:
                cost += 5.0
            elif right and before[0] != "9" and ch not in "¿¡«„‚‹§¶©€£$№~+" or left and ch in "¿¡„‚‹¤¦¨¬¯´¸÷×¼½¾":
                cost += 3.0
            elif kind == "+" and before[0] in ("+", "|") or after[0] == "|":
                cost += 2.0
        elif kind == "|":
            cost += _boxes(ch, last) + 4.0 * (before[0] in SPELLED_9 or after[0] in SPELLED_9)
        # a capital with an accent that a sign, not a letter, goes on from
        if up and not ch.isascii() and after[0] in ("+", " ", "x", "|"):
            cost += 3.0
    return cost + max(0.0, letters)


WORD = re.compile("[^ \t\n\r\x0b\x0c  -   　]+")


def text_cost(text: str) -> float:
    return 0.0 if text.isascii() and "\0" not in text else sum(map(word_cost, WORD.findall(text)))


def suspicious(text: str) -> bool:
    """Whether some run of words costs so much more than right ones that a round trip could save DROP."""
    worst = run = 0.0
    for w in WORD.findall(text):
        run = max(0.0, run + (word_cost(w) - WORD_COST if not w.isascii() else 0.0))
        worst = max(worst, run)
    return worst >= DROP


@cache
def bytes_of(codec: str) -> dict[str, int]:
    """Char -> byte from 0x80 on; bytes without a character are read as control characters."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
        if codec in ("cp1252", "cp1251") and b < 0xA0:
            out.setdefault(chr(b), b)
    if codec == "cp1252":
        for b in range(0xA0, 0x100):
            out.setdefault(chr(b), b)
    return out


def _cls(chars: list[str]) -> str:
    return "[" + "".join(map(re.escape, sorted(chars))) + "]"


@cache
def sequence(codec: str) -> re.Pattern:
    """A UTF-8 sequence of two to four bytes as it looks when read as codec."""
    table = bytes_of(codec)
    pick = lambda lo, hi: _cls([c for c, b in table.items() if lo <= b <= hi])
    more = pick(0x80, 0xBF)
    return re.compile(f"{pick(0xC2, 0xDF)}{more}|{pick(0xE0, 0xEF)}{more}{{2}}|{pick(0xF0, 0xF4)}{more}{{3}}")


CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
#: What is left of a sequence whose second byte became a blank: "à" and, in a text with other signs, a no-break space.
ORPHAN = re.compile(r"(?:(?<=\s)|(?<=[a-zà-ÿ])|^)Ã(?=\s)")
ORPHAN_BLANK = re.compile(r"Â(?=\s)")
#: Signs, in a few characters, that a sentence is about encodings.
ABOUT = re.compile(r"(?i)utf-?8|latin-?1|mojibake|encoding|charset|code ?page|\bviewer\b|\bbytes?\b|\bshows? up as\b|\bwas meant\b|\b[c-f][0-9a-f] [89ab][0-9a-f]\b|U\+[0-9A-F]{4}")
QUOTES = "\"'“”„«»‘’`"
#: A character reference to a character beyond ASCII, which a misread byte may have been written as.
REFERENCE = re.compile(r"(?:&amp;|&)(?:#[xX]?[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d{0,2});")


@cache
def plausible(ch: str) -> bool:
    """Whether a decoded character occurs in ordinary text by itself."""
    o = ord(ch)
    if o < 0xA0 or 0x250 <= o < 0x384 or 0x483 <= o < 0x48A or 0x700 <= o < 0x900 or 0xE000 <= o < 0xF900 or o == 0xFFFD:
        return False
    kind = unicodedata.category(ch)
    if kind in ("Cn", "Co", "Cs", "Cc"):
        return False
    if kind in ("Mn", "Mc") and not (0x591 <= o < 0x700 or 0x900 <= o < 0xE80):
        return False
    return o < 0x530 or 0x5B0 <= o < 0x700 or 0x900 <= o < 0x980 or 0xE00 <= o < 0xE80 or 0x1E00 <= o < 0x2000 or 0x2000 <= o < 0x2C00 or 0x3000 <= o < 0xD7B0 or o >= 0xF900


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a garbled sequence is only quoted by a text about encodings."""
    alone = (start == 0 or text[start - 1].isspace() or text[start - 1] in QUOTES) and (end == len(text) or text[end].isspace() or text[end] in QUOTES + ".,;:!?)")
    if not alone:
        return False
    if 0 < start and end < len(text) and text[start - 1] in QUOTES and text[end] in QUOTES:
        return True
    return bool(ABOUT.search(text, max(0, start - 50), min(len(text), end + 50)))


def utf8_layer(text: str, codec: str) -> str:
    """The text after one layer of UTF-8 read as codec."""
    table, find, n, base = bytes_of(codec), sequence(codec), 0, 0

    def restore(m: re.Match) -> str:
        nonlocal n
        try:
            ch = bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        # the bytes of a higher layer are themselves characters of the codec
        if not (plausible(ch) or ch in table) or quoted(text, base + m.start(), base + m.end()):
            return m[0]
        before = m.string[m.start() - 1 : m.start()]
        if ord(ch) >= 0x3040 and before.isascii() and before.isalpha() and set(m[0]) & set("\xa0«»"):
            return m[0]  # an accented last letter, a no-break space and a quotation mark
        if len(m[0]) == 2 and m[0][1] in "’”“»…–—\xa0" and m.start() and m.string[m.start() - 1].isupper() and not m.string[m.end() : m.end() + 1].islower():
            return m[0]  # the end of a quotation in capitals
        n += len(m[0])
        return ch

    if codec == "cp1252":
        return find.sub(restore, text)
    # other encodings share letters with ordinary text: a word counts if all that isn't ASCII in it is restored, and if it
    # doesn't only consist of letters, so that the sequence may be a word itself, or costs much less then
    out, spelled = [], []
    for word in re.split(r"(\s+)", text):
        n, size = 0, len(word)
        if not word.isascii():
            left = find.sub("", word)
            new = find.sub(restore, word)
            rest = [c for c in left if not c.isascii()]
            drop = word_cost(word) - word_cost(new) if n else 0.0
            if n and drop > -1 and (not rest or len(rest) == 1 and left.endswith(rest[0]) and 0xC2 <= table.get(rest[0], 0)):
                if drop >= CHANGE or not all(c.isascii() or c.isalpha() for c in word):
                    word = new
                else:
                    spelled.append((len(out), new))
        out.append(word)
        base += size
    if (fixed := "".join(out)) == text:
        return text
    for i, new in spelled:
        out[i] = new
    return "".join(out) if spelled else fixed


@remembered(1 << 16)
def encoded(word: str, reader: str) -> bytes | None:
    """The bytes that were read as this word; None if reader has no such characters."""
    if reader in WIDE:
        try:
            return word.encode(reader)
        except UnicodeEncodeError:
            return None
    table = bytes_of(reader)
    raw = [ord(c) if c < "\x80" else table.get(c) for c in word]
    return None if None in raw else bytes(raw)


@remembered(1 << 17)
def decoded(raw: bytes, writer: str) -> tuple[str, float] | None:
    """(word, its cost) strictly decoded; None if that can't be."""
    try:
        word = raw.decode(writer)
    except UnicodeDecodeError:
        return None
    return word, word_cost(word)


def _way(costs: list[float], news: list[tuple[str, float] | None]) -> tuple[float, list[bool]]:
    """(drop, whether each word is garbled): the best way through the words in two states, right and garbled."""
    right, wrong, back = 0.0, -CHANGE, []
    for c, new in zip(costs, news):
        gain = -4.0 if new is None else c - new[1]
        back.append((wrong > right, right - CHANGE > wrong))
        right, wrong = max(right, wrong), max(wrong, right - CHANGE) + gain
    drop, state, take = max(right, wrong), wrong > right, []
    for to_right, to_wrong in reversed(back):
        take.append(state)
        state = not to_wrong if state else to_right
    return drop, take[::-1]


def swap_layer(text: str, least: float) -> tuple[str, float, str]:
    """(text, drop of the cost, what was undone) of the best encoding that another one was read as, if it saves ``least``."""
    spans = [m for m in WORD.finditer(text) if not m[0].isascii()]
    words = [m[0] for m in spans]
    costs = [word_cost(w) for w in words]
    drop, name, take, chosen = least, "", [], []
    for reader in READERS + WIDE:
        raws = [encoded(w, reader) for w in words]
        # nothing can save more than its own cost
        if sum(c for c, r in zip(costs, raws) if r is not None) <= drop + CHANGE:
            continue
        for writer in ("utf-8",) if reader in WIDE else WRITERS:
            if reader == writer:
                continue
            news = [None if r is None else decoded(r, writer) for r in raws]
            if sum(max(0.0, c - new[1]) for c, new in zip(costs, news) if new is not None) <= drop + CHANGE:
                continue
            got, way = _way(costs, news)
            if got > drop:
                drop, name, take, chosen = got, f"{writer} read as {reader}", way, news
    if not name:
        return text, 0.0, ""
    out, at = [], 0
    for m, garbled, new in zip(spans, take, chosen):
        if garbled and new is not None:
            out += [text[at : m.start()], new[0]]
            at = m.end()
    return "".join(out) + text[at:], drop, name


def unescaped(text: str) -> str:
    """The text with its references to characters beyond ASCII written out."""

    def char(m: re.Match) -> str:
        # references to bytes 0x80 to 0x9F stand for those of Windows Latin-1, as browsers take them, or for themselves
        c = html.unescape(m[0].replace("&amp;", "&"))
        if c == "" and m[0].strip("&;")[-1:].isdigit():
            c = chr(int(re.sub(r"\D", "", m[0])))
        return c if len(c) == 1 and ord(c) > 0x7F else m[0]

    return REFERENCE.sub(char, text)


def utf16(text: str) -> str:
    """A text of two bytes a character whose bytes were read one by one, without every second one."""
    if text.count("\0") * 3 < len(text):
        return text
    pairs = text + "\0" if len(text) % 2 else text
    high = pairs[1::2].count("\0") >= pairs[::2].count("\0")
    try:
        return pairs.encode("latin-1").decode("utf-16-le" if high else "utf-16-be").rstrip("\0")
    except UnicodeError:
        return text


#: Sequences made of characters that are common by themselves, whose words needn't be dear, and characters that no text has.
SUSPECT = re.compile("�|\0|" + CONTROL.pattern + "|" + ORPHAN.pattern + "|" + "|".join(sequence(c).pattern for c in READERS[:2]))


def worth_a_look(text: str) -> bool:
    """False for texts that ``repair`` would leave: none of their words is dear, and no sequence of common characters is there."""
    return any(word_cost(w) > SEQUENCE_COST for w in WORD.findall(text) if not w.isascii()) or SUSPECT.search(text) is not None or REFERENCE.search(text) is not None


def _utf8(text: str) -> tuple[float, str, str]:
    """(drop, text, what was undone) of the best single layer of UTF-8."""
    cost = text_cost(text)
    found = [(cost - text_cost(new), new, f"utf-8 read as {c}") for c in READERS if sequence(c).search(text) and (new := utf8_layer(text, c)) != text]
    return max(found, default=(0.0, text, ""), key=lambda x: x[0])


def _undo(text: str) -> tuple[str, list[str]]:
    """The text after all layers whose round trip lowers its cost, and the layers."""
    layers: list[str] = []
    while len(layers) < MAX_LAYERS:
        cost = text_cost(text)
        best = step = _utf8(text)
        # what all layers of UTF-8 together save
        while step[0] > 0:
            step = _utf8(step[1])
        saved = cost - text_cost(step[1])
        # bytes of UTF-8 often make sense in an Asian encoding, hardly ever the other way round
        least = max(DROP / 2 if saved > 0 else DROP, saved * 1.25)
        if cost > least and suspicious(text):
            new, drop, name = swap_layer(text, least)
            if drop:
                best = (drop, new, name)
        if "\0" in text and (new := utf16(text)) != text:
            best = (cost - text_cost(new), new, "utf-16 read as latin-1")
        if best[0] <= 0:
            break
        text = best[1]
        layers.append(best[2])
    return text, layers


def repair(text: str) -> tuple[bool, str, list[str], float, float]:
    """(garbled, text, layers undone, cost before, cost after)."""
    before = text_cost(text)
    lost = any(not quoted(text, m.start(), m.end()) for m in re.finditer("�+", text))
    new, layers = _undo(text)
    if not layers and REFERENCE.search(text) and (plain := unescaped(text)) != text:
        # a reference is right unless the bytes it stands for were misread
        again, found = _undo(plain)
        if found:
            before, new, layers = text_cost(plain), again, ["character references", *found]
    stray = CONTROL.search(new)
    new, orphans = ORPHAN.subn("à", new)
    if layers:
        new = ORPHAN_BLANK.sub("", new)
    if orphans:
        layers.append("blank in a sequence")
    garbled = bool(layers or lost or stray)
    return garbled, new if garbled else text, layers, round(before, 3), round(text_cost(new), 3)


def find_garbled(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose ``text`` was, wholly or partly, decoded wrongly.

    Columns of ``df`` plus restored (the text as far as it could be restored),
    layers (what was undone, outermost first), cost_before and cost_after (the
    garbling cost of the text as it came and as restored). Null and empty texts
    are never garbled, nor are plain ASCII texts without character references.
    A sequence that a text only quotes is left as it is. Columns of ``df`` with
    these names get the suffix _in.
    """
    made = ("restored", "layers", "cost_before", "cost_after")
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in made and c != text})
    # a garbled text has characters beyond ASCII, written as such or as references, or null characters
    beyond = df.where((F.octet_length(text) > F.char_length(text)) | F.col(text).rlike(r"&(?:amp;)?#?[0-9A-Za-z]{2,9};") | F.contains(text, F.lit("\0")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", restored string, layers array<string>, cost_before double, cost_after double"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[np.array([worth_a_look(t) for t in b[text]], bool)]
            got = [repair(t) for t in b[text]]
            keep = np.array([g[0] for g in got], bool)
            got = [g for g in got if g[0]]
            out = b[keep].copy()
            for k, name in enumerate(made, 1):
                out[name] = pd.Series([g[k] for g in got], index=out.index, dtype="float64" if name.startswith("cost") else object)
            yield out

    return beyond.mapInPandas(look, schema)
