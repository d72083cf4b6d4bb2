"""Sentence boundaries in many languages and scripts, in SQL expressions.

Full stops that end no sentence (decimals, URLs, initials, abbreviations) are
masked with private-use characters, ends are marked by terminator patterns per
script, the text is split at the marks, and the masks are taken back. Every
step is a JVM expression; there is no Python in the plan and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Private-use characters: a masked full stop, the end of a unit, no end here.
DOT, END, JOIN = "", "", ""
SPARE = ""

# The code points with the Unicode property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Abbreviations of the languages covered, without their last full stop.
#: before a name or another word; never at the end of a sentence
ALWAYS = """Dr Mr Mrs Ms Prof St Sr Sra Srta Dra Dña Mme Mlle Mgr Hr Fr Frau Проф проф акад им κ κα Δρ د أ डॉ श्री प्रो मि.से
    i.e e.g viz cf vgl bspw sog bzw evtl ggf inkl exkl z.B d.h u.a s.o s.u z d u p.ex p c.-à-d c-à-d т.е т.к т.н см ср напр π.χ δηλ βλ bkz örn yani krş véase vid aprox approx ca ungefähr env resp vs ver Hrsg ed eds trad"""
#: before a number
BEFORE_NUMBER = """No Nos Nr Nrs Fig Figs Sec Secs Ch Chap Eq Vol pp p S Abb Abs Art Bd Kap Tab pág págs cap fig figs art n núm tab vol рис стр гл табл п ст с σελ εικ κεφ ص ج şek s sf bölüm № approx aprox ca etwa env άρθ αρ"""
#: at the end of a sentence too
MAYBE_LAST = """etc usw usf Inc Ltd Co Corp Jr Sr GmbH a.m p.m vb vs vd т.д т.п др г гг в вв тыс млн млрд руб мин сек κ.λπ κλπ κ.ά π.μ μ.μ إلخ इत्यादि min sec Std St al"""
MONTHS = """Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner"""


def _any(words: str) -> str:
    """Longest first; a full stop inside may be followed by a blank."""
    return "|".join(w.replace(".", rf"[.{DOT}]\s?") for w in sorted(set(words.split()), key=lambda w: (-len(w), w)))


_START = r"(?<![\p{L}\p{M}\p{N}_])"
#: a lower-case word that is a file or other identifier can open a sentence
_NAME = rf"(?:[\p{{Ll}}\d]+_[\w-]*\w(?:[.({DOT}]|(?=\s))|v\d|[\w-]+[.{DOT}](?:md|py|rs|go|ts|js|c|h|java|sh|json|toml|ya?ml|txt|html|css|xml|csv)\b)"
_LOWER = rf"(?=\s+(?!{_NAME})[\p{{Ll}}])"
_OPEN, _CLOSE = "\"“„«‘'‚‹「『《(（\\[", "\"”“’»›'」』》)）\\]"

#: Full stops that end nothing, in one pattern: the full stop comes first, so that look-behinds run only where there is one.
_NO_END = [
    # URLs, mail addresses, file names, version numbers, decimals: a full stop inside a word
    r"(?=[\p{L}\p{N}_/])(?<=[\p{L}\p{N}_/]\.)",
    # initials: one capital, or capitals with full stops
    rf"(?=[\s\p{{Lu}}-])(?!\s*\n\s*\n)(?<=\p{{Lu}}\.)(?<={_START}.\.)",
    rf"(?=\s)(?<=\p{{L}}[.{DOT}]\p{{Lu}}\.)",
    rf"(?=[\s-])(?<={_START}(?:{_any(ALWAYS)})\.)",
    rf"(?=\s*\p{{N}})(?<={_START}(?:{_any(BEFORE_NUMBER)})\.)",
    r"(?=\s*[\p{N}\p{Ll}])(?<=[’'](?:art|fig|al|éd)\.)",
    # one small letter and more text: т. е., z. B., p. ex., but not "0.5 h. The"
    rf"{_LOWER}(?:(?<={_START}(?:{_any(MAYBE_LAST)})\.)|(?<=\p{{Ll}}\.)(?<={_START}.\.))",
    r"(?=\s[BhaAÄ]\b)(?<=[zdu]\.)" + rf"(?<={_START}.\.)",
    # German dates
    rf"(?=\s+(?:{_any(MONTHS)})\b)(?<=\b\d{{1,2}}\.)",
]
#: (pattern, replacement), in this order.
MASKS = [(rf"\.(?:{'|'.join(_NO_END)})", DOT)]

#: What joins a quotation to the words that report it, where letters have no case to tell.
_REPORT_LEFT = r"(?:(?<=^.)|(?<=[\n。！？｡”」』）…].)|(?<=[.!?؟।۔…»”\")][ \n].)|(?<=[-*•#] .))"
JOINS = [
    (rf"([“「『]{_REPORT_LEFT}[^”」』{END}]+[。！？｡….!?][”」』])(?=[\p{{L}}\p{{N}}])", rf"$1{JOIN}"),
    (rf"([«\"“]{_REPORT_LEFT}(?:(?<=«)[^»{END}]+[.!?؟۔…]»|(?<=\")[^\"{END}]+[.!?।؟۔…]\"|(?<=“)[^”{END}]+[.!?।؟۔…]”))(?=\s[\p{{L}}\p{{N}}&&[^\p{{Lu}}\p{{Ll}}]])", rf"$1{JOIN}"),
]
#: Between the sentences of one quotation: (opening and closing marks, sentence end within), from paragraph to paragraph.
INNER = [
    ("“", "”", rf"([.!?。！？؟।])(?![”]|{JOIN})(?=[\s\p{{L}}\p{{N}}“„\"'(（])"),
    ("«", "»", rf"([.!?。！？؟।])(?!\s?»|{JOIN})(?=[\s\p{{L}}\p{{N}}])"),
    ("「『", "」』", rf"([。！？])(?![」』]|{JOIN}|$)"),
]

_LATIN_END = rf"(?:[.!?؟।۔։។៕။]+|…+|;(?<=\p{{IsGreek}};))(?!{JOIN})[{_CLOSE}]*+(?:[   ][»›])?(?!{JOIN})"
_ENDS = [
    # scripts written with spaces: terminator, closing marks, blank, and no word that goes on
    rf"{_LATIN_END}(?=\s+(?![—–―]\s)(?![»›])(?:(?!\p{{Ll}})\S|{_NAME}))",
    # ideographic terminators need no blank
    rf"(?:[。！？｡]+|…(?<=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}ー].)…*)(?!{JOIN})[”’」』》）]*+(?!{JOIN})(?![。！？｡…”’」』》）、，,;；：]|と|って)",
    # Thai and Lao have no terminators: a blank between two words of the script, or before a capital
    r"[ \n](?=[\p{IsThai}\p{IsLao}\p{Lu}“«])(?<=[\p{IsThai}\p{IsLao}].)",
]
ENDS = [("|".join(_ENDS), f"$0{END}")]
#: In texts with a unit per line, a sentence may also go on in small letters after a single mark.
LINE_ENDS = [(rf"((?<![.{DOT}])(?:\.|[?!]+)(?!{JOIN}))(?=\s+\p{{Ll}})", rf"$1{END}")]
#: Blank lines, list entries, and headings from their mark to the end of the line.
PARAGRAPHS = [(r"\n[ \t]*(?=\n|(?:[-*•+‣]|#{1,6})\s)|#(?<![^\n]#)#{0,5}\s[^\n]*(?=\n)", f"$0{END}")]


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(to))
    return text


def marked(df: DataFrame, key: str, text: str, by_line: Column) -> DataFrame:
    """(key, _kept, _t): the text with masks, and a mark after each unit but the last."""
    raw = F.col(text)
    t = F.translate(raw, DOT + END + JOIN, SPARE)
    t = F.when(F.col("_line"), F.regexp_replace(t, r"\n", END + "\n")).otherwise(_apply(t, PARAGRAPHS))
    # one projection for each choice, as an expression used twice in one would run twice
    # a text that holds the substitutes themselves is kept, to cut the sentences from
    kept = F.when(raw.rlike(f"[{SPARE}]"), raw)
    out = df.select(key, by_line.alias("_line"), raw.alias(text), kept.alias("_kept")).withColumn("_t", t).withColumn("_t", _apply(_apply(F.col("_t"), MASKS), JOINS))
    for opening, closing, pattern in INNER:
        quotation = rf"[{opening}][^{opening}{closing}{END}]*+[{closing}]"
        # cut at the marks, so that each quotation is looked at once, however long it is
        cut = F.split("_t", rf"(?=[{opening}])|(?<=[{closing}])")
        joined = F.transform(cut, lambda p: F.when(p.rlike(f"^{quotation}$"), _apply(p, [(pattern, f"$1{JOIN}")])).otherwise(p))  # noqa: B023
        out = out.withColumn("_t", F.when(F.col("_t").rlike(quotation), F.array_join(joined, "")).otherwise(F.col("_t")))
    out = out.withColumn("_t", _apply(F.col("_t"), ENDS))
    return out.select(key, "_kept", F.when(F.col("_line"), _apply(F.col("_t"), LINE_ENDS)).otherwise(F.col("_t")).alias("_t"))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", by_line: Column | None = None) -> DataFrame:
    """(key, unit, start_char, end_char, sentence): the units of each text in order.

    A unit is a sentence with its closing marks, a heading or a list entry;
    where ``by_line`` holds, each line also ends a unit. start_char and end_char
    count code points from the start of the text, so that ``sentence`` is
    text[start_char:end_char]; blanks between units belong to none. Null, empty
    and blank texts have no units; a null key is kept; each of several rows with
    the same key gives its units.
    """
    by_line = F.lit(False) if by_line is None else F.coalesce(by_line, F.lit(False))
    parts = F.split(F.translate("_t", JOIN, ""), END)
    # cumulative lengths, in one pass
    ends = F.aggregate(
        F.transform("_parts", lambda p: F.char_length(p)),
        F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")),
        lambda s, n: F.struct(F.array_append(s["at"], s["n"]).alias("at"), (s["n"] + n).alias("n")),
        lambda s: s["at"],
    )
    return (
        marked(df.where(F.col(text).isNotNull()), key, text, by_line)
        .select(F.col(key), "_kept", parts.alias("_parts"))
        .select(key, "_kept", "_parts", ends.alias("_at"))
        .select(key, "_kept", F.explode(F.arrays_zip("_parts", "_at")).alias("_u"))
        .select(key, "_kept", F.col("_u._at").alias("_at"), F.col("_u._parts").alias("_p"), F.ltrim("_u._parts", F.lit(BLANKS)).alias("_l"))
        .where(F.col("_l") != "")
        .select(
            key,
            "_kept",
            (F.col("_at") + F.char_length("_p") - F.char_length("_l")).alias("start_char"),
            F.translate(F.rtrim("_l", F.lit(BLANKS)), DOT + SPARE, "." + DOT + END + JOIN).alias("sentence"),
        )
        .select(
            key,
            "start_char",
            (F.col("start_char") + F.char_length("sentence")).alias("end_char"),
            F.when(F.col("_kept").isNull(), F.col("sentence")).otherwise(F.substring("_kept", F.col("start_char") + 1, F.char_length("sentence"))).alias("sentence"),
        )
    )
