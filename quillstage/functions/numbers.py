"""Numerals of headings, French number words, ranks and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Written numbers of headings, without accents.
WRITTEN = {
    "UN": 1, "UNE": 1, "PREMIER": 1, "PREMIERE": 1, "DEUX": 2, "SECOND": 2, "SECONDE": 2, "DEUXIEME": 2, "TROIS": 3, "TROISIEME": 3,
    "QUATRE": 4, "QUATRIEME": 4, "CINQ": 5, "CINQUIEME": 5, "SIX": 6, "SIXIEME": 6, "SEPT": 7, "SEPTIEME": 7, "HUIT": 8, "HUITIEME": 8,
    "NEUF": 9, "NEUVIEME": 9, "DIX": 10, "DIXIEME": 10, "ONZE": 11, "ONZIEME": 11, "DOUZE": 12, "DOUZIEME": 12, "TREIZE": 13,
    "TREIZIEME": 13, "QUATORZE": 14, "QUATORZIEME": 14, "QUINZE": 15, "QUINZIEME": 15, "SEIZE": 16, "SEIZIEME": 16, "VINGT": 20, "TRENTE": 30,
}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
TITLED = r"^([IVXLCDM]+|\d+)[ \t]*[.\-:)][ \t]+\S"
# French number words.
SMALL = "zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
TENS = {2: "vingt", 3: "trente", 4: "quarante", 5: "cinquante", 6: "soixante"}


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def numeral(label: Column) -> Column:
    """The number itself where a title follows it."""
    return F.when(label.rlike(TITLED), F.regexp_extract(label, TITLED, 1)).otherwise(label)


def numeral_style(label: Column) -> Column:
    n = numeral(label)
    return F.when(n.isin(*WRITTEN), "ecrit").when(n.rlike("^[IVXLCDM]+$"), "romain").when(n.rlike(r"^\d+$"), "arabe")


def roman_value(numeral: Column) -> Column:
    """From the right: a sign below the largest so far is taken off."""
    signs = F.transform(F.reverse(F.split(numeral, "")), lambda s: F.coalesce(F.try_element_at(_literal_map(ROMAN), s), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    return F.aggregate(
        signs, start, lambda a,
        v: F.struct((a["total"] + F.when(v < a["most"], -v).otherwise(v)).alias("total"), F.greatest(a["most"], v).alias("most")),
        lambda a: a["total"]
    )


def numeral_value(label: Column) -> Column:
    n = numeral(label)
    style = numeral_style(label)
    return F.when(style == "arabe", n.try_cast("int")).when(style == "romain", roman_value(n)).when(style == "ecrit", F.try_element_at(_literal_map(WRITTEN), n))


def french(n: int) -> str:
    """0 to 999 in words."""
    if n < 20:
        return SMALL[n]
    if n >= 100:
        hundreds, rest = divmod(n, 100)
        head = "cent" if hundreds == 1 else f"{SMALL[hundreds]} cent" + "s" * (not rest)
        return f"{head} {french(rest)}" if rest else head
    ten, unit = divmod(n, 10)
    if ten in (7, 9):
        return f"{'soixante' if ten == 7 else 'quatre-vingt'}-{SMALL[10 + unit]}"
    if ten == 8:
        return f"quatre-vingt-{SMALL[unit]}" if unit else "quatre-vingts"
    return TENS[ten] + ("" if not unit else " et un" if unit == 1 else f"-{SMALL[unit]}")


def in_words(n: Column) -> Column:
    """0 to 999 in French words; other numbers as they are."""
    words = F.array(*[F.lit(french(i)) for i in range(1000)])
    return F.when(n.between(0, 999), F.get(words, n.cast("int"))).otherwise(n.cast("string"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def per_cent(x: Column) -> Column:
    """Clamped to 0..100, rounded."""
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(x)))


def back_off(attempt: Column, first: float = 5.0, most: float = 60.0) -> Column:
    """Seconds to wait before a retry, without jitter."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt - 1))


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(
        h > 0, F.concat(h.cast("string"), F.lit(" h "), two(m), F.lit(" min"))
    ).when(m > 0, F.concat(m.cast("string"), F.lit(" min "), two(r), F.lit(" s"))).otherwise(F.concat(r.cast("string"), F.lit(" s")))


def lower_dpi(dpi: Column, least: int = 110) -> Column:
    return F.greatest(F.lit(least), F.floor(dpi * 0.75)).cast("int")
