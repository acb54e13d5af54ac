"""Scalar text functions as columns; regular expressions are written for Java and RE2 alike."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, as an explicit class.
WS = r" \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, NONSPACE = f"[{WS}]+", f"[^{WS}]+"
#: SPACE, and stretches of it that are no single plain space. Java asks every part of the class for a letter, so letters are told first by one range.
_SPACE = f"(?![!-~])[{WS}]+"
_UNEVEN = f"(?![!-~])(?:[{WS[1:]}][{WS}]*| [{WS}]+)"
#: Words of a balance sheet: Latin letters, digits and straight apostrophes.
BALANCE_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9']+"
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
SEPARATOR, BOLD, ITALIC = r"^\*{3,}$", r"^\*\*(.+?)\*\*$", r"^\*([^*].*?)\*$"
TRAILING_POINTS = f"[.:;,!?{WS}]+$"
PAGE_BREAK, PAGE_MARK = f"(?i)[{WS}]*<<<PAGE_BREAK>>>[{WS}]*", r"(?i)\[PAGE[\t-\r ]+\d+\]"
MOST_LABEL, LEAST_LETTERS = 40, 2


def _accents() -> tuple[str, str]:
    """Letters of Latin-1 and its extensions that are a base letter and marks, and those base letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, BARE), r"\p{Mn}", "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once, however often ``then`` names it; plans stay small."""
    return F.transform(F.array(value), then)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, _UNEVEN, " "))


def without_points(text: Column) -> Column:
    """The text without what TRAILING_POINTS names at its end, which is looked at from the end alone."""
    return F.rtrim(text, F.lit(".:;,!?" + WS_CHARS))


def label(text: Column) -> Column:
    """A heading or name as a key: no emphasis, accents, case or final points."""
    bare = strip(F.regexp_replace(strip(text), r"^\*+|\*+$", ""))
    return squeeze(without_points(F.upper(strip_accents(bare))))


def for_counting(text: Column) -> Column:
    """The text without page separators and page marks; patterns run only where their signs stand."""
    bare = F.regexp_replace(F.regexp_replace(text, PAGE_BREAK, " "), PAGE_MARK, " ")
    return squeeze(F.when(F.contains(text, F.lit("<<<")) | F.contains(text, F.lit("[")), bare).otherwise(text))


def for_comparison(text: Column) -> Column:
    # spaces are single ones already, so only those on both sides of a star meet
    return F.btrim(F.regexp_replace(F.replace(for_counting(text), F.lit("*"), F.lit("")), "  +", " "), F.lit(" "))


def speech_key(text: Column) -> Column:
    """The text by which a speech is known again: no emphasis, single spaces, small letters, accents kept."""
    return F.lower(squeeze(F.replace(text, F.lit("*"), F.lit(""))))


def speech_id(speakers: Column, text: Column, occurrence: Column) -> Column:
    """A stable id from speakers and text; the occurrence counts from the second on."""
    seed = F.concat(F.array_join(speakers, "/"), F.lit("|"), speech_key(text))
    return F.concat(F.lit("r_"), F.left(F.sha1(F.when(occurrence > 0, F.concat(seed, F.lit("|"), occurrence.cast("string"))).otherwise(seed)), F.lit(12)))


def asides_of(name: Column) -> Column:
    """What stands in brackets within a name line."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[\[(]([^\])]*)[\])]"), F.lit(1)), strip)


def speaker(name: Column) -> Column:
    """A name without asides and final points, apostrophes straight."""
    bare = F.regexp_replace(name, r"[\[(][^\])]*[\])]", " ")
    return strip(F.translate(without_points(strip(squeeze(bare))), "’‘‛", "'''"))


def speakers(name: Column) -> Column:
    """All speakers of a name line; everyone is ``*``."""
    parts = F.split(name, f"(?i)[{WS}]*/[{WS}]*|[{WS}]+et[{WS}]+")
    return F.when(F.upper(speaker(name)) == "TOUS", F.array(F.lit("*"))).otherwise(F.transform(parts, speaker))


def canonical_role(name: Column, aliases: dict[str, str] | None = None) -> Column:
    cut = strip(without_points(strip(F.substring_index(F.translate(name, "[", "("), "(", 1))))
    upper = F.upper(F.translate(cut, "’", "'"))
    for alias, name_of in (aliases or {}).items():
        upper = F.when(upper == alias, name_of).otherwise(upper)
    return upper


def balance_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BALANCE_WORD))


def tokens(text: Column) -> Column:
    """Stretches between white space."""
    return F.filter(F.split(text, _SPACE, -1), lambda t: t != "")


def stretches(text: Column) -> Column:
    """How many stretches between white space a text has; a count of matches of NONSPACE takes several times as long."""
    return F.size(tokens(text))


def real_places(words: Column) -> Column:
    """Places, from 0, of the words of an array that have a letter or digit."""
    return F.array_compact(F.transform(words, lambda t, i: F.when(t.rlike(LETTER_OR_DIGIT), i)))


def word_places(text: Column) -> Column:
    """Places, from 0, of the tokens that have a letter or digit."""
    return real_places(tokens(text))


def opening(text: Column, n: int) -> Column:
    """The tokens up to the n-th real word; empty without real words."""

    def upto(words: Column, places: Column) -> Column:
        last = F.get(places, F.least(F.lit(n), F.size(places)) - 1)
        return F.when(F.size(places) == 0, "").otherwise(F.array_join(F.slice(words, F.lit(1), F.coalesce(last, F.lit(0)) + 1), " "))

    return let(tokens(text), lambda words: let(real_places(words), lambda places: upto(words, places)))


def opening_is_all(text: Column, n: int) -> Column:
    return F.size(word_places(text)) <= n


def last_words(text: Column, n: int) -> Column:
    return let(tokens(text), lambda t: F.array_join(F.slice(t, F.greatest(F.lit(1), F.size(t) - n + 1), F.lit(n)), " "))


def initials(text: Column) -> Column:
    """Every run of letters as its first letter."""
    return F.regexp_replace(text, r"(\p{L}\p{M}*)[\p{L}\p{M}]*", "$1")


def excerpt(text: Column, n: int = 60) -> Column:
    return let(squeeze(text), lambda flat: F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n - 1)), F.lit("…"))).otherwise(flat))


def unit_label(act: Column, scene: Column, unit: Column) -> Column:
    base = F.concat_ws(" - ", F.nullif(act, F.lit("")), F.nullif(scene, F.lit("")))
    return F.concat(F.when(base == "", "Unité sans titre").otherwise(base), F.lit(" ["), unit, F.lit("]"))


def unit_title(act: Column, scene: Column, implicit: Column) -> Column:
    return F.when(~implicit, F.coalesce(scene, act))


def speakers_label(people: Column) -> Column:
    return F.when(F.array_contains(people, "*"), "TOUS").otherwise(F.array_join(people, " / "))


def role_key(people: Column) -> Column:
    """A set of roles as one key."""
    return F.array_join(F.array_sort(people), "+")


def listed(people: Column) -> Column:
    """Names between bars, |A|B|, so that a name with its bars is found as a whole."""
    return F.when(F.size(people) > 0, F.concat(F.lit("|"), F.array_join(people, "|"), F.lit("|"))).otherwise("")


def unlisted(text: Column) -> Column:
    return F.filter(F.split(text, r"\|", -1), lambda n: n != "")


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_separator(line: Column) -> Column:
    return strip(line).rlike(SEPARATOR)


def bold(line: Column) -> Column:
    """What a line that is wholly bold says, else null."""
    return let(strip(line), lambda s: F.when(s.startswith("**") & ~s.rlike(SEPARATOR) & s.rlike(BOLD), strip(F.regexp_extract(s, BOLD, 1))))


def italic(line: Column) -> Column:
    return let(strip(line), lambda s: F.when(s.startswith("*") & ~s.rlike(SEPARATOR) & s.rlike(ITALIC), strip(F.regexp_extract(s, ITALIC, 1))))


def is_speech(line: Column) -> Column:
    return let(strip(line), lambda s: (s != "") & (~s.startswith("*") | ~(s.rlike(SEPARATOR) | s.rlike(BOLD) | s.rlike(ITALIC))))


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{L}", "")


def is_name(text: Column) -> Column:
    """Two letters at least, 40 characters at most, capitals throughout."""
    return (F.length(text) <= MOST_LABEL) & let(_letters(text), lambda x: (F.length(x) >= LEAST_LETTERS) & x.rlike(r"^\p{Lu}+$"))


def may_be_name(text: Column) -> Column:
    return (F.length(_letters(text)) >= 2) & (F.length(text) <= MOST_LABEL) & F.left(text, F.lit(1)).rlike(r"^\p{Lu}")


def is_structure_label(line: Column) -> Column:
    return let(
        strip(line),
        lambda s: (F.length(s) <= MOST_LABEL) & ~s.contains("<<<") & ~s.rlike(PAGE_MARK) & let(_letters(s), lambda x: (F.length(x) >= 3) & x.rlike(r"^\p{Lu}+$"))
    )


def starts_small(text: Column) -> Column:
    """Whether the first letter or digit is a small letter."""
    return F.regexp_extract(text, r"[\p{L}\p{Nd}]", 0).rlike(r"\p{Ll}")


def has_word_of(text: Column, lexicon: list[str]) -> Column:
    return F.arrays_overlap(F.split(text, " "), F.array(*map(F.lit, lexicon)))


def without_markers(line: Column) -> Column:
    return F.coalesce(bold(line), italic(line), strip(line))


def without_envelope(text: Column, delimiters: tuple[str, ...] = ("<<<SOURCE>>>", "<<<FIN_SOURCE>>>")) -> Column:
    """A model's reply without code fences and source delimiters."""
    out = F.regexp_replace(strip(text), r"^```[^\n]*\n?", "")
    out = F.when(strip(text).startswith("```"), F.regexp_replace(out, r"\n?[ \t]*```[ \t]*$", "")).otherwise(strip(text))
    for d in delimiters:
        out = F.replace(out, F.lit(d), F.lit(""))
    return strip(out)


# Ligatures of text layers.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def text_layer(text: Column) -> Column:
    """A page's text layer: ligatures undone, line ends trimmed, at most one empty line in a row."""
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    trimmed = F.regexp_replace(text, f"[ \\t\\r\\f\\x0b\\x{{a0}}]+(\\n|$)", "$1")
    return strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


# Apostrophes and spaces, and what they are compared as.
CURVED, STRAIGHT = "’‘  \r", "''   "


def straight(text: Column) -> Column:
    """Length-preserving: apostrophes and spaces that only look different."""
    return F.translate(text, CURVED, STRAIGHT)


def stars_outside_separators(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda x: F.contains(x, F.lit("*")) & ~is_separator(x))
    joined = F.array_join(kept, "")
    return F.when(F.contains(text, F.lit("*")), F.length(joined) - F.length(F.replace(joined, F.lit("*"), F.lit("")))).when(text.isNotNull(), 0)
