"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations

from quillstage.functions import text as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{X.SPACE}|{X.SPACE}$')}, '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(X.SPACE)}, ' ', 'g')")


def label(x: str) -> str:
    bare = strip(f"regexp_replace({strip(x)}, '^\\*+|\\*+$', '', 'g')")
    return squeeze(f"regexp_replace(replace(upper(strip_accents({bare})), 'ẞ', 'SS'), {q(X.TRAILING_POINTS)}, '')")


def for_counting(x: str) -> str:
    return squeeze(f"regexp_replace(regexp_replace({x}, {q(X.PAGE_BREAK)}, ' ', 'g'), {q(X.PAGE_MARK)}, ' ', 'g')")


def speech_key(x: str) -> str:
    return f"lower({squeeze(f'''replace({x}, '*', '')''')})"


def letters(x: str) -> str:
    return f"regexp_replace({x}, '\\P{{L}}', '', 'g')"


def separator(x: str) -> str:
    return f"regexp_matches({strip(x)}, {q(X.SEPARATOR)})"


def bold(x: str) -> str:
    return f"CASE WHEN NOT {separator(x)} AND regexp_matches({strip(x)}, {q(X.BOLD)}) THEN {strip(f'regexp_extract({strip(x)}, {q(X.BOLD)}, 1)')} END"


def italic(x: str) -> str:
    return f"CASE WHEN NOT {separator(x)} AND regexp_matches({strip(x)}, {q(X.ITALIC)}) THEN {strip(f'regexp_extract({strip(x)}, {q(X.ITALIC)}, 1)')} END"


def speech(x: str) -> str:
    return f"({strip(x)} <> '' AND NOT {separator(x)} AND ({bold(x)}) IS NULL AND ({italic(x)}) IS NULL)"


def is_name(x: str) -> str:
    return f"(length({x}) <= {X.MOST_LABEL} AND length({letters(x)}) >= {X.LEAST_LETTERS} AND regexp_matches({letters(x)}, '^\\p{{Lu}}+$'))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(X.SPACE)}), lambda t: t <> '')"


LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
