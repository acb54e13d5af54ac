"""License scans: one Aho-Corasick automaton over the words of a text finds notice phrases, another over its lower-cased
bytes finds identifier tags, and a shunting-yard parser evaluates the and/or/with expression that follows a tag.

A phrase stands where its words stand consecutively, whatever is between them that is no word. Texts are scanned whole
and one at a time; memory is that of a batch.

An expression has a rank: 3 permissive, 2 weak copyleft, 1 copyleft, 0 closed or unknown. ``or`` offers a choice and takes
the higher rank, ``and`` obliges to both and takes the lower, ``with`` an exception lifts copyleft by one. What follows a tag
is read up to the first token that cannot continue an expression, and of that the longest part that is one whole counts: prose
behind a tag has no labels. An identifier is one of a known family, one with a digit, or a reference of one's own
(``licenseref-``). Where no expression stands there is neither label nor rank.

The score is the chance that at least one sign is right, signs being independent: a phrase counts by its own trust, a tag by
the rank of its expression, for the fewer terms are open the surer the notice.

Defined results: null and blank texts have no words, no places and score 0; equal rows have equal results; an empty table
gives an empty result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm.common import read

# Base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, their label and how far one place of them can be trusted.
NOTICES = {
    "mit licence": ("mit", 0.8), "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "apache licence": ("apache", 0.8), "apache software license": ("apache", 0.9),
    "general public licence": ("gpl", 0.8), "gnu gpl": ("gpl", 0.8), "lesser general public license": ("lgpl", 0.9), "gnu lgpl": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.9), "gnu agpl": ("agpl", 0.8), "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9), "mozilla public license": ("mpl", 0.9), "eclipse public license": ("epl", 0.9),
    "isc license": ("isc", 0.8), "boost software license": ("bsl", 0.9), "creative commons": ("cc", 0.6), "cc by 4 0": ("cc-by", 0.8), "cc by 3 0": ("cc-by", 0.8),
    "cc by nc": ("cc-by-nc", 0.8), "cc by sa": ("cc-by-sa", 0.8), "cc by nd": ("cc-by-nd", 0.8), "cc0 1 0": ("cc0", 0.8), "public domain": ("public-domain", 0.5),
    "free and unencumbered software released into the public domain": ("unlicense", 0.9), "all rights reserved": ("proprietary", 0.5),
}
BASE_TRUST = 0.8
TAGS = ("spdx-license-identifier:", "spdx-licence-identifier:", "license-expression:")
# Beginnings of identifiers, their label and rank.
FAMILIES = {
    "mit": ("mit", 3), "apache": ("apache", 3), "bsd": ("bsd", 3), "isc": ("isc", 3), "bsl": ("bsl", 3), "0bsd": ("bsd", 3),
    "zlib": ("zlib", 3), "unlicense": ("unlicense", 3), "cc0": ("cc0", 3), "lgpl": ("lgpl", 2), "mpl": ("mpl", 2), "epl": ("epl", 2),
    "gpl": ("gpl", 1), "agpl": ("agpl", 1), "cc-by-nc": ("cc-by-nc", 0), "cc-by-sa": ("cc-by-sa", 1), "cc-by-nd": ("cc-by-nd", 0),
    "cc-by": ("cc-by", 3), "proprietary": ("proprietary", 0)
}
#: How far a tag can be trusted whose expression has this rank; without an expression it is no sign.
RANK_TRUST = {3: 0.95, 2: 0.9, 1: 0.85, 0: 0.6}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*([()]|[\w.+:-]+)")
_OWN = ("licenseref-", "documentref-")
#: Bytes to words: letters and digits stay, A-Z become small, bytes over 0x7F stay, all else separates.
_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def family(identifier: str) -> tuple[str, int]:
    """Label and rank of a licence identifier, by the longest beginning that is known."""
    known = max((k for k in FAMILIES if identifier == k or identifier.startswith((f"{k}-", f"{k}+"))), key=len, default=None)
    return FAMILIES[known] if known else (identifier.rstrip("+"), 0)


def is_identifier(token: str) -> bool:
    named = any(token == k or token.startswith((f"{k}-", f"{k}+")) for k in FAMILIES)
    return token.isascii() and (named or token.startswith(_OWN) or (token[0].isalnum() and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)))


def leading(text: str) -> list[str]:
    """The tokens of the longest whole expression with which a lower-cased text begins; none where it begins with none."""
    tokens, depth, whole, operand, at = [], 0, 0, True, 0
    while m := _TOKEN.match(text, at):
        token, at = m[1], m.end()
        if token in "()":
            fits = (token == "(") == operand and (token == "(" or depth > 0)
            depth += 1 if token == "(" else -1
        else:
            bare = token.rstrip(".:")  # the end of a sentence
            fits = is_identifier(bare) if operand else bare in PRECEDENCE
            operand = not operand if fits else operand
        if not fits:
            break
        if token in "()":
            tokens.append(token)
        else:
            tokens.append(bare)
            if bare != token:
                text = text[:at]
        if not operand and not depth:
            whole = len(tokens)
    return tokens[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """The shunting-yard: operands and operators in the order of evaluation. Raises ValueError where brackets do not match."""
    out, waiting = [], []
    for t in tokens:
        if t in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[t]:
                out.append(waiting.pop())
            waiting.append(t)
        elif t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("a bracket closes that was not opened")
            waiting.pop()
        else:
            out.append(t)
    while waiting:
        if waiting[-1] == "(":
            raise ValueError("a bracket is not closed")
        out.append(waiting.pop())
    return out


def evaluate(text: str) -> tuple[str, list[str], int | None]:
    """The expression with which a text begins, the labels of its licences, and its rank; "", none and None without one."""
    tokens = leading(text.lower())
    if not tokens:
        return "", [], None
    stack: list[tuple[int, frozenset[str]]] = []
    for t in postfix(tokens):
        if t not in PRECEDENCE:
            label, rank = family(t)
            stack.append((rank, frozenset([label])))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        # an exception is no licence
        stack.append((max(a, b), left | right) if t == "or" else (min(a, b), left | right) if t == "and" else (min(3, a + (1 <= a <= 2)), left))
    (rank, labels), = stack
    return " ".join(tokens), sorted(labels), rank


@lru_cache(1)
def _automata():
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in BASE.items():
        phrases.add_word(f" {phrase} ", (phrase, label, BASE_TRUST, True))
    for phrase, (label, trust) in NOTICES.items():
        phrases.add_word(f" {phrase} ", (phrase, label, trust, False))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> tuple[int, list[tuple], list[tuple]]:
    """The number of words; (phrase, label, trust, base, word) of each place; (expression, labels, rank) of each tag."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORDS).split()
    if not words:
        return 0, [], []
    phrases, tags = _automata()
    joined = f" {b' '.join(words).decode('latin-1')} "
    places, counted, word = [], 0, 0
    for end, (phrase, label, trust, base) in phrases.iter(joined):
        start = end - len(phrase) - 1
        # phrases end in order but may begin before the last one that was counted
        word += joined.count(" ", counted, start) if start >= counted else -joined.count(" ", start, counted)
        counted = start
        places.append((phrase, label, trust, base, word))
    found = []
    lowered = raw.lower()
    for end, _ in tags.iter(lowered.decode("latin-1")):
        line = lowered[end + 1 : (lowered.find(b"\n", end) + 1 or len(lowered) + 1) - 1].decode("utf-8", "replace")
        expression, labels, rank = evaluate(line.strip(" \t\r*/#-<>!;\"'"))
        if rank is not None:
            found.append((expression, labels, rank))
    return len(words), places, found


SCANNED = "{id}, n_words long, places array<struct<phrase:string,label:string,trust:double,base:boolean,word:long>>, expressions array<struct<text:string,labels:array<string>,rank:int>>"
_PLACE, _EXPRESSION = ("phrase", "label", "trust", "base", "word"), ("text", "labels", "rank")


def scan(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its number of words, the places of phrases and the expressions behind tags."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [scan_text(t) for t in frame["t"].tolist()]
            yield pd.DataFrame({doc: frame["d"], "n_words": [r[0] for r in rows], "places": [[dict(zip(_PLACE, p, strict=True)) for p in r[1]] for r in rows], "expressions": [[dict(zip(_EXPRESSION, e, strict=True)) for e in r[2]] for r in rows]})

    # ids travel as text: pandas would make floats of them where one is null
    found = df.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).mapInPandas(batches, SCANNED.format(id=f"`{doc}` string"))
    return found.withColumn(doc, F.col(doc).cast(df.schema[doc].dataType))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    labels = F.concat(F.transform("places", lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    trusts = F.create_map(*[F.lit(x) for pair in RANK_TRUST.items() for x in pair])
    doubt = F.aggregate("places", F.lit(1.0), lambda rest, p: rest * (1 - p["trust"]))
    doubt = F.aggregate("expressions", doubt, lambda rest, e: rest * (1 - F.try_element_at(trusts, e["rank"])))
    ranks = F.transform("expressions", lambda e: e["rank"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(F.transform(base, lambda p: p["label"])).alias("base_labels"),
        joined(labels).alias("labels"), F.round(1 - doubt, 6).alias("score"), F.array_min(ranks).cast("long").alias("rank")
    )


QUERIES = {"op3_license_scan": op3_license_scan}
SQL: dict[str, str] = {}
