import re

import pytest

from quillstage.llm import licences
from tests.conftest import SF


@pytest.mark.parametrize(("expression", "labels", "rank"), [
    ("MIT", ["mit"], 3), ("MIT OR GPL-3.0-only", ["gpl", "mit"], 3), ("MIT AND GPL-3.0-only", ["gpl", "mit"], 1), ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl"], 2),
    ("MIT OR Apache-2.0 AND GPL-2.0", ["apache", "gpl", "mit"], 3), (
        "(MIT OR Apache-2.0) AND GPL-2.0", ["apache", "gpl", "mit"], 1
    ), ("(MIT", [], None), ("MIT)", ["mit"], 3), ("MIT MIT", ["mit"], 3), ("AND", [], None), ("LGPL-2.1+", ["lgpl"], 2), ("Odd-1", ["odd-1"], 0),
    ("MIT.", ["mit"], 3), ("MIT. AND GPL-2.0", ["mit"], 3), ("MIT, see LICENSE for all details", ["mit"], 3), ("MIT or later", ["mit"], 3), ("tag is described in the manual", [], None), ("is in the manual", [], None),
    ("LicenseRef-own AND MIT", ["licenseref-own", "mit"], 0), ("((MIT) OR (GPL-2.0", [], None), ("MIT OR (GPL-2.0", ["mit"], 3), ("é-1", [], None), ("", [], None), ("()", [], None),
])
def test_expressions(expression, labels, rank):
    assert licences.evaluate(expression)[1:] == (labels, rank)


def test_rank_reaches_the_result(spark, tmp_path):
    texts = [
        "SPDX-License-Identifier: MIT OR GPL-3.0", "SPDX-License-Identifier: MIT AND GPL-3.0",
        "The SPDX-License-Identifier: tag is described in the manual.", "SPDX-License-Identifier: Ünï-1 AND MIT", None
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    either, both, prose, odd, none = licences.QUERIES["op3_license_scan"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (either.labels, either.rank) == ("gpl,mit", 3) and (both.labels, both.rank) == ("gpl,mit", 1) and either.score > both.score > 0
    assert all((r.labels, r.rank, r.score) == ("", None, 0) for r in (prose, odd, none))


def brute(text):
    """Labels, score and lowest rank by plain search and a parser that descends."""
    raw = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = " ".join(["", *re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw), ""])
    labels, doubt, ranks = set(), 1.0, []
    for phrase, (label, trust) in {k: (v, licences.BASE_TRUST) for k, v in licences.BASE.items()}.items() | licences.NOTICES.items():
        n = len(re.findall(f"(?= {phrase} )", words))
        labels |= {label} if n else set()
        doubt *= (1 - trust) ** n
    for m in re.finditer("(?:" + "|".join(licences.TAGS) + ")([^\n]*)", raw):
        tokens = re.findall(r"[()]|[a-z0-9.+-]+|\S", m[1].strip(" \t\r*/#-<>!;\"'"))

        def value(i):
            if i < len(tokens) and tokens[i] == "(":
                found = either(i + 1)
                return found and found[0] < len(tokens) and tokens[found[0]] == ")" and (found[0] + 1, *found[1:]) or None
            ok = i < len(tokens) and licences.is_identifier(tokens[i])
            return (i + 1, licences.family(tokens[i])[1], {licences.family(tokens[i])[0]}) if ok else None

        def lifted(i):
            found = value(i)
            while found and found[0] < len(tokens) and tokens[found[0]] == "with" and (other := value(found[0] + 1)):
                found = other[0], min(3, found[1] + (found[1] in (1, 2))), found[2]
            return found

        def chain(i, part, word, choose):
            found = part(i)
            while found and found[0] < len(tokens) and tokens[found[0]] == word and (other := part(found[0] + 1)):
                found = other[0], choose(found[1], other[1]), found[2] | other[2]
            return found

        def either(i):
            return chain(i, lambda j: chain(j, lifted, "and", min), "or", max)

        found = either(0)
        if found:
            labels |= found[2]
            ranks.append(found[1])
            doubt *= 1 - licences.RANK_TRUST[found[1]]
    return ",".join(sorted(labels)), round(1 - doubt, 6), min(ranks, default=None)


def test_labels_and_score_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0 */",
        "SPDX-License-Identifier: MIT OR Apache-2.0 AND GPL-2.0 and more\nlicense-expression: Odd-1", "gnu gpl gnu gpl, the MIT License",
        "SPDX-License-Identifier: LGPL-2.1 with x-1 with y-2 or none"
    ]
    docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = {r.doc_id: (r.labels, r.score, r["rank"]) for r in licences.QUERIES["op3_license_scan"](spark, str(tmp_path)).collect()}
    assert got == {d: brute(t) for d, t in texts.items()}


def places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


def test_base_places_equal_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = [*(r.text for r in docs.collect()), "MIT license mit-LICENSE\nthe Apache\nLicense; gnu general public  license mit", "général public license"]
    for t in texts:
        n, found, _ = licences.scan_text(t)
        assert (n, sorted((w, label) for _, label, _, base, w in found if base)) == places(t)


def test_tags():
    _, _, found = licences.scan_text("// SPDX-License-Identifier: MIT OR Apache-2.0 */\nx")
    assert found == [("mit or apache-2.0", ["apache", "mit"], 3)]
    assert licences.scan_text("SPDX-License-Identifier: is of the étude\n")[2] == []


def test_odd_rows(spark, odd, nothing):
    assert licences.scan(odd).count() == odd.count() and licences.scan(nothing).count() == 0
    out = licences.QUERIES["op3_license_scan"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)
