"""Text files, listings with ignore lists, sidecars, and Word documents."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UTF8_MARK = "﻿"
_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): whole files, line ends as line feeds, without a byte order mark."""
    text = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), f"^{UTF8_MARK}", "")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), text.alias("text"))


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(file, name, bytes) of usable files by name without regard to case; hidden, lock and temporary files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    named = files.select(F.col("path").alias("file"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))
    return named.filter(~F.col("name").rlike(r"^(\.|~\$)|\.tmp$")).orderBy(F.lower("name"))


def book_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"(?i)\.pdf$", ""))


def ignored_names(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key) of an ignore list: a name a line, comments from #."""
    names = F.trim(F.regexp_replace(line, "#.*$", ""))
    return lines.select(book_key(names).alias("key")).filter("key <> ''").distinct()


def not_ignored(files: DataFrame, ignored: DataFrame, name: str = "name") -> DataFrame:
    return files.withColumn("key", book_key(F.col(name))).join(ignored, "key", "left_anti").drop("key")


SIDECAR = "statut string, reprises int, unite string, numero int, page_debut int, page_fin int, modele string, tokens_entree int, tokens_sortie int, avertissements array<string>, erreur string"


def sidecars(files: DataFrame, text: str = "text") -> DataFrame:
    """Sidecar fields of each file; a damaged one has nulls throughout."""
    return files.withColumn("s", F.from_json(text, SIDECAR, {"mode": "PERMISSIVE"})).select("file", "s.*")


def _flag(properties, name: str) -> bool:
    node = None if properties is None else properties.find(_WORD_NS + name)
    return node is not None and node.get(_WORD_NS + "val", "1") not in ("0", "false", "none")


def paragraphs_of(raw: bytes) -> list[tuple[int, str | None, list[tuple[str, bool, bool, bool, bool]]]]:
    """(number, style, runs) of a Word document; a run is (text, bold, italic, deleted, inserted)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_WORD_NS + "body")
    out = []
    for n, p in enumerate(body.iter(_WORD_NS + "p")):
        style = p.find(f"{_WORD_NS}pPr/{_WORD_NS}pStyle")
        above = {child: node for node in p.iter() for child in node}
        runs = []
        for r in p.iter(_WORD_NS + "r"):
            holder = above.get(r)
            pr = r.find(_WORD_NS + "rPr")
            text = "".join("\t" if t.tag == _WORD_NS + "tab" else "\n" if t.tag in (_WORD_NS + "br", _WORD_NS + "cr") else t.text or "" for t in r if t.tag in {_WORD_NS + x for x in ("t", "delText", "tab", "br", "cr")})
            if text:
                runs.append(
                    (text, _flag(pr, "b"), _flag(pr, "i"), holder is not None and holder.tag == _WORD_NS + "del", holder is not None and holder.tag == _WORD_NS + "ins")
                )
        out.append((n, None if style is None else style.get(_WORD_NS + "val"), runs))
    return out


RUNS = "file string, paragraph int, style string, run int, start int, text string, bold boolean, italic boolean, deleted boolean, inserted boolean"


def prompts(files: DataFrame) -> DataFrame:
    """(name, prompt): templates by the name in their files, prompt_<name>.md."""
    return files.select(F.regexp_extract("file", r"prompt_([^/]+)\.md$", 1).alias("name"), F.col("text").alias("prompt")).filter("name <> ''")


def read_word(spark: SparkSession, path: str) -> DataFrame:
    """Runs of Word documents with their start in the flat text, whose paragraphs are joined by one character."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, raw in zip(frame["path"], frame["content"], strict=True):
                rows, at = [], 0
                for n, style, runs in paragraphs_of(raw):
                    for k, (text, *flags) in enumerate(runs):
                        rows.append((file, n, style, k, at, text, *flags))
                        at += len(text)
                    at += 1
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(run, RUNS)


def paragraphs(runs: DataFrame) -> DataFrame:
    """(file, paragraph, start, text, bold_share, italic_share) of paragraphs with text: shares of characters."""
    size = F.length("text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda s: s["text"]), "")
    share = lambda flag: F.sum(F.when(F.col(flag), size).otherwise(0)) / F.sum(size)
    per = runs.groupBy("file", "paragraph").agg(
        F.min("start").alias("start"), joined.alias("text"), share("bold").alias("bold_share"), share("italic").alias("italic_share")
    )
    return per.filter(F.trim("text") != "")


def reviewed(runs: DataFrame) -> DataFrame:
    """Per file the text before a review's insertions and the spans that the review deletes."""
    old = runs.filter("not inserted")
    return old.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "text", "deleted"))).alias("runs"))


def _escaped(text: str) -> str:
    return "".join(c for c in text if c in "\t\n" or c >= " ").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def word_line(kind: str, text: str, styles: dict[str, tuple[str, bool, bool]]) -> str:
    """Markup of a paragraph; ``styles`` must know every type: (style, bold, italic)."""
    style, bold, italic = styles[kind]
    runs = []
    for part in re.findall(r"\*[^*]+\*|[^*]+|\*+", text) or [""]:
        aside = part.startswith("*") and part.strip("*") != ""
        props = "<w:b/>" * bold + "<w:i/>" * (italic or aside)
        runs.append(f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{_escaped(part.strip("*") if aside else part)}</w:t></w:r>')
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{"".join(runs)}</w:p>'


def word_bytes(lines: list[tuple[str, str]], styles: dict[str, tuple[str, bool, bool]]) -> bytes:
    """A Word document of (type, text) lines."""
    package = Package()
    for kind, text in lines:
        package.add(word_line(kind, text, styles))
    return package.close()


class Package:
    """A Word document that takes the markup of its paragraphs part by part and holds it only compressed."""

    def __init__(self) -> None:
        self.out = io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
        )
        self.zip.writestr(
            "_rels/.rels",
            '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
        )
        self.body = self.zip.open("word/document.xml", "w")
        self.add(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_WORD_NS[1:-1]}"><w:body>')

    def add(self, markup: str) -> None:
        self.body.write(markup.encode())

    def close(self) -> bytes:
        self.add("</w:body></w:document>")
        self.body.close()
        self.zip.close()
        return self.out.getvalue()


def package_rows(frames: Iterator[pd.DataFrame], doc: str, markup: Callable[[pd.DataFrame], list[str]], around: tuple[str, str] = ("", "")) -> Iterator[pd.DataFrame]:
    """(doc, content) of rows that come document by document in order; ``around`` stands before and behind all markup of a document."""
    package, name = None, None
    for frame in frames:
        done = []
        for own, part in zip(frame[doc].tolist(), markup(frame), strict=True):
            if package is None or own != name:
                if package is not None:
                    package.add(around[1])
                    done.append((name, package.close()))
                package, name = Package(), own
                package.add(around[0])
            package.add(part)
        yield pd.DataFrame(done, columns=[doc, "content"])
    if package is not None:
        package.add(around[1])
        yield pd.DataFrame([(name, package.close())], columns=[doc, "content"])


def packaged(marked: DataFrame, doc: str, place: str = "n", xml: str = "xml") -> DataFrame:
    """(doc, content): Word documents of one paragraph of the markup of their runs, in the order of ``place``.

    Runs are sorted within the partition of their document and streamed into its archive: a task holds a batch of runs and the
    compressed document.
    """
    rows = marked.select(doc, place, xml).repartition(doc).sortWithinPartitions(doc, place).select(doc, xml)
    return rows.mapInPandas(lambda frames: package_rows(frames, doc, lambda f: f[xml].tolist(), ("<w:p>", "</w:p>")), f"`{doc}` {marked.schema[doc].dataType.simpleString()}, content binary")


# The look of each type of line.
STYLES = {
    "titre_oeuvre": ("TitreOeuvre", True, False), "titre_secondaire": ("TitreSecondaire", True, False), "epigraphe": ("Epigraphe", False, True),
    "attribution": ("Attribution", False, False), "note": ("Note", False, False), "prologue": ("Prologue", False, False),
    "distribution": ("Distribution", True, False), "entree_distribution": ("EntreeDistribution", False, False), "titre_acte": ("TitreActe", True, False),
    "titre_scene": ("TitreScene", True, False), "lieu": ("Lieu", False, True), "personnage": ("Personnage", True, False), "didascalie": ("Didascalie", False, True),
    "didascalie_longue": ("DidascalieLongue", False, True), "texte": ("Texte", False, False), "separateur": ("Separateur", False, False), "vide": ("Texte", False, False),
}


def as_word(typed: DataFrame, doc: str) -> DataFrame:
    """(doc, content): a Word document of each book's typed lines, which are sorted and streamed into its archive like runs in ``packaged``."""
    rows = typed.select(doc, "line_no", "part", "type", "text").repartition(doc).sortWithinPartitions(doc, "line_no", "part").select(doc, "type", "text")

    def markup(frame: pd.DataFrame) -> list[str]:
        return [word_line(kind, text, STYLES) for kind, text in zip(frame["type"].tolist(), frame["text"].tolist(), strict=True)]

    return rows.mapInPandas(lambda frames: package_rows(frames, doc, markup), f"`{doc}` {typed.schema[doc].dataType.simpleString()}, content binary")
