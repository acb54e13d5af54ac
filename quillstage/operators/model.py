"""Steps that call an injected model: editing of blocks, comparison of blocks, annotation of front matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstage.functions import text as X
from quillstage.operators import editing, quality
from quillstage.operators.stages import FIRST_WAIT, called, status_of

#: Empty replies after which the text stands as it is.
MOST_BLANK = 2
Client = Callable[[str], str]


def edited(blocks: DataFrame, key: list[str], text: str, client: Client, first: float = FIRST_WAIT) -> DataFrame:
    """(key, output, findings, status, tries): a block's edited text with what is found against it; its own text where replies stay empty."""
    rows = called(blocks, [*key, text], text, client, blanks=MOST_BLANK, first=first)
    output = F.when(F.col("error").isNull() & (X.strip(F.coalesce("answer", F.lit(""))) == ""), F.col(text)).otherwise(F.col("answer"))
    rows = rows.withColumn("output", output)
    rows = rows.withColumn("findings", F.when(F.col("output").isNull(), F.array(F.lit("no answer"))).otherwise(quality.output_findings(F.col(text), F.col("output"))))
    status = F.when(F.col("output").isNull(), "echec").otherwise(status_of(F.col("findings")))
    return rows.select(*key, "output", "findings", status.alias("status"), "tries")


def compared(blocks: DataFrame, key: list[str], transcript: str, edition: str, client: Client, first: float = FIRST_WAIT) -> DataFrame:
    """(key, report, sound, findings, status, tries): what a model finds when it compares a block's edition with its transcript."""
    prompt = F.concat(F.lit("<<<SOURCE>>>\n"), F.col(transcript), F.lit("\n<<<FIN_SOURCE>>>\n"), F.col(edition))
    rows = called(blocks.withColumn("__prompt", prompt), key, "__prompt", client, first=first).withColumnRenamed("answer", "report")
    status = F.when(F.col("report").isNull(), "echec").when(F.col("__sound"), "termine").otherwise("suspect")
    rows = rows.withColumn("__sound", F.coalesce(quality.is_sound(F.col("report")), F.lit(False)))
    return rows.select(
        *key, "report", F.col("__sound").alias("sound"),
        F.coalesce(quality.counted_findings(F.col("report")), F.lit(0)).cast("long").alias("findings"), status.alias("status"), "tries"
    )


def annotated(lines: DataFrame, doc: str, end: int, client: Client, first: float = FIRST_WAIT) -> tuple[DataFrame, DataFrame]:
    """Roles that a model gives to the lines before ``end``, by one call per document, and the roles it gives that are none."""
    return editing.annotations(called(editing.annotation_prompt(lines, doc, end), [doc], "prompt", client, first=first), doc, "answer")
