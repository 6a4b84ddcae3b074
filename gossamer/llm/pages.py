"""What the page operators share: lines, shown text, and pages delivered twice."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

TAG = re.compile(r"<[^>\n]*>")
LETTER = re.compile(r"[^\W\d_]")
#: Ids that may be sent to every task (8 MB).
MAX_SENT_IDS = 500_000


def shown_lines(page: str) -> list[str]:
    """The shown text of each line: without tags, runs of whitespace made one blank, trimmed."""
    return [" ".join(x.split()) for x in TAG.sub("", page).split("\n")]


def flag_redelivered(df: DataFrame, key: str = "request_id") -> DataFrame:
    """``df`` with a boolean ``again``: the key stands in more than one row.

    Only the narrow key column is shuffled; the few repeated keys are written, and sent to the tasks
    while they are within ``MAX_SENT_IDS``, else joined by shuffle.
    """
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(key, F.lit(True).alias("again"))
    twice = written(twice, "redelivered")
    few = twice.count() <= MAX_SENT_IDS  # from the written footers
    return df.join(F.broadcast(twice) if few else twice, key, "left").withColumn("again", F.coalesce("again", F.lit(False)))
