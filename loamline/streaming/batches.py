"""Operators over streams: row- and key-local jobs run on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loamline.operators import linting


def lint_stream(docs: DataFrame, rules: DataFrame, key: str, path: str, checkpoint: str, profile: str = "general") -> StreamingQuery:
    """Lints every document of a stream once; findings are appended to ``path`` as Parquet.

    Lines, fences and overlaps are local to a document, so a micro-batch needs
    no state from the ones before. A batch that is run again after a failure
    replaces its own folder.
    """

    def lint(batch: DataFrame, number: int) -> None:
        ls = linting.mask_phrases(linting.lint_lines(batch, key), "text", [])
        found = linting.suppress_overlaps(linting.rule_matches(ls, rules, [key, "line"], "masked", profile), [key, "line"])
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(lint).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
