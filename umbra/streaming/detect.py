"""Detection over a stream of texts. It looks at one row at a time, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from umbra.operators import patterns
from umbra.plans.redaction import RunConfig, run
from umbra.sources.runs import text_runs


def detect_stream(texts: DataFrame, config: RunConfig | None = None) -> DataFrame:
    """Pattern hits of a streaming or static table (doc_id, text)."""
    config = config or RunConfig()
    return patterns.find(text_runs(texts), config.patterns, config.min_confidence)


def redact_stream(texts: DataFrame, path: str, checkpoint: str, config: RunConfig | None = None) -> StreamingQuery:
    """Masked lines of a stream below ``path``; the rules that look at a whole page run on each micro-batch.

    Each batch has a folder of its own, which a batch that is run again after a failure replaces, so no line comes twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        run(batch, config).masked.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


