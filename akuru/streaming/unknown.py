"""The running count of unknown words, and a lexicon that grows while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import script as S
from ..operators import spelling


def count_unknown(texts: DataFrame, lexicon: Callable[[], DataFrame], total: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Count the unknown words of a stream of (t), batch by batch, into the table folder `total` (batch, word, cnt).

    The lexicon is read anew for every batch, so added words stop counting from the next one on.
    A batch that is run again replaces its own folder, so counts are exact.
    """

    def update(batch: DataFrame, number: int) -> None:
        words = batch.select(F.explode(S.words(F.col("t"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
        unknown = spelling.word_status(words, lexicon()).filter("status = 'unknown'").select("word")
        words.join(unknown, "word", "left_semi").write.mode("overwrite").parquet(f"{total}/batch={number}")

    return texts.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(counted: DataFrame, limit: int = 100) -> DataFrame:
    return counted.groupBy("word").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "word").limit(limit)
