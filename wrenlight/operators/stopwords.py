"""Stop words: the list without apostrophes, and their removal."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenlight.functions.text import without_apostrophes

# A stop-word list is held by the driver; more words than this, unless told otherwise, is not one.
MAX_STOPWORDS = 20_000


def plain_stopwords(words: DataFrame, column: str = "word") -> DataFrame:
    """Distinct stop words with apostrophes removed."""
    return words.select(without_apostrophes(column).alias("word")).distinct()


def remove_stopwords(
    docs: DataFrame,
    words: DataFrame,
    text: str = "text",
    output: str = "kept",
    max_words: int = MAX_STOPWORDS,
) -> DataFrame:
    """Add the text without the stop words; case matters, repeated words stay."""
    listed = [row["word"] for row in words.select("word").limit(max_words + 1).collect()]
    if len(listed) > max_words:
        raise ValueError(f"more than {max_words} stop words")
    split = F.filter(F.split(F.col(text), r"\s+"), lambda word: word != "")
    remover = StopWordsRemover(
        inputCol="_words", outputCol="_kept", stopWords=listed, caseSensitive=True
    )
    kept = remover.transform(docs.withColumn("_words", split))
    return kept.withColumn(output, F.array_join("_kept", " ")).drop("_words", "_kept")
