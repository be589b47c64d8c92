"""Figures of a vocabulary beside the words of documents, without dealing most words out.

Words follow a steep law: a bounded list of the most frequent ones makes up most of what documents hold. That list goes to the
documents, so that their frequent words meet their figures where they are; only the others travel to theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import bytes_of, cut

#: Words of the list, and bytes of texts as they are stored in one part.
LISTED, PART_BYTES = 20_000, 4_000_000


def dealt_whole(docs: DataFrame, id_: str) -> DataFrame:
    """Documents in parts of a bounded size, by their id: what is grouped by it afterwards stays where it is."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-bytes_of(docs) // PART_BYTES))
    return docs.repartition(parts, id_)


def with_listed(words: DataFrame, figures: DataFrame, word: str, figure: str, listed: int = LISTED) -> DataFrame:
    """``words`` with ``figure`` of the ``listed`` words for which it is largest, else null. The list is bounded and so is its broadcast."""
    first = cut(figures.orderBy(F.desc(figure), word).limit(listed), "listed-words")
    return words.join(F.broadcast(first), word, "left")
