"""The boundary to translation models: a batch function behind ``mapInPandas``, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessella.runtime import ship_code

#: What a model offers: a list of texts in, a list of texts (None: failed) out.
Translate = Callable[[list[str]], list[str | None]]


def translate(rows: DataFrame, load: Callable[[], Translate], column: str = "text", batch: int = 64) -> DataFrame:
    """``rows`` with ``translation`` and ``ok``. A failed text falls back on itself and is marked."""
    schema = rows.selectExpr("*", "CAST(NULL AS STRING) AS translation", "true AS ok").schema

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in pdfs:
            texts = [t or "" for t in pdf[column]]
            made: list[str | None] = []
            for k in range(0, len(texts), batch):
                made += model(texts[k : k + batch])
            yield pdf.assign(translation=[m if m is not None else t for m, t in zip(made, texts)], ok=[m is not None for m in made])

    ship_code(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def lexicon_model(lexicon: dict[str, str]) -> Callable[[], Translate]:
    """A stand-in model: word for word by a lexicon; a text without any known word fails."""

    def load() -> Translate:
        def run(texts: list[str]) -> list[str | None]:
            out: list[str | None] = []
            for t in texts:
                words = t.split()
                known = [lexicon.get(w.lower()) for w in words]
                out.append(" ".join(k or w for k, w in zip(known, words)) if any(known) else None)
            return out

        return run

    return load
