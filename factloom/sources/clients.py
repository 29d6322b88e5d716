"""Names for consented clients that tell them apart."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_name(name: str | None) -> str:
    """Compatibility form in lower case, without what can't be seen."""
    shown = "".join(c for c in unicodedata.normalize("NFKC", name or "") if unicodedata.category(c) not in ("Cf", "Cc", "Cn", "Co", "Cs"))
    return " ".join(shown.split()).casefold()


def folded(name: str | Column) -> Column:
    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(fold_name)

    return run(F.col(name) if isinstance(name, str) else name)


def name_clients(clients: DataFrame) -> DataFrame:
    """(client_id, name, consented_at) with ``label``: the name alone where it
    is the only one, else with the shortest date that tells it apart (year,
    month, day), else with a number."""
    rows = clients.withColumn("_fold", folded("name"))
    alone = F.count("*").over(W.partitionBy("_fold"))
    label = F.when(alone == 1, F.col("name"))
    for form in ("yyyy", "yyyy-MM", "yyyy-MM-dd"):
        stamp = F.date_format("consented_at", form)
        distinct = F.size(F.collect_set(stamp).over(W.partitionBy("_fold"))) == alone
        label = label.when(distinct, F.concat("name", F.lit(" ("), stamp, F.lit(")")))
    nth = F.row_number().over(W.partitionBy("_fold").orderBy("consented_at", "client_id"))
    return rows.withColumn("label", label.otherwise(F.concat("name", F.lit(" #"), nth))).drop("_fold")
