"""Functions for use from SQL: scalar operators by name, and the splitter as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.chunking import _split_one

#: Scalar operators as SQL bodies, so that Catalyst sees through them.
SCALARS = {
    "clamped_dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(a) > 0 AND size(a) = size(b) THEN greatest(-1D, least(1D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x))) ELSE 0D END",
    "distance_similarity": "(d DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(1D, 1 - d * d / 2))",
    "code_entities": r"(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(transform(concat(regexp_extract_all(coalesce(t, ''), r'(\b[a-zA-Z]{1,4}\s*[-_/]?\s*\d{2,10}[a-zA-Z]{0,2}\b)', 1), regexp_extract_all(coalesce(t, ''), r'(\b\d{2,10}[a-zA-Z]{1,4}\b)', 1)), x -> trim(x)))",
    "graph_score": "(hop INT, confidence DOUBLE, evidence INT, mentions INT, direct BOOLEAN) RETURNS DOUBLE RETURN greatest(0D, least(1D, CASE WHEN direct THEN 0.82D ELSE greatest(0D, 0.62D - greatest(0, hop - 1) * 0.25D) END + 0.22D * greatest(0D, least(1D, confidence)) + 0.16D * least(1D, evidence / 5D) + 0.08D * least(1D, mentions / 8D)))",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them in the session; returns their names."""
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

    @udtf(returnType="chunk_index INT, content STRING")
    class ChunkText:
        def eval(self, text: str, doc_type: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(_split_one(text, doc_type))

    spark.udtf.register("chunk_text", ChunkText)
    return [*SCALARS, "chunk_text"]


def register_tool(spark: SparkSession, name: str, function: Callable[[pd.Series], pd.Series], returns: str) -> None:
    """A user's vectorised function under a name, for SQL."""
    spark.udf.register(name, F.pandas_udf(function, returns))
