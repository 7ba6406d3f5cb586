"""Table functions for SQL, used with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Passages:
    """passages(body [, headings]): ordinal, body, est_tokens of each passage of a text, and its headings if the second argument says so.

    Null text has no passages. The schema follows from the constant second argument.
    """

    @staticmethod
    def analyze(body: AnalyzeArgument, headings: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(body.dataType, StringType):
            raise ValueError("the body of passages() is a text")
        if headings is not None and not headings.isConstantExpression:
            raise ValueError("the second argument of passages() is a constant")
        schema = StructType().add("ordinal", IntegerType()).add("body", StringType()).add("est_tokens", IntegerType())
        return AnalyzeResult(schema.add("headings", ArrayType(StringType())) if headings is not None and headings.value else schema)

    def eval(self, body: str | None, headings: bool = False) -> Iterator[tuple]:
        from ..operators.chunking import passages, tokens_in

        for n, (heads, passage) in enumerate(passages(body or "")):
            yield (n, passage, tokens_in(passage), *([heads] if headings else []))


def register(spark: SparkSession) -> None:
    """Makes passages() known to the session's SQL."""
    spark.udtf.register("passages", udtf(Passages))
