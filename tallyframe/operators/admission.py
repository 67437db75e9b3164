"""Budget admission: calls of a request in their order, each let through or refused by what is left of its budget.

A refused call spends nothing, so what is left depends on every decision before it: no running sum says it. Rows are
dealt by request and sorted, and each task folds over its rows as they stream by, with one pair of sums in hand; a
request with very many calls is read through, never held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "request long, call long, verdict string, spent_cost long, spent_tokens long"


def admit(calls: DataFrame, budgets: DataFrame) -> DataFrame:
    """request, call, verdict, spent_cost and spent_tokens after the call.

    Calls: request, call (their order; ties by estimate), estimate, cost, max_tokens, tokens. Budgets: request, max_cost,
    max_tokens. A call is ``refused_cost`` if its estimate is more than what is left, else ``refused_tokens`` if its token ceiling is
    more than what is left; an ``admitted`` call spends its real cost and tokens, which may overdraw the budget: then all
    later ones are refused. Without a budget a call is ``no_budget`` and spends nothing; null figures count as 0.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    limits = budgets.groupBy("request").agg(F.min("max_cost").cast("long").alias("max_cost"), F.min("max_tokens").cast("long").alias("token_limit"))
    rows = calls.select(F.col("request").cast("long").alias("request"), F.col("call").cast("long").alias("call"), zero("estimate"), zero("cost"), zero("max_tokens"), zero("tokens")).join(limits, "request", "left")
    dealt = rows.repartition("request").sortWithinPartitions("request", "call", "estimate", "cost", "tokens")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cost, tokens = object(), 0, 0
        for batch in batches:
            verdicts, costs, counts = [], [], []
            for request, estimate, price, ceiling, used, most, token_most in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7)], strict=True):
                if request != at:
                    at, cost, tokens = request, 0, 0
                if most is None or token_most is None:
                    verdict = "no_budget"
                elif cost > most or estimate > most - cost:
                    verdict = "refused_cost"
                elif tokens > token_most or ceiling > token_most - tokens:
                    verdict = "refused_tokens"
                else:
                    verdict, cost, tokens = "admitted", cost + price, tokens + used
                verdicts.append(verdict)
                costs.append(cost)
                counts.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.string()), pa.array(costs, pa.int64()), pa.array(counts, pa.int64())], ["request", "call", "verdict", "spent_cost", "spent_tokens"])

    return dealt.select("request", "call", "estimate", "cost", "max_tokens", "tokens", "max_cost", "token_limit").mapInArrow(fold, _OUT)
