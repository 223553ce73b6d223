"""Calls of an outside model on rows, with the callable injected: validation, one repair, a second try, a fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Call = Callable[[str, str | None], str]
Problem = Callable[[str], str | None]


def answered(rows: DataFrame, id_col: str, prompt_col: str, call: Call, problem: Problem, *, fallback: Call | None = None, repairs: int = 1) -> DataFrame:
    """id, answer, calls, used_fallback, problem: one row a prompt.

    `call(prompt, complaint)` answers; `problem(answer)` says what is wrong with it, or nothing. A wrong answer is asked
    again with the complaint, `repairs` times, then once from `fallback`. What is still wrong has a null answer and its
    problem. Errors of a call are problems of their type's name: no fetched text goes into them. Prompts equal in a
    batch are asked once.
    """

    def one(prompt: str) -> tuple[str | None, int, bool, str | None]:
        complaint, calls = None, 0
        tries = [(call, False)] * (1 + repairs) + ([(fallback, True)] if fallback else [])
        for ask, second in tries:
            calls += 1
            try:
                answer = ask(prompt, complaint)
                complaint = problem(answer)
            except Exception as e:  # noqa: BLE001  an outside service may raise anything
                answer, complaint = None, type(e).__name__
            if complaint is None:
                return answer, calls, second, None
        return None, calls, fallback is not None, complaint

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            known = {p: one(p) for p in dict.fromkeys(rows["prompt"].fillna(""))}
            got = [known[p] for p in rows["prompt"].fillna("")]
            yield pd.DataFrame({"id": rows["id"], "answer": [g[0] for g in got], "calls": [g[1] for g in got], "used_fallback": [g[2] for g in got], "problem": [g[3] for g in got]})

    kind = dict(rows.dtypes)[id_col]
    return rows.selectExpr(f"`{id_col}` AS id", f"`{prompt_col}` AS prompt").mapInPandas(run, f"id {kind}, answer string, calls int, used_fallback boolean, problem string")
