"""Tools by name over columns; what goes wrong becomes a row, not an exception."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import Refused

RESULT = "success boolean, output string, error string, ms double"


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[[str], str]


class Tools:
    """Registered tools; a name registered again takes the newer one."""

    def __init__(self, *tools: Tool):
        self._tools: dict[str, Tool] = {}
        for t in tools:
            self.register(t)

    def register(self, tool: Tool) -> None:
        if not isinstance(tool, Tool):
            raise TypeError(f"{type(tool).__name__} is no Tool")
        self._tools[tool.name] = tool

    def get(self, name: str) -> Tool | None:
        return self._tools.get(name)

    def names(self) -> list[str]:
        return list(self._tools)

    def catalogue(self, spark) -> DataFrame:
        return spark.createDataFrame([(t.name, t.description) for t in self._tools.values()], "name string, description string")

    def invoke(self, name: Column, argument: Column) -> Column:
        """struct(success, output, error, ms) of each row's own tool, in Arrow batches."""
        tools = dict(self._tools)

        def one(n: str | None, a: str | None) -> tuple:
            tool = tools.get(n)
            if tool is None:
                return False, None, f"no tool {n!r}; there are {', '.join(sorted(tools))}", 0.0
            began = time.perf_counter()
            try:
                done = True, tool.run(a), None
            except Refused as e:
                done = False, None, str(e)
            except Exception as e:  # any failure is the row's result
                done = False, None, f"{n} failed with {type(e).__name__}: {e}"
            return *done, (time.perf_counter() - began) * 1000

        def run(n: pd.Series, a: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(x, y) for x, y in zip(n, a)], columns=["success", "output", "error", "ms"])

        run.__annotations__ = {"n": pd.Series, "a": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(run, RESULT)(name, argument)
