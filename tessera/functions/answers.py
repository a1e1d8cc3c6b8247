"""Functions on generated answers, prompts, log lines and expressions."""

from __future__ import annotations

import ast
import difflib
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import text as T


def strip_echo(answer: Column, prompt: Column) -> Column:
    """The answer without the prompt that it repeats."""
    return T.strip(F.when(F.startswith(answer, prompt), F.substr(answer, F.length(prompt) + 1)).otherwise(answer))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.size(T.split_words(c)))


def arithmetic_in(c: Column) -> Column:
    """The first arithmetic expression of a question, or null."""
    return F.nullif(T.strip(F.regexp_extract(c, r"(\(?\d[\d\s\.\+\-\*\/\(\)%]*[\+\-\*\/%][\d\s\.\+\-\*\/\(\)%]*\d\)?)", 1)), F.lit(""))


def fenced_code(c: Column) -> Column:
    """The first fenced block, or null."""
    return F.nullif(F.regexp_extract(c, r"(?s)```(?:python|py)?\n?(.*?)```", 1), F.lit(""))


def states_answer(c: Column) -> Column:
    return F.contains(c, F.lit("####")) | F.contains(c, F.lit("The answer is")) | F.contains(c, F.lit("equals"))


def log_metrics(line: Column) -> Column:
    """struct(step, loss, tok_s, mem) of a training log line of parts between bars."""
    number = lambda name: F.nullif(F.regexp_extract(line, rf"(?i){name}\s*[:=]?\s*([\d\.]+)", 1), F.lit("")).cast("double")
    return F.struct(number("step").alias("step"), number("loss").alias("loss"), number("tok/s").alias("tok_s"), number("mem").alias("mem"))


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks; the matcher has no column form, so it runs on Arrow batches."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    ratios.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratios, DoubleType())(a, b)


def response_score(answer: Column, reference: Column, task: Column) -> Column:
    """struct(score, eos_stopped, rep_rate): length, repetition, likeness to the reference and a task bonus, 0 to 10."""
    clean = T.strip(answer)
    rep = T.repetition(T.split_words(clean), 2, 4)
    bonus = (task == "instruction_following") & (F.contains(clean, F.lit("-")) | F.contains(clean, F.lit("1.")) | F.contains(clean, F.lit("\n")))
    raw = F.when(F.length(clean) >= 10, 2.0).otherwise(0.0) + F.when(rep > 0.4, -3.0).when(rep < 0.15, 2.0).otherwise(0.0) + 4 * similarity(F.lower(clean), F.lower(reference)) + F.when(bonus, 2.0).otherwise(0.0)
    empty = clean == ""
    score = F.when(empty, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw)), 2))
    stopped = ~empty & ~(F.endswith(clean, F.lit("...")) | (F.length(clean) >= 450))
    return F.struct(score.alias("score"), stopped.alias("eos_stopped"), F.when(empty, 0.0).otherwise(F.bround(rep, 3)).alias("rep_rate"))


#: What a calculator expression may use, its limits and its messages.
_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
_FUNCTIONS = {
    "sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "log10": math.log10, "exp": math.exp,
    "abs": abs, "round": round, "pow": math.pow, "floor": math.floor, "ceil": math.ceil,
}
_CONSTANTS = {"pi": math.pi, "e": math.e}
_MOST_BASE, _MOST_EXPONENT = 10_000, 1000
_EMPTY, _SYNTAX, _FAILED = "Empty expression provided to calculator.", "Syntax error in mathematical expression: ", "Evaluation failed: "
_ZERO, _BOUNDS, _NO_CALL = "Division or modulo by zero.", "Exponentiation result exceeds safe computation bounds.", "Disallowed function call in calculator expression."
_NAME, _KIND, _CALL = "Unknown constant or variable: '{}'", "Unsupported mathematical syntax: {}", "Math function error '{}': {}"


class Refused(ValueError):
    """An expression that the calculator does not take."""


def _operands(node: ast.AST) -> list[ast.AST]:
    """The operands of a part that the calculator takes; any other part is refused before its operands are looked at."""
    kind = type(node)
    if kind is ast.Call:
        if getattr(node.func, "id", None) not in _FUNCTIONS:
            raise Refused(_NO_CALL)
        return node.args
    if kind in (ast.BinOp, ast.UnaryOp) and type(node.op) in _OPERATORS:
        return [node.operand] if kind is ast.UnaryOp else [node.left, node.right]
    if kind is ast.Name and node.id not in _CONSTANTS:
        raise Refused(_NAME.format(node.id))
    if kind is not ast.Name and not (kind is ast.Constant and isinstance(node.value, (int, float))):
        raise Refused(_KIND.format(kind.__name__))
    return []


def _worth(node: ast.AST, values: list[float]) -> float:
    """A part's value from its operands'."""
    if isinstance(node, ast.Call):
        try:
            return float(_FUNCTIONS[node.func.id](*values))
        except Exception as e:
            raise Refused(_CALL.format(node.func.id, e)) from e
    if not values:
        return float(node.value) if isinstance(node, ast.Constant) else _CONSTANTS[node.id]
    op = type(node.op)
    if op in (ast.Div, ast.FloorDiv, ast.Mod) and values[1] == 0:
        raise Refused(_ZERO)
    if op is ast.Pow and (abs(values[0]) > _MOST_BASE or abs(values[1]) > _MOST_EXPONENT):
        raise Refused(_BOUNDS)
    return float(_OPERATORS[op](*values))


def _evaluated(body: ast.AST) -> float:
    """From the left, each part refused on the way down and computed on the way up; no recursion, however deep."""
    todo: list[tuple[ast.AST, int]] = [(body, -1)]
    values: list[float] = []
    while todo:
        node, n = todo.pop()
        if n < 0:
            parts = _operands(node)
            todo.append((node, len(parts)))
            todo += [(x, -1) for x in reversed(parts)]
        else:
            own = values[len(values) - n :]
            del values[len(values) - n :]
            values.append(_worth(node, own))
    return values[0]


def _calculate(expression: str | None) -> tuple[bool, str | None, str | None]:
    """success, output, error; an error is a result, it never ends the query."""
    text = (expression or "").strip()
    if not text:
        return False, None, _EMPTY
    try:
        v = _evaluated(ast.parse(text, mode="eval").body)
        return True, str(int(v)) if math.isfinite(v) and v.is_integer() else repr(v), None
    except SyntaxError as e:
        return False, None, _SYNTAX + str(e.msg)
    except Refused as e:
        return False, None, str(e)
    except Exception as e:
        return False, None, _FAILED + str(e)


def calculated(expression: str | None) -> str:
    """The calculator's output as a tool gives it; what it does not take raises Refused."""
    success, output, error = _calculate(expression)
    if not success:
        raise Refused(error)
    return output


def calculate(expression: Column) -> Column:
    """struct(success, output, error) of a calculator over a parsed tree, in Arrow batches; nothing is evaluated as code."""
    kind = StructType([StructField("success", BooleanType()), StructField("output", StringType()), StructField("error", StringType())])

    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_calculate(e) for e in x], columns=kind.names)

    run.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, kind)(expression)
