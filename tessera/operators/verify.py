"""Verifiers of candidate answers, as Column -> struct(status, score)."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: What marks a factual query.
FACTUAL = ["who ", "who was", "who is", "when was", "where is", "where was", "invented", "discovered", "capital of", "born", "died", "founded", "population", "author of", "president", "prime minister", "history of"]
#: Fixed value: one arithmetic operation and its asserted result.
EQUATION = r"(\d+(?:\.\d+)?\s*[\+\-\*\/]\s*\d+(?:\.\d+)?)\s*=\s*(\d+(?:\.\d+)?)"
#: Words of a question that name nothing.
QUESTION_WORDS = ["what", "when", "where", "which", "who", "whom", "whose", "why", "how", "cite", "sources", "source", "according", "tell", "about", "please", "the", "is", "are", "was", "were", "been", "have", "has", "had", "for", "with"]
#: Fixed value: marks taken off the ends of words.
_EDGE = ".,;:?!\"'()"


def verdict(status, score) -> Column:
    return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(score) if isinstance(score, float) else score).alias("score"))


def structural(answer: Column, max_repetition: float = 0.25, min_words: int = 1) -> Column:
    w = T.split_words(T.strip(answer))
    rep = T.repetition(w, 3, 3)
    return F.when(T.strip(answer) == "", verdict("REVISE", 0.0)).when(F.size(w) < min_words, verdict("REVISE", 0.2)).when(rep > max_repetition, verdict("REVISE", F.greatest(F.lit(0.0), 1 - rep))).otherwise(verdict("PASS", 0.95))


def _wrong(expr: Column, asserted: Column) -> Column:
    """Whether a op b differs from the asserted value; operands with leading zeros and /0 count as wrong."""
    a, op, b = (F.regexp_extract(expr, r"^(\d+(?:\.\d+)?)\s*([\+\-\*\/])\s*(\d+(?:\.\d+)?)$", k) for k in (1, 2, 3))
    x, y = a.cast("double"), b.cast("double")
    value = F.when(op == "+", x + y).when(op == "-", x - y).when(op == "*", x * y).when(y != 0, x / y)
    odd = a.rlike(r"^0\d*[1-9]\d*$") | b.rlike(r"^0\d*[1-9]\d*$")
    return odd | value.isNull() | (F.abs(value - asserted.cast("double")) > 1e-4)


def mathematical(answer: Column) -> Column:
    left, right = F.regexp_extract_all(answer, F.lit(EQUATION), 1), F.regexp_extract_all(answer, F.lit(EQUATION), 2)
    wrong = F.exists(F.arrays_zip(left.alias("l"), right.alias("r")), lambda z: _wrong(z["l"], z["r"]))
    return F.when(F.size(left) == 0, verdict("UNVERIFIED", 0.5)).when(wrong, verdict("REVISE", 0.1)).otherwise(verdict("PASS", 1.0))


def grounded(query: Column, answer: Column, evidence: Column) -> Column:
    """Entity attribution, then the share of sentences whose longer words occur in the evidence."""
    joined = F.lower(F.array_join(evidence, " "))
    edge = f"^[{_EDGE}]+|[{_EDGE}]+$"
    clean = lambda w: F.regexp_replace(w, edge, "")
    raw = F.filter(F.transform(T.split_words(query), clean), lambda w: F.length(w) > 1)
    common = F.array(*(F.lit(w) for w in QUESTION_WORDS))
    named = F.filter(raw, lambda w: (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) & ~F.array_contains(common, F.lower(w)))
    plain = F.filter(raw, lambda w: ~F.array_contains(common, F.lower(w)) & (F.length(w) > 3))
    targets = F.transform(F.when(F.size(named) > 0, named).otherwise(plain), F.lower)
    attributed = (F.size(targets) == 0) | F.exists(targets, lambda e: F.contains(joined, e))
    found = F.filter(F.transform(F.split(answer, r"[.!?\n]+"), T.strip), lambda s: F.length(s) > 5)
    sentences = F.when(F.size(found) > 0, found).otherwise(F.array(T.strip(answer)))
    claim_words = F.filter(F.transform(sentences, lambda s: F.transform(F.filter(T.split_words(s), lambda w: F.length(w) > 3), lambda w: F.lower(clean(w)))), lambda ws: F.size(ws) > 0)
    supported = F.filter(claim_words, lambda ws: F.size(F.filter(ws, lambda w: F.contains(joined, w))) / F.size(ws) >= 0.35)
    rate = F.size(supported) / F.greatest(F.lit(1), F.size(claim_words))
    none = evidence.isNull() | (F.size(evidence) == 0)
    return F.when(none, verdict("UNVERIFIED", 0.5)).when(~attributed, verdict("REVISE", 0.2)).when(rate >= 0.5, verdict("PASS", F.least(F.lit(1.0), 0.6 + 0.4 * rate))).otherwise(verdict("REVISE", rate))


def factual_query(query: Column) -> Column:
    out = F.lit(False)
    for p in FACTUAL:
        out = out | F.contains(F.lower(query), F.lit(p))
    return out


#: Fixed value: a fenced block without a language or of Python, closed.
CODE_BLOCK = re.compile(r"```(?:python)?\s*\n(.*?)```", re.DOTALL | re.IGNORECASE)


def _code_status(text: str | None) -> str:
    blocks = CODE_BLOCK.findall(text or "")
    for block in blocks:
        try:
            ast.parse(block)
        except (SyntaxError, ValueError):
            return "REVISE"
    return "PASS" if blocks else "UNVERIFIED"


def _parses(text: str | None) -> bool:
    text = text or ""
    fence = next((f for f in ("```python", "```") if f in text), None)
    try:
        ast.parse((text.split(fence)[1].split("```")[0] if fence else text).strip())
    except (SyntaxError, ValueError):
        return False
    return True


def parses(text: Column) -> Column:
    """Whether the first fenced block, or else the whole text, is Python, in Arrow batches; nothing is run."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(_parses).astype(bool)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(text)


def code(answer: Column) -> Column:
    """Whether the fenced Python parses, in Arrow batches; nothing is run."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(_code_status)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    status = F.when(F.contains(answer, F.lit("```")), F.pandas_udf(run, "string")(answer)).otherwise("UNVERIFIED")
    return verdict(status, F.when(status == "PASS", 1.0).when(status == "REVISE", 0.0).otherwise(0.5))


def composite(query: Column, answer: Column, evidence: Column, code_status: Column) -> Column:
    """Structural, mathematical, code, then grounded: the first that does not hold decides, else a pass with the structural score.

    ``code_status``: the status that ``code`` gave, as a column of its own.
    """
    s, m, g = structural(answer), mathematical(answer), grounded(query, answer, evidence)
    has = evidence.isNotNull() & (F.size(evidence) > 0)
    refused = F.when(s["status"] != "PASS", s).when(m["status"] == "REVISE", m).when(code_status == "REVISE", verdict("REVISE", 0.0))
    return refused.when(has & (g["status"] != "PASS"), g).when(~has & factual_query(query), verdict("UNVERIFIED", 0.5)).otherwise(verdict("PASS", F.least(s["score"], F.lit(1.0))))
