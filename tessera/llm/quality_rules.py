"""Quality rules as a short-circuit cascade.

Every rule says of a document whether it is rejected. On a sample, each rule's
cost (seconds a document) and selectivity (share rejected) are measured on the
executors, and rules run in the order of rejections per second, so most bad
documents meet few rules. Order changes the work alone: a document is kept if no
rule rejects it, whichever comes first.

Nulls and empty texts have no words and fail the base rules; texts of any length
are measured whole; repeated rows each get their own row; rules of equal worth run
in the order in which they are given; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BASE, U, buffers, mix, slices, word_hashes, word_spans
from .shared import id_text, tidily

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SAMPLE_ROWS = 2000


@dataclass
class Doc:
    """What rules look at."""

    text: bytes
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    def words(self) -> list[bytes]:
        return self.text.split()

    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    def string(self) -> str:
        return self.text.decode("utf-8", "replace")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def few_words(d: Doc) -> bool:
    return d.n_words < 10


def repeated_words(d: Doc) -> bool:
    return 100 * d.n_repeat_words > 20 * d.n_words


def many_symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > d.n_words


def repeated_lines(d: Doc) -> bool:
    return d.n_dup_lines > 0 and 10 * d.n_dup_lines > 3 * len(d.lines())


def odd_word_length(d: Doc) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 14 * d.n_words


def shouting(d: Doc) -> bool:
    upper = len(re.findall(rb"[A-Z]", d.text))
    return 2 * upper > upper + len(re.findall(rb"[a-z]", d.text))


def few_letters(d: Doc) -> bool:
    s = d.string()
    return 2 * sum(map(str.isalpha, s)) < d.word_chars


def one_word_rules(d: Doc) -> bool:
    words = d.words()
    most: dict[bytes, int] = {}
    for w in words:
        most[w] = most.get(w, 0) + 1
    return 10 * max(most.values(), default=0) > 4 * len(words)


BASE_RULES = (Rule("few_words", few_words), Rule("repeated_words", repeated_words))
RULES = (Rule("many_symbols", many_symbols), Rule("repeated_lines", repeated_lines), Rule("odd_word_length", odd_word_length), Rule("shouting", shouting), Rule("few_letters", few_letters), Rule("one_word_rules", one_word_rules))


def measures(col: pa.Array) -> Iterator[Doc]:
    """The base measures of each text of a binary column without nulls."""
    data, off = buffers(col)
    starts, ends, before = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(h) - 4), U)
        for j in range(5 if len(run) else 0):
            run = (run + h[j : j + len(run)]) * (BASE | U(1))
        run = mix(run)
    for k, text in enumerate(col.to_pylist()):
        a, b = int(before[k]), int(before[k + 1])
        repeat = 0
        if b - a >= 6:
            own = run[a : b - 4]
            order = np.argsort(own, kind="stable")
            s = own[order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = np.zeros(len(s), bool)
                twice[1:] |= same
                twice[:-1] |= same
                cover = np.zeros(b - a + 1, "i8")
                np.add.at(cover, order[twice], 1)
                np.add.at(cover, order[twice] + 5, -1)
                repeat = int((np.cumsum(cover)[:-1] > 0).sum())
        seen: set[bytes] = set()
        dup = 0
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
        yield Doc(text, b - a, int(in_words[b] - in_words[a]), int(symbols[off[k + 1]] - symbols[off[k]]), dup, repeat)


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules by rejections per second, measured on about ``sample_rows`` rows drawn at random.

    One row a rule reaches the driver. Without rows the order stays.
    """
    rows = id_text(docs, id_col, text_col)
    n = rows.count()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hit, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for part in slices(batch, 1):
                for d in measures(part.column(1).cast(pa.binary())):
                    if any(r.rejects(d) for r in BASE_RULES):
                        continue
                    seen += 1
                    for k, r in enumerate(rules):
                        t = time.perf_counter()
                        hit[k] += r.rejects(d)
                        spent[k] += time.perf_counter() - t
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(hit, pa.int64()), pa.array([seen] * len(rules), pa.int64())], ["rule", "spent", "hit", "seen"])

    sample = rows.sample(fraction=min(1.0, sample_rows / max(1, n)), seed=7)
    found = sample.mapInArrow(tidily(measure), "rule int, spent double, hit long, seen long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hit").alias("hit"), F.sum("seen").alias("seen")).collect()
    worth = {r["rule"]: (r["hit"] + 0.5) / max(r["spent"], 1e-9) for r in found if r["seen"]}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth.get(k, 0))]


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and rejected_by (the first rule met that rejects)."""
    order = order_rules(docs, rules, sample_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for d in measures(part.column(1).cast(pa.binary())):
                    first = next((r.name for r in base if r.rejects(d)), None)
                    failed = first is not None
                    first = first or next((r.name for r in order if r.rejects(d)), None)
                    rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, first is None, first))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.bool_()), pa.array(cols[7], pa.string())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    return id_text(docs, id_col, text_col).mapInArrow(tidily(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
