"""Document quality: all failing reasons (gate) or the first one (source filter)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class QualityPolicy:
    """The gate's thresholds."""

    min_chars: int = 160
    max_chars: int = 200_000
    min_visible: float = 0.85
    min_alnum: float = 0.20
    max_html: float = 0.08
    max_control: float = 0.001
    min_diversity: float = 0.12
    require_metadata: bool = True
    metadata: tuple[str, ...] = ("source", "source_revision", "language", "domain", "license", "document_id", "preprocessing_version")
    frozen: tuple[str, ...] = ("source_revision", "document_id", "preprocessing_version")


def word_diversity(w: Column) -> Column:
    return F.size(F.array_distinct(w)) / F.size(w)


def reasons(df: DataFrame, policy: QualityPolicy = QualityPolicy(), text_col: str = "text", language_col: str = "language", word_fold: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds normalized, folded, content_hash, dominant_script, reasons and accepted.

    A null text has the single reason missing_text and the hash of the empty text.
    Words are alike that ``word_fold`` makes equal, case folding by default.
    """
    df = df.withColumn("normalized", F.coalesce(T.normalize(F.col(text_col)), F.lit("")))
    c = F.col("normalized")
    df = df.withColumns({"dominant_script": T.dominant_script(c), "folded": T.casefold(c)}).withColumn("__words", T.words(word_fold(c) if word_fold else F.col("folded")))
    checks: list[tuple[Column, Column | str]] = [
        (F.length(c) < policy.min_chars, "too_short"),
        (F.length(c) > policy.max_chars, "too_long"),
        (F.contains(c, F.lit("�")), "unicode_replacement_character"),
        (c.rlike(r"(?s)(.)\1{19,}"), "repeated_character_run"),
        (T.ratio(T.visible_count(c), c) < policy.min_visible, "low_visible_character_ratio"),
        (T.ratio(T.alnum_count(c), c) < policy.min_alnum, "low_alphanumeric_ratio"),
        (T.ratio(T.control_count(c), c) > policy.max_control, "excess_control_characters"),
        (T.ratio(T.html_count(c), c) > policy.max_html, "html_boilerplate"),
        (F.when(F.size("__words") >= 40, word_diversity(F.col("__words")) < policy.min_diversity).otherwise(False), "low_word_diversity"),
    ]
    for key in policy.metadata if policy.require_metadata else ():
        value = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
        checks.append((value == "", f"missing_metadata:{key}"))
        if key in policy.frozen:
            checks.append((F.lower(value).isin("unknown", "latest", "unversioned"), f"unfrozen_metadata:{key}"))
    found = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in checks), T.script_mismatch(F.col(language_col), F.col("dominant_script"))))
    df = df.withColumn("reasons", F.when(F.col(text_col).isNull(), F.array(F.lit("missing_text"))).otherwise(found))
    return df.withColumn("accepted", F.size("reasons") == 0).withColumn("content_hash", T.content_hash(F.col("folded"))).drop("__words")


#: What counts as mathematical text.
MATH_SIGNALS = ["$", "\\", "=", "{", "}", "+", "-", "^", "_", "algorithm", "theorem", "proof", "equation"]


def first_reason(text: Column, source_key: Column, edu_score: Column | None = None) -> Column:
    """The source filter: the first failing reason, or ``passed``."""
    n = F.length(text)
    out = F.when(n < 180, "too_short").when(F.size(T.split_words(text)) < 30, "too_few_words")
    if edu_score is not None:
        out = out.when((source_key == "fineweb_edu") & (edu_score < 3.0), "low_educational_score")
    signal = F.lit(False)
    for s in MATH_SIGNALS:
        signal = signal | F.contains(text, F.lit(s))
    out = out.when((source_key == "open_web_math") & ~signal, "lacks_mathematical_signals")
    return out.when(T.count_chars(text, r"[\p{L}\p{N}\s\x1c-\x1f\x85\p{Z}]") / n < 0.65, "high_noise_ratio").otherwise("passed")


@dataclass(frozen=True)
class GateLimits:
    """Rates above which a corpus is not published."""

    reject_rate: float = 0.02
    duplicate_rate: float = 0.005
    script_warning_rate: float = 0.0


def gate_totals(rows: DataFrame) -> DataFrame:
    """One row of counters. rows: reasons, duplicate, contaminated.

    Duplicates come first, then contamination, then the reasons; only the reasons of rows that reach that step count.
    """
    judged = ~F.col("duplicate") & ~F.col("contaminated")
    scripts = F.size(F.filter("reasons", lambda r: F.startswith(r, F.lit("language_script_mismatch:")))) > 0
    count = lambda c, name: F.count_if(c).cast("long").alias(name)
    return rows.agg(
        F.count("*").alias("documents"),
        count(F.col("duplicate"), "duplicates"),
        count(~F.col("duplicate") & F.col("contaminated"), "contaminated"),
        count(judged & (F.size("reasons") == 0), "accepted"),
        count(judged & scripts, "script_warnings"),
    )


def gate_failures(totals: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """``totals`` with reject_rate, duplicate_rate, script_warning_rate, failures (names) and decision."""
    n = F.greatest(F.lit(1), "documents")
    df = totals.withColumns({"reject_rate": (F.col("documents") - F.col("accepted")) / n, "duplicate_rate": F.col("duplicates") / n, "script_warning_rate": F.col("script_warnings") / n})
    checks = [(F.col("contaminated") > 0, "heldout_contamination"), *((F.col(k) > getattr(limits, k), k) for k in ("reject_rate", "duplicate_rate", "script_warning_rate")), (F.col("accepted") == 0, "no_accepted_documents")]
    failures = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))
    return df.withColumn("failures", failures).withColumn("decision", F.when(F.size("failures") == 0, "PASS").otherwise("FAIL"))
