"""A plain-Python model of version expressions, to compare with."""

import re

_VERSION = re.compile(r"v?(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?")
_TERM = re.compile(r"(\^|~|>=|<=|>|<|=)?\s*(\S+)")
_NUMBER = r"^\s*(>=|<=|>|<|=)\s*(-?\d+(?:\.\d+)?)\s*$"


def _parts(text: str) -> tuple[list[int], tuple | None] | None:
    """The numbers that are given (up to a wildcard) and the pre-release; None if it is no version."""
    m = _VERSION.fullmatch(text)
    if not m:
        return None
    given: list[int] = []
    for x in m.groups()[:3]:
        if x is None or not x.isdigit():
            break
        given.append(int(x))
    pre = m.group(4)
    return given, pre and tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in pre.split("."))


def _key(given: list[int], pre: tuple | None = None) -> tuple:
    return (*given, *[0] * (3 - len(given))), pre is None, pre or ()


def _next(given: list[int], k: int) -> tuple:
    """The least version, pre-releases included, whose k-th number is one higher."""
    return tuple([*given[:k], given[k] + 1, 0, 0][:3]), False, ()


def _term(version: tuple, op: str, text: str) -> bool | None:
    p = _parts(text)
    if p is None:
        return None
    given, pre = p
    if not given:
        return op not in ("<", ">")
    low, after = _key(given, pre), _next(given, len(given) - 1)
    whole = len(given) == 3
    if op == "^":
        k = next((i for i, x in enumerate(given) if x), len(given) - 1)
        return low <= version < _next(given, k)
    if op == "~":
        return low <= version < _next(given, min(1, len(given) - 1))
    if op == ">=":
        return version >= low
    if op == "<":
        return version < low
    if op == ">":
        return version > low if whole else version >= after
    if op == "<=":
        return version <= low if whole else version < after
    return version == low if whole else low <= version < after


def satisfies(version, expression) -> bool:
    """Whether a version meets ^, ~, comparisons, wildcards, joined by spaces (and) or || (or).

    A null or blank expression asks for nothing; what cannot be read is not met.
    """
    if expression is None or not expression.strip():
        return True
    p = _parts((version or "").strip())
    if p is None or len(p[0]) < 3:
        return False
    found = _key(*p)
    for part in expression.split("||"):
        terms = _TERM.findall(part)
        if terms and all(_term(found, op, text) for op, text in terms):
            return True
    return False
