"""Titles of vacancies: cleaned of what links drag in, and told from page furniture."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import fixed

_STRIP = r"[ –—\-|,·]*"
_TAILS = rf"(?i)(?:{fixed.TITLE_TAIL}\s*{_STRIP})+$"
_tails = re.compile(_TAILS)
_drop = [re.compile(p, re.I) for p in (fixed.NOT_A_JOB, fixed.PATH_TITLE, fixed.CLOSED_TITLE)]
_scheme, _role = re.compile(fixed.SCHEME_PAGE, re.I), re.compile(fixed.CONCRETE_ROLE, re.I)


def clean_title(title: Column, company: Column) -> Column:
    """A title up to the firm's name, without calls to action at its end, however many."""
    escaped = F.regexp_replace(company, r"([^A-Za-z0-9 ])", r"\\$1")
    at = F.regexp_instr(title, F.concat(F.lit(r"(?i)\s+"), escaped, F.lit(r"\b")))
    cut = F.when((F.length(company) >= 4) & (at > 3), F.trim(F.substr(title, F.lit(1), at - 1))).otherwise(title)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, rf"{_STRIP}$", ""), _TAILS, ""), rf"^{_STRIP}|{_STRIP}$", "")


def usable_title(title: Column) -> Column:
    """Whether a title can be a vacancy's: of 3 to 140 characters, no furniture, path or closed one, no scheme without a role."""
    has = lambda p: F.rlike(title, F.lit("(?i)" + p))
    return F.length(title).between(3, 140) & ~has(fixed.NOT_A_JOB) & ~has(fixed.PATH_TITLE) & ~has(fixed.CLOSED_TITLE) & (~has(fixed.SCHEME_PAGE) | has(fixed.CONCRETE_ROLE))


def tidy(title: str) -> str:
    """``clean_title`` of one string without a firm."""
    return _tails.sub("", title.strip(" –—-|,·")).strip(" –—-|,·")


def usable(title: str) -> bool:
    """``usable_title`` of one string."""
    return 3 <= len(title) <= 140 and not any(p.search(title) for p in _drop) and not (_scheme.search(title) and not _role.search(title))
