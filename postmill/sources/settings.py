"""Rule files and settings, read on the driver."""

from __future__ import annotations

import json
import os

from postmill.functions import fixed, patterns
from postmill.operators.filters import CollectionRules
from postmill.operators.score import Rubric

try:
    import yaml
except ImportError:  # JSON is YAML too, so rule files can do without
    yaml = None


def load_rules(text: str) -> dict:
    """A rule file in YAML, or JSON where no YAML reader is installed."""
    return (yaml.safe_load(text) if yaml else json.loads(text)) or {}


def load_settings(lines: list[str], environ: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines without comments, quotes taken off; what the environment says wins."""
    out = {}
    for line in lines:
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip().strip("'\"")
    env = os.environ if environ is None else environ
    return {k: env.get(k) or v for k, v in out.items()}


def scoring_problems(rubric: dict) -> list[str]:
    """Weights that aren't numbers, and freshness steps out of order."""
    out = [f"{k}: {v!r} is not a number" for part in ("seniority", "verification", "geography", "source_weights", "sources", "firm_categories") for k, v in (rubric.get(part) or {}).items() if isinstance(v, bool) or not isinstance(v, (int, float))]
    steps = [s[0] for s in rubric.get("freshness") or []]
    return out + (["freshness limits must rise"] if steps != sorted(steps) else [])


def pattern_problems(rules: object, at: str = "") -> list[str]:
    """What is wrong with the patterns of a rule file: its lists of strings, wherever they stand, named by their place."""
    if isinstance(rules, dict):
        return [p for k, v in rules.items() for p in pattern_problems(v, f"{at}.{k}" if at else str(k))]
    if isinstance(rules, list):
        return [f"{at}: {p!r} {why}" for p in rules if isinstance(p, str) for why in patterns.problems(p)]
    return []


def rubric_of(scoring: dict, collection: dict | None = None, junior: tuple[str, ...] = fixed.JUNIOR_TITLES) -> Rubric:
    """The rubric that a scoring file states; what it leaves out keeps the rubric's own value.

    Places come from the collection file, so that filter and ranking can't drift apart. ``junior`` holds the patterns
    whose points ``seniority`` states.
    """
    where, old = collection or {}, Rubric()
    rank, checks, place = (scoring.get(k) or {} for k in ("seniority", "verification", "geography"))
    rules = lambda k: [(name, int(r.get("points", 0)), list(r.get("patterns") or [])) for name, r in (scoring.get(k) or {}).items()]
    return Rubric(
        tiers=rules("title_tiers"), junior=(list(junior), rank.get("junior_markers", 0), rank.get("no_marker", 0)), years_cap=rank.get("years_cap", old.years_cap), over_cap=rank.get("over_cap_penalty", old.over_cap),
        per_year_over=rank.get("per_year_over", old.per_year_over), phd_title=rank.get("phd_in_title", old.phd_title), phd={k: rank.get(f"phd_{k}", v) for k, v in old.phd.items()}, categories=dict(scoring.get("firm_categories") or {}),
        category_roles={k: (p, patterns) for k, p, patterns in rules("firm_role_bonus")}, signals=rules("description_signals"), least_text=scoring.get("min_jd_chars", old.least_text),
        home=(list(where.get("uk_markers") or []), place.get("uk_confirmed", 0)), away=([*(where.get("location_exclude_cities") or []), *(where.get("location_exclude_regions") or [])], place.get("outside_uk", 0)), no_location=place.get("not_stated", 0),
        sources=dict(scoring.get("source_weights") or {}), freshness=[tuple(x) for x in scoring.get("freshness") or []], live=checks.get("live", old.live), dead=checks.get("dead", old.dead), unverified=checks.get("unverified", old.unverified),
        mismatch=checks.get("title_mismatch", old.mismatch), anonymous=checks.get("anonymous_employer", old.anonymous), long_open=checks.get("long_open", old.long_open), ghost=checks.get("ghost_repost", old.ghost), python=True,
    )


def collection_of(collection: dict, junior: tuple[str, ...] = fixed.JUNIOR_MARKERS, rank_words: tuple[str, ...] = fixed.RANK_WORDS, written: bool = False) -> CollectionRules:
    """The collection filter that a collection file states; junior markers and rank words are no part of the file.

    Its patterns are Python's and are put into Java's terms, unless they are wanted as ``written``.
    """
    as_is = lambda ps: [p if written else patterns.java(p) for p in ps]
    of = lambda k: as_is(collection.get(k) or [])
    return CollectionRules(
        include=of("include"), roles=of("role_words"), domains=of("domain_words"), exclude=of("exclude"), rank_words=as_is(rank_words), junior=as_is(junior), home=of("uk_markers"),
        away=of("location_exclude_cities") + of("location_exclude_regions"), locations=of("locations"),
    )
