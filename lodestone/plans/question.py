"""Question plans: ordered steps that are checked and then compiled into one lineage of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCH, LOOKUP, EVIDENCE, CALCULATE, HISTORY = "SEARCH_DISCLOSURES", "LOOKUP_FACTS", "SEARCH_EVIDENCE", "CALCULATE", "RESOLVE_DISCLOSURE_HISTORY"

#: Fields of an input that name an earlier step, and the tool that this must have.
BINDINGS = {"disclosureIdsFrom": SEARCH, "factsFrom": LOOKUP}


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    step_id: str
    tool: str
    input: dict = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]
    companies: tuple[str, ...] = ()
    receipt_from: str | None = None
    receipt_to: str | None = None
    as_of: str | None = None


def _day(text: str | None, name: str) -> date | None:
    try:
        return date.fromisoformat(text) if text else None
    except ValueError as e:
        raise PlanError(f"{name} is no date: {text}") from e


def validated(plan: Plan, least: int = 1, most: int = 50) -> Plan:
    """The plan with all dependencies spelled out; a PlanError for what can't run."""
    start, end = _day(plan.receipt_from, "receipt_from"), _day(plan.receipt_to, "receipt_to")
    _day(plan.as_of, "as_of")
    if start and end and start > end:
        raise PlanError("receipt_from is after receipt_to")
    seen: dict[str, Step] = {}
    searches: list[dict] = []
    steps = []
    for step in plan.steps:
        if step.tool not in (SEARCH, LOOKUP, EVIDENCE, CALCULATE, HISTORY):
            raise PlanError(f"{step.step_id}: unknown tool {step.tool}")
        if step.step_id in seen:
            raise PlanError(f"{step.step_id} occurs twice")
        depends = list(step.depends_on)
        for name, tool in BINDINGS.items():
            if (target := step.input.get(name)) is not None:
                if target not in seen:
                    raise PlanError(f"{step.step_id}: {name} names no earlier step")
                if seen[target].tool != tool:
                    raise PlanError(f"{step.step_id}: {name} must name a step of {tool}")
                depends.append(target)
        if any(d not in seen for d in depends):
            raise PlanError(f"{step.step_id} depends on no earlier step")
        limit = step.input.get("limit")
        if limit is not None and not least <= limit <= most:
            raise PlanError(f"{step.step_id}: limit lies between {least} and {most}")
        if step.tool == SEARCH:
            if step.input in searches:
                raise PlanError(f"{step.step_id} repeats a search")
            searches.append(step.input)
            if len(searches) > 2:
                raise PlanError("a plan varies its search once at most")
        seen[step.step_id] = made = replace(step, depends_on=tuple(dict.fromkeys(depends)))
        steps.append(made)
    return replace(plan, steps=tuple(steps))


def with_required_facts(plan: Plan, required: tuple[str, ...]) -> Plan:
    """Each lookup also asks for the facts that the answer's policy requires."""
    return replace(plan, steps=tuple(replace(s, input=s.input | {"factKeys": list(dict.fromkeys([*s.input.get("factKeys", []), *required]))}) if s.tool == LOOKUP else s for s in plan.steps))


def compiled(plan: Plan, tools: dict[str, Callable[[dict, dict[str, DataFrame]], DataFrame]]) -> tuple[dict[str, DataFrame], list[str]]:
    """A DataFrame for each step and warnings for those without a tool. Nothing runs until an action asks for it."""
    frames: dict[str, DataFrame] = {}
    warnings = []
    for step in validated(plan).steps:
        if step.tool not in tools or any(d not in frames for d in step.depends_on):
            warnings.append(f"{step.step_id}: {step.tool} isn't executed")
        else:
            frames[step.step_id] = tools[step.tool](step.input, {d: frames[d] for d in step.depends_on})
    return frames, warnings


# Search words for each concept and fact.
SECTION_HINTS = ("신규시설투자", "투자내역", "기타 투자판단에 참고할 사항")
FACT_WORDS = {
    "facility.type": ("투자구분", "투자 구분"),
    "facility.target": ("투자대상", "투자 대상"),
    "facility.amount": ("투자금액", "투자 금액", "투자규모"),
    "facility.equity_amount": ("자기자본", "자기 자본"),
    "facility.equity_ratio": ("자기자본대비", "자기자본 대비"),
    "facility.purpose": ("투자목적", "투자 목적"),
    "facility.start_date": ("투자기간", "투자 기간", "시작일"),
    "facility.end_date": ("투자기간", "투자 기간", "종료일"),
    "facility.decision_date": ("이사회결의일", "이사회 결의일", "결정일"),
}
CONCEPT_WORDS = {
    "FACILITY_INVESTMENT": ("시설투자", "설비투자"),
    "CAPACITY_EXPANSION": ("생산능력 확대", "생산 능력 확대", "생산시설 확충", "설비 증설"),
    "INVESTMENT_SCALE": ("투자금액", "투자 금액", "투자규모", "자기자본대비"),
    "COMPLETION_SCHEDULE": ("투자기간", "투자 기간", "종료일", "완료예정일"),
}


def resolved_terms(concepts: list[str], fact_keys: list[str], words: list[str] = ()) -> tuple[tuple[str, ...], frozenset[str], tuple[str, ...], list[str]]:
    """Keywords in a fixed order, those from facts, section hints, and warnings for names that have no words."""
    keywords: list[str] = list(words)
    hints: set[str] = set()
    warnings = []
    known = False
    for name in sorted(concepts):
        known |= name in CONCEPT_WORDS
        keywords += CONCEPT_WORDS.get(name, ())
        warnings += [] if name in CONCEPT_WORDS else [f"unknown concept {name}"]
    for name in sorted(fact_keys):
        known |= name in FACT_WORDS
        keywords += FACT_WORDS.get(name, ())
        hints |= set(FACT_WORDS.get(name, ()))
        warnings += [] if name in FACT_WORDS else [f"unknown fact {name}"]
    return tuple(dict.fromkeys(keywords)), frozenset(hints), SECTION_HINTS if known else (), warnings


def resolved_company(companies: DataFrame, name_column: str, asked: DataFrame) -> DataFrame:
    """asked (name) with the number of companies of exactly that name and what follows: FOUND, NOT_FOUND or AMBIGUOUS."""
    counts = companies.groupBy(F.col(name_column).alias("name")).agg(F.count("*").alias("n"))
    found = asked.join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("status", F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") > 1, "AMBIGUOUS").otherwise("FOUND"))


def matched_policy(policies: list[dict], subtype: str | None, asked: str) -> dict | None:
    """The policy of the subtype that was asked for, else of exactly this question; several are an error."""
    found = [p for p in policies if subtype and p.get("subtype") == subtype] or [p for p in policies if p.get("question") == asked]
    if len(found) > 1:
        raise PlanError("several policies fit")
    return found[0] if found else None
