"""Contract rules as rows: ``violations`` compiles a table of rules into one
expression over nested fields.

A rule names a field (``a.b`` of the row, or ``a.b[].c`` of every element of
the array ``a.b``) and what it must satisfy: a domain, a closed range, or the
least and most elements of an array.  It may hold at some stages only, and for
array elements only where a sibling field has one of some values.  Rules of one
name count as one.  All rules over one array are tested in one walk of it for
each name, so a rule costs an expression and no join or shuffle.

A NULL array has no elements.  A NULL value breaks a rule only if the rule says
``required``; a NULL stage meets no stage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S


@dataclass(frozen=True)
class Rule:
    name: str
    field: str
    domain: tuple = ()
    low: float | None = None
    high: float | None = None
    least: int | None = None
    most: int | None = None
    stages: tuple = ()
    where: tuple = ()          # (sibling field, its values), array elements only
    required: bool = False

    def __post_init__(self) -> None:
        if self.where and "[]." not in self.field:
            raise ValueError(f"rule {self.name}: only elements of an array have siblings")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _broken(rule: Rule, value: Column) -> Column:
    """Whether ``value`` breaks the rule; never NULL."""
    bad = []
    if rule.domain:
        bad.append(~value.isin(*rule.domain))
    if rule.low is not None:
        bad.append(value < rule.low)
    if rule.high is not None:
        bad.append(value > rule.high)
    if rule.least is not None:
        bad.append(F.size(value) < rule.least)
    if rule.most is not None:
        bad.append(F.size(value) > rule.most)
    if not bad and not rule.required:
        raise ValueError(f"rule {rule.name} tests nothing")
    known = F.coalesce(_any(bad), F.lit(False)) if bad else F.lit(False)
    return F.when(value.isNull(), F.lit(rule.required)).otherwise(known)


def _at_stage(rule: Rule, stage: str | None, bad: Column) -> Column:
    if not rule.stages:
        return bad
    if stage is None:
        raise ValueError(f"rule {rule.name} holds at some stages, but no stage column is given")
    return F.coalesce(F.col(stage).isin(*rule.stages), F.lit(False)) & bad


def violations(rules: list[Rule], stage: str | None = None) -> Column:
    """Names of the broken rules, ``;``-joined in the order of the table, '' if none."""
    names = list(dict.fromkeys(r.name for r in rules))
    out = []
    for name in names:
        own, bad, arrays = [r for r in rules if r.name == name], [], {}
        for r in own:
            if "[]." in r.field:
                arrays.setdefault(r.field.split("[].", 1)[0], []).append(r)
            else:
                bad.append(_at_stage(r, stage, _broken(r, F.col(r.field))))
        for array, group in arrays.items():
            bad.append(F.coalesce(F.exists(F.col(array), lambda e: _any([_element(r, stage, e) for r in group])), F.lit(False)))
        out.append(F.when(_any(bad), F.lit(name)))
    return F.concat_ws(";", *out)


def _element(rule: Rule, stage: str | None, element: Column) -> Column:
    bad = _at_stage(rule, stage, _broken(rule, element[rule.field.split("[].", 1)[1]]))
    if rule.where:
        sibling, values = rule.where
        bad = F.coalesce(element[sibling].isin(*values), F.lit(False)) & bad
    return bad


def research_rules() -> list[Rule]:
    """The rules of a research result: domains, ranges, and confidence bands by stage."""
    confidence = "result.findings[].confidence"
    bands = [Rule("confidence_outside_band", confidence, low=low, high=high, stages=(stage,), where=("source_type", (source,)))
             for stage, source, low, high in S.STAGE_CONFIDENCE_BANDS]
    return [
        Rule("presence_out_of_range", "online_presence_score", low=0, high=100, required=True),
        Rule("unknown_stage", "research_stage_reached", domain=tuple(S.RESEARCH_STAGES), required=True),
        Rule("confidence_out_of_range", confidence, low=0.0, high=1.0, required=True),
        Rule("confidence_below_floor", confidence, low=S.FINDING_CONFIDENCE_FLOOR,
             stages=tuple(dict.fromkeys(s for s, *_ in S.STAGE_CONFIDENCE_BANDS))),
        *bands,
        Rule("unknown_source_type", "result.findings[].source_type",
             domain=tuple(dict.fromkeys(s for _, s, *_ in S.STAGE_CONFIDENCE_BANDS))),
        Rule("unknown_business_function", "result.findings[].business_function", domain=tuple(S.FUNCTION_KEYWORDS)),
    ]


def check_research_rules(results: DataFrame) -> DataFrame:
    """``results`` with ``violations`` of :func:`research_rules`."""
    return results.withColumn("violations", violations(research_rules(), "research_stage_reached"))
