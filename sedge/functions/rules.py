"""Rule catalogues as data: rows that are folded into literal predicates, so each pattern compiles once per task."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` (Java regular expression) votes for ``group`` with ``weight``; the list's order breaks ties.

    ``needs`` are lists of words in lower case: any text on which the rule fires holds a word of each list, without regard to case. ``spared`` are such lists for
    the texts on which ``unless`` fires. Both are only a help: ``risks.all_risks`` leaves patterns out by them.
    """

    group: str
    pattern: str
    weight: float = 1.0
    name: str = ""
    level: str = "medium"
    unless: str | None = None
    gate: str | None = None
    message: str = ""
    needs: tuple[tuple[str, ...], ...] = ()
    spared: tuple[tuple[str, ...], ...] = ()


class RuleSet:
    """A user adds rows, not code. ``from_rows`` takes a small table with the columns of Rule."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)

    @classmethod
    def from_rows(cls, df: DataFrame, limit: int = 10_000) -> RuleSet:
        fields = [c for c in df.columns if c in Rule.__dataclass_fields__]
        rows = df.select(fields).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"a rule catalogue holds at most {limit} rows")
        return cls(Rule(**r.asDict()) for r in rows)

    def groups(self) -> list[str]:
        return list(dict.fromkeys(r.group for r in self.rules))

    def hits(self, text: Column) -> Column:
        """array<struct<group, ordinal, weight, name, level, message>> of the rules that fire on ``text``."""
        return F.filter(
            F.array(*[
                F.when(self._fires(r, text), F.struct(F.lit(r.group).alias("group"), F.lit(i).alias("ordinal"), F.lit(float(r.weight)).alias("weight"), F.lit(r.name or r.pattern).alias("name"), F.lit(r.level).alias("level"), F.lit(r.message).alias("message")))
                for i, r in enumerate(self.rules)
            ]),
            lambda h: h.isNotNull(),
        )

    @staticmethod
    def _fires(rule: Rule, text: Column, spared: Column | None = None) -> Column:
        """``spared`` tells where ``unless`` may fire; everywhere if it is not given."""
        fires = text.rlike(rule.pattern)
        if rule.gate:
            fires = text.rlike(rule.gate) & fires
        if rule.unless:
            fires = fires & ~(text.rlike(rule.unless) if spared is None else spared & text.rlike(rule.unless))
        return fires

    def score(self, text: Column, group: str) -> Column:
        """Sum of the weights of the group's rules that fire, each once."""
        total = F.lit(0.0)
        for r in self.rules:
            if r.group == group:
                total = total + F.when(self._fires(r, text), F.lit(float(r.weight))).otherwise(0.0)
        return total

    def first(self, text: Column, default: str | None = None) -> Column:
        """Group of the first rule that fires (CASE WHEN)."""
        out = None
        for r in self.rules:
            out = F.when(self._fires(r, text), r.group) if out is None else out.when(self._fires(r, text), r.group)
        return out.otherwise(F.lit(default)) if out is not None else F.lit(default)

    def best(self, text: Column) -> Column:
        """struct<group, score> with the highest score; ties to the group that comes first; null if nothing fires."""
        scored = F.array(*[F.struct(self.score(text, g).alias("score"), F.lit(-i).alias("rank"), F.lit(g).alias("group")) for i, g in enumerate(self.groups())])
        top = F.array_max(scored)
        return F.when(top["score"] > 0, F.struct(top["group"].alias("group"), top["score"].alias("score")))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def present(text: Column, words: Iterable[str]) -> Column:
    """Array of the words contained in ``text``, in the given order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))
