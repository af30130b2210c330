"""Detection rules as column expressions, and the engine that weighs them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import text as X
from ..functions.vocabulary import LANGUAGES, TERMS, TYPE_OF, terms_for


@dataclass
class KeywordRule:
    """Share of a term list found as whole words; empty categories mean all of them."""

    name: str
    categories: list[str] = field(default_factory=list)
    custom_terms: dict[str, list[str]] = field(default_factory=dict)
    weight: float = 1.0

    def __post_init__(self):
        self.categories = list(self.categories or TERMS)

    @property
    def types(self) -> list[str]:
        return list(dict.fromkeys(TYPE_OF[c] for c in self.categories if c in TYPE_OF))

    def of_terms(self, terms: list[str]) -> str:
        """SQL of the score of a list, over the lower-cased text t; the number found passes through an array of one, so
        that the matches stand in the plan once."""
        if not terms:
            return "0D"
        found = " + ".join(f"CAST({X.has_term('t', x)} AS INT)" for x in terms)
        return f"transform(array({found}), n -> CASE WHEN n = 0 THEN 0D ELSE least(0.3D + least(n / CAST({len(terms)} AS DOUBLE) * 5D, 1D) * 0.7D, 1D) END)[0]"

    def score(self, text: str = "text", language: str = "language") -> Column:
        """text, language: SQL of the columns.  One SQL text is parsed faster than its many parts are built one by one."""
        own = dict.fromkeys([*(x for x in LANGUAGES if x != "en"), *self.custom_terms])
        when = " ".join(f"WHEN {X.sql_string(x)} THEN {self.of_terms(terms_for(self.categories, x, self.custom_terms))}" for x in own)
        default = self.of_terms(terms_for(self.categories, "", {}))
        return F.expr(f"transform(array(lower({text})), t -> CASE {language} {when} ELSE {default} END)[0]")


@dataclass
class PatternRule:
    """Share of patterns found anywhere, without regard to case."""

    name: str
    patterns: list[str]
    weight: float = 1.0
    types: tuple[str, ...] = ()

    def score(self, text: str = "text", language: str = "language") -> Column:
        text = F.expr(text)
        found = sum((text.rlike("(?iu)" + p).cast("int") for p in self.patterns), F.lit(0))
        return F.when(found == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.4) + found / F.lit(len(self.patterns)) * F.lit(0.6), F.lit(1.0)))


@dataclass
class PandasRule:
    """Any Python function of a text and its language that gives a number from 0 to 1, in Arrow batches."""

    name: str
    func: Callable[[str, str], float]
    weight: float = 1.0
    types: tuple[str, ...] = ()

    def score(self, text: str = "text", language: str = "language") -> Column:
        func = self.func

        def run(t, x):
            import pandas as pd

            return pd.Series([float(func(a, b)) for a, b in zip(t, x)], dtype=float)

        run = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)

        return run(F.expr(text), F.expr(language))


def default_rules() -> list:
    # fixed values: names, weights and the pattern of the default rules
    return [
        KeywordRule("keyword_violence", ["violence"], weight=1.2),
        KeywordRule("keyword_disaster", ["natural_disaster"], weight=1.0),
        KeywordRule("keyword_platform", ["platform_abuse"], weight=1.1),
        KeywordRule("keyword_csam", ["child_safety"], weight=1.5),
        KeywordRule("keyword_self_harm", ["self_harm"], weight=1.3),
        PatternRule("url_flood", [r"https?://\S+"], weight=0.5),
    ]


class RuleEngine:
    def __init__(self, rules: list | None = None, thresholds: Thresholds | None = None):
        self.rules = list(rules or default_rules())
        self.thresholds = thresholds or Thresholds()

    def scores(self, records: DataFrame) -> DataFrame:
        """Non-blank records with some match, and score, severity, matched_rules, suggested_types and dedup_key.

        The rules stand in the generator of an explode of one struct or none, so a filter on their sum can't be pushed
        below them and evaluate each pattern twice."""
        text, language = F.col("text"), "coalesce(language, 'en')"
        one = F.array(F.struct(*[r.score("text", language).alias(f"r{k}") for k, r in enumerate(self.rules)]))
        weights = [F.lit(float(r.weight)) for r in self.rules]
        hit = lambda s: [s[f"r{k}"] > 0 for k in range(len(self.rules))]
        total = lambda s: _sum([F.when(h, w).otherwise(F.lit(0.0)) for h, w in zip(hit(s), weights)])
        found = records.filter(~X.is_blank(text)).select("*", F.explode(F.filter(one, lambda s: total(s) != 0)).alias("_s"))
        s = F.col("_s")
        weighted = _sum([F.when(h, s[f"r{k}"] * w).otherwise(F.lit(0.0)) for k, (h, w) in enumerate(zip(hit(s), weights))])
        present = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
        names = present([F.when(h, F.lit(r.name)) for h, r in zip(hit(s), self.rules)])
        typed = [F.when(h, F.lit(t)) for h, r in zip(hit(s), self.rules) for t in r.types]
        types = F.array_distinct(present(typed)) if typed else F.array().cast("array<string>")
        out = found.withColumns({"score": weighted / total(s), "matched_rules": names, "suggested_types": types, "dedup_key": X.dedup_key(text)})
        return out.withColumn("severity", X.severity(F.col("score"), self.thresholds)).drop("_s")


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out
