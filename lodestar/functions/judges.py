"""Judges: column functions that score an answer, alone and in ensembles."""

from __future__ import annotations

import abc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.registry import registry
from lodestar.operators.metrics import KEYWORDS, answer_of, keyword_judge, policy_of


class Judge(abc.ABC):
    """A score from 0 to 1 for an answer to a question, from columns (docs: array of strings). A judge that needs a model
    may return a pandas UDF's column."""

    name = "JUDGE"

    @abc.abstractmethod
    def __call__(self, question: Column, docs: Column, answer: Column) -> Column: ...


class KeywordJudge(Judge):
    """Share of keywords in the answer, or in the documents where the answer is empty."""

    name = "KEYWORD"

    def __init__(self, keywords: tuple[str, ...] = KEYWORDS):
        self.keywords = keywords

    def __call__(self, question: Column, docs: Column, answer: Column) -> Column:
        return keyword_judge(F.when(F.length(answer) > 0, answer).otherwise(answer_of(docs)), self.keywords)


def make_judges(names: str | list[str]) -> list[Judge]:
    """'keyword', 'mock' and 'dummy' name the keyword judge; others must be registered in the group 'judge', as a loader
    that takes what follows a colon ('mine:small'), if anything does."""
    out: list[Judge] = []
    for name in filter(None, (n.strip() for n in (names.split(",") if isinstance(names, str) else names))):
        kind, _, option = name.partition(":")
        if kind.lower() in ("keyword", "mock", "dummy"):
            out.append(KeywordJudge())
        elif kind.lower() in registry["judge"]:
            loader = registry["judge"][kind.lower()]
            out.append(loader(option) if option else loader())
        else:
            raise ValueError(f"unknown judge {name!r}")
    return out


def judge_ensemble(rows: DataFrame, judges: list[Judge] | None = None, policy: str = "mean") -> DataFrame:
    """rows (id, query, docs, and maybe answer) -> id, score, details (score by judge name; of one name the last)."""
    judges = judges or [KeywordJudge()]
    given = F.col("answer") if "answer" in rows.columns else F.lit(None).cast("string")
    answer = F.coalesce(given, answer_of(F.col("docs")))
    scores = [j(F.col("query"), F.col("docs"), answer).cast("double") for j in judges]
    by_name = {j.name: s for j, s in zip(judges, scores)}
    details = F.create_map(*[x for n, s in by_name.items() for x in (F.lit(n), s)])
    return rows.select("id", policy_of(F.array(*scores), policy).alias("score"), details.alias("details"))


def rare(rows: DataFrame, judges: list[Judge] | None = None, policy: str = "mean", stemming: bool = True) -> DataFrame:
    """rows (id, query, docs, reference) -> id, score: the longest-common-subsequence measure of the documents' answer
    with the reference, and the judges' score where there is none."""
    from lodestar.operators.metrics import rouge_l

    without = judge_ensemble(rows.where("reference is null"), judges, policy).select(F.col("id").cast("long").alias("id"), "score")
    given = rows.where("reference is not null").select("id", answer_of(F.col("docs")).alias("answer"), "reference")
    return rouge_l(given, stemming).union(without)


def sud(rows: DataFrame, judges: list[Judge] | None = None, policy: str = "mean") -> DataFrame:
    """rows (id, query, gt_docs, new_docs) -> id, score: the judges' score of the new documents less that of the old, and
    both (gt, new)."""
    one = lambda docs, name: judge_ensemble(rows.select("id", "query", F.col(docs).alias("docs")), judges, policy).select("id", F.col("score").alias(name))
    both = one("gt_docs", "gt").join(one("new_docs", "new"), "id")
    return both.select("id", (F.col("new") - F.col("gt")).alias("score"), "gt", "new")
