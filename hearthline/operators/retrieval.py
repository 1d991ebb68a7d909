"""Evidence for questions: chunks of the source that a question is about, scored by the question's own and widened terms, articles that topics pin first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.text import budgeted_pick, query_terms, score_by_terms

# Articles that a question's topic puts first; named twice, they come before others.
PINS = (
    (r"[12]\s*순위|(?<!무)순위\s*(조건|요건)", ("제27조", "제28조")), (r"가점|점수", ("별표 1", "제28조")), (r"통장|예치금", ("별표 2", "제28조")),
    (r"특공|특별공급", ("제35조", "제36조", "제40조", "제41조", "제43조", "제46조", "제55조")), (r"신혼", ("제41조",)), (r"생애|생초", ("제43조",)), (r"다자녀", ("제40조",)), (r"노부모", ("제46조",)),
    (r"신생아", ("제41조의2", "제35조의3")), (r"얼마(?:씩)?\s*(?:넣|납입|내)|납입(?:금|액)|월\s*납입|인정(?:액|금액)|선납|연체|저축\s*총액|나아요|낫나요|유리", ("제9조", "제9조", "제10조", "제27조")),
    (r"재당첨", ("제54조",)), (r"부적격", ("제58조",)), (r"무주택|주택\s*소유|분양권", ("제53조", "제2조")), (r"무순위|사후접수|잔여", ("제19조", "제47조의3")), (r"한\s*번|1회|횟수|평생|두\s*번", ("제55조",)),
)
PIN_BONUS, LATER_PART = 40.0, 10.0


def pins(question: Column, article: Column) -> Column:
    """How often a question's topics name an article."""
    q = F.coalesce(question, F.lit(""))
    times = lambda articles: F.size(F.filter(F.lit(list(articles)), lambda a: a == article))
    hits = [F.when(q.rlike(pattern) & article.isin(*articles), times(articles)).otherwise(0) for pattern, articles in PINS]
    return F.coalesce(reduce(lambda a, b: a + b, hits), F.lit(0))


def scored(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question, pos, h, t, score of every chunk of the source that a question is about, where it is above nothing.

    questions: question (id), source, asked (text); chunks: source, pos, h (heading), t (text), article and part (an article's number and part, null outside laws).
    """
    q = questions.select("question", "source", "asked", query_terms(F.col("asked")).alias("terms"))
    both = q.join(chunks, "source")
    n = pins(F.col("asked"), F.col("article"))
    bonus = F.when(n > 0, PIN_BONUS * n - F.when(F.coalesce("part", F.lit(0)) > 0, LATER_PART).otherwise(0.0)).otherwise(0.0)
    score = score_by_terms(F.col("t"), F.coalesce("h", F.lit("")), F.col("terms")) + bonus
    return both.select("question", "pos", "h", "t", score.cast("double").alias("score")).where("score > 0")


def evidence(questions: DataFrame, chunks: DataFrame, most: int = 5, chars: int = 4500) -> DataFrame:
    """question, pos, t, score: a question's best chunks within the budget, in their source's order."""
    return budgeted_pick(scored(questions, chunks).select("question", "pos", "t", "score"), "question", most, chars)
