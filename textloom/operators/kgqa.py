"""Question answering over a triple table (s, v, o): one question on the driver, or a table of questions by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import settle
from .lexicon import Lexicon
from .linking import Matcher, link_by_join

NOTHING = "你好"
ENTITY, PREDICATE = "实体", "谓词"
#: Link types of a question -> the columns its first two links bind.
SIGNATURES = {(): (), (ENTITY,): ("s",), (PREDICATE,): ("v",), (ENTITY, PREDICATE): ("s", "v"), (ENTITY, ENTITY): ("s", "o"), (PREDICATE, ENTITY): ("v", "o")}


def build_kg(triples: DataFrame) -> DataFrame:
    return triples.select("s", "v", "o").dropDuplicates()


def pattern(kg: DataFrame, s: str | None = None, v: str | None = None, o: str | None = None, limit: int | None = None) -> DataFrame:
    """The unbound columns of the triples that match the bound ones."""
    bound = {"s": s, "v": v, "o": o}
    out = kg
    for c, x in bound.items():
        if x is not None:
            out = out.where(F.col(c) == x)
    out = out.select(*[c for c, x in bound.items() if x is None] or ["s"])
    return out if limit is None else out.limit(limit)


def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment: swaps of neighbours cost one."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def match_template(question: str, templates: list[str]) -> str:
    """Nearest template, ties by its text."""
    return min((edit_distance(question, t), t) for t in templates)[1]


def question_links(kg: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, found, types): the first two links of each question (qid, text) to the words of a graph of any size."""
    words = kg.select(F.explode(F.array(F.struct(F.col("s").alias("w"), F.lit(ENTITY).alias("t")), F.struct(F.col("o").alias("w"), F.lit(ENTITY).alias("t")), F.struct(F.col("v").alias("w"), F.lit(PREDICATE).alias("t")))).alias("x")).select("x.*")
    # a word that is both counts as a predicate, as in the driver's lexicon
    mentions = words.where("w is not null and w <> ''").groupBy(F.col("w").alias("mention")).agg(F.when(F.max((F.col("t") == PREDICATE).cast("int")) == 1, PREDICATE).otherwise(ENTITY).alias("etype")).withColumn("entity", F.col("mention"))
    links = link_by_join(questions, mentions, "qid")
    two = links.groupBy(F.col("doc_id").alias("qid")).agg(F.slice(F.array_sort(F.collect_list(F.struct("l", "entity", "etype"))), 1, 2).alias("x"))
    return two.select("qid", F.col("x.entity").alias("found"), F.col("x.etype").alias("types"))


def default_answers(kg: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, answer) of every question (qid, text), as ``KGQA.answer`` gives without templates; equi-joins on the bound columns."""
    kg = settle(build_kg(kg), "kg")  # read for its words and for each kind of question
    parsed = settle(question_links(kg, questions), "questions")
    rows = None
    for types, bound in SIGNATURES.items():
        if not bound:
            continue
        own = parsed.where(F.col("types") == F.array(*map(F.lit, types))).select("qid", *[F.get("found", F.lit(i)).alias(f"b{i}") for i in range(len(bound))])
        same = [F.col(c) == F.col(f"b{i}") for i, c in enumerate(bound)]
        free = [c for c in "svo" if c not in bound]
        hit = kg.join(own, same).select("qid", F.concat(*free).alias("a"))
        rows = hit if rows is None else rows.union(hit)
    told = rows.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("a")), "、").alias("answer"))
    return questions.select("qid").join(told, "qid", "left").select("qid", F.coalesce("answer", F.lit(NOTHING)).alias("answer"))


class KGQA:
    """Templates and answer functions on the driver, triples in Spark."""

    def __init__(self, triples: DataFrame, entities: Lexicon | None = None, words_limit: int = 500_000):
        self.kg = build_kg(triples)
        words = self.kg.select(F.explode(F.array(F.struct("s", F.lit(ENTITY).alias("t")), F.struct(F.col("o").alias("s"), F.lit(ENTITY).alias("t")), F.struct(F.col("v").alias("s"), F.lit(PREDICATE).alias("t")))).alias("x")).select("x.*").distinct()
        rows = words.where("s is not null and s <> ''").limit(words_limit + 1).collect()
        if len(rows) > words_limit:
            raise ValueError(f"more than {words_limit} words in the graph")
        self.lexicon = Lexicon().add_typed_words({t: [r.s for r in rows if r.t == t] for t in (ENTITY, PREDICATE)})
        self.entities = entities or Lexicon()
        self.templates: dict[tuple[str, ...], list[str]] = {k: ["default" + "".join("E" if t == ENTITY else "V" for t in k)] for k in SIGNATURES}
        self.answers: dict[str, Callable[[list[str], list[list[str]]], str]] = {}

    def add_template(self, types: tuple[str, ...], template: str, answer: Callable[[list[str], list[list[str]]], str]) -> None:
        self.templates[types].append(template)
        self.answers[template] = answer

    def _links(self, lexicon: Lexicon, question: str) -> list[tuple[int, int, str, str]]:
        m = Matcher(lexicon.candidates())
        return [(l, r, *m.cands[question[l:r]][0]) for l, r in m.scan(question)]

    def parse(self, question: str) -> tuple[list[str], tuple[str, ...]]:
        """Entities and types of the first two links."""
        found = self._links(self.lexicon, question)[:2]
        return [e for _, _, e, _ in found], tuple(t for _, _, _, t in found)

    def masked(self, question: str) -> str:
        out, at = [], 0
        for l, r, _, t in self._links(self.entities, question):
            out += [question[at:l], f"#{t}#"]
            at = r
        return "".join([*out, question[at:]])

    def answer(self, question: str) -> str:
        """Answer text; a question of unknown link types gets the default one."""
        found, types = self.parse(question)
        if not SIGNATURES.get(types):
            return NOTHING
        rows = [list(r) for r in pattern(self.kg, **dict(zip(SIGNATURES[types], found))).orderBy(*[c for c in "svo" if c not in SIGNATURES[types]]).collect()]
        template = match_template(self.masked(question), self.templates[types])
        if template in self.answers:
            return self.answers[template](found, rows)
        return "、".join("".join(r) for r in rows) or NOTHING
