"""Toxicity of documents by a weighted grammar of clauses whose weights are learned from labels."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import toxic_grammar as grammar
from marketlens.llm.labelled import LABELLED_ROWS, fold, labelled_sample
from marketlens.llm.tables import durable, filter_rows, map_columns, task_scoped

#: A document is called toxic from this score on.
TOXIC = 0.7
#: Letters of the stems that may become terms; whole words may too.
STEM = range(3, 9)
#: Terms need this share of toxic documents among those that hold them.
PURITY = 0.8
#: Log-odds that one term or kind of clause can give at most.
STRONGEST = 3.0


@dataclass
class ToxicModel:
    """Weights of the grammar: log-odds of terms, shifts of clause kinds, score without a clause."""

    terms: dict[str, float] = field(default_factory=dict)
    shift: dict[str, float] = field(default_factory=lambda: dict.fromkeys(grammar.KINDS, 0.0))
    rest: float = 0.05

    def __post_init__(self):
        self._search = None

    def score(self, text: str | None) -> float:
        """Probability from the strongest clause; ``rest`` if there is none."""
        low = (text or "").lower()
        if self._search is None:
            words = {t: w for t, w in self.terms.items() if t != "<threat>"}
            self._search = grammar.insult_pattern(words | dict.fromkeys((f"{w}$" for w in grammar.THREATS), 0.0))
        if not self._search.search(low):
            return self.rest
        best = max((w + self.shift[kind] for kind, w in grammar.clauses(low, self.terms)), default=None)
        return self.rest if best is None else max(self.rest, 1 / (1 + math.exp(-best)))

    def __getstate__(self):
        return {"terms": self.terms, "shift": self.shift, "rest": self.rest, "_search": None}


def word_terms(text: str) -> set[str]:
    """Stems and whole words of a text, as terms."""
    words = {m[0] for m in grammar.WORD.finditer(text.lower())}
    return {f"{w}$" for w in words} | {w[:k] for w in words for k in STEM if k <= len(w)}


def _gain(toxic: int, all_: int, base: float) -> float:
    """Log-likelihood that a term's documents gain from a rate of their own."""
    rate = toxic / all_
    gain = toxic * math.log(rate / base) if toxic else 0.0
    return gain + ((all_ - toxic) * math.log((1 - rate) / (1 - base)) if all_ > toxic else 0.0)


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = LABELLED_ROWS) -> ToxicModel:
    """Fit the grammar on at most about ``rows`` labelled rows outside the held-out fold.

    Spark counts every stem and word over the sample. Terms are chosen greedily: the one whose
    documents gain most likelihood, then the next over the documents not yet explained, until the
    gain could be chance among so many terms. Every term that passes this test alone is a candidate;
    those of the same documents are one, the whole word or longest stem. So words that merely stand beside an insult, or in
    copies of one toxic document, earn nothing. The fixed insults count as seen in two toxic
    documents beforehand. Then the kinds of clauses get their shifts. With no labels the fixed
    words and priors remain.
    """
    sample = durable(labelled_sample(documents, labels, "toxic", key, text, rows).select("text", "label").distinct())
    totals = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    count, toxic = totals[0], totals[1]
    base = (toxic + 0.5) / (count + 1)

    @task_scoped
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, bad, sets = Counter(), Counter(), Counter()
        for batch in batches:
            for body, label in zip(*(c.to_pylist() for c in batch.columns)):
                found = word_terms(body)
                all_.update(found)
                if label:
                    bad.update(found)
                mark = int.from_bytes(blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                for t in found:
                    sets[t] ^= mark
        names = list(all_)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in (all_, bad, sets))],
                ["term", "n", "bad", "set"],
            )

    counts = durable(
        sample.mapInArrow(counted, "term string, n long, bad long, set long").groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.bit_xor("set").alias("set"))
    )
    chance = math.log(max(1, counts.count())) + 2
    n, hits = F.col("n"), F.col("bad")
    gain = hits * F.log(hits / n / base) + F.when(n > hits, (n - hits) * F.log((1 - hits / n) / (1 - base))).otherwise(0.0)
    strong = counts.where((hits >= PURITY * n) & (hits > 2)).where(gain >= chance - 1e-6)
    whole_first = F.struct(F.endswith("term", F.lit("$")), F.length("term"), F.col("term").alias("term"))
    top = strong.groupBy("set", "n", "bad").agg(F.max(whole_first)["term"].alias("term")).collect()
    stats = {r.term: (r.bad, r.n) for r in top if _gain(r.bad, r.n, base) >= chance}
    chosen = _chosen(sample, stats, base, chance) if stats else {}

    seeds = {f"{w}$" for w in grammar.INSULTS}
    held = {r.term: (r.bad, r.n) for r in counts.where(F.col("term").isin(sorted(seeds))).collect()}
    terms = {t: min(STRONGEST, grammar.logit((b + 0.5) / (n + 1))) for t, (b, n) in chosen.items()}
    for t in seeds - set(terms):
        b, n = held.get(t, (0, 0))
        terms[t] = min(STRONGEST, grammar.logit((b + 2) / (n + 2.5)))
    terms["<threat>"] = grammar.logit(0.8)
    return _with_kinds(sample, ToxicModel(terms), count)


def _chosen(sample: DataFrame, stats: dict[str, tuple[int, int]], base: float, chance: float) -> dict:
    """Terms by greedy cover; the documents come as their candidate terms, at most the sample."""
    held = sample.sparkSession.sparkContext.broadcast(set(stats))
    rows = map_columns(
        sample.select("text", "label"),
        "label int, terms array<string>",
        lambda texts, labels: {"label": labels, "terms": [sorted(word_terms(t) & held.value) for t in texts]},
    ).where(F.size("terms") > 0).collect()
    docs = defaultdict(set)
    for i, r in enumerate(rows):
        for t in r.terms:
            docs[t].add(i)
    bad = {i for i, r in enumerate(rows) if r.label}
    chosen, explained = {}, set()
    # of equal gains the whole word, then the longer stem
    place = {t: i for i, t in enumerate(sorted(docs, key=lambda t: (t.endswith("$"), len(t), t)))}

    def worth(t: str) -> tuple:
        open_ = docs[t] - explained
        return (-round(_gain(len(open_ & bad), len(open_), base) if open_ else 0.0, 6), -place[t], t)

    current = {t: worth(t) for t in docs}
    queue = list(current.values())
    heapify(queue)
    while queue:
        best = heappop(queue)
        ranked = best[2]
        if current.get(ranked) != best:
            continue
        open_ = docs[ranked] - explained
        if not open_ or -best[0] < chance:
            break
        del current[ranked]
        if len(open_ & bad) < PURITY * len(open_):
            continue
        chosen[ranked] = stats[ranked]
        explained |= docs[ranked]
        for t in {t for i in open_ for t in rows[i].terms if t in current}:
            if docs[t] <= explained:
                del current[t]
            else:
                current[t] = worth(t)
                heappush(queue, current[t])
    return chosen


def _with_kinds(sample: DataFrame, model: ToxicModel, count: int) -> ToxicModel:
    """Shifts of the clause kinds, from documents whose clauses are all of one kind."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def kinds(texts, labels):
        found = [{k for k, _ in grammar.clauses(t.lower(), held.value.terms)} for t in texts]
        return {"label": labels, "kind": ["none" if not k else next(iter(k)) if len(k) == 1 else "several" for k in found]}

    seen = {
        r.kind: (r.bad, r.n)
        for r in map_columns(sample.select("text", "label"), "label int, kind string", kinds)
        .groupBy("kind").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).collect()
    }
    rate = {k: (seen.get(k, (0, 0))[0] + grammar.PRIOR[k]) / (seen.get(k, (0, 0))[1] + 1) for k in grammar.KINDS}
    odds = {k: min(STRONGEST, grammar.logit(rate[k])) for k in grammar.KINDS}
    model.shift = {k: min(1.0, odds[k] - odds[grammar.PLAIN]) for k in grammar.KINDS}
    bad, n = seen.get("none", (0, 0))
    model.rest = min(0.5, (bad + 0.5) / (n + 10))
    return model


def score_toxicity(documents: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every row, from the whole text alone.

    The score is the probability of the strongest clause, or the rate of toxic documents without
    one; null and empty texts get that rate. Equal texts get equal scores. Other columns are not
    read; ``held_out`` tells whether the key is in the fold that no fit sees.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()
    scored = map_columns(
        documents.select(key, text),
        f"key {kind}, score double",
        lambda keys, texts: {"key": keys, "score": [held.value.score(t) for t in texts]},
    )
    return scored.select(
        F.col("key").alias(key),
        (fold(F.col("key")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def without_toxic(documents: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Rows whose score stays below ``TOXIC``; all columns pass through."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    return filter_rows(documents, [text], lambda texts: [held.value.score(t) < TOXIC for t in texts])
