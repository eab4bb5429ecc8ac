"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import small_batches
from plumbline.session import cut_lineage

MOST_LABELLED = 20_000  # labelled rows that word lists are mined from, those with the smallest hashes
MOST_TRAINED = 50_000  # rows with posterior labels that the classifier is fitted on, those with the smallest hashes
PREFIXES = (4, 5, 6)
LISTS = 8  # voters over mined words, and as many over mined beginnings

#: Voters that need no labels: common insults and threats, by topic.
GENERAL = {
    "stupidity": "idiot idiots moron morons stupid dumb fool dumbass imbecile idiota estupido estúpido idiote stupide imbécile dumm dummkopf blöd trottel",
    "contempt": "worthless pathetic disgusting loser losers scum trash garbage filth vermin clown basura asqueroso ordure dégoûtant abschaum müll wertlos ekelhaft",
    "abuse": "bitch bastard asshole whore slut puta cabrón mierda salope connard pute merde arschloch hure schlampe scheiße",
    "threat": "kill murder hang shoot matar muere tuer crève töten verrecke",
}
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\w[*#@$]{2,}\w|\b(?:\w[.\-*]){3,}\w\b")
_ADDRESSED = re.compile(r"\b(?:you|your|du|dein|tu|vous|eres)\b[^.!?\n]{0,20}\b(?:idiot|moron|loser|stupid|scum|trash|dumm|idiota|idiote)\b")


def _units(text: str) -> set[str]:
    """Distinct words of a text, and beginnings of words, marked by a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "-" for w in words for k in PREFIXES if len(w) > k}


@dataclass
class Voters:
    """Word lists and patterns; each votes for toxic where it matches, and abstains elsewhere."""

    lists: dict[str, int]
    units: dict[str, int]
    n: int = field(init=False)

    def __post_init__(self):
        self.n = max(self.lists.values(), default=-1) + 1 + 2

    def __call__(self, text: str) -> tuple[set[int], list[int]]:
        """The voters that vote, and the classifier's features: voters first, then units."""
        found = _units(text)
        votes = {self.lists[u] for u in found & self.lists.keys()}
        low = text.lower()
        if _MASKED.search(low):
            votes.add(self.n - 2)
        if _ADDRESSED.search(low):
            votes.add(self.n - 1)
        return votes, sorted(votes) + sorted(self.n + self.units[u] for u in found & self.units.keys())


def mine_units(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, float, int]], float]:
    """Words and beginnings that mark toxic texts, with log odds and evidence, and the share of toxic rows.

    Evidence counts texts: copies of a text are one, toxic if a row of it is.
    """
    sample = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_l_doc")).agg(F.max("toxic").alias("_toxic"))
    sample = cut_lineage(sample.orderBy(F.xxhash64("_l_doc"), "_l_doc").limit(MOST_LABELLED), "labelled")
    share = sample.agg(F.avg("_toxic").alias("p")).first()["p"] or 0.0
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == sample["_l_doc"])
    texts = rows.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(F.first("text").alias("text"), F.max(F.col("_toxic").cast("int")).alias("_toxic"))
    texts = cut_lineage(texts.select("text", "_toxic"), "labelled-texts")
    of_texts = texts.agg(F.avg("_toxic").alias("p")).first()["p"] or 0.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_rows, toxic = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                found = _units(text or "")
                all_rows.update(found)
                if label:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(all_rows), pa.string()), pa.array([toxic[u] for u in all_rows], pa.int64()),
                                              pa.array(list(all_rows.values()), pa.int64())], ["unit", "n_toxic", "n"])

    units = texts.mapInArrow(count, "unit string, n_toxic long, n long").groupBy("unit").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n"))
    odds = F.log((F.col("n_toxic") + 0.5) / (F.col("n") - F.col("n_toxic") + 0.5)) - float(np.log((of_texts + 1e-6) / (1 - of_texts + 1e-6)))
    # nats by which the unit's toxic share beats the share of all texts: chance reaches 9 once in thousands of units
    p, base = F.col("n_toxic") / F.col("n"), min(max(of_texts, 1e-6), 1 - 1e-6)
    clean = F.when(p < 1, (F.col("n") - F.col("n_toxic")) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    proof = F.col("n_toxic") * F.log(p / base) + clean
    best = units.where("n_toxic >= 3").withColumn("odds", odds).withColumn("proof", proof).where("odds > 3 and proof > 9")
    best = best.orderBy(F.desc("proof"), "unit").collect()
    return [(r["unit"], r["odds"], r["proof"]) for r in best], float(share)


def make_voters(mined: list[tuple[str, float, int]]) -> Voters:
    """Strong mined units dealt to lists in turn, words and beginnings apart, after the general lists."""
    lists = {w: k for k, words in enumerate(GENERAL.values()) for w in words.split()}
    strong = [u for u, odds, proof in mined if odds > 4 and proof > 14]
    for begins, base in ((False, len(GENERAL)), (True, len(GENERAL) + LISTS)):
        for k, unit in enumerate(u for u in strong if u.endswith("-") == begins):
            lists.setdefault(unit, base + k % LISTS)
    lists.setdefault("\0", len(GENERAL) + 2 * LISTS - 1)  # keeps the number of lists
    return Voters(lists, {u: k for k, (u, _, _) in enumerate(mined)})


@dataclass
class LabelModel:
    """Class-conditional rates of each voter, and the damping of correlated ones."""

    prior: float
    fires_toxic: np.ndarray
    fires_clean: np.ndarray
    damping: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, rows: int, prior: float) -> LabelModel:
        """From how often each pair of voters fires together.

        With voters independent given the class, their covariance is v a_i a_j, v the variance of the class and a_i
        the gap of voter i's rates; so any two partners give a_i, and the median over partners is taken. What a
        covariance has beyond v a_i a_j is correlation of the two; it damps both votes.
        """
        prior = min(max(prior, 1e-3), 0.5)
        joint, m = counts / max(rows, 1), len(counts)
        mean = np.diag(joint)
        cov = joint - np.outer(mean, mean)
        v = prior * (1 - prior)
        gap = np.zeros(m)
        for i in range(m):
            others = [j for j in range(m) if j != i and counts[i, j] > 0 and cov[i, j] > 0]
            found = [cov[i, j] * cov[i, k] / cov[j, k] / v for a, j in enumerate(others) for k in others[a + 1:] if cov[j, k] > 0 and counts[j, k] > 0]
            # without partners, a voter is taken to be right in seven cases of ten
            gap[i] = np.sqrt(np.median(found)) if len(found) >= 3 else mean[i] * (0.7 / prior - 0.3 / (1 - prior))
        toxic = np.clip(mean + (1 - prior) * gap, 1e-4, 1 - 1e-3)
        clean = np.clip(mean - prior * gap, 0.02 * toxic, 1 - 1e-3)
        spread = np.sqrt(np.outer(np.maximum(mean * (1 - mean), 1e-9), np.maximum(mean * (1 - mean), 1e-9)))
        beyond = (cov - v * np.outer(gap, gap)) / spread
        np.fill_diagonal(beyond, 0)
        return cls(prior, toxic, clean, 1 / (1 + np.where(beyond > 0.1, beyond, 0).sum(axis=1)))

    def posterior(self, votes: list[int]) -> float:
        """Probability of toxic: abstaining says something only where all voters abstain."""
        odds = np.log(self.prior / (1 - self.prior))
        if votes:
            odds += float((self.damping[votes] * np.log(self.fires_toxic[votes] / self.fires_clean[votes])).sum())
        else:
            odds += float((self.damping * np.log((1 - self.fires_toxic) / (1 - self.fires_clean))).sum())
        return float(1 / (1 + np.exp(-odds)))


def fit_linear(features: list[list[int]], target: np.ndarray, width: int, rounds: int = 300, ridge: float = 2e-5) -> np.ndarray:
    """Logistic regression of soft labels on binary features by Adam steps; the last weight is the constant."""
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    ids = np.fromiter((i for f in features for i in f), np.int64, len(row))
    w, m1, m2 = (np.zeros(width + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[ids], len(features)) + w[-1]
        gap = (1 / (1 + np.exp(-z)) - target) / max(len(target), 1)
        grad = np.r_[np.bincount(ids, gap[row], width), gap.sum()] + ridge * np.r_[w[:-1], 0]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        w -= 0.1 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-8)
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; only the text is an input of a score.

    Rows whose doc_id, as text, has a CRC-32 divisible by 5 are held out: their labels and votes are not learned
    from. Word lists come from at most MOST_LABELLED labelled rows; the label model's counts of votes cover all rows
    that are not held out; the classifier is fitted on at most MOST_TRAINED of these, with the posterior of their
    votes as labels. Null and empty texts get the score of a text without features; rows without doc_id are not held
    out. Equal texts have equal scores. Without labels the general lists alone vote.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = labels.select("doc_id", "toxic").where(~held)
    mined, share = mine_units(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    voters = make_voters(mined)
    n = voters.n

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [voters(t or "")[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(features, pa.list_(pa.int32()))], ["doc_id", "held_out", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(rows.mapInArrow(vote, "doc_id long, held_out boolean, features array<int>"), "votes")
    learned = rows.where("not held_out")
    fired = learned.withColumn("votes", F.filter("features", lambda i: i < n))
    pairs = fired.select("votes", F.explode("votes").alias("i")).select("i", F.explode("votes").alias("j")).groupBy("i", "j").count().collect()
    counts = np.zeros((n, n))
    for r in pairs:  # n * n at most
        counts[r["i"], r["j"]] = r["count"]
    model = LabelModel.fit(counts, learned.count(), share or 0.05)
    sample = learned.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_TRAINED).select("features").toPandas()["features"]
    sample = [list(map(int, f)) for f in sample]
    target = np.array([model.posterior([i for i in f if i < n]) for f in sample])
    weights = fit_linear(sample, target, n + len(voters.units)) if sample else np.zeros(n + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([weights[-1] + sum(weights[i] for i in f) for f in batch.column("features").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
