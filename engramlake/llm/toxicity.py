"""Abusive, hateful or sexual content: severity grades of pieces of text by ordinal regression.

A document's grade comes from its raters: 0 clean, 1 disputed, 2 toxic. The cumulative-link model
P(grade > k) = sigmoid(w.x - theta_k) shares the weights of its sparse features across the two
thresholds; the expected severity is the sum of the two. Labels belong to whole documents while
a single line may carry the abuse, so the model is fitted on pieces: one piece stands for a document
labelled toxic, the one whose features occur most in other documents labelled toxic rather than in
clean ones, and the pieces of clean documents are clean. Nothing about a word is weighted by hand; the
lists below only give words of one kind a common feature, whose weight is learned like any other.
The ridge and the severity from which a document is to be reviewed are chosen on held-out folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.sampling import bounded_sample
from engramlake.llm.folding import line_pieces, pieces

#: Words of abuse in the folded spelling, by what they do; fixed values.
LEXICON = {
    "insult": (
        "idiot moron imbecile stupid dumb worthles useles trash scum parasite loser bastard asshole shit pathetic coward cunt bitch whore slut "
        "clown scumbag pig halfwit dumbas cockroach disgusting miserable ugly filthy "
        "schwein versager widerlicher trotel volidiot dumkopf arschloch hirnloser erbarmlicher nutzloser dreckiges wichser schlampe hurensohn maul abschaum "
        "abruti porc minable conard conase cretin debile salope imbecile ordure gueule "
        "payaso cerdo asqueroso imbecil gilipolas inutil idiota estupido puta mierda asco basura"
    ),
    "harm": (
        "bled kil die murder hang dragged burn rape cages gas shot stab whip beat crevais crever tuer pendre sterben verecken umbringen erhangen "
        "matar mueras muerto colgar"
    ),
    "hate": "vermin animals filth subhuman ungeziefer stinken untermenschen vermine chaser racaille ratas bichos alimanas",
    "sexual": (
        "naked nude breasts sex fuck porn dick cock pusy moaning skirt undres horny nackt bruste fickt nacktbilder stohnte sein nue coucher baiser "
        "seins desnuda follar tetas acostarme gemia"
    ),
    "han": "垃圾 滚出 去死 闭嘴 蠢货 白痴 废物 傻 杀 裸 脱光 做爱 婊 人渣 畜生 蠢猪 上床",
}
_KIND = {w: kind for kind, words in LEXICON.items() if kind != "han" for w in words.split()}
_HAN = LEXICON["han"].split()
#: Folded words that speak to or of somebody, fixed values.
_ADDRESS = frozenset("you your yours u du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous tus eres ti usted 你 您 他 她".split())


@dataclass(frozen=True)
class ToxicityConfig:
    #: Labelled documents that the model is fitted on, at most; those with the smallest hash of their id.
    max_labelled: int = 20_000
    #: Folds of labelled documents, on each of which a model fitted on the others chooses the ridge and the review limit.
    folds: int = 10
    ridges: tuple[float, ...] = (0.1, 1.0, 5.0)
    steps: int = 60
    #: Mean share of documents labelled toxic among those with a feature of a piece, from which the piece may stand for its document.
    least_share: float = 0.2
    #: What a document that raters agree on may be known by though no other is like it: the share of its word pairs that no clean
    #: document has, and of its words that stand in more than two documents.
    unlike_clean: float = 0.6
    known_words: float = 0.6
    #: The review limit is the lowest one whose expected F measure on held-out documents is this share of the best.
    of_best: float = 0.98
    #: An expected grade below this is never a reason to review; with few labels the held-out documents alone would not tell.
    least_limit: float = 0.05


def features(words: list[str]) -> set[str]:
    """Sparse features of a piece: words, pairs, pairs with one word between, and the kinds of words of the lists."""
    found = set(words)
    found.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    found.update(f"{a} _ {b}" for a, b in zip(words, words[2:]))
    found.update(_kinds(words))
    return found


def _kinds(words: list[str]) -> set[str]:
    kinds = {_KIND[w] for w in words if w in _KIND}
    if any(len(w) == 1 for w in words):
        joined = "".join(words)
        if any(h in joined for h in _HAN):
            kinds.add("insult")
    if any("*" in w for w in words):
        kinds.add("masked")
    if kinds and not _ADDRESS.isdisjoint(words):
        kinds |= {f"{k}+you" for k in kinds}
    out = {f"#{k}" for k in kinds}
    for i, w in enumerate(words):
        if w in _KIND:
            # what stands before and after a word of the lists, and whether that is one of them, too
            for j in (i - 1, i + 1):
                if 0 <= j < len(words):
                    other = f"#{_KIND[words[j]]}" if words[j] in _KIND else words[j]
                    out.add(f"#{other} #{_KIND[w]}" if j < i else f"##{_KIND[w]} {other}")
    return out


def rated_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade, share, n_votes): 2 where most raters say toxic, 1 where a minority or half does, 0 else; the share that
    says so. A null vote is no vote; a rater's repeated votes on a document count once, as their mean."""
    votes = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id", F.lower(F.btrim("rater")).alias("rater")).agg(F.avg("toxic").alias("vote"))
    share = F.avg("vote")
    return votes.groupBy("doc_id").agg(
        F.when(share > 0.5, 2).when(share > 0, 1).otherwise(0).alias("grade"), share.alias("share"), F.count("*").cast("int").alias("n_votes")
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _piece_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [" ".join(p) for p in pieces(t)] if t else [])


def rater_error(shares: np.ndarray, votes: np.ndarray) -> tuple[float, float]:
    """(how often a vote is wrong, how many documents are toxic), from how often raters of one document disagree."""
    many = votes > 1
    k = shares[many] * votes[many]
    apart = np.mean(2 * k * (votes[many] - k) / (votes[many] * (votes[many] - 1))) if many.any() else 0.0
    error = float(np.clip((1 - np.sqrt(max(0.0, 1 - 2 * apart))) / 2, 0.01, 0.3))
    toxic = (shares.mean() - error) / (1 - 2 * error) if len(shares) else 0.0
    return error, float(np.clip(toxic, 0.005, 0.5))


def probably_toxic(shares: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Probability of each document to be toxic, given its votes only."""
    error, base = rater_error(shares, votes)
    yes, no = shares * votes, (1 - shares) * votes
    a, b = base * (1 - error) ** yes * error**no, (1 - base) * error**yes * (1 - error) ** no
    return a / (a + b)


class Labelled:
    """The pieces of the labelled sample as a sparse matrix, and the fits on parts of it."""

    def __init__(self, shares: list[float], votes: list[int], documents: list[list[str]], config: ToxicityConfig):
        self.config = config
        self.shares, self.votes = np.array(shares, float), np.array(votes, float)
        self.grade = np.where(self.shares > 0.5, 2, np.where(self.shares > 0, 1, 0))
        index: dict[str, int] = {}
        self.docs = [np.array(sorted({index.setdefault(p, len(index)) for p in ps}), int) for ps in documents]
        self.n = len(index)
        found = [features(p.split(" ")) for p in index]
        self.size = np.array([max(1, len(f)) for f in found], float)
        suspect = set(np.concatenate([d for d, g in zip(self.docs, self.grade) if g > 0] or [np.zeros(0, int)]).tolist())
        # a feature that no suspect document has cannot speak for toxicity
        self.vocabulary = {f: i for i, f in enumerate(sorted(set().union(*(found[p] for p in suspect))))}
        own = [np.array([self.vocabulary[f] for f in fs if f in self.vocabulary], np.int32) for fs in found]
        self.rows = np.repeat(np.arange(self.n), [len(o) for o in own])
        self.cols = np.concatenate(own) if own else np.zeros(0, np.int32)
        self.own = own
        self.doc_of = np.repeat(np.arange(len(self.docs)), [len(d) for d in self.docs])
        self.piece_of = np.concatenate(self.docs) if self.docs else np.zeros(0, int)
        self.in_doc = [np.unique(np.concatenate([own[p] for p in d])) if len(d) else np.zeros(0, int) for d in self.docs]
        pair = np.zeros(len(self.vocabulary), bool)
        pair[[i for f, i in self.vocabulary.items() if " " in f]] = True
        self.pair = pair
        #: Documents with each feature.
        self.spread = np.bincount(np.concatenate(self.in_doc), minlength=len(self.vocabulary)) if self.in_doc else np.zeros(0, int)

    def total(self, w: np.ndarray) -> np.ndarray:
        """Sum of the features' weights of every piece."""
        return np.bincount(self.rows, w[self.cols], self.n)

    def worst(self, score: np.ndarray) -> np.ndarray:
        """Greatest score of a document's pieces."""
        out = np.full(len(self.docs), -np.inf)
        np.maximum.at(out, self.doc_of, score[self.piece_of])
        return out

    def examples(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(grade, weight) of every piece, weight 0 for those that teach nothing."""
        c, grade = self.config, np.where(train, self.grade, -1)
        toxic, clean = np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary))
        for i in np.flatnonzero(grade == 2):
            toxic[self.in_doc[i]] += 1
        for i in np.flatnonzero(grade == 0):
            clean[self.in_doc[i]] += 1
        base = (grade == 2).sum() / max(1, (grade == 2).sum() + (grade == 0).sum())
        others = self.total((np.maximum(toxic - 1, 0) + base) / (np.maximum(toxic - 1, 0) + clean + 1)) / self.size
        every = self.total((toxic + base) / (toxic + clean + 1)) / self.size
        times = np.bincount(self.piece_of[grade[self.doc_of] == 0], minlength=self.n)
        y, weight = np.zeros(self.n), np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0.0)
        weight[every >= c.least_share] = 0.0  # what a rater has missed
        for i in np.flatnonzero(grade > 0):
            mine = self.docs[i][self.size[self.docs[i]] > 2]
            if not len(mine):
                continue
            score = others if grade[i] == 2 else every
            best = mine[np.argmax(score[mine])]
            if score[best] < c.least_share:
                if grade[i] < 2 or self.votes[i] < 2 or self.shares[i] < 1:
                    continue
                best = self._only_here(mine, clean, every)
                if best is None:
                    continue
            if grade[i] >= y[best]:
                y[best], weight[best] = grade[i], (3.0 if grade[i] == 2 else 1.0) * self.votes[i]
        return y, weight

    def _only_here(self, mine: np.ndarray, clean: np.ndarray, every: np.ndarray) -> int | None:
        """The piece that is least like clean documents though made of known words, if any is so."""
        best = None
        for p in mine:
            pairs, words = self.own[p][self.pair[self.own[p]]], self.own[p][~self.pair[self.own[p]]]
            if len(pairs) < 6 or np.mean(clean[pairs] == 0) < self.config.unlike_clean or np.mean(self.spread[words] > 2) < self.config.known_words:
                continue
            if best is None or every[p] > every[best]:
                best = p
        return best

    def fit(self, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
        """(weights by feature, thresholds) of the cumulative-link model on the examples, by Adam on the
        negative log-likelihood of both thresholds with a ridge. Features that no example above grade 0 has get no weight."""
        used = np.zeros(len(self.vocabulary), bool)
        for p in np.flatnonzero(y > 0):
            used[self.own[p]] = True
        w, theta = np.zeros(len(self.vocabulary)), np.array([3.0, 3.5])
        if not used.any():
            return w, theta
        at = used[self.cols] & (weight[self.rows] > 0)
        kept = np.flatnonzero(weight > 0)
        row_of = np.zeros(self.n, int)
        row_of[kept] = np.arange(len(kept))
        rows, cols = row_of[self.rows[at]], (np.cumsum(used) - 1)[self.cols[at]]
        y, weight, n, d = y[kept], weight[kept], len(kept), int(used.sum())
        x, m, v = np.zeros(d), np.zeros(d + 2), np.zeros(d + 2)
        for step in range(1, self.config.steps + 1):
            s = np.bincount(rows, x[cols], n)
            pull, slope = np.zeros(n), np.zeros(2)
            for k, t in enumerate(theta):
                off = (_sigmoid(s - t) - (y > k)) * weight
                pull += off
                slope[k] = -off.sum()
            g = np.concatenate([np.bincount(cols, pull[rows], d) + ridge * x, slope]) / weight.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            x -= move[:d]
            theta = np.sort(theta - move[d:])
        w[used] = x
        return w, theta

    def held_out(self) -> dict[float, np.ndarray]:
        """By ridge, the severity of every document by a model fitted without its fold."""
        fold, out = np.arange(len(self.docs)) % self.config.folds, {r: np.zeros(len(self.docs)) for r in self.config.ridges}
        for k in range(self.config.folds):
            if (fold == k).any():
                examples = self.examples(fold != k)
                for ridge, found in out.items():
                    w, theta = self.fit(*examples, ridge)
                    found[fold == k] = severity(self.worst(self.total(w))[fold == k], theta)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def severity(score: np.ndarray | float, theta) -> np.ndarray:
    """Expected grade at a score."""
    return sum(_sigmoid(score - t) for t in theta)


def review_limit(severities: np.ndarray, toxic: np.ndarray, of_best: float) -> tuple[float, float]:
    """(limit, F) from held-out severities and probabilities of being toxic: the lowest limit whose expected F measure
    is at least `of_best` of the greatest. Without anything to choose by, the middle of the scale."""
    if not len(severities):
        return 1.0, 0.0
    order = np.argsort(-severities, kind="stable")
    s = severities[order]
    found = np.cumsum(toxic[order])
    last = np.append(s[1:] < s[:-1], True)  # all documents of one severity are listed together
    f = (2 * found / (np.arange(1, len(s) + 1) + toxic.sum()))[last]
    s = s[last]
    if s[0] <= 0:
        return 1.0, 0.0
    at = np.flatnonzero(f >= of_best * f.max())[-1]
    below = s[at + 1] if at + 1 < len(s) else 0.0
    return float((s[at] + below) / 2), float(f.max())


def fit(documents: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> dict:
    """The model {weights, theta, review_from, ridge, held_out} from at most max_labelled labelled documents, cut into
    pieces by Spark; held_out is (severity, probability by the votes) of the sample's documents, each by a model fitted
    without it. Labels of documents that are not there, without a vote or of null texts count for nothing."""
    rated = bounded_sample(rated_grades(labels), ["doc_id"], config.max_labelled)
    chosen = documents.select("doc_id", "text").join(F.broadcast(rated), "doc_id").where("text is not null")  # of bounded size
    found = chosen.dropDuplicates(["doc_id"]).select("doc_id", "share", "n_votes", _piece_texts("text").alias("pieces")).orderBy("doc_id").collect()
    sample = Labelled([r.share for r in found], [r.n_votes for r in found], [r.pieces for r in found], config)
    toxic = probably_toxic(sample.shares, sample.votes) if found else np.zeros(0)
    best = None
    for ridge, held in sample.held_out().items():
        limit, f = review_limit(held, toxic, config.of_best)
        limit = max(limit, config.least_limit)
        if best is None or f > best[0]:
            best = f, ridge, limit, held
    _, ridge, limit, held = best
    w, theta = sample.fit(*sample.examples(np.ones(len(sample.docs), bool)), ridge)
    limit = max(limit, 2 * float(severity(0.0, theta)))  # what shows no learned feature is never listed
    weights = {f: float(w[i]) for f, i in sample.vocabulary.items() if abs(w[i]) > 1e-3}
    return {"weights": weights, "theta": theta.tolist(), "review_from": limit, "ridge": ridge, "held_out": list(zip(held.tolist(), toxic.tolist()))}


class Scorer:
    """Scores lines by the weights; remembers those it has met, as many lines of chats are the same."""

    def __init__(self, weights: dict[str, float], remember: int = 50_000):
        self.remember, self.known = remember, {}
        self.word, self.next, self.after = {}, {}, {}
        self.kinds = {f: w for f, w in weights.items() if f[0] == "#"}
        for f, w in weights.items():
            if f[0] == "#":
                continue
            a, *more = f.split(" ")
            if not more:
                self.word[a] = w
            elif len(more) == 1:
                self.next.setdefault(a, {})[more[0]] = w
            else:
                self.after.setdefault(a, {})[more[1]] = w

    def piece(self, words: list[str]) -> float:
        """Sum of the weights of the distinct features, equal to that over `features`."""
        s = sum(self.kinds.get(k, 0.0) for k in _kinds(words)) if self.kinds else 0.0
        s += sum(self.word[w] for w in set(words) if w in self.word)
        for table, gap in ((self.next, 1), (self.after, 2)):
            pairs = {(a, b) for a, b in zip(words, words[gap:]) if a in table}
            for a, b in pairs:
                s += table[a].get(b, 0.0)
        return s

    def line(self, line: str) -> tuple[float, str | None]:
        found = self.known.get(line)
        if found is None:
            found = (-np.inf, None)
            for p in line_pieces(line):
                s = self.piece(p)
                if s > found[0]:
                    found = (s, " ".join(p))
            if len(self.known) >= self.remember:
                self.known.clear()
            if len(line) < 400:
                self.known[line] = found
        return found

    def text(self, text: str | None) -> tuple[float, str | None]:
        """(score, piece) of the worst piece; (-inf, None) without words."""
        return max(map(self.line, text.splitlines()), key=lambda x: x[0], default=(-np.inf, None)) if text else (-np.inf, None)


def worst_piece(text: str | None, weights: dict, theta: list[float]) -> tuple[float, str | None]:
    """(expected severity, piece) of the worst piece; (0, None) for a text without words."""
    score, which = Scorer(weights).text(text)
    return (0.0, None) if which is None else (float(severity(score, theta)), which)


def score_documents(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, source, severity, worst): expected severity 0 to 2 of every document and its worst piece, folded.

    Whole texts are scored. Null, empty and blank texts have severity 0 and a null worst piece; copies
    get equal scores; other columns are not needed. No shuffle.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model["weights"], model["theta"]))  # bounded by the labelled sample
    kind = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("worst", T.StringType())])

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, theta = sent.value
        scorer = Scorer(weights)
        for texts in batches:
            found = [scorer.text(t) for t in texts]
            severities = np.where([w is None for _, w in found], 0.0, severity(np.array([s for s, _ in found]), theta)) if found else []
            yield pd.DataFrame({"severity": severities, "worst": pd.Series([w for _, w in found], dtype=object)})

    return documents.select("doc_id", "source", scored("text").alias("s")).select("doc_id", "source", "s.severity", "s.worst")


def to_review(scored: DataFrame, model: dict) -> DataFrame:
    """The scored documents whose severity reaches the model's review limit."""
    return scored.where(F.col("severity") >= model["review_from"])


def rates(scored: DataFrame, model: dict) -> DataFrame:
    """(source, n_docs, n_review, review_rate, mean_severity) by source as given in the rows."""
    hit = (F.col("severity") >= model["review_from"]).cast("int")
    return scored.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(hit).alias("n_review"), F.avg(hit).alias("review_rate"), F.avg("severity").alias("mean_severity")
    )
