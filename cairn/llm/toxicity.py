"""Toxicity by weak supervision.

Voters (lexicons and patterns) each vote toxic, clean or abstain on every document. A generative label
model estimates their accuracies and correlations without any label: a latent class with class-conditional
vote tables, fitted by expectation maximisation; voters that agree beyond what the class explains are joined into
cliques with a joint table, so that they don't count as independent. A linear classifier is then trained on the
posterior labels and scores every document.

Lexicons of public insults can't know every language. Where a table of labels is given, three more lexicons are
mined from all of it: words that occur in toxic documents and hardly in others. They are
voters like the rest; how far to trust them is the label model's to find out.

The texts are read three times (votes, sample, scores), and a fourth time for the lexicons, for which they are shuffled
by id where there are more than `BROADCAST_LABELS` labels. The label model sees only counts of
vote patterns over all documents, of which there are some hundreds in practice. The classifier is fitted on a
bounded sample: the `TRAIN_ROWS` different documents with the smallest hash of their id and text. The lexicons come from counts
of words over all labelled documents: labels and texts are joined by id, each task counts words in portions of
`COUNT_WORDS` distinct ones, and the counts are shuffled by word. A word is mined if at least `SUPPORT` toxic documents
have it, they are `PRECISION` of all that have it, and so many wouldn't be by chance (see `mined`).

Defined results:
* a null or empty text has no words: the voters for clean text vote, and it is scored like others;
* repeated rows are scored each and alike; null doc_ids are carried; an empty table gives an empty table;
* ids are whole numbers or, if of another type, strings; texts are read whole; scores don't depend on the order of rows; extra columns are ignored;
* labels: rows with a null id or label are ignored, an id labelled both ways counts as toxic;
  labels that are all toxic or all clean give no lexicons;
* if no voter votes toxic anywhere, every document has score 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Columns, id_kind, lean, list_array, ready, slices

TRAIN_ROWS, DIMS, THRESHOLD = 20_000, 1 << 16, 0.5
COUNT_WORDS = 200_000
#: A word is mined if so many toxic documents have it, and they are so large a share of all that have it.
SUPPORT, PRECISION = 6, 0.9
GROUPS = 3
#: So many labels (16 bytes each) are broadcast to count words; more of them are joined by shuffle.
BROADCAST_LABELS = 2_000_000

INSULTS = "idiot idiots moron morons imbecile imbeciles cretin cretins dimwit dimwits nitwit halfwit simpleton dunce blockhead dolt buffoon dumbass dumbasses jackass".split()
CONTEMPT = "loser losers scum scumbag scumbags trash clown clowns vermin filth parasite parasites creep creeps freak freaks garbage lowlife".split()
ADJECTIVES = "stupid pathetic worthless disgusting dumb brainless idiotic moronic useless despicable repulsive ugly sickening revolting braindead hideous".split()
PROFANE = "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard bastards asshole assholes piss slut whore cunt".split()
HOSTILE = "hate kill hang stab shoot destroy burn rot choke".split()
FOREIGN = "idiota estúpido estúpida imbécil basura asqueroso mierda puta dumm dummkopf arschloch scheiße abschaum trottel müll idiote connard salaud merde ordure crétin débile raclure".split()
LEXICONS = [frozenset(x) for x in (INSULTS, CONTEMPT, ADJECTIVES, PROFANE, HOSTILE, FOREIGN)]
EVERY = frozenset().union(*LEXICONS[:4], LEXICONS[5])
ADDRESSED = re.compile(r"\b(?:you|your|he|she|they|these|this|that|such an?)\s+(?:(?:are|is|a|an|all|so|really|fucking|damn)\s+){0,3}(?:" + "|".join(sorted(EVERY)) + r")\b")
SHUT = re.compile(r"\b(?:shut up|go to hell|drop dead|get lost|screw you|f[*@#]ck|sh[*@!#]t|stfu|kys)\b")
WORDS = re.compile(r"\w+")
VOTERS = ["insults", "contempt", "adjectives", "profane", "hostile", "foreign", *[f"mined_{g}" for g in range(GROUPS)], "several", "addressed", "phrases", "unmarked", "long_unmarked"]
ABSTAIN, CLEAN, TOXIC = 0, 1, 2


def votes(text: str | None, words: list[str], own: dict[str, int]) -> list[int]:
    """`own`: mined words and their group."""
    found = set(words)
    hits = [len(found & lexicon) for lexicon in LEXICONS]
    marked = found & EVERY
    mined = [0] * GROUPS
    for w in found & own.keys():
        mined[own[w]] += 1
    n = len(marked) + sum(mined)
    low = text.lower() if text else ""
    out = [TOXIC if x else ABSTAIN for x in hits[:4]]
    out.append(TOXIC if hits[4] and marked else ABSTAIN)
    out.append(TOXIC if hits[5] else ABSTAIN)
    out += [TOXIC if x else ABSTAIN for x in mined]
    out.append(TOXIC if n >= 2 else ABSTAIN if n else CLEAN)
    out.append(TOXIC if marked and ADDRESSED.search(low) else ABSTAIN)
    out.append(TOXIC if SHUT.search(low) else ABSTAIN)
    out.append(ABSTAIN if n or hits[4] else CLEAN)
    out.append(CLEAN if not n and len(words) >= 100 else ABSTAIN)
    return out


def pattern(vote: list[int]) -> int:
    return sum(v << (2 * i) for i, v in enumerate(vote))


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> (2 * np.arange(len(VOTERS)))) & 3


class LabelModel:
    """Class-conditional tables of cliques of voters, fitted to counts of vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
        self.votes, self.counts, self.rounds = unpacked(patterns), counts.astype(np.float64), rounds
        self.cliques = [[i] for i in range(len(VOTERS))]
        self.correlations: dict[tuple[int, int], float] = {}
        if not ((self.votes == TOXIC).any(axis=1) @ self.counts):
            self.posterior = np.zeros(len(counts))
            self.accuracies = np.full(len(VOTERS), np.nan)
            return
        self.posterior = self.start()
        self.cliques = self.linked()
        self.fit()
        self.accuracies = self.measured()

    def start(self) -> np.ndarray:
        toxic, clean = (self.votes == TOXIC).sum(axis=1), (self.votes == CLEAN).sum(axis=1)
        return np.clip((toxic + 0.1) / (toxic + clean + 0.5), 0.02, 0.98)

    def fit(self) -> None:
        codes = []
        for clique in self.cliques:
            own = (self.votes[:, clique] * 3 ** np.arange(len(clique))).sum(axis=1)
            codes.append(np.unique(own, return_inverse=True)[1])
        for _ in range(self.rounds):
            p = self.posterior
            prior = float(np.clip((p @ self.counts) / self.counts.sum(), 1e-4, 0.5))
            log = np.full(len(p), np.log(prior / (1 - prior)))
            for code, clique in zip(codes, self.cliques):
                n = code.max() + 1
                t = np.bincount(code, weights=p * self.counts, minlength=n) + 0.5
                c = np.bincount(code, weights=(1 - p) * self.counts, minlength=n) + 0.5
                log += (np.log(t / t.sum()) - np.log(c / c.sum()))[code]
            new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            if np.abs(new - p).max() < 1e-9:
                break
            self.posterior = new
        # The toxic class is the one in which voters say toxic more often.
        score = ((self.votes == TOXIC).sum(axis=1) - (self.votes == CLEAN).sum(axis=1)).astype(float)
        mean = lambda q: (score * q * self.counts).sum() / max((q * self.counts).sum(), 1e-9)
        if mean(self.posterior) < mean(1 - self.posterior):
            self.posterior = 1 - self.posterior

    def linked(self, least: float = 0.3, most: int = 3) -> list[list[int]]:
        """Voters joined where their votes agree beyond what the class explains, strongest first.

        Judged within the classes that the vote shares give: a fit that took the voters for independent
        would have taken the strongest correlation for the class itself. A clique has three voters at most: one that
        holds most voters leaves nothing to tell the class from their agreement.
        """
        m = len(VOTERS)
        signal = (self.votes == TOXIC).astype(float) - (self.votes == CLEAN)
        for i in range(m):
            for j in range(i):
                total = 0.0
                for q in (self.posterior, 1 - self.posterior):
                    w = q * self.counts
                    w = w / max(w.sum(), 1e-9)
                    a, b = signal[:, i] - w @ signal[:, i], signal[:, j] - w @ signal[:, j]
                    scale = np.sqrt((w @ (a * a)) * (w @ (b * b)))
                    total = max(total, (w @ (a * b)) / scale if scale > 1e-9 else 0.0)
                self.correlations[j, i] = float(total)
        clique = {i: [i] for i in range(m)}
        for (j, i), r in sorted(self.correlations.items(), key=lambda x: (-x[1], x[0])):
            if r >= least and clique[i] is not clique[j] and len(clique[i]) + len(clique[j]) <= most:
                both = sorted(clique[i] + clique[j])
                for v in both:
                    clique[v] = both
        return sorted({id(c): c for c in clique.values()}.values())

    def measured(self) -> np.ndarray:
        """The share of each voter's votes that agree with the latent class."""
        out = []
        for i in range(len(VOTERS)):
            t, c = self.votes[:, i] == TOXIC, self.votes[:, i] == CLEAN
            right = (self.posterior * self.counts)[t].sum() + ((1 - self.posterior) * self.counts)[c].sum()
            out.append(right / max(self.counts[t].sum() + self.counts[c].sum(), 1e-9))
        return np.array(out)


def _votes(own: dict[str, int]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                out = [pattern(votes(t, WORDS.findall(t.lower()) if t else [], own)) for t in part.column(0).to_pylist()]
                values, n = np.unique(np.array(out, dtype=np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["pattern", "n"])

    return run


@lean
def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): numbers of labelled documents."""

    def flush() -> pa.RecordBatch:
        words = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array([toxic[x] for x in words], type=pa.int64()), pa.array([clean[x] for x in words], type=pa.int64())], ["word", "toxic", "clean"])

    toxic, clean = Counter(), Counter()
    for batch in batches:
        for part in slices(batch, 0):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                (toxic if label else clean).update(set(WORDS.findall(text.lower())) if text else ())
            if len(toxic) + len(clean) > COUNT_WORDS:
                yield flush()
                toxic, clean = Counter(), Counter()
    yield flush()


def mined(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """Words of toxic documents, from all labelled ones, and a group for each.

    Chance: were n documents with the word toxic at the share q of all labelled ones, t or more would be with a
    probability of at most exp(-n KL(t/n, q)) (Chernoff), which has to be below 1/20 over all words together.
    """
    d, l, kind = Columns(docs), Columns(labels), id_kind(docs, id_col)  # noqa: E741
    marks = l.df.select(l[id_col].cast(kind).alias("l_id"), l["toxic"].cast("int").alias("toxic")).where("l_id is not null and toxic is not null")
    marks = marks.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    n, q = marks.agg(F.count(F.lit(1)), F.avg((F.col("toxic") != 0).cast("double"))).first()
    if not n or not 0 < q < 1:
        return {}
    texts = d.df.select(d[id_col].cast(kind).alias("id"), d[text_col].cast("string").alias("text"))
    x = texts.join(F.broadcast(marks) if n <= BROADCAST_LABELS else marks, F.col("id") == F.col("l_id")).select("text", "toxic")
    x = x.mapInArrow(_labelled, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    # One row, without a word, counts all words that aren't likely.
    likely = (F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * (F.col("t") + F.col("c")))
    found = x.groupBy(F.when(likely, F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("words"), F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    least = np.log(20 * max(1, sum(r.words for r in found)))
    return {r.word: xxhash.xxh3_64_intdigest(r.word) % GROUPS for r in sorted((r for r in found if r.word is not None), key=lambda r: r.word) if r.word not in EVERY and surprise(r.t, r.c, q) >= least}


def surprise(t: int, c: int, q: float) -> float:
    """n KL(t/n, q), 0 where t/n isn't above q."""
    n = t + c
    if t <= q * n:
        return 0.0
    return float(t * np.log(t / n / q) + (c * np.log(c / n / (1 - q)) if c else 0.0))


def features(words: list[str], vote: list[int], known: dict[str, int]) -> np.ndarray:
    """Hashed distinct words, and one feature for each (voter, vote)."""
    out = []
    for w in set(words):
        i = known.get(w)
        if i is None:
            i = known[w] = 3 * len(VOTERS) + xxhash.xxh3_64_intdigest(w) % DIMS
        out.append(i)
    return np.array(sorted(set(out)) + [3 * i + v for i, v in enumerate(vote)], dtype=np.int64)


class Linear:
    """Logistic regression on sparse 0/1 features, scaled by the root of each row's length."""

    def __init__(self, rows: list[np.ndarray], target: np.ndarray, steps: int = 150, l2: float = 2e-4, least: int = 3):
        n = 3 * len(VOTERS) + DIMS
        sizes = np.array([len(r) for r in rows])
        cols = np.concatenate(rows)
        seen = np.bincount(cols, minlength=n)
        # Words of fewer than `least` rows would only let the fit learn rows by heart.
        usable = seen >= least
        at = np.repeat(np.arange(len(rows)), sizes)
        good = usable[cols]
        cols, at = cols[good], at[good]
        scale = self.scale(cols, at, len(rows))
        self.w, self.bias = np.zeros(n), 0.0
        grow, first = np.zeros(n), 1e-8
        for _ in range(steps):  # full-batch Adagrad: no order, no chance
            z = np.bincount(at, weights=self.w[cols] * scale, minlength=len(rows)) + self.bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            g = np.bincount(cols, weights=error[at] * scale, minlength=n) / len(rows) + l2 * self.w
            gb = error.mean()
            grow += g * g
            first += gb * gb
            self.w -= 0.5 * g / np.sqrt(grow + 1e-12)
            self.bias -= 0.5 * gb / np.sqrt(first)

    @staticmethod
    def scale(cols: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """Votes count whole; words by the root of their number in the row."""
        words = cols >= 3 * len(VOTERS)
        n = np.bincount(at[words], minlength=rows)
        return np.where(words, 1 / np.sqrt(np.maximum(n[at], 1)), 1.0)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        cols, at = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        z = np.bincount(at, weights=self.w[cols] * self.scale(cols, at, len(rows)), minlength=len(rows)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, own = model.value
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                if len(known) > 1_000_000:
                    known.clear()
                for t in part.column(1).to_pylist():
                    words = WORDS.findall(t.lower()) if t else []
                    rows.append(features(words, votes(t, words, own), known))
                p = np.round(linear.score(rows) if linear else np.zeros(len(rows)), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "toxic"])

    return run


def label_model(docs: DataFrame, own: dict[str, int], text_col: str = "text") -> LabelModel | None:
    """The label model of all documents, None for an empty table."""
    ready(docs.sparkSession)
    c = Columns(docs)
    seen = c.df.select(c[text_col].cast("string").alias("text")).mapInArrow(_votes(own), "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    # All voters but one have two votes, and that one three: there are 3 * 2^13 = 24,576 patterns at most.
    table = seen.orderBy("pattern").toArrow()
    if not table.num_rows:
        return None
    out = LabelModel(table.column("pattern").to_numpy(), table.column("n").to_numpy())
    out.patterns = table.column("pattern").to_numpy()
    return out


def _sampled(own: dict[str, int]):
    """(h, features, vote pattern) of sampled documents: the driver gets no texts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, 1):
                rows, patterns = [], []
                for t in part.column(1).to_pylist():
                    words = WORDS.findall(t.lower()) if t else []
                    vote = votes(t, words, own)
                    rows.append(features(words, vote, known))
                    patterns.append(pattern(vote))
                sizes = np.array([len(r) for r in rows])
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(np.concatenate(rows).astype(np.int32), sizes, pa.int32()), pa.array(patterns, type=pa.int64())], ["h", "cols", "pattern"])

    return run


def classify(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic): toxic is 1 where the classifier's score reaches the threshold."""
    spark = ready(docs.sparkSession)
    c = Columns(docs)
    kind = id_kind(docs, id_col)
    narrow = c.df.select(c[id_col].cast(kind).alias("doc_id"), c[text_col].cast("string").alias("text"))
    own = {} if labels is None else mined(docs, labels, id_col=id_col, text_col=text_col)
    model = label_model(docs, own, text_col)
    linear = None
    if model is not None and model.posterior.max() > 0:
        # The hashes alone tell where the sample ends.
        hashed = narrow.select(F.xxhash64("doc_id", "text").alias("h"), "text")
        end = hashed.select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
        # Rows of equal hash repeat a document: one of them is enough, whichever it is.
        sample = hashed.where(F.col("h") <= end).dropDuplicates(["h"]).mapInArrow(_sampled(own), "h bigint, cols array<int>, pattern bigint").toArrow()
        by = dict(zip(model.patterns.tolist(), model.posterior.tolist()))
        order = np.argsort(sample.column("h").to_numpy(), kind="stable")
        cols = sample.column("cols").combine_chunks()
        offsets, flat = cols.offsets.to_numpy(), cols.values.to_numpy()
        rows = [flat[offsets[i] : offsets[i + 1]] for i in order]
        target = np.array([by[p] for p in sample.column("pattern").to_pylist()])[order]
        linear = Linear(rows, target)
    scorer = spark.sparkContext.broadcast((linear, own))
    return narrow.mapInArrow(_score(scorer), f"doc_id {kind}, score double, toxic int").withColumnRenamed("doc_id", id_col)
