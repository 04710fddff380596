"""Operator 9: toxicity by weak supervision.

1. Lexicons. Besides a fixed list of abusive words (without those that mostly
   stand in clean texts of the sample), words and beginnings of words are mined
   that mark toxic texts in a bounded sample of labelled rows (one row of each
   of `SAMPLE` ids, those with the smallest hashes; where an id has several
   texts, the one with the smallest hash).
2. Voters. Each document gets votes (toxic, clean, abstain) of groups of lexicon
   entries and of patterns (several hits, their density, two side by side,
   shouting, exclamations).
3. Label model. How often each pattern of votes occurs in all documents is
   counted (3**voters patterns at most). A generative model of the votes given
   the hidden class, whose voters depend on each other along a tree, is fitted
   by expectation maximisation, with the sample's labels as anchors: it
   estimates each voter's accuracy and their correlations. A label weighs
   documents / (4 * labels), so all labels together weigh a quarter of all
   documents, however large the table is.
4. A linear classifier learns the model's posteriors from counts of lexicon
   entries: those of the labelled sample, where the label counts as one more
   voter of accuracy `TRUST`, and those of `UNLABELLED` other texts at most (the
   distinct ones with the smallest hashes). It scores every document, so texts
   are read twice: for the counts of votes, and for the scores.

Scores depend on the text alone. Labels are used only of rows for whose id
`crc32(id as text) mod 5` is not 0; null labels and ids are left out, of several
labels of an id the largest counts. Without labels the fixed list alone votes.
Null and empty texts score like texts without any hit. Repeated rows are each
scored. Labels may be of any type that can be cast to int. Further columns are
ignored by toxicity() and kept by without_toxic().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.bytewords import ALNUM, Words, mixed, slices, text_bytes, words_of
from ledgerlark.llm.scratch import written

#: Labelled rows that the lexicon and the classifier learn from at most; mined entries at most; the least toxic texts that an entry is in.
SAMPLE, MINED, SUPPORT = 20_000, 192, 5
#: Texts without labels that the classifier learns from at most, and how often a label is taken to be right.
UNLABELLED, TRUST = 20_000, 0.98
#: How much an entry must tell (a log-likelihood ratio), and what of the texts with it must be toxic at least.
TELLS, PURE = 20.0, 0.7
#: Bytes of the beginnings of words that are mined.
STEMS = (4, 5, 6)
#: Abusive words in four languages, in groups (general knowledge of the languages).
ABUSE = [
    "idiot idiots moron morons imbecile dumb stupid fool fools clown clowns dummkopf trottel depp idiota idiotas imbecil tonto estupido imbécile idiote abruti crétin débile",
    "loser losers scum vermin pig pigs bastard bastards bitch abschaum schwein arschloch bastardo basura cerdo escoria ordure salaud connard pute",
    "worthless pathetic disgusting trash garbage filth filthy useless vile repulsive wertlos widerlich erbärmlich müll patético asqueroso inútil pathétique dégoûtant minable inutile",
    "hate kill die shut hass töten muere odio cállate crève haine tais",
]
MINED_GROUPS = 4
VOTERS = len(ABUSE) - 1 + MINED_GROUPS + 5


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a row's label may not be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _terms(words: Words) -> list[np.ndarray]:
    """For each word a number of the word, and of each of its beginnings (0 where it is no longer than that)."""
    lengths = words.ends - words.starts
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    value, out = np.zeros(len(lengths), np.uint64), [words.hashes()]
    for i in range(max(STEMS)):
        value |= padded[words.starts + i].astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in STEMS:
            stem = mixed(value * np.uint64(0x9FB21C651E98DF25) + np.uint64(i + 1))
            stem[lengths <= i + 1] = 0
            out.append(stem)
    return out


def _fixed_terms() -> dict[int, int]:
    """Numbers of the fixed words, with their groups."""
    out = {}
    for g, line in enumerate(ABUSE):
        raw = line.encode()
        words = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
        out |= dict.fromkeys(words.hashes().tolist(), g)
    return out


@dataclass
class Lexicon:
    """Entries by number, sorted; group[i] is that of entry i. Groups 0 to 3 are the fixed ones, then the mined ones."""

    terms: np.ndarray
    group: np.ndarray


def lexicon(mined: list[int], ordinary: set[int] = frozenset()) -> Lexicon:
    groups = {t: len(ABUSE) + i % MINED_GROUPS for i, t in enumerate(mined)} | {t: g for t, g in _fixed_terms().items() if t not in ordinary}
    terms = np.array(sorted(groups), dtype=np.uint64)
    return Lexicon(terms, np.array([groups[t] for t in terms.tolist()]))


def bounded(labels: DataFrame, doc_id: str, bound: int) -> DataFrame:
    """At most `bound` of the rows, those whose ids have the smallest hashes; what is far from them is left out before rows meet in one task."""
    n = labels.count()
    if n > bound:
        labels = labels.filter(F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.1 * bound / n)))
    return labels.orderBy(F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)), doc_id).limit(bound)


def one_text() -> F.Column:
    """Of an id's texts the one with the smallest hash, as an aggregate."""
    return F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")


def sample_of(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """At most `bound` labelled rows that may be learnt from, one an id: doc_id, text, toxic."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    picked = bounded(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "doc_id", bound)
    rows = docs.join(F.broadcast(picked.withColumnRenamed("doc_id", "of")), F.col("doc_id") == F.col("of"))
    return rows.groupBy("doc_id").agg(one_text(), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")


def others_of(docs: DataFrame, bound: int = UNLABELLED) -> DataFrame:
    """At most `bound` distinct texts, those with the smallest hashes: text."""
    hashed = docs.select(F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"), "text").filter("text is not null")
    n = docs.count()
    if n > bound:
        # hashes alone tell where to cut, so no task gathers texts that are not in the sample
        likely = hashed.filter(F.col("h") < int((1 << 40) * min(1.0, 2.0 * bound / n))).select("h").distinct().orderBy("h").limit(bound)
        last = likely.agg(F.max("h").alias("h")).first().h
        hashed = hashed.filter(F.col("h") <= (last if last is not None else -1))
    return hashed.groupBy("h").agg(F.min("text").alias("text")).select("text")


def _term_counts(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(*text_bytes(part.column("text")), ALNUM)
            terms, first = _terms(words), words.first
            toxic = part.column("toxic").to_numpy(zero_copy_only=False) > 0
            seen = [np.unique(np.concatenate([t[a:b] for t in terms])) for a, b in zip(first[:-1], first[1:], strict=True)]
            every, place = np.unique(np.concatenate(seen), return_inverse=True)
            mark = np.repeat(toxic, [len(x) for x in seen])
            counts = [np.bincount(place[mark == k], minlength=len(every)) for k in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), *map(pa.array, counts)], ["term", "toxic", "clean"])


def mined_terms(sample: DataFrame) -> tuple[list[int], set[int]]:
    """Numbers of the words and beginnings that tell most of toxic texts, the most telling first, and of fixed words that mostly stand in clean ones."""
    counts = sample.mapInArrow(_term_counts, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n = sample.agg(F.coalesce(F.sum(F.expr("int(toxic > 0)")), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not 0 < n.t < n.n:
        return [], set()
    share = n.t / n.n
    both = F.col("a") + F.col("b")
    tells = 2 * (F.col("a") * F.log(F.col("a") / (both * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (both * (1 - share)))).otherwise(0))
    found = counts.filter((F.col("term") != 0) & (F.col("a") >= SUPPORT) & (F.col("a") >= PURE * both)).withColumn("tells", F.round(tells, 6)).filter(F.col("tells") >= TELLS)
    fixed = [t - 2**64 if t >= 2**63 else t for t in _fixed_terms()]
    ordinary = counts.filter(F.col("term").isin(fixed) & (both >= SUPPORT) & (F.col("a") < PURE * both)).select("term").collect()
    return [r.term % 2**64 for r in found.orderBy(F.desc("tells"), "term").limit(MINED).collect()], {r.term % 2**64 for r in ordinary}


class _Hits:
    """What the texts of a slice hold of the lexicon: for each text and entry a count, votes (a letter each), words, and hits in all."""

    def __init__(self, known: Lexicon, texts: pa.Array):
        data, offsets = text_bytes(texts)
        words, n = words_of(data, offsets, ALNUM), len(texts)
        first, found = words.first, []
        for terms in _terms(words):
            at = np.minimum(np.searchsorted(known.terms, terms), len(known.terms) - 1)
            hit = np.flatnonzero(known.terms[at] == terms)
            found.append(np.stack([hit, at[hit]]))
        place, entry = np.concatenate(found, axis=1)
        doc = np.searchsorted(first, place, side="right") - 1
        self.n_words = np.diff(first)
        pairs, self.count = np.unique(doc * len(known.terms) + entry, return_counts=True)
        self.doc, self.entry = np.divmod(pairs, len(known.terms))
        self.total = np.bincount(doc, minlength=n)

        groups = np.zeros((n, len(ABUSE) + MINED_GROUPS), dtype=bool)
        groups[doc, known.group[entry]] = True
        hit_words = np.unique(place)
        of = np.searchsorted(first, hit_words, side="right") - 1
        several = np.bincount(of, minlength=n)
        beside = np.zeros(n, dtype=bool)
        beside[of[1:][(of[1:] == of[:-1]) & (np.diff(hit_words) <= 8)]] = True
        shout = 2 * _per_text((data >= 65) & (data <= 90), offsets) > np.diff(offsets)
        calls = _per_text((data[:-1] == 33) & ((data[1:] == 33) | (data[1:] == 49)), np.minimum(offsets, max(len(data) - 1, 0))) > 3
        never = np.zeros(n, dtype=bool)
        voters = [(groups[:, g], ~groups[:, g]) for g in [*range(len(ABUSE) - 1), *range(len(ABUSE), len(ABUSE) + MINED_GROUPS)]]
        voters += [(several >= 2, several == 0), ((100 * several >= self.n_words) & (several > 0), several == 0), (beside, several == 0), (shout, never), (calls | groups[:, len(ABUSE) - 1], never)]
        letters = np.stack([np.where(yes, ord("+"), np.where(no, ord("-"), ord("0"))) for yes, no in voters], axis=1).astype(np.uint8).tobytes().decode()
        self.votes = [letters[i * VOTERS : (i + 1) * VOTERS] for i in range(n)]

    def summary(self) -> np.ndarray:
        """Features of all hits together, a row for each text."""
        dense = np.minimum(10.0, 100.0 * self.total / np.maximum(self.n_words, 1)) / 10
        return np.column_stack([np.log1p(self.total), self.total >= 2, self.total == 0, dense])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The classifier's probability for each text."""
        z = np.bincount(self.doc, weights[self.entry] * np.log1p(self.count), minlength=len(self.total)) + self.summary() @ weights[-5:-1] + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _votes(known: Lexicon):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_Hits(known, part.column("text")).votes, pa.string())], ["votes"])

    return run


def _examples(known: Lexicon):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hits = _Hits(known, part.column("text"))
                bounds = pa.array(np.searchsorted(hits.doc, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (hits.entry, hits.count)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *lists, pa.array(hits.votes, pa.string()), pa.array(hits.summary().tolist(), pa.list_(pa.float64()))], ["toxic", "entries", "counts", "votes", "summary"])

    return run


def _per_text(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    return np.diff(np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])[offsets])


def label_model(patterns: list[str], counts: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The probability of the toxic class for each pattern of votes.

    counts: how many documents have each pattern; toxic, clean: how many of the labelled ones.
    """
    votes = np.array([["-0+".index(v) for v in p] for p in patterns])
    n, m = votes.shape
    known = toxic + clean
    weight = counts.sum() / max(1.0, 4 * known.sum())
    one_hot = np.eye(3)[votes]
    lead = (votes == 2).sum(axis=1) - 0.25 * (votes == 0).sum(axis=1)
    q = 1 / (1 + np.exp(-2.0 * lead))
    share = (toxic.sum() + 1) / (known.sum() + 2) if known.sum() else 0.1
    if known.sum():
        q = (toxic + share) / (known + 1) * (known > 0) + q * (known == 0)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - q) + weight * clean, counts * q + weight * toxic])
        parent = _tree(one_hot, mass)
        logs = np.stack([np.full(n, np.log(1 - share)), np.full(n, np.log(share))])
        for k in range(2):
            for j in range(m):
                p = parent[j]
                table = np.einsum("n,na,nb->ab", mass[k], one_hot[:, p] if p >= 0 else np.ones((n, 1)), one_hot[:, j]) + 0.5
                table /= table.sum(axis=1, keepdims=True)
                logs[k] += np.log(table[votes[:, p] if p >= 0 else 0, votes[:, j]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done = np.abs(new - q).max() < 1e-5
        q = new
        if done:
            break
    return q


def _tree(one_hot: np.ndarray, mass: np.ndarray) -> list[int]:
    """For each voter the one that it depends on given the class, -1 for the first: the tree of most conditional information."""
    m = one_hot.shape[1]
    total = mass.sum()
    gain = np.zeros((m, m))
    for k in range(2):
        joint = np.einsum("n,nia,njb->ijab", mass[k], one_hot, one_hot) + 1e-9
        weight = mass[k].sum() / total
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        single = np.einsum("iiaa->ia", joint)
        gain += weight * (joint * np.log(joint / (single[:, None, :, None] * single[None, :, None, :] + 1e-12) + 1e-12)).sum(axis=(2, 3))
    parent, best = [-1] * m, [(gain[0, j], 0) for j in range(m)]
    left = set(range(1, m))
    while left:
        j = max(left, key=lambda x: (best[x][0], -x))
        parent[j] = best[j][1]
        left.remove(j)
        for x in left:
            if gain[j, x] > best[x][0]:
                best[x] = gain[j, x], j
    return parent


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on labels between 0 and 1, by Newton steps that are halved until they help."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])

    def loss(w):
        z = np.clip(x @ w, -50, 50)
        return np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z) + penalty * w @ w / 2

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - y) / len(x) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, before, now = w - step, now, new
        if before - now < 1e-10:
            break
    return w


@dataclass
class Model:
    known: Lexicon
    weights: np.ndarray


def _posterior(q: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """q with a label (1, 0, -1: none) as one more voter."""
    q = np.clip(q, 1e-9, 1 - 1e-9)
    z = np.log(q / (1 - q)) + np.log(TRUST / (1 - TRUST)) * np.where(toxic < 0, 0, 2 * toxic - 1)
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, others: int = UNLABELLED) -> Model:
    """Lexicon and classifier, from documents (doc_id, text) and labels (doc_id, toxic)."""
    sample = written(sample_of(docs, labels, bound).select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    known = lexicon(*mined_terms(sample))
    size = len(known.terms)
    by_votes = {r.votes: r.n for r in docs.select("text").mapInArrow(_votes(known), "votes string").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = sample.unionByName(others_of(docs, others).withColumn("toxic", F.lit(-1)))
    rows = texts.mapInArrow(_examples(known), "toxic int, entries array<int>, counts array<int>, votes string, summary array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.toxic, r.votes, r.entries, r.counts, r.summary))  # the same sums whatever the order of tasks
    toxic = np.array([min(r.toxic, 1) for r in rows])
    if not (toxic >= 0).any():
        return Model(known, np.concatenate([np.full(size, 1.0), [1.0, 2.0, -2.0, 1.0], [-2.0]]))
    patterns = sorted({*by_votes, *(r.votes for r in rows)})
    place = {p: i for i, p in enumerate(patterns)}
    at = np.array([place[r.votes] for r in rows])
    marks = [np.bincount(at[toxic == k], minlength=len(patterns)).astype(float) for k in (1, 0)]
    q = label_model(patterns, np.array([by_votes.get(p, 0) for p in patterns], float), *marks)
    x = np.zeros((len(rows), size + 4), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r.entries] = np.log1p(r.counts)
        x[i, size:] = r.summary
    return Model(known, fit_linear(x, _posterior(q[at], toxic)))


def scored(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, named k0, k1 and so on, and score."""
    picked = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [docs[text].alias("text")]))
    at = f"k{keep.index(text)}" if text in keep else "text"
    keys = [f"k{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, at):
                score = _Hits(own.known, part.column(at)).scores(own.weights)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(score, pa.float64())], [*keys, "score"])

    kept = ", ".join(f"{k} {picked.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{kept}, score double")


def _named(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", bound: int = SAMPLE) -> DataFrame:
    """A row for each row of docs: doc_id, score (0 to 1), predicted (1 if the score is 0.5 at least)."""
    rows = scored(docs, fit(_named(docs, text, doc_id), labels, bound), text, [doc_id])
    return rows.select(F.col("k0").alias(doc_id), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", bound: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that score less than 0.5. Columns go through the operator, so nothing is joined or shuffled for them."""
    names = docs.columns
    rows = scored(docs, fit(_named(docs, text, doc_id), labels, bound), text, names)
    return rows.filter("score < 0.5").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
