"""Operator 10: document quality with hierarchical empirical Bayes.

A classifier of the text alone gives each document a probability p of being
good. Sites add to it: the mean of p over a host's documents, and over those of
a path of that host, are evidence about what stands there. Means of few
documents say little, so they are shrunk: a path's towards its host's, a host's
towards the global one, by prior weights that are estimated from how much the
means of hosts, and of paths inside hosts, differ beyond chance. With w the
variance of p inside groups and b the variance between their true means, both by
the method of moments (one-way analysis of variance with unequal groups), a
prior weighs w / b documents (at least 1, at most a million, the latter where
nothing differs beyond chance). A document itself is left out of its site's
means. Its score is

    logit(score) = logit(p) - logit(global mean) + logit(shrunk mean of its path)

Sums run over all documents, partially aggregated before they are shuffled, as
whole numbers (millionths and their squares), so they do not depend on the order
of rows.

The classifier is an additive logistic model over quantile bins of text
statistics, fitted on `SAMPLE` labelled rows at most, one an id (ids and texts
with the smallest hashes), for whose id `crc32(id as text) mod 5` is not 0. Without labels p is the
same for all. Null and empty texts have the statistics of an empty text; null
hosts and paths are each a site. Repeated rows are each scored. Labels may be of
any type that can be cast to int. Further columns are ignored.

page_rows() makes rows of web pages, whose urls have hosts and paths. `documents`
has no url: in the registered query source stands for the host and lang for the
path there, beside all pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.bytewords import NOT_SPACE, slices, text_bytes, words_of
from ledgerlark.llm.scratch import written
from ledgerlark.llm.toxicity import SAMPLE, bounded, fit_linear, held_out, one_text

BINS = 12
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False
_KINDS = [(48, 58), (65, 91), (97, 123), (128, 256), (10, 11), (32, 33)]


def statistics(part: pa.Array) -> np.ndarray:
    """For each text: sizes, shares of kinds of bytes, repetition of words and lines."""
    data, offsets = text_bytes(part)
    size = np.diff(offsets)
    share = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])[offsets]) / np.maximum(size, 1)
    columns = [np.log1p(size), *(share((data >= a) & (data < b)) for a, b in _KINDS)]
    columns.append(1 - sum(columns[1:]))  # other signs
    for kind in (NOT_SPACE, _LINE):
        words = words_of(data, offsets, kind)
        hashes, counts = words.hashes(), np.diff(words.first)
        distinct, most = np.zeros(len(size)), np.zeros(len(size))
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if b > a:
                n = np.unique(hashes[a:b], return_counts=True)[1]
                distinct[i], most[i] = len(n) / (b - a), n.max() / (b - a)
        columns += [np.log1p(counts), distinct, most, size / np.maximum(counts, 1)]
    return np.column_stack(columns).astype(np.float64)


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column for each statistic and bin."""
    out = np.zeros((len(x), x.shape[1] * (BINS + 1)), dtype=np.float32)
    for j in range(x.shape[1]):
        out[np.arange(len(x)), j * (BINS + 1) + np.searchsorted(edges[j], x[:, j])] = 1
    return out


def _fitted(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Edges of bins, and weights, from labelled rows (text, quality)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(statistics(part.column("text")).tolist(), pa.list_(pa.float64())), part.column("quality")], ["x", "quality"])

    rows = sample.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "x array<double>, quality int").collect()
    rows = sorted(rows, key=lambda r: (r.quality, r.x))  # the same sums whatever the order of tasks
    width = statistics(pa.array([""])).shape[1]
    if not rows:
        return np.zeros((width, BINS)), np.zeros(width * (BINS + 1) + 1)
    x = np.array([r.x for r in rows])
    edges = np.quantile(x, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    return edges, fit_linear(_binned(x, edges), np.array([float(r.quality > 0) for r in rows]), penalty=1e-4)


def classified(docs: DataFrame, labels: DataFrame, keep: list[str], bound: int = SAMPLE) -> DataFrame:
    """The columns `keep` of docs (doc_id, text and others) and p, in millionths between 1 and 999,999."""
    usable = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    picked = bounded(usable.groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").cast("int").alias("quality")), "of", bound)
    rows = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("of"))
    edges, weights = _fitted(written(rows.groupBy("of").agg(one_text(), F.min("quality").alias("quality")).select("text", "quality"), "labelled"))
    model = docs.sparkSession.sparkContext.broadcast((edges, weights))

    def run(batches):
        edges, w = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                z = _binned(statistics(part.column("text")), edges) @ w[:-1] + w[-1]
                p = np.clip(np.rint(1e6 / (1 + np.exp(-z))), 1, 999_999).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(p)], [*keep, "p"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, p long")


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, text, host, path) of pages (page_id, url, html): doc_id is -1 - page_id, path the url's path up to its last part, text what is shown."""
    url = F.col("url")
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.regexp_replace(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "/+$", ""), "/[^/]*$", "")
    shown = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|nav|head)\b.*?</\1\s*>", " ")
    shown = F.regexp_replace(F.regexp_replace(shown, r"(?i)<(br|/?p|/?h[1-6]|/?div|/?li|/?tr)\b[^>]*>", "\n"), r"<[^>]*>", " ")
    for code, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        shown = F.replace(shown, F.lit(code), F.lit(sign))
    return pages.select((-1 - F.col("page_id")).cast("long").alias("doc_id"), F.trim(shown).alias("text"), host.alias("host"), path.alias("path"))


def _squares(n: str, total: str, squares: str) -> F.Column:
    """The sum of squared differences from a group's mean, from its sums."""
    return F.greatest(F.lit(0.0), F.col(squares).cast("double") - F.pow(F.col(total).cast("double"), 2) / F.col(n)) / 1e12


def _prior(inside: float, between: float, rows: int, groups: int, parents: int, spread: float) -> float:
    """How many documents a prior weighs; spread: the rows less what the groups' sizes take (sums of squared sizes over the parents' sizes)."""
    w = inside / max(1, rows - groups)
    b = (between - (groups - parents) * w) / spread if spread > 0 else 0.0
    return min(1e6, max(1.0, w / b)) if b > 0 else 1e6


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", path: str = "lang", bound: int = SAMPLE) -> DataFrame:
    """A row for each row of docs: doc_id, host, path, p_text, p_host, p_path (shrunk means without the row itself), score, predicted."""
    site = lambda c: F.coalesce(F.concat(F.lit("s"), docs[c].cast("string")), F.lit("n"))
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), site(host).alias("host"), site(path).alias("path"))
    rows = written(classified(docs, labels, ["doc_id", "host", "path"], bound), "classified")
    square = (F.col("p") * F.col("p")).cast("decimal(38,0)")
    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("t"), F.sum(square).alias("s")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("t").alias("ht"), F.sum("s").alias("hs")), "hosts")
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("ht").alias("t"), F.count(F.lit(1)).alias("hosts"), F.sum(_squares("hn", "ht", "hs")).alias("inside"), F.sum(F.pow("hn", F.lit(2))).alias("sizes")).first()
    mean, m_host, m_path = 0.5, 1.0, 1.0
    if whole.n:
        mean = whole.t / whole.n / 1e6
        apart = lambda n, t, of: F.col(n) * F.pow(F.col(t) / F.col(n) / 1e6 - of, 2)
        between = hosts.agg(F.sum(apart("hn", "ht", F.lit(mean))).alias("b")).first().b
        m_host = _prior(whole.inside, between, whole.n, whole.hosts, 1, whole.n - whole.sizes / whole.n)
        nested = paths.join(hosts, "host").agg(F.count(F.lit(1)).alias("paths"), F.sum(_squares("n", "t", "s")).alias("inside"), F.sum(apart("n", "t", F.col("ht") / F.col("hn") / 1e6)).alias("b"), F.sum(F.pow("n", F.lit(2)) / F.col("hn")).alias("sizes")).first()
        m_path = _prior(nested.inside, nested.b, whole.n, nested.paths, whole.hosts, whole.n - nested.sizes)
    sites = paths.join(hosts, "host")
    both = rows.join(sites, ["host", "path"])
    own = F.col("p")
    p_host = ((F.col("ht") - own) / 1e6 + m_host * mean) / (F.col("hn") - 1 + m_host)
    both = both.withColumn("p_host", p_host)
    p_path = ((F.col("t") - own) / 1e6 + m_path * F.col("p_host")) / (F.col("n") - 1 + m_path)
    both = both.withColumn("p_path", p_path).withColumn("p_text", own / 1e6)
    logit = lambda c: F.log(c / (1 - c))
    z = logit(F.col("p_text")) - float(np.log(mean / (1 - mean))) + logit(F.col("p_path"))
    score = 1 / (1 + F.exp(-z))
    real = lambda c: F.when(F.col(c) != "n", F.substr(c, F.lit(2)))
    out = both.select(F.col("doc_id").alias(doc_id), real("host").alias("host"), real("path").alias("path"), "p_text", "p_host", "p_path", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
