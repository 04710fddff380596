"""Operator 8: removing passages of benchmarks from documents.

The windows of `size` consecutive words of all benchmark items (an item of fewer
words, but not none, is one window) make a hash set that is broadcast. Each
window of a document's words that meets the set is compared word by word; what
is equal is hit. So documents are read once and nothing of them is shuffled.

A set of more than `BROADCAST` bytes stays a table. Of it only a bitmap of
hashes is broadcast (2**`BITMAP` bits, however many windows there are); windows
of documents that meet it are joined to the table by hash and words, and a text
is known by its digest on the way, so no task or driver holds the set.

Words are longest runs of 0-9, a-z (A-Z count as a-z) and characters beyond
ASCII. Null and empty texts, and texts without such characters, have no words
and are never hit; items without words have no window. Items that repeat an id
or a text all count. Rows of documents are independent of each other; repeated
rows are each returned. Further columns are ignored by scan() and kept by
without_hits().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.bytewords import ALNUM, Words, slices, text_bytes, windows, words_of
from ledgerlark.llm.scratch import written

#: Bytes of windows, with their items, that are broadcast at most, and bits of a bitmap's places beyond that.
BROADCAST, BITMAP = 32 << 20, 26
_BITS = 20


def _windows_of(words: Words, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """For each text its windows: number of the text, hash (as a signed number), words, and the words with spaces between."""
    hashes = words.hashes()
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        own = min(size, b - a)
        if own:
            texts = [words.text(k) for k in range(a, b)]
            for k, h in enumerate(windows(hashes[a:b], own).view(np.int64).tolist()):
                yield i, h, own, b" ".join(texts[k : k + own])


def benchmark_windows(benchmark: DataFrame, size: int = 13, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The distinct windows of all items: hash, size, words, items (ids as strings, sorted)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = list(_windows_of(words_of(*text_bytes(part.column("text")), ALNUM), size))
                ids = part.column("item_id").take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.binary())], ["item_id", "hash", "size", "words"])

    picked = benchmark.select(benchmark[item_id].cast("string").alias("item_id"), benchmark[text].alias("text"))
    rows = picked.mapInArrow(run, "item_id string, hash long, size int, words binary")
    return rows.groupBy("hash", "size", "words").agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("items"))


class _Set:
    """Windows of one size in arrays, to be looked up by hash and then by words."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.hash % 2**64)
        self.hashes = np.array([r.hash for r in rows], dtype=np.int64).view(np.uint64)
        self.words = pa.array([bytes(r.words) for r in rows], pa.binary())
        self.items = pa.array([r["items"] for r in rows], pa.list_(pa.string()))

    def places(self, hashes: np.ndarray, maybe: np.ndarray) -> np.ndarray:
        """Places of the given hashes that are in the set."""
        likely = np.flatnonzero(maybe[hashes >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[likely]), len(self.hashes) - 1)
        return likely[self.hashes[at] == hashes[likely]]

    def maybe(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, dtype=bool)
        out[self.hashes >> np.uint64(64 - _BITS)] = True
        return out

    def of(self, h: np.uint64, words: bytes) -> list[str]:
        """Items of the window, none if it isn't in the set."""
        k = int(np.searchsorted(self.hashes, h))
        while k < len(self.hashes) and self.hashes[k] == h:
            if self.words[k].as_py() == words:
                return self.items[k].as_py()
            k += 1
        return []


def _hits(texts: pa.Array, sets: dict[int, tuple[_Set, np.ndarray]]) -> list[tuple[int, list[int], list[int], set[str]]]:
    """For each text: its words, first words and lengths of windows that are hit, their items."""
    words = words_of(*text_bytes(texts), ALNUM)
    hashes, first = words.hashes(), words.first
    out = [(int(b - a), [], [], set()) for a, b in zip(first[:-1], first[1:], strict=True)]
    for size, (own, maybe) in sets.items():
        found = windows(hashes, size)
        for p in own.places(found, maybe).tolist():
            i = int(np.searchsorted(first, p, side="right")) - 1
            if p + size <= first[i + 1] and (items := own.of(found[p], b" ".join(words.text(k) for k in range(p, p + size)))):
                out[i][1].append(p - int(first[i]))
                out[i][2].append(size)
                out[i][3].update(items)
    return out


def _covered(starts: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """Longest runs of words that the windows cover, as first word and word after the last."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(starts, sizes, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], a + n)
        else:
            out.append((a, a + n))
    return out


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
_SCAN = "n_hit long, runs array<struct<first:int,after:int>>, items array<string>"


def _summed(hits: list[tuple[list[int], list[int], set[str]]]) -> list[pa.Array]:
    """The columns of _SCAN for first words, lengths and items of each text."""
    runs = [_covered(starts, sizes) for starts, sizes, _ in hits]
    return [pa.array([sum(b - a for a, b in x) for x in runs], pa.int64()), pa.array([[{"first": a, "after": b} for a, b in x] for x in runs], _RUNS), pa.array([sorted(h[2]) for h in hits], pa.list_(pa.string()))]


def _scanned(docs: DataFrame, benchmark: DataFrame, size: int, text: str, keep: list[str]) -> DataFrame:
    """scan() with its kept columns named k0, k1 and so on."""
    found = written(benchmark_windows(benchmark, size), "windows")
    total = found.agg(F.coalesce(F.sum(F.length("words") + F.expr("aggregate(items, 200, (n, x) -> n + length(x) + 60)")), F.lit(0)).alias("n")).first().n
    picked = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [docs[text].alias("text")]))
    at = f"k{keep.index(text)}" if text in keep else "text"
    keys = [f"k{i}" for i in range(len(keep))]
    return (_by_broadcast if total <= BROADCAST else _by_join)(picked, found, size, at, keys)


def _by_broadcast(picked: DataFrame, found: DataFrame, size: int, at: str, keys: list[str]) -> DataFrame:
    by_size: dict[int, list] = {}
    for r in found.collect():
        by_size.setdefault(r["size"], []).append(r)
    shared = picked.sparkSession.sparkContext.broadcast({n: _Set(rows) for n, rows in by_size.items()})

    def run(batches):
        sets = {n: (own, own.maybe()) for n, own in shared.value.items()}
        for batch in batches:
            for part in slices(batch, at):
                rows = _hits(part.column(at), sets)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array([r[0] for r in rows], pa.int64()), *_summed([r[1:] for r in rows])], [*keys, "n_words", "n_hit", "runs", "items"])

    kept = ", ".join(f"{k} {picked.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{kept}, n_words long, {_SCAN}")


def _by_join(picked: DataFrame, found: DataFrame, size: int, at: str, keys: list[str]) -> DataFrame:
    context = picked.sparkSession.sparkContext
    lead = F.shiftrightunsigned("hash", 64 - BITMAP)
    marked = found.groupBy("size", F.shiftright(lead, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - BITMAP}) & 63))")).alias("bits"))
    bitmaps: dict[int, np.ndarray] = {}
    for r in marked.toLocalIterator():  # 2**BITMAP / 64 numbers a size at most, whatever the table's size
        bitmaps.setdefault(r["size"], np.zeros(1 << BITMAP - 6, np.int64))[r["at"]] = r["bits"]
    shared = context.broadcast(bitmaps)

    def run(batches):
        sets = {n: np.unpackbits(x.view(np.uint8), bitorder="little").view(bool) for n, x in shared.value.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(*text_bytes(part.column("text")), ALNUM)
                hashes, first, rows = words.hashes(), words.first, []
                for n, maybe in sets.items():
                    own = windows(hashes, n)
                    for p in np.flatnonzero(maybe[own >> np.uint64(64 - BITMAP)]).tolist():
                        i = int(np.searchsorted(first, p, side="right")) - 1
                        if p + n <= first[i + 1]:
                            rows.append((i, p - int(first[i]), n, int(own[p].view(np.int64)), b" ".join(words.text(k) for k in range(p, p + n))))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("mark").take(pa.array([r[0] for r in rows], pa.int64())), *columns], ["mark", "start", "size", "hash", "words"])

    def summed(batches):
        for batch in batches:
            hits = [([h["start"] for h in x], [h["size"] for h in x], set(y)) for x, y in zip(batch.column("hits").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("of"), *_summed(hits)], ["of", "n_hit", "runs", "items"])

    mark = F.sha2(F.coalesce(F.col(at), F.lit("")).cast("binary"), 256)
    likely = picked.select(F.col(at).alias("text"), mark.alias("mark")).mapInArrow(run, "mark string, start int, size int, hash long, words binary")
    # written, so that the join can deal out a window that many documents have
    hits = written(likely, "likely-hits").join(found, ["hash", "size", "words"])
    by_text = hits.groupBy(F.col("mark").alias("of")).agg(F.collect_set(F.struct("start", "size")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found"))
    hit = written(by_text.mapInArrow(summed, f"of string, {_SCAN}"), "hits")
    n_words = F.coalesce(F.regexp_count(F.col(at), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    every = picked.select(*keys, n_words.alias("n_words"), mark.alias("mark"))
    none = F.array().cast("array<string>")
    both = every.join(hit, F.col("mark") == F.col("of"), "left")
    return both.select(*keys, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("runs", F.array().cast("array<struct<first:int,after:int>>")).alias("runs"), F.coalesce("items", none).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: the columns `keep`, n_words, n_hit, runs (of words that are hit), items (ids as strings, sorted)."""
    keep = keep or ["doc_id"]
    return _scanned(docs, benchmark, size, text, keep).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "runs", "items")


def contaminated() -> F.Column:
    """Whether a scanned document counts as contaminated: a hit, and a twentieth of its words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_documents(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    names = docs.columns
    return _scanned(docs, benchmark, size, text, names).filter(~contaminated()).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text") -> DataFrame:
    """All rows of docs, with all their columns; from the texts the words that are hit are cut, with what stands between them."""
    names = docs.columns
    kind = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).schema
    at = names.index(text)

    def run(batches):
        for batch in batches:
            texts = []
            for value, runs in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if runs:
                    raw = value.encode()
                    words = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
                    for x in reversed(runs):
                        raw = raw[: words.starts[x["first"]]] + raw[words.ends[x["after"] - 1] :]
                    value = raw.decode()
                texts.append(value)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, kind.names)

    found = _scanned(docs, benchmark, size, text, names).select(*[F.col(f"k{i}").alias(f"c{i}") for i in range(len(names))], "runs")
    return found.mapInArrow(run, kind).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

