"""Operator 11: the tokens of two tokenizers aligned in each text.

Tokenizer A is a byte-level BPE that reads a space and the text, tokenizer B a
SentencePiece model that puts that space before the text itself; the tokens of
both cover the same bytes. Two tokens are linked where their bytes overlap, and
where tokens of both end at the same byte a cut ends a group.

All texts of a slice are merged in lockstep: for each text (and each stretch of
`STRIDE` bytes of a longer one) a state vector holds the places of its next A
and B token. One step, for all of them together, emits the link of these two
tokens, and a cut where they end alike, moves on the pointer whose token ends
first, or both, and drops what is finished. A stretch begins with the tokens
that hold its first byte and ends where the next one begins, which is a state on
the text's only path, so long texts need no more steps than short ones.

Both encoders look up distinct words of a slice once. Longer texts are taken in
pieces of about `PIECE` characters, cut at spaces between two other characters,
where both tokenizers begin anew; a text without such places is one piece, for
which some hundred bytes are held for each character.

How many texts hold a pair of ids linked is counted over all of them: tasks add
up the distinct pairs of their texts, a shuffle the rest. The counts of the
`DICTIONARY` most frequent pairs are broadcast, rarer pairs are joined.

Null and empty texts, and those whose tokens do not give back a space and the
text, have no tokens: all numbers are 0, and the digest is ''. Special tokens'
strings are plain text. Rows are independent, and each row counts as a document
for its pairs: repeated rows are each returned and counted. An empty table gives
an empty one. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.bpe import TEXTS, MergeTable, _ranges, _starts, encoded_texts
from ledgerlark.llm.bytewords import slices, text_bytes
from ledgerlark.llm.scratch import written
from ledgerlark.llm.tokencount import checked_model, pre_tokens

#: Bytes of a stretch, and characters of a long text's piece.
STRIDE, PIECE = 256, 1 << 20
#: Entries of the broadcast dictionary at most, of 17 bytes each.
DICTIONARY = 1 << 18
#: Pairs that a task counts together.
HELD = 1 << 21
#: How two ids share a number.
_BITS = 21


class PlainTable(MergeTable):
    """A vocabulary of byte-level BPE for which the strings of added tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.added_in, self.added_starts, self.added_longest = None, set(), 0


class TokenBytes:
    """The bytes of each id, one behind the other."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.array(list(map(len, tokens)), dtype=np.int64)
        self.starts = _starts(self.sizes)[:-1]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return _ranges(self.data, self.starts[ids], self.sizes[ids])


class Tokenizers:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainTable(path_a), checked_model(path_b)
        n = self.b.get_piece_size()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(n)]
        self.bytes_a = TokenBytes(self.a.tokens)
        self.bytes_b = TokenBytes([bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces])
        self.mark = [self.b.piece_to_id("▁")]
        most = max(n, len(self.a.tokens))
        #: Each id in decimal digits, and a place for what follows it.
        self.digits = TokenBytes([b"%d," % i for i in range(most)])

    def ids_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The A ids of a space and each text, and how many each has."""
        found = [b"".join(blocks) for blocks in encoded_texts(self.a, [" " + t for t in texts])]
        return np.frombuffer(b"".join(found), "<u4").astype(np.int64), np.array([len(x) // 4 for x in found], dtype=np.int64)

    def ids_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = list(map(pre_tokens, texts))
        coded = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        keys = coded.dictionary.to_pylist()
        of_key = [ids if key else self.mark for key, ids in zip(keys, self.b.encode(keys, num_threads=1), strict=True)]
        counts = np.array(list(map(len, of_key)), dtype=np.int64)
        values = np.fromiter(chain.from_iterable(of_key), dtype=np.int64, count=int(counts.sum()))
        place = coded.indices.to_numpy().astype(np.int64)
        bounds = _starts(np.array(list(map(len, words)), dtype=np.int64))
        return _ranges(values, _starts(counts)[place], counts[place]), np.diff(_starts(counts[place])[bounds])


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (places of A and B tokens) and whether both end there, in order.

    ends: where each token ends, over all texts, which end alike in both;
    starts: the first bytes of stretches, among them those of all texts.
    """
    places = [np.searchsorted(e, starts, side="right") for e in (ends_a, ends_b)]
    stops = [np.append(p[1:], len(e)) for p, e in zip(places, (ends_a, ends_b), strict=True)]
    base = _starts(sum(stops) - sum(places))
    link_a, link_b, cut = np.full(base[-1], -1), np.full(base[-1], -1), np.zeros(base[-1], dtype=bool)
    state = np.stack([*places, *stops, base[:-1]])
    while True:
        going = (state[0] < state[2]) | (state[1] < state[3])
        if not going.all():
            state = state[:, going]
        if not state.shape[1]:
            break
        i, j, _, _, at = state
        a, b = ends_a[i], ends_b[j]
        link_a[at], link_b[at], cut[at] = i, j, a == b
        state[0] += a <= b
        state[1] += b <= a
        state[4] += 1
    kept = link_a >= 0
    return link_a[kept], link_b[kept], cut[kept]


@dataclass
class Aligned:
    """The tokens of several texts, and their links; those of text i have the places first_x[i] to first_x[i + 1]. A text that is not whole has none."""

    whole: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut: np.ndarray
    first_link: np.ndarray

    def pairs(self) -> np.ndarray:
        return self.ids_a[self.link_a] << _BITS | self.ids_b[self.link_b]

    def n_groups(self) -> np.ndarray:
        return np.diff(_starts(self.cut)[self.first_link])

    def groups(self, digits: TokenBytes) -> list[memoryview]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3;`."""
        marks, groups = [], []
        for links, n in ((self.link_a, len(self.ids_a)), (self.link_b, len(self.ids_b))):
            last = np.zeros(n, dtype=np.int64)
            last[links[self.cut]] = 1
            marks.append(last)
            groups.append(np.cumsum(last) - last)
        size = [_starts(np.bincount(g)) for g in groups]
        place = [np.arange(len(self.ids_a)) + size[1][groups[0]], np.arange(len(self.ids_b)) + size[0][groups[1] + 1]] if len(self.ids_a) else [np.zeros(0, np.int64)] * 2
        ids, signs = np.empty(len(self.ids_a) + len(self.ids_b), dtype=np.int64), np.empty(len(self.ids_a) + len(self.ids_b), dtype=np.uint8)
        for at, own, last, sign in ((place[0], self.ids_a, marks[0], b"|"), (place[1], self.ids_b, marks[1], b";")):
            ids[at], signs[at] = own, np.where(last, sign[0], b","[0])
        out = digits.joined(ids)
        ends = np.cumsum(digits.sizes[ids])
        out[ends - 1] = signs
        bounds = np.append(0, ends)[self.first_a + self.first_b]
        return [memoryview(out[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def aligned_texts(both: Tokenizers, texts: list[str], stride: int = STRIDE) -> Aligned:
    """Texts that are not empty."""
    data, offsets = text_bytes(pa.array([" " + t for t in texts], pa.large_string()))
    sides = [(both.bytes_a, *both.ids_a(texts)), (both.bytes_b, *both.ids_b(texts))]
    whole = np.ones(len(texts), dtype=bool)
    for own, ids, counts in sides:
        sizes = np.diff(_starts(own.sizes[ids])[_starts(counts)])
        alike = np.flatnonzero(sizes == np.diff(offsets))
        whole[sizes != np.diff(offsets)] = False
        if len(alike):
            made = own.joined(ids if len(alike) == len(texts) else _ranges(ids, _starts(counts)[alike], counts[alike]))
            given = data if len(alike) == len(texts) else _ranges(data, offsets[alike], sizes[alike])
            differs = np.add.reduceat((made != given).astype(np.int64), _starts(sizes[alike])[:-1]) > 0
            whole[alike[differs]] = False
    kept, ends, firsts = [], [], []
    for own, ids, counts in sides:
        kept.append(ids if whole.all() else ids[np.repeat(whole, counts)])
        ends.append(np.cumsum(own.sizes[kept[-1]]))
        firsts.append(_starts(np.where(whole, counts, 0)))
    sizes = np.diff(offsets)[whole]
    stretches = -(-sizes // stride)
    starts = np.repeat(_starts(sizes)[:-1], stretches) + _ranges(np.arange(int(stretches.max(initial=0))), np.zeros(len(sizes), np.int64), stretches) * stride
    link_a, link_b, cut = lockstep(ends[0], ends[1], starts)
    return Aligned(whole, kept[0], kept[1], firsts[0], firsts[1], link_a, link_b, cut, np.searchsorted(link_a, firsts[0]))


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text in pieces, each without the space before it."""
    fits = lambda i: i > 0 and text[i] == " " and not (text[i - 1].isspace() or text[i + 1 : i + 2].isspace())
    at = 0
    while len(text) - at > size:
        cut = next((i for i in range(at + size, at + size // 2, -1) if fits(i)), None) or next((i for i in range(at + size, len(text) - 1) if fits(i)), None)
        if cut is None:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _summary(both: Tokenizers, texts: list[str], stride: int) -> Iterator[tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and their numbers of links, for each text."""
    some = [i for i, t in enumerate(texts) if t]
    rows = dict.fromkeys(range(len(texts)), (0, 0, 0, 0, "", b"", b""))
    if some and len(texts[some[0]]) <= PIECE:
        x = aligned_texts(both, [texts[i] for i in some], stride)
        n_links = np.diff(x.first_link)
        keys, times = np.unique(np.repeat(np.arange(len(some)), n_links) << 2 * _BITS | x.pairs(), return_counts=True)
        bounds = np.searchsorted(keys, np.arange(len(some) + 1) << 2 * _BITS)
        keys, times = keys & (1 << 2 * _BITS) - 1, times.astype("<u4")
        figures = zip(np.diff(x.first_a).tolist(), np.diff(x.first_b).tolist(), x.n_groups().tolist(), n_links.tolist(), x.groups(both.digits), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        for i, (n_a, n_b, n_groups, n, groups, p, q) in zip(some, figures, strict=True):
            if n_a:
                rows[i] = n_a, n_b, n_groups, n, hashlib.sha256(groups[:-1]).hexdigest(), keys[p:q].tobytes(), times[p:q].tobytes()
    else:  # one long text
        for i in some:
            sums, sha, found, counts, held = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64), b""
            for piece in pieces_of(texts[i]):
                x = aligned_texts(both, [piece], stride)
                if not x.whole[0]:
                    break
                sha.update(held)
                groups = x.groups(both.digits)[0]
                sha.update(groups[:-1])
                held = b";"
                sums += [len(x.ids_a), len(x.ids_b), int(x.cut.sum()), len(x.link_a)]
                own, times = np.unique(x.pairs(), return_counts=True)
                found, back = np.unique(np.concatenate([found, own]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
            else:
                rows[i] = *sums.tolist(), sha.hexdigest(), found.tobytes(), counts.astype("<u4").tobytes()
    yield from (rows[i] for i in range(len(texts)))


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", stride: int = STRIDE) -> DataFrame:
    """A row for each row of docs: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times.

    pairs: the distinct linked ids, each pair as A's id * 2**21 + B's in 64 bits;
    times: how often each is linked, in 32 bits; both little-endian.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches):
        both = tokenizers(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                rows = list(_summary(both, part.column("text").to_pylist(), stride))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["row", "doc_id", *names])

    picked = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return picked.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def alignments(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The alignment itself: doc_id, ids_a, ids_b, links_a and links_b (places of linked tokens), and cuts (the last link of each group)."""
    lists = ["ids_a", "ids_b", "links_a", "links_b", "cuts"]

    def run(batches):
        both = tokenizers(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                texts = part.column("text").to_pylist()
                some = [i for i, t in enumerate(texts) if t]
                x = aligned_texts(both, [texts[i] for i in some])
                rows = [[[]] * 5 for _ in texts]
                for k, i in enumerate(some):
                    (a, a_to), (b, b_to), (p, q) = (f[k : k + 2].tolist() for f in (x.first_a, x.first_b, x.first_link))
                    rows[i] = [x.ids_a[a:a_to], x.ids_b[b:b_to], x.link_a[p:q] - a, x.link_b[p:q] - b, np.flatnonzero(x.cut[p:q])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(5)]], ["doc_id", *lists])

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return picked.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<int>" for c in lists))


def pair_counts(found: DataFrame) -> DataFrame:
    """A row for each pair of ids that aligned() found linked anywhere: pair, n (rows that hold it), best (whether no other pair of its A id has more)."""

    def run(batches):
        held: list[np.ndarray] = []

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for part in slices(batch, "pairs", 8 * HELD):
                held.append(text_bytes(part.column("pairs"))[0].view("<i8"))
                if sum(map(len, held)) > HELD:
                    yield out()
        if held:
            yield out()

    counts = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", _BITS))  # an A id has at most as many pairs as B has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair (in order), n and best of at most `most` of the most frequent pairs: all that occur more often than some count, which a histogram tells."""
    classes = counts.groupBy(F.floor(F.log2("n") * 16).alias("class")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("class")).collect()
    total, least = 0, None
    for c in classes:
        total += c.k
        if total > most:
            break
        least = c.least
    table = counts.filter(F.col("n") >= (least if least is not None else 2**62)).select("pair", "n", "best").orderBy("pair").toArrow()
    return tuple(table.column(c).to_numpy() for c in ("pair", "n", "best"))


def _known(batches, known):
    """For each slice of aligned(): the slice, its pairs and their numbers of links, the row of each, whether it is in the dictionary, and where."""
    for batch in batches:
        for part in slices(batch, "pairs", 8 * HELD):
            raw, offsets = text_bytes(part.column("pairs"))
            pairs, times = raw.view("<i8"), text_bytes(part.column("times"))[0].view("<u4").astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets) // 8)
            at = np.minimum(np.searchsorted(known.value[0], pairs), max(0, len(known.value[0]) - 1))
            there = known.value[0][at] == pairs if len(known.value[0]) else np.zeros(len(pairs), dtype=bool)
            yield part, pairs, times, row, there, at


def scored(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", dictionary: int | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other of its A id outnumbers), count_sum (over links), groups_sha256."""
    found = written(aligned(docs, path_a, path_b, text, doc_id), "aligned")
    counts = written(pair_counts(found), "pair-counts")
    known = docs.sparkSession.sparkContext.broadcast(frequent(counts, DICTIONARY if dictionary is None else dictionary))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def summed(batches):
        for part, _, times, row, there, at in _known(batches, known):
            _, n, best = known.value
            sums = [np.bincount(row[there], x[there], part.num_rows) for x in ((times * n[at], times * best[at]) if len(n) else (times, times))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(x.astype(np.int64)) for x in sums], pa.array(np.bincount(row[~there], minlength=part.num_rows))], [*kept, "count_sum", "n_best", "n_rare"])

    def rare(batches):
        for part, pairs, times, row, there, _ in _known(batches, known):
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(row[~there])), pa.array(pairs[~there]), pa.array(times[~there])], ["row", "pair", "times"])

    sums = found.mapInArrow(summed, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, count_sum long, n_best long, n_rare long")
    others = found.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times long").join(counts, "pair")
    others = others.groupBy(F.col("row").alias("of")).agg(F.sum(F.col("times") * F.col("n")).alias("c"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"))
    both = sums.join(others, sums["row"] == others["of"], "left")
    add = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return both.select(F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", add("n_best", "b"), add("count_sum", "c"), "groups_sha256")
