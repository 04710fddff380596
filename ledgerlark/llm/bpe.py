"""Operator 6: byte-pair encoding and decoding as streaming transducers.

Encoding reads a text in blocks and emits tokens as soon as nothing that may
follow can change them, so it holds a bounded part of a text at any time:

* a space before a character that is not white space always begins a new
  pre-token, so all text before the last such place is settled;
* inside a pre-token without an end in sight, `MergeTable.lookahead` bytes decide.

The lookahead is computed from the merge list. Let u be the bytes read so far
and v any continuation. Merging u and merging uv go alike left of a frontier
that begins at the end of u. It moves left only by a merge (a, b) made in one
of the two runs, with a just left of the frontier and b right of it; then a is
the left end of what a later merge takes as its right side. Ranks grow strictly
along such a chain, so the furthest the frontier can move is the longest chain,
by the length of the left sides, found in one pass over the merges by rank.

What is settled comes out of the encoder as stretches of text; the stretches of
a slice of rows (or of one block of a long text) get their tokens together: each
distinct word in them is merged once, all words at the same time in arrays, and
nothing is remembered from one slice to the next.

Decoding maps ids to bytes and bytes to text with an incremental UTF-8 decoder.

Null texts count as empty. An empty text has no tokens. Strings of added tokens
that occur in a text become those tokens, as the tokenizers library does it.
Rows are independent: ties, repeated rows and further columns change nothing.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlark.llm.bytewords import slices, text_bytes

#: Code points with the property White_Space (fixed values of Unicode), as a part of a character class.
_WS = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)])
#: How byte-level BPE splits a text before merging (fixed values).
_PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", rf"[^{_WS}\p{{L}}\p{{N}}]+", rf"[{_WS}]+")]
_SETTLED = re.compile(r" (?=\S)")
#: A space that settles nothing.
_ODD = re.compile(r" (?!\S)")
#: How two ids share a number.
_BITS = 21
_ID = (1 << _BITS) - 1
#: How a rank and a place in a piece share a number; pieces of up to `SHORT` bytes are merged together, so many at a time.
_PLACE, _NO_RANK, SHORT, TOGETHER = 6, 1 << 24, 60, 4096
#: Characters that are read at a time, and bytes of text whose tokens are looked up together, besides a longer single text.
BLOCK, TEXTS = 1 << 16, 1 << 20


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ranges(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] for each i, one behind the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    """The sums of all sizes before each, and of all."""
    return np.concatenate([[0], np.cumsum(sizes)])


class MergeTable:
    """Merges, tokens and added tokens of a byte-level BPE vocabulary in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in _byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for text, i in vocab.items():
            if text not in self.added:
                self.tokens[i] = bytes(letters[c] for c in text)
        for text, i in self.added.items():
            self.tokens[i] = text.encode()
        self.byte_ids = [vocab[_byte_letters()[b]] for b in range(256)]
        #: By the ids of both sides, rank and id of the token that the merge makes, each as one number.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << _BITS | vocab[b]] = rank << _BITS | vocab[a + b]
        self.lookahead = self._lookahead()
        self.added_in = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.added_starts = {x[:i] for x in self.added for i in range(1, len(x))}
        self.added_longest = max(map(len, self.added), default=0)
        self._index()

    def _index(self) -> None:
        """Merges as a hash table in arrays: the pair and its rank, each at the first free place from its hash on."""
        pairs = np.array([*self.merges, -1], dtype=np.int64)[:-1]
        self.made = np.array([x & _ID for x in self.merges.values()], dtype=np.int64)
        if len(pairs) >= _NO_RANK:
            raise ValueError("too many merges")
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift, last = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, _NO_RANK, dtype=np.int64)
        at, left = self._hashed(pairs), np.arange(len(pairs))
        while len(left):
            free = left[self.pairs[at[left]] == -1]
            self.pairs[at[free]], self.ranks[at[free]] = pairs[free], free
            left = left[self.pairs[at[left]] != pairs[left]]
            at[left] = (at[left] + 1) & last
        self.bytes = np.array(self.byte_ids, dtype=np.int64)
        self.byte_ranks = self.ranks_of(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))

    def _hashed(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each a and b, _NO_RANK where there is none (or one of them is negative)."""
        pairs = np.where((a < 0) | (b < 0), -2, a << _BITS | b)
        at = self._hashed(pairs)
        there = self.pairs[at]
        out = np.where(there == pairs, self.ranks[at], _NO_RANK)
        left = np.flatnonzero((there != pairs) & (there != -1) & (pairs >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.pairs) - 1)
            there = self.pairs[at[left]]
            out[left] = np.where(there == pairs[left], self.ranks[at[left]], _NO_RANK)
            left = left[(there != pairs[left]) & (there != -1)]
        return out

    def _lookahead(self) -> int:
        left_of = {}  # the left side of the merge that first makes a token
        reach: dict[int, int] = {}
        most = 1
        for pair, rank_made in self.merges.items():
            a, b, made = pair >> _BITS, pair & _ID, rank_made & _ID
            far, x = 0, b
            while x is not None:
                far, x = max(far, reach.get(x, 0)), left_of.get(x)
            left_of.setdefault(made, a)
            here = len(self.tokens[a]) + far
            reach[a] = max(reach.get(a, 0), here)
            most = max(most, here)
        return max(most, max(map(len, self.tokens)))

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token, of any length."""
        ids = list(map(self.byte_ids.__getitem__, piece))
        found, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(best >> _BITS, i, pair) for i in range(n - 1) if (best := found(pair := ids[i] << _BITS | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] << _BITS | ids[j] != pair:
                continue
            ids[i], ids[j] = self.merges[pair] & _ID, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] < n and (best := found(pair := ids[p] << _BITS | ids[after[p]])):
                    heapq.heappush(heap, (best >> _BITS, p, pair))
        return [x for x in ids if x >= 0]

    def merged_together(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, whose bytes are data[offsets[i] : offsets[i + 1]], and how many each has."""
        sizes = np.diff(offsets)
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], SHORT, side="right"))
        parts, counts = [], np.zeros(len(sizes), np.int64)
        for at in range(0, short, TOGETHER):
            own = order[at : min(short, at + TOGETHER)]
            ids, n = self._merged_columns(data, offsets[own], sizes[own])
            parts.append(ids)
            counts[own] = n
        for i in order[short:].tolist():
            ids = self.merged(data[offsets[i] : offsets[i + 1]].tobytes())
            parts.append(np.array(ids, dtype=np.int64))
            counts[i] = len(ids)
        starts = np.empty(len(sizes), np.int64)
        starts[order] = _starts(counts[order])[:-1]
        return _ranges(np.concatenate([np.zeros(0, np.int64), *parts]), starts, counts), counts

    def _merged_columns(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges pieces that are columns, the shortest first: in each round the first merge of the lowest rank in each of them."""
        most, width = int(sizes[-1]), len(sizes)
        ids = np.full((most + 1, width), -1, dtype=np.int64)  # the last row is what is before and behind a piece
        best = np.full((most + 1, width), _NO_RANK << _PLACE, dtype=np.int64)
        for p in range(most):
            k = int(np.searchsorted(sizes, p, side="right"))
            now = data[starts[k:] + p]
            ids[p, k:] = self.bytes[now]
            if p:
                best[p - 1, k:] = self.byte_ranks[before[k - width :].astype(np.int64) << 8 | now] << _PLACE | p - 1  # noqa: F821
            before = now  # noqa: F841
        after, ahead = np.empty_like(ids), np.empty_like(ids)
        after[:] = np.arange(1, most + 2)[:, None]
        ahead[:] = np.arange(-1, most)[:, None]
        ahead[0] = most
        columns, done = np.arange(width), ids
        while True:
            low = best.min(axis=0)
            active = np.flatnonzero(low < _NO_RANK << _PLACE)
            if not len(active):
                break
            if 2 * len(active) < len(columns):  # go on with those columns alone
                done[:, columns] = ids
                columns, low = columns[active], low[active]
                ids, best, after, ahead = (np.take(x, active, axis=1) for x in (ids, best, after, ahead))
                active = np.arange(len(columns))
            n = len(columns)
            flat_ids, flat_best, flat_after, flat_ahead = (x.reshape(-1) for x in (ids, best, after, ahead))
            place, made = low[active] & (1 << _PLACE) - 1, self.made[low[active] >> _PLACE]
            here = place * n + active
            gone = flat_after[here] * n + active
            right, left = flat_after[gone], flat_ahead[here]
            flat_ids[here], flat_ids[gone] = made, -1
            flat_best[gone] = _NO_RANK << _PLACE
            flat_after[here] = right
            flat_ahead[right * n + active] = place
            beside = self.ranks_of(np.concatenate([made, flat_ids[left * n + active]]), np.concatenate([flat_ids[right * n + active], made])) << _PLACE
            flat_best[here] = beside[: len(active)] | place
            flat_best[left * n + active] = beside[len(active) :] | left
        done[:, columns] = ids
        across = done.T
        return across[across >= 0], (done >= 0).sum(axis=0)

    def _words(self, words: pa.Array, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of distinct words, each with a space before it unless it is the first of a stretch, and how many each has."""
        if first or pc.any(pc.match_substring(words, " ")).as_py():
            found = [_PRE_TOKEN.findall(x if first else " " + x) for x in words.to_pylist()]
            sizes, pieces = np.array(list(map(len, found)), dtype=np.int64), pa.array(itertools.chain.from_iterable(found), pa.string())
        else:  # a space before each word settles what is before it, so all of them can be read as one text
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
            pieces = pa.array(_PRE_TOKEN.findall(" " + joined) if len(words) else [], pa.string())
            begins = np.flatnonzero(pc.starts_with(pieces, " ").to_numpy(zero_copy_only=False))
            sizes = np.diff(np.append(begins, len(pieces)))
        coded = pieces.dictionary_encode()
        ids, counts = self.merged_together(*text_bytes(coded.dictionary))
        place = coded.indices.to_numpy().astype(np.int64)
        return _ranges(ids, _starts(counts)[place], counts[place]), np.diff(_starts(counts[place])[_starts(sizes)])

    def stretches(self, texts: list[str]) -> list[bytes]:
        """The tokens of texts that begin and end at ends of pre-tokens, each as little-endian 32-bit ids."""
        if not texts:
            return []
        if any(map(_ODD.search, texts)):
            split = pa.array(map(_SETTLED.split, texts), pa.list_(pa.string()))
        else:
            split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        every = split.flatten()
        is_first = np.zeros(len(every), dtype=bool)
        is_first[bounds[:-1]] = True
        sizes, starts, values = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), []
        for first in (True, False):
            own = np.flatnonzero(is_first == first)
            coded = every.take(pa.array(own)).dictionary_encode()
            ids, counts = self._words(coded.dictionary, first)
            place = coded.indices.to_numpy().astype(np.int64)
            sizes[own], starts[own] = counts[place], _starts(counts)[place] + sum(map(len, values))
            values.append(ids)
        out = _ranges(np.concatenate(values), starts, sizes).astype("<u4").tobytes()
        ends = 4 * _starts(sizes)[bounds]
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def resolved(self, rows: list[list[bytes | str]]) -> list[bytes]:
        """The tokens of each row of what encoders have let out: tokens, and stretches of text."""
        found = iter(self.stretches([x for row in rows for x in row if isinstance(x, str)]))
        return [b"".join(next(found) if isinstance(x, str) else x for x in row) for row in rows]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class Encoder:
    """Text comes in by feed() and ends with close(); both return what is settled since: tokens (as little-endian 32-bit ids) and stretches of text."""

    def __init__(self, table: MergeTable, block: int = BLOCK):
        self.table, self.block = table, block
        self.text = ""  # not settled yet
        self.run: regex.Pattern | None = None  # what goes on in a pre-token that is longer than a block
        self.piece = b""  # bytes of that pre-token that have no token yet

    def feed(self, chunk: str) -> list[bytes | str]:
        self.text += chunk
        out = []
        while self.table.added_in and (m := self.table.added_in.search(self.text)):
            rest = self.text[m.end() :]
            self.text = self.text[: m.start()]
            out += [*self._end(), self.table.added[m[0]].to_bytes(4, "little")]
            self.text = rest
        held = next((n for n in range(min(len(self.text), self.table.added_longest - 1), 0, -1) if self.text[-n:] in self.table.added_starts), 0)
        self.text, tail = (self.text[:-held], self.text[-held:]) if held else (self.text, "")
        out += self._go_on()
        self.text += tail
        return out

    def close(self) -> list[bytes | str]:
        return self._end()

    def _go_on(self) -> list[bytes | str]:
        out = [self._continued(False)] if self.run else []
        if self.run is None:
            if (cut := self._last_cut()) > 0:
                out.append(self.text[:cut])
                self.text = self.text[cut:]
            if len(self.text) > self.block:
                *settled, last = _PRE_TOKEN.finditer(self.text)
                if len(last[0]) < 4 and settled:
                    last = settled.pop()
                out += [_packed(self.table.merged(m[0].encode())) for m in settled]
                self.text = self.text[last.start() :]
                if len(self.text) > self.block:
                    self.run = next(r for r in _RUNS if r.match(last[0][-1]))
                    if last[0][0] == " " and self.run is not _RUNS[3]:
                        self.piece, self.text = b" ", self.text[1:]
                    out.append(self._continued(False))
        return out

    def _last_cut(self) -> int:
        at = self.text.rfind(" ")
        while at > 0 and (at + 1 == len(self.text) or self.text[at + 1].isspace()):
            at = self.text.rfind(" ", 0, at)
        return at

    def _continued(self, ends: bool) -> bytes:
        """Tokens of the long pre-token, as far as they are settled."""
        m = self.run.match(self.text)
        to = m.end() if m else 0
        over = to < len(self.text)
        if self.run is _RUNS[3] and to and (over or not ends):  # white space leaves its last character to what follows
            to -= 1
        self.piece += self.text[:to].encode()
        self.text = self.text[to:]
        over = over or ends
        ids = self.table.merged(self.piece)
        if over:
            self.run, self.piece = None, b""
        else:
            at, keep = 0, 0
            safe = len(self.piece) - self.table.lookahead
            for keep, i in enumerate(ids):  # noqa: B007
                if at + len(self.table.tokens[i]) > safe:
                    break
                at += len(self.table.tokens[i])
            ids, self.piece = ids[:keep], self.piece[at:]
        return _packed(ids)

    def _end(self) -> list[bytes | str]:
        out = [self._continued(True)] if self.run else []
        out += [self.text] if self.text else []
        self.text = ""
        return out


class Decoder:
    """Ids come in by feed(), as little-endian 32-bit numbers, and end with close(); both return text that is complete since."""

    def __init__(self, table: MergeTable):
        self.tokens = table.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def close(self) -> str:
        return self.state.decode(b"", True)


def encoded_blocks(table: MergeTable, text: str, block: int = BLOCK) -> Iterator[bytes]:
    """The tokens of one text, block by block."""
    encoder = Encoder(table, block)
    for at in range(0, len(text), block):
        yield table.resolved([encoder.feed(text[at : at + block])])[0]
    yield table.resolved([encoder.close()])[0]


def encoded_texts(table: MergeTable, texts: list[str | None], block: int = BLOCK) -> Iterator[Iterator[bytes]]:
    """The tokens of each text in turn; those of texts of one block are looked up together."""
    rows, short = [], []
    for i, text in enumerate(texts):
        if len(text or "") <= block:
            encoder = Encoder(table, block)
            rows.append([*encoder.feed(text or ""), *encoder.close()])
            short.append(i)
    found = dict(zip(short, table.resolved(rows), strict=True))
    for i, text in enumerate(texts):
        yield iter([found.pop(i)]) if i in found else encoded_blocks(table, text, block)


def _by_row(batches: Iterable[pa.RecordBatch], column: str, names: list[str], kinds: list[pa.DataType], made) -> Iterator[pa.RecordBatch]:
    """made: for a list of texts the new columns' values of each."""
    for batch in batches:
        for part in slices(batch, column, TEXTS):
            rows = list(made(part.column(column).to_pylist()))
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(kept + [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], part.schema.names[:-1] + names)


def _mapped(df: DataFrame, column: str, keep: list[str], out: list[tuple[str, T.DataType, pa.DataType]], made) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t, _ in out])
    names, kinds = [n for n, _, _ in out], [k for _, _, k in out]
    picked = df.select(*keep, df[column].alias("__read"))
    return picked.mapInArrow(lambda batches: _by_row(batches, "__read", names, kinds, made), schema)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str = "token_ids") -> DataFrame:
    """The columns `keep` and the token ids of each text as an array."""

    def made(texts):
        for blocks in encoded_texts(merge_table(path), texts):
            yield (np.frombuffer(b"".join(blocks), "<u4").tolist(),)

    return _mapped(df, text, keep or ["doc_id"], [(ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], made)


def decode(df: DataFrame, path: str, ids: str = "token_ids", keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` and the text of each array of token ids (null: empty)."""

    def made(x):
        decoder = Decoder(merge_table(path))
        return (decoder.feed(np.asarray(x or [], dtype="<u4").tobytes()) + decoder.close(),)

    wanted = keep or [c for c in df.columns if c != ids]
    schema = T.StructType([df.schema[c] for c in wanted] + [T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            rows = [made(x.as_py())[0] for x in batch.column("__read")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(rows, pa.string())], [*wanted, text])

    return df.select(*wanted, df[ids].alias("__read")).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Encodes and decodes each text block by block, and returns what both streams add up to.

    Columns: `keep`, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded text in UTF-8). No text's
    ids are ever held whole.
    """

    def made(texts):
        table = merge_table(path)
        for blocks in encoded_texts(table, texts, block):
            decoder, ids_sha, text_sha, n = Decoder(table), hashlib.sha256(), hashlib.sha256(), 0
            for ids in blocks:
                n += len(ids) // 4
                ids_sha.update(ids)
                text_sha.update(decoder.feed(ids).encode())
            text_sha.update(decoder.close().encode())
            yield n, ids_sha.hexdigest(), text_sha.hexdigest()

    out = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _mapped(df, text, keep or ["doc_id"], out, made)
