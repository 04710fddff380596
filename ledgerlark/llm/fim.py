"""Operator 13: fill-in-middle documents.

A text is cut into units (white space and the word behind it; white space at the
end is a unit of its own), two hashed numbers of units bound the middle, and the
parts are put behind sentinels in one of two orders.

Units are never listed. A text is looked at in blocks of `BLOCK` bytes, whose
numbers of unit ends and of code points are the leaves of a Fenwick tree. The
trees of all texts of a slice are built level by level, and binary lifting takes
all cuts down their trees together: it finds the block of each cut and the code
points before it. The place inside that block is then looked up in its bytes.
Beside the text itself, a few bytes are held for each byte of a slice, which has
`SLICE` bytes or one longer text.

Null texts count as empty; they, and texts that hold a sentinel, are left plain,
as are those that the rate leaves out. A null id is hashed as an empty one. Rows
are independent, so ties, repeated rows and further columns change nothing, and
an empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.bytewords import NOT_SPACE, slices, text_bytes

#: What stands before prefix, suffix and middle (fixed values).
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of a leaf of a tree.
BLOCK = 1024


class UnitTrees:
    """The Fenwick trees of several texts, given by text_bytes()."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        sizes = np.diff(offsets)
        self.block, self.offsets = block, offsets
        self.leaves = -(-sizes // block)
        self.first = np.concatenate([[0], np.cumsum(self.leaves)])  # node i of text k is at first[k] + i - 1
        word = NOT_SPACE[data]
        #: Last bytes of units, and first bytes of code points.
        self.ends = word.copy()
        self.ends[:-1] &= ~word[1:]
        some = np.flatnonzero(sizes)
        self.ends[offsets[some + 1] - 1] = True
        self.begins = (data & 0xC0) != 0x80

        of = np.repeat(np.arange(len(sizes)), self.leaves)
        at = np.arange(len(of)) - self.first[of]
        starts = offsets[of] + at * block
        count = lambda flags: np.add.reduceat(flags.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        self.units, self.chars = count(self.ends), count(self.begins)
        self.n = np.bincount(of, self.units, len(sizes)).astype(np.int64)
        at, most, step = at + 1, self.leaves[of], 1
        while step < (int(self.leaves.max()) if len(sizes) else 0):
            here = np.flatnonzero((at & (2 * step - 1) == step) & (at + step <= most))
            self.units[here + step] += self.units[here]
            self.chars[here + step] += self.chars[here]
            step *= 2

    def cut(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in its text (bytes, code points) each of the first k units ends; 0 where k is 0."""
        leaf, left, chars = np.zeros(len(k), np.int64), k.astype(np.int64), np.zeros(len(k), np.int64)
        step = 1 << max(0, (int(self.leaves.max()) if len(self.leaves) else 0).bit_length() - 1)
        while step:
            to = leaf + step
            inside = to <= self.leaves[text]
            node = np.where(inside, self.first[text] + to - 1, 0)
            go = inside & (self.units[node] < left) if len(self.units) else inside
            left[go] -= self.units[node[go]]
            chars[go] += self.chars[node[go]]
            leaf[go] = to[go]
            step //= 2
        places = np.zeros(len(k), np.int64)
        for i in np.flatnonzero(k).tolist():
            a = int(self.offsets[text[i]] + leaf[i] * self.block)
            b = min(a + self.block, int(self.offsets[text[i] + 1]))
            end = a + int(np.flatnonzero(self.ends[a:b])[left[i] - 1]) + 1
            chars[i] += int(self.begins[a:end].sum())
            places[i] = end - self.offsets[text[i]]
        chars[k == 0] = 0
        return places, chars


def _transformed(block: int, sentinels: tuple[str, str, str]):
    p, s, m = (x.encode() for x in sentinels)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                trees = UnitTrees(data, offsets, block)
                every = np.arange(part.num_rows)
                picked = np.sort([part.column(c).to_numpy() % (trees.n + 1) for c in ("h1", "h2")], axis=0)
                places, chars = trees.cut(np.tile(every, 2), picked.reshape(-1))
                out, forms = [], part.column("form").to_pylist()
                for i, form in enumerate(forms):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    a, b = int(places[i]), int(places[i + len(every)])
                    if form == PSM:
                        raw = b"".join([p, raw[:a], s, raw[b:], m, raw[a:b]])
                    elif form == SPM:
                        raw = b"".join([s, raw[b:], p, raw[:a], m, raw[a:b]])
                    out.append(raw)
                plain = np.array([f == PLAIN for f in forms], dtype=bool)
                before, upto = chars[: len(every)], chars[len(every) :]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(trees.n), part.column("form"), pa.array(before, mask=plain), pa.array(upto - before, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, percent_spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output."""
    if len(set(sentinels)) < 3 or not all(re.fullmatch("<[^<>]+>", x) for x in sentinels):
        raise ValueError("sentinels are three different texts of the form <...>")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[doc_id].cast("string"), F.lit(""))), 256)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), key.alias("key"))
    number = lambda i: F.conv(F.substring("key", 8 * i + 1, 8), 16, 10).cast("long")
    held = F.col("text") == ""
    for x in sentinels:
        held = held | F.contains("text", F.lit(x))
    form = F.when(held | (number(2) % 100 >= percent), PLAIN).when(number(3) % 100 < percent_spm, SPM).otherwise(PSM)
    rows = rows.select("doc_id", "text", number(0).alias("h1"), number(1).alias("h2"), form.alias("form"))
    out = rows.mapInArrow(_transformed(block, sentinels), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("doc_id", doc_id)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from a transformed one and its form."""
    p, s, m = (F.instr(output, F.lit(x)) for x in sentinels)
    size = {k: len(x) for k, x in zip("psm", sentinels, strict=True)}
    part = lambda a, k, b: F.substr(output, a + size[k], b - a - size[k])
    middle = F.substr(output, m + size["m"])
    psm = F.concat(part(F.lit(1), "p", s), middle, part(s, "s", m))
    spm = F.concat(part(p, "p", m), middle, part(F.lit(1), "s", p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
