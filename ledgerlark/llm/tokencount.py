"""Operator 3: tokens per document, from counts per distinct pre-token.

A SentencePiece BPE model whose normaliser leaves texts as they are, and whose
pieces hold the word mark only as a run at their beginning, never merges across
the place between another character and a word mark. So a text falls into
pre-tokens (a run of spaces and what follows up to the next space) whose counts
add up. `checked_model` refuses any other model.

The work, whose parts are all by distinct pre-token:

1. count how often each pre-token occurs, partially in each task;
2. count the pieces of each distinct pre-token once, into a written table;
3. read the documents again; pre-tokens of the `DICTIONARY` most frequent ones
   (a broadcast of that many short strings at most) are added up in place, the
   rest becomes rows (document, pre-token, frequency), joined to the table and
   summed. Frequent keys are in the dictionary, so the join has no hot key.

Pre-tokens of more than `LONG` characters are counted where they stand. Ids are
never materialised, and texts are worked on a slice of a few MB (or one longer text)
at a time. Null texts count as empty; empty texts have no tokens. Rows
that repeat id and text are each returned; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.bytewords import slices
from ledgerlark.llm.scratch import written

#: Most entries of the broadcast dictionary, and characters of a pre-token there and in the table: 13 million characters at most.
DICTIONARY, LONG = 200_000, 64
#: Distinct pre-tokens that a task holds before it passes its counts on.
HELD = 200_000
_MARK = "▁"
_RUN = re.compile(r" +[^ ]*")


@lru_cache(maxsize=4)
def checked_model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and _MARK in model.id_to_piece(i).lstrip(_MARK):
            raise ValueError(f"the piece {model.id_to_piece(i)!r} crosses a word's end")
    if len(model.encode(_MARK)) != 1 or model.normalize(" a  b ") != "▁▁a▁▁b▁":
        raise ValueError("the model's normaliser changes texts")
    return model


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first word mark, which the model puts before every text."""
    if not text:
        return []
    text = text.replace(_MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [m[1:] for m in _RUN.findall(" " + text)]
    return text.split(" ")


def piece_counts(path: str, keys: list[str]) -> list[int]:
    """Pieces of each pre-token; the empty one is a word mark alone."""
    return [len(ids) if key else 1 for key, ids in zip(keys, checked_model(path).encode(keys, num_threads=1), strict=True)]


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out():
        return pa.RecordBatch.from_pydict({"pre_token": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text"):
                seen.update(k for k in pre_tokens(text.as_py() or "") if len(k) <= LONG)
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()


def pre_token_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """A row for each distinct pre-token of at most LONG characters: pre_token, n (occurrences), pieces."""

    def counted(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(piece_counts(path, keys), pa.int64())], ["pre_token", "n", "pieces"])

    by_key = docs.select(docs[text].alias("text")).mapInArrow(_frequencies, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return by_key.mapInArrow(counted, "pre_token string, n long, pieces long")


def frequent(table: DataFrame, most: int) -> dict[str, int]:
    """Pieces of at most `most` of the most frequent pre-tokens: all that occur more often than some count.

    The count comes from a histogram of a few hundred classes, so no task or
    driver sorts or gathers more than what is returned.
    """
    scale = F.floor(F.log2("n") * 16)
    classes = table.groupBy(scale.alias("class")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("class")).collect()
    total, least = 0, None
    for c in classes:
        total += c.k
        if total > most:
            break
        least = c.least
    if least is None:
        return {}
    return {r.pre_token: r.pieces for r in table.filter(F.col("n") >= least).select("pre_token", "pieces").collect()}


def count_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens."""
    spark = docs.sparkSession
    table = written(pre_token_table(docs, path, text), "pre-tokens")
    known = spark.sparkContext.broadcast(frequent(table, DICTIONARY))

    def counted(batches):
        pieces = known.value.get
        some = list(known.value)[:4096] or [""]
        for part in (x for batch in batches for x in slices(batch, "text")):
            ids, marks, keys, values, own = [], [], [], [], []
            for doc, value in zip(part.column("doc_id"), part.column("text"), strict=True):
                x, doc = value.as_py() or "", doc.as_py()
                raw = x.encode()
                mark, total, rest = xxhash.xxh3_64_intdigest(raw) - 2**63, 0, []
                for key in pre_tokens(x):
                    if (n := pieces(key)) is not None:
                        total += n
                    elif len(key) > LONG:
                        total += piece_counts(path, [key])[0]
                    else:
                        rest.append(key)
                # what is counted already goes with the first row; without one, with a row of no occurrence
                rare = Counter(rest) or {some[mark % len(some)]: 0}
                ids += [doc] * len(rare)
                marks += [mark] * len(rare)
                keys += rare.keys()
                values += rare.values()
                own += [len(raw) << 32 | total] + [None] * (len(rare) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.string()), pa.array(values, pa.int32()), pa.array(own, pa.int64())], ["doc_id", "mark", "pre_token", "n", "own"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(counted, "doc_id long, mark long, pre_token string, n int, own long")
    joined = rows.join(table.select("pre_token", "pieces"), "pre_token", "left")
    total = F.coalesce(F.col("own").bitwiseAND(2**32 - 1), F.lit(0)) + F.coalesce(F.col("n") * F.col("pieces"), F.lit(0))
    by_doc = joined.groupBy("doc_id", "mark").agg(F.sum(total).alias("total"), F.max(F.shiftright("own", 32)).alias("n_bytes"), F.count("own").alias("rows"))
    each = by_doc.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select(F.col("doc_id").alias(doc_id), "n_bytes", F.expr("total div rows").alias("n_tokens"))
