"""Each operator against a brute-force version, over texts with all awkward cases."""

import bisect
import functools
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import alignment, bpe, bytewords, chat, components, decontam, exactdedup, fim, mixing, neardup, quality, runningsums, sharding, tokencount, tokenshards, toxicity
from ledgerlark.llm.queries import BYTE_BPE, ORACLES, PIECE_BPE, QUERIES
from tests.oracle import assert_same

LONG = "Lorem ipsum dolor sit amet, " * 3000 + "x" * 70_000 + "  end"
TEXTS = [
    None, "", " ", "\n", "a", "A", "one two", "one two", "one  two three. Four!", "é à ü ñ 日本語 text", "a\tb\nc\x0bd", "▁odd▁ mark", "<s>[INST] x [/INST]</s>", "<|endoftext|>", "it's we'll DON'T 123 4567", "tail  ", "  head", "\x00nul", "😀😀 emoji",
    "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven", LONG, LONG,
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words bigint, keep_id string, k0 int, shard int"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None if i % 3 else "en", f"s{i % 2}" if i % 5 else None, 7, "x", 1, 3) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, TEXTS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# operator 6
@functools.lru_cache(maxsize=1)
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def encoded(text):
    return byte_bpe().encode(text or "", add_special_tokens=False).ids


def test_bpe_is_the_librarys(docs):
    got = by_id(bpe.round_trip(docs, BYTE_BPE))
    for i, t in enumerate(TEXTS):
        ids = encoded(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_tables(docs, spark):
    ids = bpe.encode(docs, BYTE_BPE, keep=["doc_id", "source"])
    assert by_id(ids)[8].token_ids == encoded(TEXTS[8])
    assert {r.doc_id: r.text for r in bpe.decode(ids, BYTE_BPE).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(docs.limit(0), BYTE_BPE).count() == 0


@pytest.mark.parametrize("block", [3, 17, 64, 4096])
def test_bpe_blocks(block):
    from tokenizers import Tokenizer

    library, table = Tokenizer.from_file(BYTE_BPE), bpe.merge_table(BYTE_BPE)
    rng = np.random.default_rng(block)
    parts = ["a", "the", "th", "e", " ", "  ", "\n", "'", "'s", "re", "1", "!", "...", "é", "日本", "　", "\x1c", "<|endoftext|>", "<|endof", "text|>", "aaaaaaaa" * 5, "0" * 30, " " * 40, "-" * 50]
    for n in range(150):
        pick = parts if n % 3 else list(rng.choice(parts, 2))
        text = "".join(rng.choice(pick, rng.integers(0, 200)))
        got = np.frombuffer(b"".join(bpe.encoded_blocks(table, text, block)), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_lookahead_is_enough():
    table = bpe.merge_table(BYTE_BPE)
    rng = np.random.default_rng(3)
    for _ in range(300):
        whole = bytes(rng.choice(list(b"aeinrst"), 2000))
        cut = int(rng.integers(800, 1500))
        ids, at = table.merged(whole[:cut]), 0
        safe = []
        for i in ids:
            at += len(table.tokens[i])
            if at > cut - table.lookahead:
                break
            safe.append(i)
        assert table.merged(whole)[: len(safe)] == safe


# operator 3
def test_token_counts_are_the_librarys(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = by_id(tokencount.count_tokens(docs, PIECE_BPE))
    for i, t in enumerate(TEXTS):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(library.encode(t or ""))), t


def test_token_counts_by_join(docs, monkeypatch):
    whole = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, PIECE_BPE).collect()}
    monkeypatch.setattr(tokencount, "DICTIONARY", 1)  # all but one pre-token go by the join
    twice = docs.union(docs)
    got = tokencount.count_tokens(twice, PIECE_BPE).collect()
    assert len(got) == 2 * len(TEXTS) and all(r.n_tokens == whole[r.doc_id] for r in got)
    assert tokencount.count_tokens(docs.limit(0), PIECE_BPE).count() == 0


def test_token_counts_of_a_long_text_among_short_ones(spark, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    texts = [f"short text number {i}" for i in range(300)] + [" ".join(f"w{i % 5000}" for i in range(60_000)), None, "tail"]
    parts = []
    monkeypatch.setattr(tokencount, "slices", lambda batch, column: (parts.append(x.num_rows) or x for x in bytewords.slices(batch, column, 4096)))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    counts = {}
    for out in tokencount._frequencies(iter([batch])):
        for k, n in zip(out.column("pre_token").to_pylist(), out.column("n").to_pylist(), strict=True):
            counts[k] = counts.get(k, 0) + n
    assert max(parts) < 300 and 1 in parts and counts["w7"] == 12 and counts["short"] == 300
    monkeypatch.undo()
    got = by_id(tokencount.count_tokens(docs_of(spark, texts).coalesce(1), PIECE_BPE))
    assert [got[i].n_tokens for i in range(len(texts))] == [len(model.encode(t or "")) for t in texts]


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        tokencount.checked_model(BYTE_BPE)


# operator 5
def brute_groups(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    return {i: (max(g), len(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("hashed", [exactdedup._hash, lambda chunk: len(chunk) % 3, lambda chunk: 0])
def test_exact_duplicates(docs, hashed):
    got = by_id(exactdedup.exact_duplicates(docs, hashed=hashed))
    want = brute_groups(TEXTS)
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {i: (*x, x[0] == i) for i, x in want.items()}
    assert all(got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS))


def test_exact_duplicates_of_nothing_and_of_repeats(docs, spark):
    assert exactdedup.exact_duplicates(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id bigint, text string")
    got = sorted((r.text_sha256[:1], r.doc_id or 0, r.group_size, r.kept) for r in exactdedup.exact_duplicates(rows).collect())
    assert sorted(x[1:] for x in got) == [(0, 1, True), (0, 3, False), (1, 3, True), (1, 3, True)]


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8)
    moved = np.concatenate([data[:1000], np.array([1, 2, 3], np.uint8), data[1000:]])
    a, b = exactdedup.cuts(data), exactdedup.cuts(moved)
    assert a[-1] == len(data) and b[-1] == len(moved) and len({x + 3 for x in a} & set(b)) > 0.9 * len(a)
    assert max(np.diff([0, *exactdedup.cuts(np.zeros(100_000, np.uint8))])) <= exactdedup.MOST


# operator 7
def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(texts, n):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def copies(rng, base, count, edits):
    words = [f"w{x}" for x in rng.integers(0, 10**6, base)]
    for _ in range(count):
        own = list(words)
        for at in rng.integers(0, base, rng.integers(0, edits + 1)):
            own[at] = f"e{rng.integers(0, 10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, spark, n):
    rng = np.random.default_rng(n)
    texts = TEXTS[:-2] + list(copies(rng, 120, 150, 14)) + list(copies(rng, 60, 40, 4)) + list(copies(rng, 12, 20, 2)) + list(copies(rng, 400, 30, 90))
    got = by_id(neardup.near_duplicates(docs_of(spark, texts), words=n))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute_components(texts, n)


def test_near_duplicates_by_the_exact_rest(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FIRST", 1)
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "NEAR", 1)
    texts = list(copies(np.random.default_rng(9), 100, 120, 12))
    got = by_id(neardup.near_duplicates(docs_of(spark, texts), words=2))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute_components(texts, 2)


def test_large_regions_meet_in_pieces(spark, monkeypatch):
    texts = list(copies(np.random.default_rng(9), 100, 120, 12))
    monkeypatch.setattr(neardup, "PIECE", 7)
    for name in ("FIRST", "NEAR"):
        monkeypatch.setattr(neardup, name, 1)
    monkeypatch.setattr(neardup, "SMALL", 2)
    rest, seen = neardup._rest, []
    monkeypatch.setattr(neardup, "_rest", lambda members, *a: seen.append(members.count()) or rest(members, *a))
    got = by_id(neardup.near_duplicates(docs_of(spark, texts), words=2))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute_components(texts, 2) and seen[0] > 7


def test_pairs_of_a_small_region_are_all_confirmed(spark):
    members = spark.createDataFrame([(1, 0, i, 10, i, bytes([i] * 128), [7] * 32) for i in (5, 6)], "region long, tree int, node long, n long, component long, sketch binary, prefixes array<long>")
    assert [(r.a, r.b) for r in neardup._between_components(members, 80).collect()] == [(5, 6)]


def test_near_duplicates_of_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [long, long + " end", long.replace("w5 ", "v5 "), "w1 w2", LONG, LONG + " and more", "x" * 90_000, long[: len(long) // 2]]
    got = by_id(neardup.near_duplicates(docs_of(spark, texts)))
    assert {i: tuple(r)[1:] for i, r in got.items()} == brute_components(texts, 5)
    assert [got[i].component_id for i in range(4)] == [0, 0, 0, 3] and got[0].n_shingles == 29_996


def test_pairs_at_the_threshold_are_all_found(spark):
    """1,200 pairs whose similarity is exactly 0.8, and none besides."""
    texts = []
    for k in range(1200):
        both, own = [f"w{k}x{i}" for i in range(80)], [[f"{x}{k}y{i}" for i in range(10)] for x in "ab"]
        texts += [" ".join(both + own[0]), " ".join(own[1] + both)]
    got = by_id(neardup.near_duplicates(docs_of(spark, texts), words=1))
    assert all(got[2 * k].component_id == got[2 * k + 1].component_id == 2 * k for k in range(1200))


def test_a_hot_region_is_dealt_out_before_it_is_ordered(spark, monkeypatch):
    """With a third of all sets in one region of a tree, parts of it are ordered apart, also without broadcasts."""
    monkeypatch.setattr(neardup, "ORDERED", 20)
    rows = [(i, 10, [7 if tree == 0 and i % 3 == 0 else 1_000 + (i // 2) * (tree + 1) for tree in range(neardup.TREES)]) for i in range(600)]
    sets = spark.createDataFrame(rows, "node bigint, n bigint, prefixes array<bigint>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = neardup.in_order(sets)
        plan = members._jdf.queryExecution().executedPlan().toString()
        got = members.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hot = [r for r in got if r.sets == 200]
    assert len(hot) == 200 and sum(not r.before for r in hot) == 10 and max(len(r.before) for r in hot) == neardup.NEAR
    assert {r.sets for r in got if r not in hot} <= {2} and all(r.first == min(x.node for x in got if x.region == r.region) for r in hot)
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("part" in line.split("hashpartitioning(")[1].split(")")[0] and "region" in line.split("hashpartitioning(")[1] for line in exchanges)


def test_near_duplicates_of_nothing_and_without_ids(docs, spark):
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "A b  C"), (9, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(rows, words=2).collect())
    assert got == [(0, None, True), (3, 3, True), (3, 3, True), (5, 3, False), (9, 9, True)]


@pytest.mark.parametrize("finish", [components.FINISH, 0, 60])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(components, "FINISH", finish)
    path = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)] + [(900, x) for x in range(901, 960)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert set(got) == {*range(201), 500, 501, *range(900, 960)}
    assert all(c == (0 if v <= 200 else 500 if v < 600 else 900) for v, c in got.items())
    found = components.components(spark.createDataFrame(path, "a bigint, b bigint"))
    more = components.extended(found, spark.createDataFrame([(150, 501), (77, 960), (960, 961), (1, 2)], "a bigint, b bigint"))
    wider = {r.node: r.component for r in more.collect()}
    assert set(wider) == {*got, 77, 960, 961} and all(c == (0 if v <= 501 else 900 if v < 960 else 0) for v, c in wider.items() if v not in (77, 960, 961))
    assert wider[77] == wider[960] == wider[961] == 0 and len(wider) == more.count()


# operator 8
def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(texts, items, size):
    grams = {}
    for i, t in items:
        w = alnum(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = alnum(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out[d] = (len(w), len(hit), sorted(found))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Short ITEM"), (3, None), (4, "..."), (10, "short item"), (10, "b c d e f g h i j k l m n o")]
SUSPECTS = TEXTS + ["x one two three four five six seven eight nine ten eleven twelve thirteen fourteen y", "short, item short item and more", "a b c d e f g h i j k l m n o p q", "ONE-TWO three four five six seven eight nine ten eleven twelve thirteen"]


@pytest.mark.parametrize("limit", [decontam.BROADCAST, 900])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST", limit)  # 900 bytes: several blocks
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = docs_of(spark, SUSPECTS)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.scan(rows, bench).collect()}
    want = brute_hits(SUSPECTS, ITEMS, 13)
    assert got == want
    twice = rows.union(rows)
    assert sorted((r.doc_id, r.n_hit) for r in decontam.scan(twice, bench).collect()) == sorted((d, x[1]) for d, x in want.items() for _ in range(2))
    left = decontam.without_documents(rows, bench)
    assert left.columns == rows.columns
    assert {r.doc_id for r in left.collect()} == {d for d, (n, h, _) in want.items() if not (h and 20 * h >= n)}


def test_spans_are_cut(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = docs_of(spark, SUSPECTS)
    got = {r.doc_id: r.text for r in decontam.without_spans(rows, bench).collect()}
    assert got[len(TEXTS)] == "x  y" and got[len(TEXTS) + 1] == " and more" and got[0] is None and got[8] == TEXTS[8]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.scan(rows, none).filter("n_hit > 0").count() == 0 and decontam.scan(rows.limit(0), bench).count() == 0


# operator 9 and 10
def marked(rng, n):
    rows = []
    for i in range(n):
        words = [f"word{x}" for x in rng.integers(0, 300, rng.integers(5, 60))]
        toxic = i % 7 == 0
        if toxic:
            for at in rng.integers(0, len(words), 3):
                words[at] = str(rng.choice(["idiot", "grumzel", "grumzelig", "moron"]))
        rows.append((i, " ".join(words) if i % 11 else " ".join(words) + " $$$ ### @@@ %%%" * 8, int(i % 11 > 0), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = marked(np.random.default_rng(4), 900)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t, _, _ in rows] + [(10_000, None, None, None), (10_001, "", "", "")], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels, rows


def test_toxicity(labelled):
    docs, labels, rows = labelled
    got = by_id(toxicity.toxicity(docs, labels))
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(i, t) for i, _, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == t for i, t in held]) > 0.97
    assert got[10_000].predicted == got[10_001].predicted == 0


def test_toxicity_looks_at_texts_only(labelled, spark):
    docs, labels, rows = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = by_id(toxicity.toxicity(docs, labels)), by_id(toxicity.toxicity(docs.withColumn("lang", F.lit("q")), flipped))
    assert all(abs(a[i].score - b[i].score) < 1e-9 for i in a)


def test_toxicity_without_labels_or_rows(labelled):
    docs, labels, _ = labelled
    got = by_id(toxicity.toxicity(docs, labels.limit(0)))
    assert got[10_000].predicted == 0 and sum(r.predicted for r in got.values()) > 20
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    accuracy = np.array([0.95, 0.9, 0.8, 0.8, 0.55])
    right = rng.random((20_000, 5)) < accuracy
    right[:, 3] = right[:, 2]  # two voters that are one
    votes = np.where(right == truth[:, None], "+", "-")
    patterns, place, counts = np.unique(["".join(v) for v in votes], return_inverse=True, return_counts=True)
    labels = np.arange(20_000) < 400
    marks = [np.bincount(place[labels & (truth == k)], minlength=len(patterns)) for k in (True, False)]
    q = toxicity.label_model(list(patterns), counts.astype(float), *marks)
    assert np.mean((q[place] > 0.5) == truth) > 0.95


def test_labels_weigh_alike_at_every_size():
    patterns = ["".join(v) for v in itertools.product("+-", repeat=3)]
    toxic, clean = np.array([40, 30, 25, 5, 20, 4, 3, 1.0]), np.array([2, 3, 5, 30, 4, 40, 50, 90.0])
    counts = np.array([3, 2, 90, 200, 80, 150, 170, 60.0])
    small, large = (toxicity.label_model(patterns, counts * k, toxic, clean) for k in (1e3, 1e7))
    assert np.abs(small - large).max() < 0.01


def test_one_row_of_a_labelled_id(labelled, spark, monkeypatch):
    docs, labels, rows = labelled
    of = next(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5)
    more = spark.range(400).select(F.lit(of).alias("doc_id"), F.concat(F.lit("again "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s0").alias("source"))
    every = docs.unionByName(more)
    usable = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, *_ in rows)
    sample = toxicity.sample_of(every, labels).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == usable
    assert [r.text for r in sample if r.doc_id == of] == [r.text for r in toxicity.sample_of(every.repartition(7), labels).collect() if r.doc_id == of]
    fitted, seen = quality._fitted, []
    monkeypatch.setattr(quality, "_fitted", lambda df: seen.append(df.count()) or fitted(df))
    assert quality.quality(every, labels).count() == 1302 and seen == [usable]


def test_quality(labelled):
    docs, labels, rows = labelled
    got = by_id(quality.quality(docs, labels))
    held = [(i, q) for i, _, q, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 902 and np.mean([got[i].predicted == q for i, q in held]) > 0.97
    assert got[10_000].host is None and got[10_001].host == ""
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).select("p_text").distinct().count() == 1


def test_sparse_sites_are_shrunk(labelled, spark):
    _, labels, rows = labelled
    bad, good = next(t for i, t, q, _ in rows if not q), next(t for i, t, q, _ in rows if q and i % 7)
    texts = [("bad", "p", bad)] * 200 + [("good", "p", good)] * 200 + [("bad", "new", good), ("good", "new", good), ("other", "new", good)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id bigint, text string").withColumn("source", F.lit("train")).withColumn("lang", F.lit("train"))
    more = spark.createDataFrame([(5000 + k, t, h, p) for k, (h, p, t) in enumerate(texts)], "doc_id bigint, text string, source string, lang string")
    got = by_id(quality.quality(docs.unionByName(more), labels))
    alone = [got[5400 + k].score for k in range(3)]
    assert alone[0] < alone[2] <= alone[1]


def test_site_posteriors_are_what_is_described(labelled, spark):
    """Hosts and paths that differ, against the description worked out in Python."""
    _, labels, rows = labelled
    rng = np.random.default_rng(6)
    good, bad = [t for _, t, q, _ in rows if q], [t for _, t, q, _ in rows if not q]
    more = []
    for h in range(12):
        for p in range(int(rng.integers(1, 5))):
            rate = np.clip(0.5 + (h - 6) / 20 + rng.normal(0, 0.15), 0, 1)
            for _ in range(int(rng.integers(1, 30))):
                pick = good if rng.random() < rate else bad
                more.append((f"h{h}", f"/p{p}" if p else None, pick[int(rng.integers(0, len(pick)))]))
    docs = spark.createDataFrame([(i, t, "train", "/") for i, t, _, _ in rows] + [(5000 + k, t, h, p) for k, (h, p, t) in enumerate(more)], "doc_id bigint, text string, host string, path string")
    got = quality.quality(docs.union(docs.filter("doc_id = 5003")), labels, host="host", path="path").collect()  # a repeated row counts twice
    p, site = np.array([r.p_text for r in got]), [(r.host, r.path) for r in got]
    groups = lambda keys: {k: p[[i for i, x in enumerate(keys) if x == k]] for k in set(keys)}

    def weight(own, parent_of, parents):
        n, k = len(p), len(own)
        inside = sum(((x - x.mean()) ** 2).sum() for x in own.values()) / (n - k)
        between = sum(len(x) * (x.mean() - parent_of(key)[0]) ** 2 for key, x in own.items()) - (k - parents) * inside
        spread = n - sum(len(x) ** 2 / parent_of(key)[1] for key, x in own.items())
        return min(1e6, max(1.0, inside / (between / spread))) if between > 0 else 1e6

    hosts, paths, mean = groups([h for h, _ in site]), groups(site), p.mean()
    m_host = weight(hosts, lambda key: (mean, len(p)), 1)
    m_path = weight(paths, lambda key: (hosts[key[0]].mean(), len(hosts[key[0]])), len(hosts))
    assert 1 < m_host < 1e3 and 1 < m_path < 1e4
    for r in got:
        h, q = hosts[r.host], paths[r.host, r.path]
        p_host = (h.sum() - r.p_text + m_host * mean) / (len(h) - 1 + m_host)
        p_path = (q.sum() - r.p_text + m_path * p_host) / (len(q) - 1 + m_path)
        z = np.log(r.p_text / (1 - r.p_text)) - np.log(mean / (1 - mean)) + np.log(p_path / (1 - p_path))
        assert (r.p_host, r.p_path, r.score) == pytest.approx((p_host, p_path, 1 / (1 + np.exp(-z))), rel=1e-6)


def test_page_rows(spark):
    pages = [(0, "HTTP://Www.A.example/en/x/12.html?q=1#t", "<html><script>var a='<p>';</script><body><p>One &amp; two</p><!-- no --><b>three</b></body></html>"), (1, "http://b.example/", ""), (2, None, None), (3, "no url at all", "<p>")]
    got = {r.doc_id: (r.host, r.path, r.text) for r in quality.page_rows(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[-1][:2] == ("www.a.example", "/en/x") and " ".join(got[-1][2].split()) == "One & two three"
    assert got[-2] == ("b.example", "", "") and got[-3] == (None, None, None) and got[-4][0] is None


def test_quality_and_toxicity_of_awkward_rows(labelled, docs, spark):
    _, labels, _ = labelled
    wide = labels.selectExpr("doc_id", "cast(quality as bigint) quality", "cast(toxic as string) toxic", "'x' text", "'x' source")
    every = docs.union(docs).withColumn("score", F.lit("x")).withColumn("p", F.lit("x"))
    for rows in (quality.quality(every, wide).collect(), toxicity.toxicity(every, wide).collect()):
        assert len(rows) == 2 * len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
        scores = {}
        for r in rows:
            scores.setdefault(r.doc_id, set()).add(round(r.score, 9))
        assert all(len(x) == 1 for x in scores.values())  # repeated rows score alike
    left = toxicity.without_toxic(every, wide)
    assert left.columns == every.columns and left.count() > len(TEXTS)


def test_label_model_against_one_row_at_a_time():
    """Expectation maximisation over single rows instead of patterns, with each step written out."""
    rng = np.random.default_rng(5)
    votes = ["".join(rng.choice(list("-0+"), 3, p=[0.6, 0.1, 0.3])) for _ in range(60)]
    label = [int(rng.integers(0, 2)) if i < 12 else None for i in range(60)]
    patterns = sorted(set(votes))
    counts = np.array([votes.count(x) for x in patterns], float)
    marks = [np.array([sum(v == x and y == k for v, y in zip(votes, label, strict=True)) for x in patterns], float) for k in (1, 0)]
    got = dict(zip(patterns, toxicity.label_model(patterns, counts, *marks, rounds=3), strict=True))
    known = [y for y in label if y is not None]
    weight, share = 60 / max(1.0, 4 * len(known)), (sum(known) + 1) / (len(known) + 2)
    q = {}
    for x in patterns:
        own = [y for v, y in zip(votes, label, strict=True) if v == x and y is not None]
        q[x] = (sum(own) + share) / (len(own) + 1) if own else 1 / (1 + np.exp(-2 * (x.count("+") - 0.25 * x.count("-"))))
    for _ in range(3):
        rows = [(v, 1 - q[v], q[v]) for v in votes] + [(v, weight * (1 - y), weight * y) for v, y in zip(votes, label, strict=True) if y is not None]
        one_hot = np.eye(3)[[["-0+".index(c) for c in x] for x in patterns]]
        parent = toxicity._tree(one_hot, np.array([[sum(r[1 + k] for r in rows if r[0] == x) for x in patterns] for k in (0, 1)]))
        new = {}
        for x in patterns:
            logs = [np.log(1 - share), np.log(share)]
            for k in (0, 1):
                for j, pa_ in enumerate(parent):
                    at = lambda v, j=j: v[j]
                    alike = [r for r in rows if pa_ < 0 or r[0][pa_] == x[pa_]]
                    logs[k] += np.log((sum(r[1 + k] for r in alike if at(r[0]) == x[j]) + 0.5) / (sum(r[1 + k] for r in alike) + 1.5))
            new[x] = 1 / (1 + np.exp(logs[0] - logs[1]))
        q = new
    assert all(abs(got[x] - q[x]) < 1e-9 for x in patterns)


# operator 4
def test_stratified_shards(docs, spark):
    rows = docs_of(spark, [f"t{i % 40}" for i in range(500)] + TEXTS)
    n, shards = 500 + len(TEXTS), 7
    got = sharding.stratified_shards(rows, shards, seed=3).collect()
    assert sorted(r.position for r in got) == list(range(n))
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
    assert set(per) == set(range(shards)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    for own in per.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for s in {r.source for r in got}:
        counts = [sum(r.source == s for r in own) for own in per.values()]
        assert max(counts) - min(counts) <= 2
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert sharding.stratified_shards(docs.limit(0), 3).count() == 0 and sharding.stratified_shards(docs.limit(1), 3).count() == 1


def test_ranks_by_cells(spark, monkeypatch):
    rows = docs_of(spark, [f"t{i}" for i in range(300)])
    whole = {r.doc_id: r.position for r in sharding.stratified_shards(rows, 4, seed=1).collect()}
    monkeypatch.setattr(sharding, "CELL", 4)
    assert {r.doc_id: r.position for r in sharding.stratified_shards(rows, 4, seed=1).collect()} == whole


def test_shards_with_many_sources_of_a_row(spark):
    sources = ["large"] * 800 + [f"single{i}" for i in range(1600)]
    rows = spark.createDataFrame([(i, f"t{i}", x) for i, x in enumerate(sources)], "doc_id bigint, text string, source string")
    per = np.zeros(24, int)
    for r in sharding.stratified_shards(rows, 24, seed=7).collect():
        per[r.shard] += r.source == "large"
    assert per.sum() == 800 and per.min() >= 20 and per.max() <= 47


# operator 2
def chat_bytes(role, text):
    for plain, code in chat._CODES:
        role, text = role.replace(plain, code), text.replace(plain, code)
    return len(f"{chat.BEGIN}{role.replace(*chat._LINE)}\n{text}{chat.END}\n".encode())


def test_chat_windows(spark):
    rng = np.random.default_rng(2)
    words = ["hello", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>\n", "\x1b", "\x1ba", "x\ny", "é", "<|en", "d|>"]
    turns = []
    for conv in range(12):
        for t in range(int(rng.integers(1, 60))):
            role = "system" if t == 0 and conv % 2 else ["user", "assistant"][t % 2]
            text = None if rng.random() < 0.1 else " ".join(rng.choice(words, rng.integers(0, 40)))
            turns.append((conv, t, role, text, 0))
    turns += [(100, 0, "assistant", "same", 0), (100, 0, "assistant", "same", 0), (101, None, None, None, 0), (None, 1, "ro\nle", "t", 0)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, window int")
    windows = chat.chat_windows(df, budget=800, history=160)
    read = windows.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("targets", chat.read_targets(F.col("formatted"), F.col("loss_spans"))).collect()
    for conv in {t[0] for t in turns}:
        own = sorted((r for r in read if r.conv_id == conv), key=lambda r: r.window)
        want = [(r or "", x or "") for c, _, r, x, _ in turns if c == conv]
        assert [(t.role, t.text) for r in own for t in r.turns[r.n_repeated :]] == want
        assert [t for r in own for t in r.targets] == [x for r, x in want if r == "assistant"]
        for r in own:
            assert r.tokens <= 800 or len(r.turns) - r.n_repeated == 1
            if want[0][0] == "system":
                assert r.turns[0].role == "system"
    assert any(r.n_repeated > 1 for r in read)
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_chat_windows_keep_within_the_budget(spark):
    rng = np.random.default_rng(5)
    turns = []
    for conv, system in enumerate([0, 0, 0, 20, 60, 110, 120, 140, 155, 165, 180, 195, 210]):
        sizes = [system] * (system > 0) + [int(rng.integers(150, 197)) if k % 6 == 5 else int(rng.integers(4, 30)) for k in range(80)]
        at = 3 * (conv % 2) if system else 0
        sizes = sizes[1 : at + 1] + sizes[:1] + sizes[at + 1 :]
        for k, n in enumerate(sizes):
            role = "system" if system and k == at else ["user", "assistant"][k % 2]
            turns.append((conv, k, role, f"t{k}".ljust(10 * n - 17 - len(role), "a")))
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    read = chat.chat_windows(df, budget=2000, history=400).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    tokens = lambda t: len(f"{chat.BEGIN}{t.role}\n{t.text}{chat.END}\n")
    for conv in {t[0] for t in turns}:
        own = sorted((r for r in read if r.conv_id == conv), key=lambda r: r.window)
        assert [t.text for r in own for t in r.turns[r.n_repeated :]] == [x for c, _, _, x in turns if c == conv]
        for r in own:
            new, system = r.turns[r.n_repeated :], sum(tokens(t) for t in r.turns if t.role == "system")
            assert r.tokens == sum(map(tokens, r.turns))
            assert r.tokens <= 2000 or system >= 2000 or (len(new) == 1 and tokens(new[0]) + system * (new[0].role != "system") > 2000)
    assert any(len(r.turns) - r.n_repeated == 1 and r.n_repeated and 1800 <= r.tokens <= 2000 for r in read)


def test_chat_windows_keep_within_the_budget_in_real_tokens(spark, sf_dir):
    """With both tokenizers, over all conversations and texts without spaces."""
    import sentencepiece

    turns = [(c, t, r or "", x or "") for c, t, r, x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-2, k, ["user", "assistant"][k % 2], "\u4e2d\u6587\u5b57" * 30) for k in range(40)] + [(-3, k, ["user", "assistant"][k % 2], "</s>[INST]\x1b" * 8) for k in range(40)] + [(-4, 0, "user", "\U0001f600" * 700)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    read = chat.chat_windows(df, budget=512, history=96).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    over = 0
    for r in read:
        tokens = max(len(encoded(r.formatted)), len(piece.encode(r.formatted)) - 1)  # but for the space that the model adds
        assert tokens <= r.tokens == len(r.formatted.encode())
        new, system = r.turns[r.n_repeated :], [t for t in r.turns if t.role == "system"]
        bytes_of = lambda rows: sum(chat_bytes(t.role, t.text) for t in rows)
        assert tokens <= 512 or len(new) == 1 and bytes_of([*new, *[t for t in system if t not in new]]) > 512 or bytes_of(system) >= 512
        over += r.tokens > 512
    assert over < len(read) and any(r.conv_id == -2 for r in read)


def test_a_late_system_turn_and_given_tokens(spark):
    turns = [(1, k, "system" if k == 10 else ["user", "assistant"][k % 2], "x" * 9, 20) for k in range(30)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, pieces int")
    read = chat.chat_windows(df, budget=200, history=40, tokens="pieces").withColumn("turns", chat.read_turns(F.col("formatted"))).orderBy("window").collect()
    seen = 0
    for r in read:
        system = [k for k, t in enumerate(r.turns) if t.role == "system"]
        assert system == ([] if seen + len(r.turns) - r.n_repeated <= 10 else system) and (seen <= 10 or system), "only from its place on"
        assert r.tokens == 24 * len(r.turns) <= 200
        seen += len(r.turns) - r.n_repeated
    assert seen == 30 and len(read) > 4


def test_chat_of_long_texts(spark):
    turns = [(0, 0, "system", LONG), (0, 1, "user", LONG), (0, 2, "assistant", LONG), (0, 3, "assistant", "")]
    windows = chat.chat_windows(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), budget=512, history=96)
    read = windows.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("targets", chat.read_targets(F.col("formatted"), F.col("loss_spans"))).orderBy("window").collect()
    assert [t.text for r in read for t in r.turns[r.n_repeated :]] == [LONG, LONG, LONG, ""] and [t for r in read for t in r.targets] == [LONG, ""]


# operator 1
def test_token_shards(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    tokenshards.write_shards(docs, BYTE_BPE, folder, key=5, length=64, shard=50)
    got = tokenshards.read_shards(spark, BYTE_BPE, folder, length=64).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and len({r.shard for r in got}) > 3
    texts = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.sequence)):
        texts[r.doc_id] = texts.get(r.doc_id, []) + np.frombuffer(r.ids, "<u2").tolist()
    assert texts == {i: [*encoded(t), 50256] for i, t in enumerate(TEXTS)}
    late = tokenshards.read_shards(spark, BYTE_BPE, folder, length=64, start=100).collect()
    assert {(r.slot, r.doc_id, r.sequence) for r in late} == {(r.slot, r.doc_id, r.sequence) for r in got if r.slot >= 100}
    tokenshards.write_shards(docs.repartition(5), BYTE_BPE, folder + "2", key=5, length=64, shard=50)
    again = tokenshards.read_shards(spark, BYTE_BPE, folder + "2", length=64).collect()
    assert {(r.slot, r.doc_id, r.sequence) for r in again} == {(r.slot, r.doc_id, r.sequence) for r in got}


def test_token_shards_of_nothing(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    tokenshards.write_shards(docs.limit(0), BYTE_BPE, folder)
    assert tokenshards.read_shards(spark, BYTE_BPE, folder).count() == tokenshards.read_shards(spark, BYTE_BPE, folder, start=3).count() == 0


def test_slots_are_in_the_order_of_permuted_places(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenshards, "MOST", 6)  # several files in each shard
    folder = f"file://{tmp_path}/shards"
    tokenshards.write_shards(docs, BYTE_BPE, folder, key=5, length=32, shard=40)
    files = sorted(tmp_path.glob("shards/shard=*/part*"))
    assert len(list(tmp_path.glob("shards/shard=*"))) == 6 and len(files) > 12 and max(f.stat().st_size for f in files) == 40 * tokenshards.record_bytes(BYTE_BPE, 32)
    got = sorted(tokenshards.read_shards(spark, BYTE_BPE, folder, length=32).collect(), key=lambda r: r.slot)
    per_doc = max(len((t or "").encode()) for t in TEXTS) // 32 + 1
    numbers = [i * per_doc + k for i, t in enumerate(TEXTS) for k in range(-(-(len(encoded(t)) + 1) // 32))]
    place = dict(zip(tokenshards.permuted(np.array(numbers), len(TEXTS) * per_doc, 5).tolist(), numbers, strict=True))
    assert [r.doc_id * per_doc + r.sequence for r in got] == [place[p] for p in sorted(place)]
    late = tokenshards.read_shards(spark, BYTE_BPE, folder, length=32, start=got[-1].slot)
    assert [r.slot for r in late.collect()] == [got[-1].slot] and tokenshards.read_shards(spark, BYTE_BPE, folder, length=32, start=len(got)).count() == 0
    assert f">= {got[-1].shard})" in late._jdf.queryExecution().toString().split("PartitionFilters")[1]


def test_token_shards_of_ids_far_apart(spark, tmp_path):
    rows = spark.createDataFrame([(-(2**62), "a"), (2**62, "b"), (None, "c"), (2**62, "b")], "doc_id bigint, text string")
    tokenshards.write_shards(rows, BYTE_BPE, f"file://{tmp_path}/s", shard=2)
    assert sorted(r.doc_id for r in tokenshards.read_shards(spark, BYTE_BPE, f"file://{tmp_path}/s").collect()) == [-(2**62), -1, 2**62, 2**62]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    p = tokenshards.permuted(np.arange(size, dtype=np.uint64), size, 9)
    assert sorted(p.tolist()) == list(range(size))
    assert size < 100 or (p != tokenshards.permuted(np.arange(size, dtype=np.uint64), size, 10)).any()


# operator 11
def brute_alignments(texts):
    """For each text the contract's figures, pair by pair, with both libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    letters = {c: b for b, c in bpe._byte_letters().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode()
    found, counts = [], {}
    for t in texts:
        ids = (a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")) if t else ([], [])
        tokens = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], list(map(of_b, ids[1]))]
        if not t or any(b"".join(x) != (" " + t).encode() for x in tokens):
            found.append(([], [], [], []))
            continue
        spans = [list(itertools.pairwise([0, *itertools.accumulate(map(len, x))])) for x in tokens]
        links, j = [], 0
        for i, (p, q) in enumerate(spans[0]):
            while spans[1][j][1] <= p:
                j += 1
            links += [(i, k) for k in itertools.takewhile(lambda k: k < len(spans[1]) and spans[1][k][0] < q, itertools.count(j))]
        cuts = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        groups = [[[], []] for _ in cuts]
        for s in (0, 1):
            for i, (_, q) in zip(ids[s], spans[s], strict=True):
                groups[bisect.bisect_left(cuts, q)][s].append(i)
        found.append((*ids, groups, links))
        for pair in {(ids[0][i], ids[1][k]) for i, k in links}:
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for ids_a, ids_b, groups, links in found:
        own = [(ids_a[i], ids_b[k]) for i, k in links]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


AWKWARD = [*TEXTS[:-2], "x" * 700, "\u4e2d\u6587" * 90 + " end", "a" * 300 + "  " + "b" * 300, "caf\u00e9 na\u00efve \U0001f600\U0001f601", "tabs\t\tand\r\nlines\n\n  twice", "one two", "x\x00y", "Lorem ipsum dolor sit amet, " * 30]


@pytest.mark.parametrize(("stride", "dictionary"), [(1, None), (7, 0), (256, 40), (1 << 20, None)])
def test_alignment(spark, stride, dictionary):
    docs = docs_of(spark, AWKWARD).withColumn("n_a", F.lit("x")).withColumn("pairs", F.lit(1))
    got = by_id(alignment.scored(docs, BYTE_BPE, PIECE_BPE, dictionary=dictionary)) if stride == 256 else None
    if got is None:
        found = alignment.aligned(docs, BYTE_BPE, PIECE_BPE, stride=stride)
        want = brute_alignments(AWKWARD)
        assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in sorted(found.collect(), key=lambda r: r.doc_id)] == [(*w[:4], w[6]) for w in want]
        if dictionary == 0:
            got = by_id(alignment.scored(docs, BYTE_BPE, PIECE_BPE, dictionary=0))
    if got:
        assert [tuple(got[i])[1:] for i in range(len(AWKWARD))] == brute_alignments(AWKWARD)


def test_alignment_of_long_texts_and_repeats(spark, monkeypatch):
    texts = [LONG, "word " * 400 + "x" * 300 + " end", LONG]
    want = brute_alignments(texts)
    both = alignment.tokenizers(BYTE_BPE, PIECE_BPE)
    monkeypatch.setattr(alignment, "PIECE", 1000)
    for size in (50, 1000, 10_000):
        assert all(" ".join(alignment.pieces_of(t, size)) == t for t in texts)
    for t, w in zip(texts, want, strict=True):  # in pieces, as a text of more than PIECE characters is read
        pieces = list(alignment.pieces_of(t, 1000))
        assert len(pieces) > 1
        (row,) = alignment._summary(both, [t], 256)
        assert (*row[:5],) == (*w[:4], w[6])
        pairs, times = np.frombuffer(row[5], "<i8"), np.frombuffer(row[6], "<u4")
        assert (np.diff(pairs) > 0).all() and times.sum() == row[3]
    monkeypatch.undo()
    docs = spark.createDataFrame([(None, texts[0]), (5, texts[1]), (5, texts[1]), (5, texts[1])], "doc_id bigint, text string")
    got = [tuple(r) for r in alignment.scored(docs, BYTE_BPE, PIECE_BPE).collect()]
    want = brute_alignments([texts[0], texts[1], texts[1], texts[1]])
    assert sorted(got, key=repr) == sorted([(None, *want[0]), *[(5, *w) for w in want[1:]]], key=repr)
    assert alignment.scored(docs.limit(0), BYTE_BPE, PIECE_BPE).count() == 0


def test_alignments_are_what_the_figures_say(spark):
    docs = docs_of(spark, AWKWARD)
    rows, want = by_id(alignment.alignments(docs, BYTE_BPE, PIECE_BPE)), brute_alignments(AWKWARD)
    for i, w in enumerate(want):
        r = rows[i]
        assert (len(r.ids_a), len(r.ids_b), len(r.cuts), len(r.links_a)) == w[:4]
        groups, a, b = [], 0, 0
        for k in r.cuts:
            groups.append(",".join(map(str, r.ids_a[a : r.links_a[k] + 1])) + "|" + ",".join(map(str, r.ids_b[b : r.links_b[k] + 1])))
            a, b = r.links_a[k] + 1, r.links_b[k] + 1
        assert (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") == w[6]


def test_lockstep():
    rng = np.random.default_rng(5)
    for _ in range(50):
        texts = [int(x) for x in rng.integers(1, 60, 6)]
        offsets = np.concatenate([[0], np.cumsum(texts)])
        inner = [np.unique(np.concatenate([offsets[1:], rng.integers(1, offsets[-1] + 1, 30)])) for _ in range(2)]
        starts = np.unique(np.concatenate([offsets[:-1], rng.integers(0, offsets[-1], 9)]))
        a, b, cut = alignment.lockstep(*inner, starts)
        begins = [np.append(0, e[:-1]) for e in inner]
        want = [(i, j) for i in range(len(inner[0])) for j in range(len(inner[1])) if begins[0][i] < inner[1][j] and begins[1][j] < inner[0][i]]
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == want
        assert cut.tolist() == [bool(inner[0][i] == inner[1][j]) for i, j in want]


# operator 12
def brute_level(sources, words):
    """Excess over a source's most is shared by weight until none is above."""
    fixed, level = set(), None
    while len(fixed) < len(sources):
        level = (words - sum(sources[s][0] for s in fixed)) / sum(w for s, (_, w) in sources.items() if s not in fixed)
        above = {s for s, (most, w) in sources.items() if s not in fixed and w * level > most}
        if not above:
            break
        fixed |= above
    return {s: most if s in fixed else w * level for s, (most, w) in sources.items()}


def brute_time(points, q):
    """When the integral of a schedule reaches the part q of the whole, by halving."""
    def upto(t):
        total = 0.0
        for (a, v), (b, w) in itertools.pairwise([(0.0, points[0][1]), *points, (1.0, points[-1][1])]):
            if (to := min(b, t)) > a:
                total += (to - a) * (v + v + (w - v) * (to - a) / (b - a)) / 2
        return total

    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upto(mid) < q * upto(1.0) else (lo, mid)
    return hi


SCHEDULES = {"a": [(0.0, 3.0), (0.5, 1.0), (1.0, 2.0)], "b": [(0.25, 1.0), (0.75, 0.0)], None: [(0.0, 0.0), (1.0, 8.0)], "d": [(0.5, 0.25)]}


@pytest.mark.parametrize("cell", [2, 4096])
def test_mixing(spark, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    monkeypatch.setattr(runningsums, "BLOCK", 3)
    rng = np.random.default_rng(12)
    rows = [(i, "w " * int(rng.integers(0, 30)), rng.choice(["a", "b", "", "d", "left out"], p=[0.5, 0.2, 0.1, 0.1, 0.1]).item() or None) for i in range(300)]
    rows += [(300, "\x0b x\x0cy  z\u00a0z ", "b"), (301, None, "b"), (None, "one two", "a"), (7, "w w", "a"), (7, "w w", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("target", F.lit("x")).withColumn("stratum", F.lit(1))
    schedules = spark.createDataFrame([(s, p) for s, p in SCHEDULES.items()], "source string, points array<struct<at:double,weight:double>>")
    placed = mixing.mixed(docs, schedules, amount=1.2, repeats=2, seed=3)
    got = placed.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=repr) == sorted(((i, s, size(t)) for i, t, s in rows), key=repr)
    whole = {s: sum(size(t) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}}
    area = lambda p: sum((b - a) * (v + w) / 2 for (a, v), (b, w) in itertools.pairwise([(0.0, p[0][1]), *p, (1.0, p[-1][1])]))
    targets = {"left out": 0.0} | brute_level({s: (2 * whole[s], area(p)) for s, p in SCHEDULES.items()}, 1.2 * sum(whole.values()))
    for s in whole:
        own = sorted((r for r in got if r.source == s), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.source_size for r in own} == {whole[s]}
        assert all(abs(r.target - targets[s]) < 1e-6 for r in own) and sum(r.taken for r in own) == round(targets[s])
        before = 0
        for r in own:
            want = [(e, e * whole[s] + before) for e in (0, 1) if r.size and e * whole[s] + before < round(targets[s])]
            assert [c.epoch for c in r.copies] == [e for e, _ in want] and r.taken <= 2 * r.size
            for c, (_, start) in zip(r.copies, want, strict=True):
                assert c.words == min(r.size, round(targets[s]) - start) and abs(c.time - brute_time(SCHEDULES[s], start / round(targets[s]))) < 1e-6
            before += r.size
    order = sorted(mixing.training_order(placed).collect(), key=lambda r: r.slot)
    assert [r.slot for r in order] == list(range(len(order))) and len(order) == sum(len(r.copies) for r in got)
    assert [r.time for r in order] == sorted(r.time for r in order)
    again = mixing.mixed(docs.repartition(7), schedules, amount=1.2, repeats=2, seed=3).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixing_of_nothing_and_of_all(docs, spark):
    schedules = spark.createDataFrame([("s0", [(0.0, 1.0)]), ("s1", [(0.0, 1.0)])], "source string, points array<struct<at:double,weight:double>>")
    empty = mixing.mixed(docs.limit(0), schedules)
    assert empty.count() == 0 and mixing.training_order(empty).count() == 0
    assert {r.taken for r in mixing.mixed(docs, schedules.limit(0)).collect()} == {0}  # no schedule, no weight
    all_of = mixing.mixed(docs, schedules, amount=9.0, repeats=3).collect()
    assert all(r.taken == (3 * r.size if r.source else 0) for r in all_of)


# operator 13
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text, percent=50):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 80 else "psm", len(p), len(m), out


@pytest.mark.parametrize("block", [1, 3, 16, 1024])
def test_fill_in_middle(spark, block):
    texts = [*TEXTS, "<P> x", "a <S>b", "<M>", "x <P", "P> y < <S", "< M>", " \x85 \xa0 \u2028 ", "\x0b\x0c", *[f"é{'x' * k} " * k for k in range(40)]]
    rows = [*enumerate(texts), (None, "no id at all"), (7, "one two"), (7, "one two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form", F.lit(0)).withColumn("output", F.lit(1))
    for percent in (50, 100):
        made = fim.fill_in_middle(docs, percent=percent, block=block)
        got = made.withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect()
        key = lambda x: tuple(map(repr, x))
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in got), key=key) == sorted(((i, *brute_fim(i, t, percent), t or "") for i, t in rows), key=key)
        assert percent < 100 or {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_trees_find_every_unit():
    texts = ["", "a", " ", " a  b ", "é" * 50, "one two three " * 40, "\n", "日本 語 " * 30]
    data, offsets = bytewords.text_bytes(pa.array(texts))
    for block in (1, 2, 7, 64):
        trees = fim.UnitTrees(data, offsets, block)
        for i, t in enumerate(texts):
            units = UNIT.findall(t)
            assert trees.n[i] == len(units)
            k = np.arange(len(units) + 1)
            places, chars = trees.cut(np.full(len(k), i), k)
            want = ["".join(units[:n]) for n in k]
            assert places.tolist() == [len(x.encode()) for x in want] and chars.tolist() == [len(x) for x in want]


def test_sentinels_are_checked(docs):
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>", "<<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=bad)


# words and queries
def test_words_of_slices():
    texts = pa.array(["Foo bar", "", None, "baz  qux", "é"])
    for part in (texts, texts[1:], texts[3:]):
        w = bytewords.words_of(*bytewords.text_bytes(part), bytewords.NOT_SPACE)
        want = [x.lower().encode() for t in part.to_pylist() for x in (t or "").split()]
        assert [w.text(i) for i in range(len(w.starts))] == want
        assert len(set(w.hashes().tolist())) == len(set(want))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert_same(df, ORACLES[name], sf_dir)
    else:
        assert df.count() > 0
