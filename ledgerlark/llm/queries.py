"""Registered queries of the operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import alignment, bpe, chat, decontam, exactdedup, fim, mixing, neardup, quality, sharding, tokencount, tokenshards, toxicity
from ledgerlark.llm.scratch import new_path, written
from ledgerlark.operators.ranking import globally_numbered
from ledgerlark.plans.tables import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

#: Bytes, and so tokens at most, of a chat window and of what it repeats.
CHAT_BUDGET, CHAT_HISTORY = 2048, 384


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-shards")
    tokenshards.write_shards(read_table(spark, sf_dir, "documents"), BYTE_BPE, folder, key=11)
    read = tokenshards.read_shards(spark, BYTE_BPE, folder)
    return read.select("slot", "shard", "offset", "doc_id", "sequence", F.expr("octet_length(ids) div 2").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.sql("SELECT -1L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    windows = chat.chat_windows(turns, CHAT_BUDGET, CHAT_HISTORY)
    # all that follows is read back from the formatted windows
    new = F.expr("slice(turns, n_repeated + 1, size(turns))")
    read = windows.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("new", new).withColumn("targets", chat.read_targets(F.col("formatted"), F.col("loss_spans")))
    own = read.select("conv_id", F.struct("window", F.expr("array_join(transform(new, t -> concat(t.role, '\n', t.text, '\n')), '')").alias("turns"), F.array_join("targets", "").alias("loss")).alias("w"), F.size("new").alias("n"), F.length("formatted").alias("chars"))
    by_conv = own.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    loss = F.array_join("w.loss", "")
    return by_conv.select("conv_id", "n_turns", F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.stratified_shards(read_table(spark, sf_dir, "documents"), shards=24, seed=7)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "position")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.count_tokens(read_table(spark, sf_dir, "documents"), PIECE_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scores.withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    rows = docs.unionByName(quality.page_rows(read_table(spark, sf_dir, "pages")))
    scores = quality.quality(rows, read_table(spark, sf_dir, "labels"), host="host", path="path")
    return scores.withColumn("held_out", toxicity.held_out(F.col("doc_id"))).withColumn("kept", F.col("predicted") == 1)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(read_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # weights 5, 2 and 1 as integrals: sources of 5 fade from 7.5 to 2.5, those of 2 are steady, those of 1 grow from 0.5 to 1.5
    ranked = globally_numbered(docs.select("source").distinct(), [F.col("source").asc_nulls_last()], "at", first=0)
    point = lambda at, *weights: F.struct(F.lit(at).alias("at"), F.expr(f"array({', '.join(map(str, weights))})[at % 3]").cast("double").alias("weight"))
    schedules = ranked.select("source", F.array(point(0.0, 7.5, 2, 0.5), point(1.0, 2.5, 2, 1.5)).alias("points"))
    placed = written(mixing.mixed(docs, schedules, amount=1.5, repeats=2, seed=12), "mix")
    # the training order, gathered again by document
    order = mixing.training_order(placed).groupBy(F.col("stratum").alias("of"), F.col("rank").alias("at")).agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_copies"), F.min("slot").alias("first_slot"))
    both = placed.drop("taken").join(order, (placed["stratum"] == order["of"]) & (placed["rank"] == order["at"]), "left")
    return both.select("doc_id", "source", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", "n_copies")], "first_slot")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(read_table(spark, sf_dir, "documents"))
    text = fim.restored(F.col("output"), F.col("form"))  # rebuilt from output and form alone
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_chat_format": op2_chat_format,
    "op4_stratified_shards": op4_stratified_shards,
    "op3_token_counts": op3_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_minhash_forest": op7_minhash_forest,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_site_quality": op10_site_quality,
    "op11_token_alignment": op11_token_alignment,
    "op12_curriculum": op12_curriculum,
    "op13_fill_in_middle": op13_fill_in_middle,
}

def _escaped_sql(text: str, line: bool = False) -> str:
    for plain, code in [*chat._CODES, *([chat._LINE] if line else [])]:
        plain, code = (x.replace("\x1b", "' || chr(27) || '").replace("\n", "' || chr(10) || '") for x in (plain, code))
        text = f"replace({text}, '{plain}', '{code}')"
    return text


_CHAT_ROOM = f"greatest(left_of - {CHAT_HISTORY}, CASE WHEN left_of > 0 THEN least(left_of, {max(CHAT_BUDGET // 4, CHAT_HISTORY)}) ELSE {max(CHAT_BUDGET // 4, CHAT_HISTORY)} END)"
ORACLES: dict[str, str] = {
    "op2_chat_format": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (SELECT conv_id, turn, role, text, octet_length(encode({_escaped_sql("role", line=True)})) + octet_length(encode({_escaped_sql("text")})) + {len(chat.BEGIN) + len(chat.END) + 2} AS tokens,
                length({_escaped_sql("role", line=True)}) + length({_escaped_sql("text")}) + {len(chat.BEGIN) + len(chat.END) + 2} AS chars FROM t),
        p AS (SELECT *, row_number() OVER o - 1 AS place, sum(tokens) OVER o - tokens AS start FROM n WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
        s AS (SELECT conv_id AS of, min(place) AS s_place, arg_min(tokens, place) AS s_tokens, arg_min(chars, place) AS s_chars FROM p WHERE role = 'system' GROUP BY 1),
        r AS (SELECT *, {_CHAT_ROOM} AS room FROM (SELECT *, {CHAT_BUDGET} - coalesce(s_tokens, 0) AS left_of FROM p LEFT JOIN s ON conv_id IS NOT DISTINCT FROM of)),
        w AS (SELECT *, start // room AS cut, 2 * (start // room) + CASE WHEN (start + tokens - 1) // room > start // room THEN 1 ELSE 0 END AS win FROM r),
        f AS (SELECT conv_id, win, min(place) AS first_place, min(start) AS first_start, sum(chars) AS own_chars, any_value(s_place) AS s_place, any_value(s_tokens) AS s_tokens, any_value(s_chars) AS s_chars,
                {CHAT_BUDGET} - sum(tokens) - CASE WHEN any_value(s_place) < min(place) THEN any_value(s_tokens) ELSE 0 END AS free FROM w GROUP BY 1, 2),
        h AS (SELECT f.conv_id, f.win, sum(x.chars) AS chars, bool_or(x.place = f.s_place) AS has_system FROM f JOIN w x ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND x.place < f.first_place AND x.cut >= f.win // 2 - 1 AND x.start >= f.first_start - {CHAT_HISTORY}
              WHERE x.place IS NOT DISTINCT FROM f.s_place OR f.first_start - x.start - CASE WHEN f.s_place >= x.place AND f.s_place < f.first_place THEN f.s_tokens ELSE 0 END <= f.free GROUP BY 1, 2),
        c AS (SELECT f.conv_id, sum(own_chars + coalesce(chars, 0) + CASE WHEN s_place < first_place AND NOT coalesce(has_system, false) THEN s_chars ELSE 0 END) AS chars, count(*) AS n_windows
              FROM f LEFT JOIN h ON f.conv_id IS NOT DISTINCT FROM h.conv_id AND f.win = h.win GROUP BY 1),
        d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss FROM p GROUP BY 1)
        SELECT d.conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(n_windows AS BIGINT) AS n_windows
        FROM d JOIN c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op4_stratified_shards": """
        WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8),
        crcs AS (SELECT list(c ORDER BY i) AS crc FROM t WHERE k = 8),
        bytes AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
                    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)) AS b FROM documents),
        d AS (SELECT doc_id, source, size, xor(list_reduce(b, lambda a, x: xor(a // 256, crc[xor(a, x) % 256 + 1])), 4294967295) AS text_crc32 FROM bytes, crcs),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '7', doc_id, text_crc32)), doc_id, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM d),
        p AS (SELECT *, row_number() OVER (ORDER BY (rank + ('0x' || substr(md5('7|' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / n, coalesce('s' || source, 'n'), rank) - 1 AS position, count(*) OVER () AS whole FROM r),
        q AS (SELECT *, position * 24 // whole AS shard FROM p)
        SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, position - (shard * whole + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard, position FROM q
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_minhash_forest": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w)
              UNION ALL SELECT doc_id, words[1] FROM w WHERE len(words) = 1),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        sn AS (SELECT s.doc_id, shingle, n FROM s JOIN n USING (doc_id)),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM sn a JOIN sn b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
              WHERE 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n) GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, reached) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
        c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
        SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op8_decontamination": """
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM benchmark),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS gram
               FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM (SELECT *, least(13, len(words)) AS n FROM b) WHERE n > 0)),
        dw AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
               FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
        hits AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op12_curriculum": """
        WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS stratum, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        g AS (SELECT stratum, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, CAST(source_size * 2 AS DOUBLE) AS most, CAST(list_extract([5, 2, 1], 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS DOUBLE) AS weight, CAST(list_extract([-5, 0, 1], 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS DOUBLE) AS slope FROM g),
        f AS (SELECT most, weight, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS words, coalesce(sum(most) OVER (ORDER BY most / weight, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(weight) OVER (ORDER BY most / weight, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM w),
        l AS (SELECT arg_min((words - full_) / open_, most / weight) AS level FROM f WHERE most > (words - full_) / open_ * weight),
        t AS (SELECT stratum, source_size, weight, slope, least(most, weight * level) AS target FROM w, l),
        p AS (SELECT d.*, source_size, weight, weight - slope / 2 AS first_weight, slope, target, CAST(round(target) AS BIGINT) AS demand,
                CAST(coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, row_number() OVER o - 1 AS rank
              FROM d JOIN t USING (stratum) WINDOW o AS (PARTITION BY d.stratum ORDER BY md5(concat_ws('|', '12', doc_id, size)), doc_id)),
        c AS (SELECT stratum, rank, epoch, least(size, demand - (epoch * source_size + before)) AS words, (epoch * source_size + before) / demand::DOUBLE * weight AS x, first_weight, slope
              FROM p, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0 AND epoch * source_size + before < demand),
        s AS (SELECT *, row_number() OVER (ORDER BY least(1.0::DOUBLE, CASE WHEN x > 0 THEN 2 * x / (first_weight + sqrt(greatest(0, first_weight * first_weight + 2 * slope * x))) ELSE 0 END), stratum, epoch, rank) - 1 AS slot FROM c),
        q AS (SELECT stratum, rank, CAST(sum(words) AS BIGINT) AS taken, count(*) AS n_copies, min(slot) AS first_slot FROM s GROUP BY 1, 2)
        SELECT doc_id, source, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_copies, 0) AS n_copies, first_slot FROM p LEFT JOIN q USING (stratum, rank)
    """,
    "op13_fill_in_middle": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
                ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM h),
        c AS (SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle, array_to_string(units[b + 1 :], '') AS suffix FROM c)
        SELECT doc_id, CAST(len(units) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
}
