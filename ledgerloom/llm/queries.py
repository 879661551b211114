"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ledgerloom.llm import bpe, chat, ctw, exact_dedup, fim, line_dedup, minhash, packing, quality_fm, rabitq, recompression, resampling, suffix_dedup
from ledgerloom.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup.find_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return rabitq.link_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.render(turns.unionByName(chat.hard_conversation(spark))))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, decoded=True)
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = recompression.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", (F.col("n_words") - F.col("n_kept")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = quality_fm.score(docs, quality_fm.train(docs, labels))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        quality_fm.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality_fm.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.transform(read_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean_lines(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ctw": op2_ctw,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_rabitq": op4_rabitq,
    "op5_packing": op5_packing,
    "op6_chat_format": op6_chat_format,
    "op7_bpe": op7_bpe,
    "op8_minhash": op8_minhash,
    "op9_recompression": op9_recompression,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_resampling": op12_resampling,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm
    """,
    "op6_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        c AS (
            SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') AS odd FROM t),
        f AS (
            SELECT *, CASE WHEN odd THEN length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) + 1
                           ELSE length(text) END AS body FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length('<s>[INST] ' || role || ' [/INST]') + body + length('</s>'))::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id
    """,
    "op4_rabitq": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r(i, j) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.i, l.j FROM r JOIN l ON l.i = r.j)
        SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.i = v.vec_id) AS n_links, c.low AS component_id, c.low = v.vec_id AS kept
        FROM v JOIN (SELECT i, min(j) AS low FROM r GROUP BY i) c ON c.i = v.vec_id
    """,
    "op8_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM w, range(1, 100000) t(i) WHERE i <= greatest(len(ws) - 4, least(len(ws), 1))),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 75 * (a.n + b.n - c)),
        r(i, j) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.i, l.j FROM r JOIN l ON l.i = r.j)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id, c.low = w.doc_id AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT i, min(j) AS low FROM r GROUP BY i) c ON c.i = w.doc_id
    """,
    "op9_recompression": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
        win AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS s FROM w JOIN t USING (doc_id) WHERE p <= len(ws) - 12),
        low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, p + k AS p FROM win JOIN low USING (s), range(13) r(k) WHERE m < doc_id),
        k AS (SELECT t.doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.p) FILTER (WHERE gone.p IS NULL), '') AS kept
            FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.p = t.p GROUP BY t.doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS x FROM documents),
        h AS (
            SELECT *, len(u) AS n, ('0x' || x[1:8])::UBIGINT AS h1, ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3, ('0x' || x[25:32])::UBIGINT AS h4 FROM d),
        c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (
            SELECT *, array_to_string(u[1 : a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 : n], '') AS suf FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op12_resampling": r"""
        WITH RECURSIVE step(i, k, c) AS (
            SELECT i, 0, i FROM range(256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
        texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
        w AS (
            SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
        f AS (
            SELECT side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
                list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS feature FROM w),
        n AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
        x AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM n)),
        b AS (
            SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda k: ('0x' || h[k : k + 1])::BIGINT)),
                lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM x, crc),
        g AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM n JOIN b USING (feature) GROUP BY bucket),
        a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM g),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM g, a),
        d AS (SELECT id, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM n JOIN b USING (feature) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
        e AS (
            SELECT w.id AS doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.id)[1:8])::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM w LEFT JOIN d ON d.id = w.id WHERE side = 0),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE words >= 20)
        SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM r) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
    """,
}
