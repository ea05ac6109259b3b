"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import ann, chat, conversation_repair, conversation_trie, exact_dedup, fingerprints, line_dedup, packing, pii, sentencepiece_fst, simhash, token_files, tokens, toxicity
from quantloom.llm.common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.scratch_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokens.default_path(), end_id=1)
    return token_files.read_token_files(spark, folder)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_with_next(table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.as_text(a).alias("fingerprint"), fingerprints.as_text(b).alias("edited_fingerprint"),
        fingerprints.resemblance(a, b).alias("near_edited"), fingerprints.resemblance(a, c).alias("near_next"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out=True))
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="removed")
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{hard}'), (-7L, 1L, 'assistant', '{hard}') AS t(conv_id, turn, role, text)")
    found = chat.format_conversations(rows.unionByName(more))
    found = found.withColumns({"formatted": chat.formatted_text(F.col("segments")), "loss": chat.loss_text(F.col("segments"))})
    found = found.withColumn("turns", chat.read_turns(F.col("formatted")))
    written = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=1, capacity=4096)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), queries="vec_id % 20 = 0", k=20)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.in_order(table(spark, sf_dir, "conversations"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_fingerprints, op3_sentencepiece, op4_toxicity, op5_line_dedup, op6_simhash_near_dedup, op7_chat_formatting, op8_pii, op9_best_fit_packing, op10_nearest_neighbours, op11_conversation_trie, op12_conversation_repair, op13_exact_dedup)}
#: A table of CRC-32 by bytes, and the digest of a text of ASCII letters by it.
_CRC = """crc_bits AS (
            SELECT i, i::BIGINT AS c, 0 AS bit FROM range(256) AS r(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, bit + 1 FROM crc_bits WHERE bit < 8
        ), crc_table AS (SELECT list(c ORDER BY i) AS crc_by_byte FROM crc_bits WHERE bit = 8)"""


def _crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)), lambda c, b: xor(c >> 8, crc_by_byte[(xor(c, b) & 255) + 1])))"


ORACLES: dict[str, str] = {
    "op7_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), marked AS (
            SELECT *, regexp_replace(text, '([<\[])(\\*)(/INST\]|/ROLE\]|/TEXT\]|/SYS\]|INST\]|ROLE\]|TEXT\]|SYS\]|/s>|s>)', '\1\\\2\3', 'g') AS escaped,
                   row_number() OVER w AS k,
                   coalesce(lag(role) OVER w, 'start') AS before
            FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(escaped) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE length(role) + 26 END)::BIGINT AS formatted_chars,
               bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
                   AND max_by(role, k) = 'assistant' AS valid
        FROM marked GROUP BY conv_id""",
    "op11_conversation_trie": rf"""
        WITH RECURSIVE {_CRC}, rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), lists AS (
            SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS s FROM rows GROUP BY conv_id
        ), headed AS (
            SELECT a.conv_id, a.s, b.s AS base, ({_crc("a.conv_id::VARCHAR")} % 4)::INT AS h FROM lists a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 20, crc_table
        ), rebuilt AS (
            SELECT conv_id, list_concat(CASE WHEN base IS NULL THEN s[1:0] ELSE base[1:h] END, s[h + 1:]) AS s FROM headed
        ), nodes AS (
            SELECT s[1:d] AS p, d, count(*) AS n_convs, min(conv_id) AS conv_id,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
            FROM rebuilt, range(0, len(s) + 1) AS r(d) GROUP BY ALL
        ), linked AS (
            SELECT n.*, up.conv_id AS parent_conv_id, coalesce(kids, 0) AS n_children,
                   CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.p[-1].text, '[^\x20\x09-\x0D]+')) END AS own
            FROM nodes n LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
            LEFT JOIN (SELECT p[1:d - 1] AS above, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL) k ON k.above = n.p
        ), below AS (
            SELECT p[1:a] AS top, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved_tokens FROM linked, range(0, d + 1) AS r(a) GROUP BY ALL
        )
        SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM linked JOIN below ON top = p""",
    "op12_conversation_repair": rf"""
        WITH RECURSIVE {_CRC}, marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations, crc_table
        ), damaged AS (
            SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(CASE f WHEN 3 THEN [1, 2] ELSE [1] END) FROM marked WHERE f <> 0)
        ), placed AS (
            SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS o,
                   coalesce(lag(left(role, 1)) OVER w, '') AS before, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), faults AS (
            SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   last = '' OR again AS must, (last NOT IN ('.', '!', '?'))::INT AS tr FROM (SELECT *, k > min(k) OVER (PARTITION BY conv_id, role, text) AS again FROM placed)
        ), back AS (
            SELECT DISTINCT conv_id, n + 1 AS k, [0, 4, 2, 0] AS v FROM faults
            UNION ALL
            SELECT conv_id, k, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])] FROM (
                SELECT b.conv_id, f.k, [least(3 + v[1], CASE WHEN NOT must THEN 2 + tr + v[3] END, CASE WHEN NOT must AND o = 's' THEN tr + v[2] WHEN NOT must AND o = 'u' THEN tr + v[3] END),
                    least(3 + v[2], CASE WHEN NOT must THEN 2 + tr + v[3] END, CASE WHEN NOT must AND o = 'u' THEN tr + v[3] END),
                    least(3 + v[3], CASE WHEN NOT must THEN 2 + tr + v[4] END, CASE WHEN NOT must AND o = 'a' THEN tr + v[4] END),
                    least(3 + v[4], CASE WHEN NOT must THEN 2 + tr + v[3] END, CASE WHEN NOT must AND o = 'u' THEN tr + v[3] END)] AS w
                FROM back b JOIN faults f ON f.conv_id = b.conv_id AND f.k = b.k - 1)
        ), tight AS (
            SELECT b.conv_id, b.k, q, b.v[q] AS cost, b.v[[3, 3, 4, 3][q]] + 2 = b.v[q] AS i, coalesce(3 + x.v[q] = b.v[q], false) AS d,
                   coalesce(NOT must AND tr + x.v[CASE WHEN q = 1 AND o = 's' THEN 2 WHEN q IN (1, 2, 4) AND o = 'u' THEN 3 WHEN q = 3 AND o = 'a' THEN 4 END] = b.v[q], false) AS keep,
                   [3, 3, 4, 3][q] AS step, CASE WHEN q = 1 AND o = 's' THEN 2 ELSE [3, 3, 4, 3][q] END AS kept, role, text
            FROM back b CROSS JOIN (VALUES (1), (2), (3), (4)) s(q) LEFT JOIN back x ON x.conv_id = b.conv_id AND x.k = b.k + 1 LEFT JOIN faults f ON f.conv_id = b.conv_id AND f.k = b.k
        ), walk AS (
            SELECT DISTINCT conv_id, 1::BIGINT AS k, 1 AS q, '' AS audit, []::VARCHAR[] AS lines, false AS over FROM faults
            UNION ALL
            SELECT w.conv_id, CASE WHEN over OR role IS NULL OR (i AND NOT d) THEN w.k ELSE w.k + 1 END,
                   CASE WHEN role IS NULL AND cost = 0 OR d THEN w.q WHEN i THEN step WHEN keep THEN kept ELSE step END,
                   audit || CASE WHEN role IS NULL AND cost = 0 THEN '' WHEN d THEN 'D' WHEN i THEN 'I' WHEN keep THEN 'K' ELSE 'R' END,
                   lines || CASE WHEN role IS NULL AND cost = 0 OR d THEN [] WHEN i THEN [CASE step WHEN 3 THEN 'user:' ELSE 'assistant:' END]
                                 WHEN keep THEN [role || ':' || text] ELSE [CASE step WHEN 3 THEN 'user:' ELSE 'assistant:' END || text] END,
                   role IS NULL AND cost = 0
            FROM walk w JOIN tight t ON t.conv_id = w.conv_id AND t.k = w.k AND t.q = w.q WHERE NOT over
        ), sums AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND before || o NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id = c.conv_id LEFT JOIN back b ON b.conv_id = c.conv_id AND b.k = 1 LEFT JOIN walk w ON w.conv_id = c.conv_id AND over""",
    "op13_exact_dedup": r"""
        WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (same ORDER BY doc_id) = 1 AS kept, sha256(text) AS text_sha256
        FROM plain WINDOW same AS (PARTITION BY text)""",
}
