"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit.llm import (attention_lm, hamming, host_paths, line_runs, near_dedup, packing, repeats, severity, spelling, syncmers, token_alignment,
                          token_files, word_table)
from govaudit.llm.common import stored, table
from govaudit.session import new_path

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), end_id=0)
    return (token_files.read_token_files(spark, path)
            .select("doc_id", "start", "n_tokens", token_files.ids_crc32("ids").alias("ids_crc32")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of several lengths."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=1)


def op3_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by their distinct words."""
    return word_table.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return (host_paths.extract_pages(table(spark, sf_dir, "pages"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest codes of every embedding whose id is divisible by 20, among all."""
    codes = hamming.binary_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.nearest(codes, codes.where("id % 20 = 0"), 10)


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(syncmers.fingerprint("sketch")).alias("fingerprint"),
        F.expr(syncmers.fingerprint("edited_sketch")).alias("edited_fingerprint"),
        F.expr(syncmers.likeness("sketch", "edited_sketch")).alias("near_edited"),
        F.expr(syncmers.likeness("sketch", "next_sketch")).alias("near_next"))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return attention_lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return severity.score(docs, severity.fit(docs, table(spark, sf_dir, "labels")))


def op11_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(stored(spelling.corpus_words(table(spark, sf_dir, "documents")), "words"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them hold."""
    return line_runs.without_common_lines(table(spark, sf_dir, "documents"), least=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two tokenizers aligned, over all documents."""
    rows = token_alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {
    "op1_hyperminhash": op1_hyperminhash,
    "op2_token_files": op2_token_files,
    "op3_word_table": op3_word_table,
    "op4_host_paths": op4_host_paths,
    "op5_multi_index_hashing": op5_multi_index_hashing,
    "op6_packing": op6_packing,
    "op7_syncmers": op7_syncmers,
    "op8_attention_lm": op8_attention_lm,
    "op9_prefix_free_parsing": op9_prefix_free_parsing,
    "op10_severity": op10_severity,
    "op11_frequency_trie": op11_frequency_trie,
    "op12_line_runs": op12_line_runs,
    "op13_token_alignment": op13_token_alignment,
}

_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
rows AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
pairs AS (
  SELECT a.rep AS u, b.rep AS v FROM rows a JOIN rows b ON a.x = b.x AND a.rep > b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT rep AS node, rep AS seen FROM classes UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.seen = e.u),
labels AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.label, s.doc_id) AS component_id,
       s.doc_id = coalesce(l.label, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN labels l ON c.rep = l.node
"""

_OP5 = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS bits FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: abs(q.bits[i] - c.bits[i]))) AS BIGINT) AS distance
  FROM codes q, codes c WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""

_OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))),
    lambda a, x: xor(a >> 8, steps[1 + (xor(a, x) & 255)])), 4294967295) AS h
  FROM lowered, crc),
edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words),
cuts AS (SELECT word, k, substring(word, 1, k - 1) || substring(word, k + 1) AS short FROM places),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.short = b.short AND a.k = b.k AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.short = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.short = w.word),
ranked AS (
  SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS rank
  FROM near JOIN words w ON near.other = w.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
         CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON w.word = r.word),
walk AS (
  SELECT word, word AS root, form AS following FROM formed
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON walk.following = f.word)
SELECT f.word, f.form, walk.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN walk ON f.word = walk.word AND walk.following IS NULL
"""

_OP12 = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
keyed AS (
  SELECT doc_id, l, list_transform(l, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k
  FROM split),
flat AS (SELECT doc_id, unnest(l) AS line, unnest(k) AS key, generate_subscripts(l, 1) AS place FROM keyed),
common AS (SELECT key FROM flat WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM flat f LEFT JOIN common c ON f.key = c.key GROUP BY doc_id
"""

SQL: dict[str, str] = {
    "op11_frequency_trie": _OP11,
    "op12_line_runs": _OP12,
    "op5_multi_index_hashing": _OP5,
    "op1_hyperminhash": _OP1,
}
