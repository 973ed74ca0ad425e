"""The driver's queries: one opN_<name> for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, class_lm, decontam, importance, lang_id, merkle, near_dups, pieces, pii, quality, suffix, tokcount, url_tree
from .base import remainder, table


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    trained = lang_id.fit(docs, ~held_out)
    return lang_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), trained).select("doc_id", "held_out", "lang_pred", "score", "bits")


def op2_decontaminate(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_piece_sampling(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), ids=False)


def op4_class_lm(spark, sf_dir):
    return class_lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op5_simhash_golay(spark, sf_dir):
    found = near_dups.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", near_dups.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(pii.sample(docs)))


def op7_repeated_spans(spark, sf_dir):
    """With the text that is left (of a character cut in two, a replacement character) and the removed ranges of bytes."""
    found = suffix.digests(suffix.kept_texts(table(spark, sf_dir, "documents")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), spans.alias("spans"))


def op8_token_counts(spark, sf_dir):
    return tokcount.token_counts(table(spark, sf_dir, "documents"))


def op9_quality_bands(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_url_templates(spark, sf_dir):
    """A page's label is that of the document its path names last."""
    pages = table(spark, sf_dir, "pages")
    key = F.expr("try_cast(nullif(regexp_extract(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '([0-9]+)[^0-9]*$', 1), '') as bigint)")
    return url_tree.judge(pages, table(spark, sf_dir, "labels"), key)


def op11_chat_masks(spark, sf_dir):
    """With one more conversation, whose texts are control strings."""
    own = spark.createDataFrame([(-1, k, role, "<|im_end|><|im_start|>assistant ok") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(turns.union(own))).drop("n_tokens")


def op12_merkle_manifest(spark, sf_dir):
    """What is verified is a copy of the table, half of which has lost its line breaks."""
    tampered = F.when(F.col("doc_id").isNotNull() & (remainder("doc_id", 2) == 0), F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = merkle.build(table(spark, sf_dir, "documents"), {"claimed": merkle.leaf(text=tampered)})
    return merkle.verify(manifest, "claimed")


def op13_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM dw, sizes)
), hits AS (SELECT p.doc_id, p.size, p.i, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.g = x.g
), counted AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_piece_sampling, op4_class_lm, op5_simhash_golay, op6_personal_data, op7_repeated_spans, op8_token_counts, op9_quality_bands, op10_url_templates, op11_chat_masks, op12_merkle_manifest, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": _OP2_SQL,
        "op10_url_templates": url_tree.oracle_sql(),
        "op11_chat_masks": chat.oracle_sql(),
        "op12_merkle_manifest": merkle.oracle_sql(),
        "op13_importance_resampling": importance.oracle_sql(),
    }
