"""Queries of the text problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshline.llm.packing import CAPACITY, pack_texts
from threshline.llm.secrets import scan_secrets, secret_places
from threshline.llm.shared_spans import members, passages, shared_spans
from threshline.llm.source_filter import machine_made_rows
from threshline.llm.splitter import LIMIT, OVERLAP, oversized_report, split_oversized
from threshline.llm.tokenizer import decoded_digest, encode_corpus
from threshline.session import checkpointed, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_made_rows(table(spark, sf_dir, "st_diff"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_places(scan_secrets(table(spark, sf_dir, "st_diff")))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, diff): every diff that isn't null, with only the characters of its credentials replaced."""
    return scan_secrets(table(spark, sf_dir, "st_diff")).select("diff_id", F.col("redacted").alias("diff"))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, n_chars, n_lines) of every diff as redacted: placeholders move no character and no line."""
    clean = scan_secrets(table(spark, sf_dir, "st_diff"))
    return clean.select("diff_id", F.length("redacted").alias("n_chars"), F.size(F.split("redacted", "\n")).alias("n_lines"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_report(split_oversized(table(spark, sf_dir, "st_diff")))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, piece_no, start_pos, piece)."""
    return split_oversized(table(spark, sf_dir, "st_diff")).drop("cut_lines")


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, n_chars, n_too_long, n_wrong_overlaps, text_md5) of every oversized diff, put together again from its pieces."""
    pieces = split_oversized(table(spark, sf_dir, "st_diff"))
    # The pieces of one diff are as long as it is.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))), lambda x: x["piece"])
    per = pieces.groupBy("diff_id").agg(ordered.alias("p"))
    text = F.array_join(F.transform("p", lambda x, n: F.when(n == 0, x).otherwise(F.substring(x, OVERLAP + 1, LIMIT))), "")
    wrong = F.size(F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda n: ~F.startswith(F.get("p", n), F.right(F.get("p", n - 1), F.lit(OVERLAP)))))
    too_long = F.size(F.filter("p", lambda x: F.length(x) > LIMIT))
    return per.select("diff_id", F.length(text).alias("n_chars"), too_long.alias("n_too_long"), wrong.alias("n_wrong_overlaps"), F.md5(text).alias("text_md5"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text_md5): a digest of each text as decoded from its ids; empty for a null text."""
    return decoded_digest(encode_corpus(table(spark, sf_dir, "documents")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: texts in containers, containers that hold too much, texts whose parts don't follow each other, texts split without need."""
    packed = checkpointed(pack_texts(table(spark, sf_dir, "documents")))
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("n_overfull"))
    # A row's last token is the sum of its parts when they follow each other from the first; a number may repeat.
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens") - 1).alias("last"), F.min("first_token").alias("first"), F.count("*").alias("parts"))
    per = texts.agg(F.count("*").alias("n_texts"), F.count_if((F.col("first") != 1) | (F.col("last") != F.col("n"))).alias("n_gaps"), F.count_if((F.col("n") <= CAPACITY) & (F.col("parts") > 1)).alias("n_needless"))
    names = ("n_texts", "n_gaps", "n_needless", "n_overfull")
    return per.unionByName(boxes, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, shared_chars): how much of each document stands in others too, nought included."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id")
    per = shared_spans(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.sum("n_chars").alias("shared_chars"))
    zero = F.lit(0).cast("bigint")
    return docs.join(per, "doc_id", "left").select("doc_id", F.coalesce("n_runs", zero).alias("n_runs"), F.coalesce("shared_chars", zero).alias("shared_chars"))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def p9_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, doc_id, start_pos): the members of every group of documents with a common seed."""
    return members(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p2_found, p3_found, p3_redacted, p3_lines, p5_found, p5_pieces, p5_rebuilt, p7_ids, p7_decoded, p8_containers, p8_checked, p9_found, p9_shared, p9_passages, p9_members)
    return {f.__name__: f for f in found}


_RUNS = """
WITH docs AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
windows AS (SELECT doc_id, p, substr(text, p, 200) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS p FROM docs)),
shared AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) <> max(doc_id)),
marks AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS apart FROM windows SEMI JOIN shared USING (w)),
runs AS (SELECT doc_id, p, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marks),
found AS (SELECT doc_id, CAST(min(p) AS INTEGER) AS start_pos, CAST(max(p) - min(p) + 200 AS INTEGER) AS n_chars FROM runs GROUP BY doc_id, run)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_lines": "SELECT diff_id, CAST(length(diff) AS INTEGER) AS n_chars, CAST(length(diff) - length(replace(diff, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM st_diff WHERE diff IS NOT NULL",
        "p5_found": """
WITH big AS (SELECT diff_id, string_split(diff, chr(10)) AS lines FROM st_diff WHERE length(diff) > 4000),
numbered AS (SELECT diff_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM big)
SELECT diff_id, CAST(0 AS INTEGER) AS line_no FROM big
UNION ALL SELECT diff_id, CAST(n AS INTEGER) FROM numbered WHERE length(line) > 3800""",
        "p5_rebuilt": "SELECT diff_id, CAST(length(diff) AS INTEGER) AS n_chars, CAST(0 AS INTEGER) AS n_too_long, CAST(0 AS INTEGER) AS n_wrong_overlaps, md5(diff) AS text_md5 FROM st_diff WHERE length(diff) > 4000",
        "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
        "p8_checked": "SELECT count(DISTINCT doc_id) AS n_texts, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_needless, CAST(0 AS BIGINT) AS n_overfull FROM documents WHERE length(text) > 0",
        "p9_found": f"{_RUNS} SELECT * FROM found",
        "p9_shared": f"{_RUNS} SELECT doc_id, count(start_pos) AS n_runs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS shared_chars FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN found USING (doc_id) GROUP BY doc_id",
    }
