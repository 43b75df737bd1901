"""Queries of the training-data operators, with DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, table
from .mixing import mix, normal_label, shares
from .near_duplicates import near_duplicate_groups, similar_ids
from .packing import fills, pack
from .personal_data import masked, personal_places
from .scanned_text import noise_places, paragraphs
from .similar_vectors import most_similar
from .splitting import split_oversized
from .tokens import token_counts


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for space, name, width in (("chunk", "vec_chunks", 384), ("media", "vec_media", 512)):
        found = most_similar(table(spark, sf_dir, name), "rowid", "embedding", width)
        parts.append(found.select(F.lit(space).alias("space"), F.col("id").alias("rowid"), "other", "score"))
    return parts[0].unionByName(parts[1])


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector of both tables, with their score."""
    return _neighbours(spark, sf_dir).select("space", "rowid", F.col("other").alias("similar_rowid"), "score")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _neighbours(spark, sf_dir).where(F.col("score") >= 0.80)
    return near.select("space", F.least("rowid", "other").alias("rowid_a"), F.greatest("rowid", "other").alias("rowid_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_places(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of all .pdf files."""
    return paragraphs(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose sets of three-word sequences have a similarity of 0.5 or more."""
    return similar_ids(table(spark, sf_dir, "chunks"), "id", "content", words=3, threshold=0.5, whole=True)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the pairs of p4_found form, one row per chunk."""
    return near_duplicate_groups(table(spark, sf_dir, "chunks"), "id", "content", words=3, threshold=0.5)


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk above 500 code points."""
    return split_oversized(table(spark, sf_dir, "chunks"), "id", "content", "start_line")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 0").select("id", "kind")


def p5_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each chunk join up to without their overlaps: a digest, how many are too long, and the lines."""
    pieces = p5_pieces(spark, sf_dir).withColumn("body", F.expr("substring(content, overlap_chars + 1)"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "body"))), lambda p: p["body"]), "")
    return pieces.groupBy("id").agg(F.sha2(whole, 256).alias("sha256"), F.count_if(F.char_length("content") > 500).alias("n_too_long"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each kind."""
    counted = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "tokens")
    return pack(counted, table(spark, sf_dir, "containers")).withColumnRenamed("id", "doc_id")


def p6_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(p6_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of container: its documents, how many containers are overfull, how many documents were split without
    need, and how many have gaps between their parts."""
    packed = materialize(p6_packed(spark, sf_dir), "packed").join(F.broadcast(table(spark, sf_dir, "containers").dropDuplicates(["container_kind"])), "container_kind")  # four rows
    over = packed.groupBy("container_kind", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("used")).groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("n_overfull"))
    each = packed.groupBy("container_kind", "doc_id", "capacity_tokens").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.min("first_token").alias("start"))
    counts = each.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_split"), F.count_if((F.col("start") != 0) | (F.col("end") != F.col("n"))).alias("n_gaps"))
    return counts.join(over, "container_kind").select("container_kind", "n_documents", "n_overfull", "n_split", "n_gaps")


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their repeats."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reaches in it."""
    return shares(materialize(p7_mixed(spark, sf_dir), "mixed"), table(spark, sf_dir, "mix_targets"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target: how many documents are used too often or carry another label, and whether its share is met: but for 0.01 of all
    tokens, or for one document where that is more, it has its part of the targets that have documents."""
    mixed, targets = materialize(p7_mixed(spark, sf_dir), "mixed"), table(spark, sf_dir, "mix_targets")
    labels = table(spark, sf_dir, "documents").select("doc_id", normal_label().alias("label"))
    caps = targets.select(normal_label().alias("source"), "max_repeats").dropDuplicates(["source"])
    used = mixed.join(labels, "doc_id").join(caps, "source").groupBy("source").agg(
        F.count_if((F.col("repeats") > F.col("max_repeats")) & ~F.col("soft")).alias("n_over"), F.count_if(~F.col("soft") & (F.col("label") != F.col("source"))).alias("n_foreign"))
    reached = shares(mixed, targets)
    whole = reached.where("n_documents > 0").agg(F.sum("target_share").alias("all"), F.sum("n_tokens").alias("whole"))
    largest = mixed.agg(F.max("n_tokens").alias("largest"))
    goal = F.when(F.col("n_documents") > 0, F.col("target_share") / F.col("all")).otherwise(0.0)
    off = F.abs(F.col("reached_share") - goal) * F.col("whole")
    joined = reached.crossJoin(whole).crossJoin(largest).join(used, "source", "left")  # one row each
    return joined.select("source", F.coalesce("n_over", F.lit(0)).alias("n_over"), F.coalesce("n_foreign", F.lit(0)).alias("n_foreign"), (off <= F.greatest(0.01 * F.col("whole"), F.col("largest"))).alias("is_met"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = personal_places(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "given_names"))
    return places.select(F.col("id").alias("doc_id"), F.col("start_char").cast("long").alias("start_char"), "pii_type")


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a typed placeholder for each value."""
    return masked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "given_names")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p3_found": p3_found,
    "p3_paragraphs": p3_paragraphs,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_joined": p5_joined,
    "p6_packed": p6_packed,
    "p6_fills": p6_fills,
    "p6_checks": p6_checks,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_masked": p8_masked,
}
_NEAREST = """
WITH {0} AS (SELECT DISTINCT rowid AS rid, CAST(embedding AS DOUBLE[]) AS e FROM {1} WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
{0}_d AS (SELECT a.rid AS rid, b.rid AS other, list_cosine_similarity(a.e, b.e) AS c FROM {0} a JOIN {0} b ON a.rid <> b.rid),
{0}_r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY c DESC, other) AS k FROM {0}_d)
SELECT DISTINCT '{0}' AS space, least(rid, other) AS rowid_a, greatest(rid, other) AS rowid_b FROM {0}_r WHERE k <= 10 AND c >= 0.8
"""

ORACLES: dict[str, str] = {
    # all pairs, which is what the index saves; both agree on the small tables
    "p1_found": f"SELECT * FROM ({_NEAREST.format('chunk', 'vec_chunks')}) UNION ALL SELECT * FROM ({_NEAREST.format('media', 'vec_media')})",
    "p4_found": """
WITH c AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM c WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * k >= x.n + y.n - k
""",
    # classes are texts with the same words; the smallest id stands for each, and groups are what links reach
    "p4_groups": """
WITH RECURSIVE c AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL),
k AS (SELECT id, w, min(id) OVER (PARTITION BY w) AS cls FROM c WHERE len(w) >= 3),
s AS (SELECT DISTINCT cls, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM k WHERE id = cls),
n AS (SELECT cls, count(*) AS n FROM s GROUP BY cls),
p AS (SELECT a.cls AS a, b.cls AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.cls <> b.cls GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.cls = a JOIN n y ON y.cls = b WHERE 2 * k >= x.n + y.n - k),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
d AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT k.id AS id, least(k.cls, coalesce(m.least, k.cls)) AS group_id, coalesce(d.n_links, 0) AS n_links FROM k LEFT JOIN m ON m.a = k.cls LEFT JOIN d ON d.a = k.cls
""",
    "p5_joined": """
SELECT DISTINCT id, sha256(content) AS sha256, 0 AS n_too_long, start_line AS first_line, start_line + CAST(length(content) - length(replace(content, chr(10), '')) AS INTEGER) AS last_line
FROM chunks WHERE length(content) > 500
""",
    "p6_checks": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, 0 AS n_overfull, 0 AS n_split, 0 AS n_gaps FROM containers",
    "p7_checks": "SELECT DISTINCT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS source, 0 AS n_over, 0 AS n_foreign, true AS is_met FROM mix_targets",
    "p5_found": """
SELECT DISTINCT id, CASE WHEN regexp_matches(content, '[^ \\t\\r\\n]{501,}') THEN 'hard' ELSE 'boundary' END AS kind
FROM chunks WHERE length(content) > 500
""",
}
