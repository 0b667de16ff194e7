"""The registered queries of this subpackage, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, kdtree, licenses, lines, multiset_hash, packing, pii, quality, simhash, spelling, substrings, token_store, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find_repeats(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    said = F.transform("found", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"], F.format_number(x["probability"], 3), x["confirmed"].cast("string")))
    return rows.select(
        "doc_id", F.size("found").cast("long").alias("n_found"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"), F.array_join(said, ",").alias("paragraphs"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(spark, _table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def _words(column: str) -> str:
    """SQL for the words of a text, by the contract's pattern."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{upper}', '{lower}'), '{decontaminate.WORD}')"


def _centroids(rounds: int) -> str:
    """SQL for the clustering: a table of centroids and one of assignments a round."""
    distance = "list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: CAST(floor({kdtree.SCALE} * x) AS BIGINT)) AS v
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {kdtree.DIM}) WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"z0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS z FROM (SELECT sha256(concat('{kdtree.SEED}:', vec_id)) AS h, v FROM kept ORDER BY h, v LIMIT {kdtree.CENTROIDS}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT r, vec_id, v, c, {distance} AS d FROM kept CROSS JOIN z{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        parts.append(f"s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL)")
        parts.append(f"z{i + 1} AS MATERIALIZED (SELECT c, coalesce(moved, z) AS z FROM z{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved FROM s{i} GROUP BY c) USING (c))")
    last = f"SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256 FROM a{rounds} JOIN z{rounds} USING (c)"
    return "WITH " + ",\n".join(parts[:-2]) + "\n" + last


QUERIES = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_store": op9_token_store,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_nearest_vectors": op12_nearest_vectors,
    "op13_centroids": op13_centroids,
}
#: The other operators rest on hashes, tokenizers or models that SQL lacks; they are tested otherwise.
ORACLE_SQL = {
    "op10_decontamination": rf"""
with d as materialized (select row_number() over () as r, doc_id, {_words("text")} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item_id, {_words("text")} as w from benchmark),
windows as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as said
  from (select item_id, w, least(len(w), {decontaminate.WINDOW}) as size, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1) + 1)) as i from b where len(w) > 0)
),
places as (
  select r, size, i, array_to_string(w[i:i + size - 1], ' ') as said
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from windows) where len(w) >= size)
),
hits as materialized (select r, i, size, item_id from places join windows using (size, said)),
hit_words as (select r, count(*) as n_hit from (select distinct r, i + unnest(range(size)) as word from hits) group by r),
hit_items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, item_id from hits) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (r) left join hit_items using (r)
""",
    "op13_centroids": _centroids(kdtree.ROUNDS),
}
