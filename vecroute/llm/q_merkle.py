"""op13: the manifest of all documents, a proof for each, and what proofs of altered documents give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.llm.common import table
from vecroute.llm.merkle import digest, fold, manifest, proof, row_digest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with an id whose CRC-32 is a multiple of 5 is altered: its text's A-Z are lower-cased."""
    docs = table(spark, sf_dir, "documents")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    rows = docs.select(
        "doc_id", "source", row_digest([F.col(c) for c in COLUMNS]).alias("leaf"), F.when(altered, row_digest(lowered)).alias("altered")
    )
    found = manifest(rows, "source", ["doc_id"])
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    shown = found.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
#: DuckDB has no CRC-32: its table of 256 values is made by the rule of the polynomial, and applied byte by byte.
SQL = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE steps(i, s, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, s + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE s < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM steps WHERE s = 8
), ids AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id IS NOT NULL
), crc(doc_id, name, i, c) AS (
  SELECT doc_id, name, 1, 4294967295 FROM ids
  UNION ALL SELECT doc_id, name, i + 1, xor(c >> 8, t[(xor(c, ascii(substr(name, i, 1))) & 255) + 1])
  FROM crc, crc_table WHERE i <= length(name)
), altered AS (
  SELECT doc_id AS hit FROM crc WHERE i = length(name) + 1 AND xor(c, 4294967295) % 5 = 0
), leaves AS (
  SELECT d.doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN a.hit IS NOT NULL THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered
  FROM documents d LEFT JOIN altered a ON d.doc_id = a.hit
), groups AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM leaves)
), numbered AS (
  SELECT l.*, g.tree, count(*) OVER (PARTITION BY g.tree) AS size,
         row_number() OVER (PARTITION BY g.tree ORDER BY l.doc_id NULLS FIRST, leaf) - 1 AS place
  FROM leaves l JOIN groups g ON l.source IS NOT DISTINCT FROM g.source
), nodes(tree, level, place, size, h) AS (
  SELECT tree, 0, place, size, leaf FROM numbered
  UNION ALL SELECT tree, level + 1, place // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM nodes WHERE size > 1 GROUP BY tree, level, place // 16, size
), subroots AS (
  SELECT tree, h, count(*) OVER () AS n FROM nodes WHERE size = 1
), top(level, place, size, h) AS (
  SELECT 0, tree, n, h FROM subroots
  UNION ALL SELECT level + 1, place // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM top WHERE size > 1 GROUP BY level, place // 16, size
), every AS (
  SELECT tree, level, place, size, h FROM nodes UNION ALL SELECT -1, level, place, size, h FROM top
), walk(tree, first, here, level, place, now, proof) AS (
  SELECT tree, place, tree, 0, place, coalesce(altered, leaf), '' FROM numbered
  UNION ALL
  SELECT w.tree, w.first, CASE WHEN max(e.size) > 1 THEN w.here ELSE -1 END, CASE WHEN max(e.size) > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN max(e.size) > 1 THEN w.place // 16 ELSE w.tree END,
         CASE WHEN max(e.size) > 1 THEN sha256(string_agg(CASE WHEN e.place = w.place THEN w.now ELSE e.h END, '' ORDER BY e.place)) ELSE w.now END,
         w.proof || coalesce(string_agg(e.h, '' ORDER BY e.place) FILTER (e.place <> w.place), '')
  FROM walk w JOIN every e ON e.tree = w.here AND e.level = w.level AND e.place // 16 = w.place // 16
  WHERE NOT (w.here = -1 AND e.size = 1)
  GROUP BY w.tree, w.first, w.here, w.level, w.place, w.now, w.proof
)
SELECT n.doc_id, n.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.now AS folded_root, w.now = r.h AS verified
FROM numbered n
JOIN subroots s ON s.tree = n.tree
JOIN top r ON r.size = 1
JOIN walk w ON w.tree = n.tree AND w.first = n.place AND w.here = -1 AND w.level = r.level
"""
}
