"""Content scans over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import content as C
from .adapters import sql_text, table
from .catalog import query


# In the documents a secret stands inside a sentence; giving it its own line
# makes the text look like source code.
@query(r"""
WITH lines AS (SELECT doc_id, pos::INT AS line, l FROM (
  SELECT doc_id, unnest(list_zip(range(1, len(parts) + 1), parts)) AS z, z[1] AS pos, z[2] AS l FROM (
    SELECT doc_id, regexp_split_to_array(replace(text, ' token = ', chr(10) || '  api_token = '), '\r\n|\n|\r') AS parts FROM documents)))
, f AS (SELECT *, trim(regexp_extract(l, '(?i)^\s*(\w*token)\s*=\s*"([^''"]+)"', 1)) AS identifier,
  regexp_extract(l, '(?i)^\s*(\w*token)\s*=\s*"([^''"]+)"', 2) AS v FROM lines)
SELECT doc_id, line, identifier, left(v, 2) || repeat('•', (length(v) - 4)::INT) || right(v, 2) AS masked_value, left(trim(l), 120) AS excerpt
FROM f WHERE identifier <> '' AND ltrim(l) NOT LIKE '#%' AND length(v) > 4""")
def secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit(" token = "), F.lit("\n  api_token = ")).alias("text")
    )
    return C.secret_scan(docs, "text").select("doc_id", "line", "identifier", "masked_value", "excerpt")


MANIFEST = [name for name, *_ in R.VULNERABLE_VERSIONS] + ["numpy"]


# Parts become manifests: one component per brand and size, in three notations.
@query("""
WITH m AS (SELECT p_partkey, p_partkey % 8 AS c, p_size // 3 || '.' || p_size || '.' || (p_partkey % 20) AS v,
   p_size // 3 AS a, p_size AS b, p_partkey % 20 AS d FROM part)
, t AS (SELECT p_partkey, ([{names}])[(c + 1)::INT] AS component, CASE WHEN p_partkey % 3 = 2 THEN '0' ELSE v END AS installed,
   CASE WHEN p_partkey % 3 = 2 THEN [0] ELSE [a, b, d] END AS parts, p_partkey % 3 AS form FROM m)
, base AS (SELECT * FROM (VALUES {base}) AS x(component, lim))
SELECT p_partkey, component, installed, CASE WHEN lim IS NULL THEN 'NO BASELINE' WHEN parts <= lim THEN 'VULNERABLE' ELSE 'CLEAR' END AS status
FROM t LEFT JOIN base USING (component)""".format(
    names=", ".join(sql_text(n) for n in MANIFEST),
    base=", ".join(f"('{n}', [{v.replace('.', ', ')}])" for n, v, _, _ in R.VULNERABLE_VERSIONS),
))
def sca_scan(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in MANIFEST]), (F.col("p_partkey") % 8 + 1).cast("int"))
    version = F.concat_ws(".", F.expr("p_size div 3"), "p_size", F.col("p_partkey") % 20)
    form = F.col("p_partkey") % 3
    line = F.when(form == 0, F.concat(name, F.lit(" == "), version)).when(
        form == 1, F.concat(F.upper(name), F.lit("@"), version)
    ).otherwise(name)
    manifests = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("# pinned\n\n"), line).alias("manifest"))
    return C.sca_scan(manifests, "manifest").select("p_partkey", "component", "installed", "status")


# Every document gets a made-up id at its end.
@query("""
SELECT doc_id, substr(lpad((doc_id % 100000)::VARCHAR, 5, '3'), 1, 3) || '••-•••••••-' || (doc_id % 10) AS masked_id FROM documents""")
def id_mask(spark, sf_dir):
    number = F.concat(F.lpad((F.col("doc_id") % 100_000).cast("string"), 5, "3"), F.lit("-1234567-"), F.col("doc_id") % 10)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("text", F.lit(" id "), number, F.lit(" end")).alias("text")
    )
    return C.find_ids(docs, "text").select("doc_id", "masked_id")
