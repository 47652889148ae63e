"""The driver's tables seen as labelled matrices: cells, samples, folds, scores, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, models, nested, splits
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    frozen = (F.col("vec_id") % 3 == 0) & (F.col("label") != 9)
    return e.select(
        F.col("vec_id").alias("sample_id"), F.col("label").alias("class"), F.floor(F.col("label") / 3).cast("int").alias("family"), F.when(frozen, "Frozen").otherwise("FFPE").alias("material"),
        F.when(F.col("vec_id") % 4 == 0, "external").otherwise("reference").alias("cohort"), "embedding",
    )


def gone(sample_id: Column, probe: Column) -> Column:
    """Which cells are missing: by a rule, so that probe 5 misses more than a twentieth."""
    return ((sample_id * 31 + probe * 17) % 23 == 0) | ((probe == 5) & (sample_id % 10 == 0))


def cells_of(rows: DataFrame) -> DataFrame:
    """Long cells of sample rows, with their other columns. What a sample carries, such as its fold, is joined to its row before, so that no cell is shuffled for it."""
    s = rows.select(*[c for c in rows.columns if c != "embedding"], F.posexplode("embedding").alias("probe", "v"))
    return s.withColumn("beta", F.when(~gone(F.col("sample_id"), F.col("probe")), F.col("v").cast("double"))).drop("v")


def with_betas(rows: DataFrame) -> DataFrame:
    """Sample rows with all their cells as one array, betas, by the probe's number."""
    return rows.withColumn("betas", F.transform("embedding", lambda v, i: F.when(~gone(F.col("sample_id"), i), v.cast("double")))).drop("embedding")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Long cells; some are missing."""
    return cells_of(samples(spark, sf))


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_folds(samples(spark, sf))


def folded(spark: SparkSession, sf: str) -> DataFrame:
    """Sample rows with their outer fold."""
    return samples(spark, sf).join(folds(spark, sf).select("sample_id", "outer_fold"), "sample_id")


def split_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training and test cells of outer fold 0."""
    both = cells_of(folded(spark, sf))
    return both.filter("outer_fold <> 0"), both.filter("outer_fold = 0")


def test_scores(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, class, p of every sample, by the nearest centroid of the outer folds that it isn't in."""
    return models.centroid_scores(nested.held_out_distances(cells(spark, sf), nested.outer_dealt(folds(spark, sf))))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("sample_id", F.col("class").alias("truth"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.scored_rows(test_scores(spark, sf), truth(spark, sf))


SAMPLES = """WITH samples AS (SELECT vec_id AS sample_id, label AS class, CAST(floor(label / 3) AS INT) AS family,
 CASE WHEN vec_id % 3 = 0 AND label <> 9 THEN 'Frozen' ELSE 'FFPE' END AS material,
 CASE WHEN vec_id % 4 = 0 THEN 'external' ELSE 'reference' END AS cohort, embedding FROM embeddings)"""
CELLS = SAMPLES + """, cells AS (SELECT sample_id, class, family, material, cohort, probe,
 CASE WHEN (sample_id * 31 + probe * 17) % 23 = 0 OR (probe = 5 AND sample_id % 10 = 0) THEN NULL ELSE CAST(v AS DOUBLE) END AS beta
 FROM (SELECT *, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS probe FROM samples))"""
_INNER = ", ".join(f"CASE WHEN outer_fold = {k} THEN -1 ELSE (row_number() OVER (PARTITION BY class, outer_fold = {k} ORDER BY md5('{43 + k}|' || sample_id), sample_id) - 1) % 3 END" for k in range(5))
FOLDS = """, outers AS (SELECT sample_id, class, (row_number() OVER (PARTITION BY class ORDER BY md5('42|' || sample_id), sample_id) - 1 + class) % 5 AS outer_fold FROM samples)"""
INNER = FOLDS + f""", folds AS (SELECT *, [{_INNER}] AS inner_folds FROM outers)"""
SPLIT = CELLS + FOLDS + """, split AS (SELECT c.*, o.outer_fold FROM cells c JOIN outers o USING (sample_id)),
 train AS (SELECT * FROM split WHERE outer_fold <> 0), test AS (SELECT * FROM split WHERE outer_fold = 0)"""
CENTROIDS = SPLIT + """, cent AS (SELECT class, probe, avg(beta) AS mean FROM train WHERE beta IS NOT NULL GROUP BY 1, 2),
 df AS (SELECT greatest(count(DISTINCT sample_id) - count(DISTINCT class), 1) AS df FROM train WHERE beta IS NOT NULL),
 pooled AS (SELECT probe, sum((beta - mean) * (beta - mean)) / max(df) + 1e-4 AS var FROM train JOIN cent USING (class, probe), df WHERE beta IS NOT NULL GROUP BY probe),
 centroids AS (SELECT class, probe, mean, var, mean / var AS a, mean * mean / var AS b FROM cent JOIN pooled USING (probe))"""
SCORES = CELLS + FOLDS + """, each AS (SELECT k, s.sample_id, s.class, s.probe, s.beta FROM cells s JOIN outers USING (sample_id) JOIN (SELECT unnest(range(5)) AS k) ON outer_fold <> k WHERE s.beta IS NOT NULL),
 means AS (SELECT k, class, probe, avg(beta) AS mean FROM each GROUP BY ALL), sizes AS (SELECT k, greatest(count(DISTINCT sample_id) - count(DISTINCT class), 1) AS df FROM each GROUP BY k),
 vars AS (SELECT k, probe, sum((beta - mean) * (beta - mean)) / any_value(df) + 1e-4 AS var FROM each JOIN means USING (k, class, probe) JOIN sizes USING (k) GROUP BY k, probe),
 dist AS (SELECT t.sample_id, c.class, sum(-2 * t.beta * c.mean / v.var + c.mean * c.mean / v.var) AS distance, count(*) AS n_obs FROM cells t JOIN outers o USING (sample_id) JOIN means c ON c.k = o.outer_fold AND c.probe = t.probe JOIN vars v ON v.k = c.k AND v.probe = c.probe WHERE t.beta IS NOT NULL GROUP BY 1, 2),
 ex AS (SELECT *, exp(-0.5 * (distance - min(distance) OVER (PARTITION BY sample_id)) / greatest(n_obs, 1)) AS e FROM dist),
 scores AS (SELECT sample_id, class, round(e / sum(e) OVER (PARTITION BY sample_id), 9) AS p FROM ex)"""
TOP = """, top AS (SELECT sample_id, class AS predicted, p AS confidence FROM scores QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, class) = 1)"""
SCORED = SCORES + TOP + """, scored AS (SELECT sample_id, truth, brier, p_true, predicted, confidence, CAST(truth = predicted AS INT) AS correct FROM
 (SELECT sample_id, s2.class AS truth, sum(p * p) - 2 * max(CASE WHEN scores.class = s2.class THEN p END) + 1 AS brier, max(CASE WHEN scores.class = s2.class THEN p END) AS p_true
  FROM scores JOIN samples s2 USING (sample_id) GROUP BY 1, 2) JOIN top USING (sample_id))"""


def summary_sql(source: str, by: str) -> str:
    """SQL of metrics.summary over a relation with the columns of scored and the keys by (comma-separated, never empty)."""
    on = f"USING ({by})"
    return f"""SELECT * FROM (SELECT {by}, count(*) AS n, avg(correct) AS accuracy, avg(brier) AS brier, avg(CAST(confidence >= 0.9 AS INT)) AS confident_share, avg(correct) FILTER (WHERE confidence >= 0.9) AS confident_accuracy FROM {source} GROUP BY {by})
 JOIN (SELECT {by}, avg(2.0 * tp / (n_t + n_p)) AS macro_f1, avg(1.0 * tp / n_t) AS balanced_accuracy FROM (SELECT {by}, truth AS class, count(*) AS n_t, sum(correct) AS tp FROM {source} GROUP BY {by}, truth)
  LEFT JOIN (SELECT {by}, predicted AS class, count(*) AS n_q FROM {source} GROUP BY {by}, predicted) USING ({by}, class), LATERAL (SELECT coalesce(n_q, 0) AS n_p) GROUP BY {by}) {on}
 JOIN (SELECT {by}, sum(off) / sum(n_bin) AS ece FROM (SELECT {by}, least(floor(confidence * 15), 14) AS bin, count(*) AS n_bin, abs(sum(correct) - sum(confidence)) AS off FROM {source} GROUP BY {by}, bin) GROUP BY {by}) {on}"""


#: SQL of a hashed uniform, from seed and columns.
U = "(CAST(('0x' || substr(md5(concat_ws('|', '{}', {})), 1, 8)) AS BIGINT) / 4294967296.0)"
#: Resamples of the registered queries.
DRAWN = 200
DRAWS = """, numbered AS (SELECT *, row_number() OVER (ORDER BY floor(""" + U.format("row", "sample_id") + """ * 256), sample_id) - 1 AS i, count(*) OVER () AS nn FROM {src}),
 drawn AS (SELECT b, CAST(floor(""" + U.format(0, "b, i") + """ * nn) AS BIGINT) AS i FROM numbered, (SELECT unnest(range(200)) AS b)), boot AS (SELECT b, n.* FROM drawn JOIN numbered n USING (i))"""


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def rsql(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)
