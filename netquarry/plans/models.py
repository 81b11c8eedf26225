"""Training, ablation and collinearity queries, each with SQL that gives the same rows (SQL takes the Newton steps in a recursion)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import training
from ..sources.packets import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


FEATURES = ["upper", "marks"]
SUBSETS = {"upper": ["upper"], "marks": ["marks"], "both": FEATURES}
STEPS = 25


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: the source as group, quality as label, two shares of characters as features."""
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").select("doc_id", F.col("quality").alias("y"))
    t = F.coalesce("text", F.lit(""))
    share = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) * 100 / F.greatest(F.length(t), F.lit(1))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), share("[^A-Z]").alias("upper"), share("[^!?#$%&*|]").alias("marks"))
    return docs.join(labels, "doc_id")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return rows.join(training.group_folds(rows, "source", "y").select("source", "fold"), "source")


def _out_of_fold(rows: DataFrame, subsets: dict[str, list[str]]) -> DataFrame:
    models = training.fit_many(rows, FEATURES, "y", "fold", subsets)
    return training.fold_rates(training.predictions(rows, FEATURES, "fold", models), "y", "fold")


_DATA = """
d0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
r AS (SELECT source, l.quality AS y, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) * 100::DOUBLE / greatest(length(t), 1) AS x1, (length(t) - length(regexp_replace(t, '[!?#$%&*|]', '', 'g'))) * 100::DOUBLE / greatest(length(t), 1) AS x2
      FROM d0 JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1)),
g AS (SELECT source, count(*) AS n, sum(y) AS pos FROM r GROUP BY 1)"""
_FOLDS = _DATA + """,
k AS (SELECT greatest(2, least(5, sum(pos), sum(n) - sum(pos), count(*)))::BIGINT AS k FROM g),
f AS (SELECT source, n, CAST((row_number() OVER (ORDER BY n DESC, source) - 1) % k AS INTEGER) AS fold FROM g, k)"""
_ALONE = _DATA + """,
f AS (SELECT source, n, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS fold FROM g)"""


def _newton_sql(folds: str, subsets: str) -> str:
    """Models of every subset and fold by Newton steps, then their rates on the rows of their fold."""
    q = "1 / (1 + exp(-(m.b0 + m.b1 * x1 * m1 + m.b2 * x2 * m2)))"
    return f"""WITH RECURSIVE {folds},
rows_ AS (SELECT r.*, fold FROM r JOIN f USING (source)),
sub(subset, m1, m2) AS (VALUES {subsets}),
bal AS (SELECT f.fold, count(*)::DOUBLE / (2 * count(*) FILTER (y = 1)) AS s1, count(*)::DOUBLE / (2 * count(*) FILTER (y = 0)) AS s0 FROM (SELECT DISTINCT fold FROM f) f JOIN rows_ t ON t.fold <> f.fold GROUP BY 1),
models AS (
  SELECT 0 AS i, subset, m1, m2, fold, s0, s1, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM sub, bal
  UNION ALL
  SELECT i + 1, subset, m1, m2, fold, s0, s1,
         b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
         b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
         b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (
    SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
      SELECT i, subset, m1, m2, fold, s0, s1, b0, b1, b2, sum(s * (q - y)) AS g0, sum(s * (q - y) * x1 * m1) + b1 AS g1, sum(s * (q - y) * x2 * m2) + b2 AS g2,
             sum(s * q * (1 - q)) AS h00, sum(s * q * (1 - q) * x1 * m1) AS h01, sum(s * q * (1 - q) * x2 * m2) AS h02, sum(s * q * (1 - q) * x1 * x1 * m1) + 1 AS h11,
             sum(s * q * (1 - q) * x1 * x2 * m1 * m2) AS h12, sum(s * q * (1 - q) * x2 * x2 * m2) + 1 AS h22
      FROM (SELECT m.*, x1, x2, y, {q} AS q, CASE WHEN y = 1 THEN s1 ELSE s0 END AS s FROM models m JOIN rows_ t ON t.fold <> m.fold WHERE i < {STEPS})
      GROUP BY i, subset, m1, m2, fold, s0, s1, b0, b1, b2))),
p AS (SELECT m.subset, m.fold, y, {q} >= 0.5 AS hit FROM models m JOIN rows_ t ON t.fold = m.fold WHERE i = {STEPS}),
c AS (SELECT subset, fold, count(*) FILTER (y = 1 AND hit) AS tp, count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 1 AND NOT hit) AS fn, count(*) FILTER (y = 0 AND NOT hit) AS tn FROM p GROUP BY 1, 2),
rates AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 4) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1, round(CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END, 4) AS fpr FROM c)
"""


_BOTH, _EACH = "('both', 1, 1)", "('upper', 1, 0), ('marks', 0, 1), ('both', 1, 1)"
_add("fold_groups", lambda s, d: training.group_folds(_rows(s, d), "source", "y"), f"WITH {_FOLDS} SELECT source, n, fold FROM f")
_add("fold_rates", lambda s, d: _out_of_fold(_folded(s, d), {"both": FEATURES}), _newton_sql(_FOLDS, _BOTH) + "SELECT * FROM rates")
_SUMMARY = """SELECT subset, count(*) AS folds, """ + ", ".join(f"round(avg({c}), 4) AS {c.strip(chr(34))}_mean, round(stddev_pop({c}), 4) AS {c.strip(chr(34))}_std" for c in ("f1", '"precision"', "recall", "fpr")) + ", CAST(sum(fn) AS BIGINT) AS total_fn, CAST(sum(fp) AS BIGINT) AS total_fp FROM rates GROUP BY 1"
_add("subset_ablation", lambda s, d: training.summary(_out_of_fold(_folded(s, d), SUBSETS)), _newton_sql(_FOLDS, _EACH) + _SUMMARY)


def _left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return rows.join(training.group_numbers(rows, "source"), "source")


_add("leave_one_out", lambda s, d: _out_of_fold(_left_out(s, d), {"both": FEATURES}), _newton_sql(_ALONE, _BOTH) + "SELECT * FROM rates")

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "unit"]


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.lit(1.0).alias("unit"))


_add("feature_moments", lambda s, d: training.moments(_measures(s, d), _MEASURES).select("a", "b", F.format_string("%.9e", "covariance").alias("covariance")),
     "WITH m AS (SELECT *, 1.0::DOUBLE AS unit FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, printf('%.9e', covar_pop({a}::DOUBLE, {b}::DOUBLE)) AS covariance FROM m" for i, a in enumerate(_MEASURES) for b in _MEASURES[i:]))
_add("variance_inflation", lambda s, d: training.vif(_measures(s, d), _MEASURES).select("column", F.round("vif", 6).alias("vif")), """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
SELECT 'l_quantity' AS "column", round((1 - bc * bc) / det, 6) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - ac * ac) / det, 6) FROM d
UNION ALL SELECT 'l_discount', round((1 - ab * ab) / det, 6) FROM d UNION ALL SELECT 'unit', NULL""")
