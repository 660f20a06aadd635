"""Ranks, bins, running totals, permutations, top-k and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.contracts import SEED
from cohortspark.operators import ranks, resample, sampling
from cohortspark.queries import bindings as B
from cohortspark.queries.evaluation import md5_order
from cohortspark.queries.registry import query

UNITS = "SELECT id_municipio, count(*) AS n, avg(y) AS taxa, sum(peso_aluno) AS peso FROM scored GROUP BY 1"


def units(spark, folder):
    return B.scored(spark, folder).groupBy("id_municipio").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("taxa"), F.sum("peso_aluno").alias("peso"))


@query("ordinal_rank_of_eligible", B.with_ctes("""
SELECT id_municipio, taxa, CASE WHEN n >= 3 THEN row_number() OVER (PARTITION BY n >= 3 ORDER BY taxa DESC, id_municipio) END AS posicao FROM u""", "scored", extra={"u": UNITS}), ["taxa"])
def ordinal_rank_of_eligible(spark, folder):
    """Position among the eligible units only; the others keep NULL."""
    table = units(spark, folder).withColumn("_e", F.when(F.col("n") >= 3, F.col("taxa")))
    return ranks.row_number(table, "_e", "id_municipio", "posicao", descending=True).select("id_municipio", "taxa", "posicao")


@query("competition_rank", B.with_ctes("SELECT id_municipio, rank() OVER (ORDER BY taxa DESC) AS posicao FROM u", "scored", extra={"u": UNITS}))
def competition_rank(spark, folder):
    return ranks.tied_rank(units(spark, folder), "taxa", "posicao", method="min", descending=True).select("id_municipio", "posicao")


@query("average_rank", B.with_ctes("SELECT row_id, r AS posto FROM ranked", "ranked"), ["posto"])
def average_rank(spark, folder):
    return ranks.tied_rank(B.scored(spark, folder).select("row_id", "p"), "p", "posto").select("row_id", "posto")


BIN = "greatest(1, ceil(round((rn - 1) * {q}.0::DOUBLE / (total - 1), 9)))"


@query("equal_frequency_bins", B.with_ctes("SELECT decil, count(*) AS n, min(taxa) AS menor, max(taxa) AS maior, sum(id_municipio)::BIGINT AS soma FROM (SELECT *, CAST("
       + BIN.format(q=10) + """ AS INTEGER) AS decil FROM (SELECT *, row_number() OVER (ORDER BY taxa, id_municipio) AS rn, count(*) OVER () AS total FROM u) AS x) AS y GROUP BY 1""",
       "scored", extra={"u": UNITS}), ["menor", "maior"])
def equal_frequency_bins(spark, folder):
    binned = ranks.equal_frequency(units(spark, folder), "taxa", "id_municipio", 10, "decil")
    return binned.groupBy("decil").agg(F.count(F.lit(1)).alias("n"), F.min("taxa").alias("menor"), F.max("taxa").alias("maior"), F.sum("id_municipio").alias("soma"))


@query("value_quantile_bins", B.with_ctes("""
SELECT nivel, count(*) AS n, avg(risco_nao_alfabetizacao) AS taxa FROM (SELECT risco_nao_alfabetizacao, CASE WHEN v IS NULL THEN 'sem_historico' WHEN v <= q1 THEN 'q1' WHEN v <= q2 THEN 'q2'
  WHEN v <= q3 THEN 'q3' WHEN v <= q4 THEN 'q4' ELSE 'q5' END AS nivel FROM (SELECT risco_nao_alfabetizacao, mun_taxa_presenca_lag1 AS v FROM dataset) AS d
  CROSS JOIN (SELECT quantile_cont(mun_taxa_presenca_lag1, 0.2) AS q1, quantile_cont(mun_taxa_presenca_lag1, 0.4) AS q2, quantile_cont(mun_taxa_presenca_lag1, 0.6) AS q3,
    quantile_cont(mun_taxa_presenca_lag1, 0.8) AS q4 FROM dataset) AS e) AS b GROUP BY 1""", "dataset"), ["taxa"])
def value_quantile_bins(spark, folder):
    """Quintiles of the presence rate; unknown presence is a level of its own."""
    rows = B.dataset(spark, folder).select("mun_taxa_presenca_lag1", "risco_nao_alfabetizacao")
    edges = ranks.quantile_edges(rows, "mun_taxa_presenca_lag1", 5)
    level = F.coalesce(ranks.cut(F.col("mun_taxa_presenca_lag1"), edges, [f"q{i + 1}" for i in range(len(edges) - 1)], True), F.lit("sem_historico"))
    return rows.groupBy(level.alias("nivel")).agg(F.count(F.lit(1)).alias("n"), F.avg("risco_nao_alfabetizacao").alias("taxa"))


@query("fixed_edge_bins", B.with_ctes("""
SELECT faixa, count(*) AS n FROM (SELECT CASE WHEN n > 0 AND n <= 2 THEN '(0, 2]' WHEN n <= 4 THEN '(2, 4]' WHEN n <= 8 THEN '(4, 8]' ELSE '(8, inf)' END AS faixa FROM u) AS x GROUP BY 1""",
    "scored", extra={"u": UNITS}))
def fixed_edge_bins(spark, folder):
    label = ranks.cut(F.col("n"), [0, 2, 4, 8, float("inf")], ["(0, 2]", "(2, 4]", "(4, 8]", "(8, inf)"])
    return units(spark, folder).groupBy(label.alias("faixa")).agg(F.count(F.lit(1)).alias("n"))


@query("running_total", B.with_ctes("SELECT id_municipio, n, sum(n) OVER (ORDER BY id_municipio ROWS UNBOUNDED PRECEDING)::BIGINT AS acumulado FROM u", "scored", extra={"u": UNITS}))
def running_total(spark, folder):
    return ranks.running_sum(units(spark, folder).select("id_municipio", "n"), "id_municipio", "n", "acumulado")


@query("difference_from_previous_year", B.with_ctes("""
SELECT sigla_uf, ano, taxa, taxa - lag(taxa) OVER (PARTITION BY sigla_uf ORDER BY ano) AS variacao FROM (
  SELECT sigla_uf, ano, avg(alfabetizado) AS taxa FROM students WHERE preenchimento_caderno = 1 GROUP BY 1, 2) AS t""", "students"), ["taxa", "variacao"])
def difference_from_previous_year(spark, folder):
    table = B.students(spark, folder).where(F.col("preenchimento_caderno") == 1).groupBy("sigla_uf", "ano").agg(F.avg("alfabetizado").alias("taxa"))
    return table.withColumn("variacao", F.col("taxa") - F.lag("taxa").over(Window.partitionBy("sigla_uf").orderBy("ano")))


def _order(salt: int, key: str, by: str = "") -> str:
    return f"row_number() OVER ({by} ORDER BY {md5_order(f"'42:{salt}:' || {key}")}, {key})"


@query("permutation_within_group", B.with_ctes(f"""
SELECT sigla_uf, row_id, y FROM (SELECT sigla_uf, row_id, {_order(1, 'row_id', 'PARTITION BY sigla_uf')} AS ordem FROM scored) AS a
JOIN (SELECT sigla_uf, y, {_order(2, 'row_id', 'PARTITION BY sigla_uf')} AS ordem FROM scored) AS b USING (sigla_uf, ordem)""", "scored"))
def permutation_within_group(spark, folder):
    """A shuffle inside the state: which outcome each row takes."""
    return resample.permute(B.scored(spark, folder).select("row_id", "sigla_uf", "y"), ["y"], ["row_id"], SEED, ["sigla_uf"])


@query("global_permutation", B.with_ctes(f"""
SELECT row_id, y, p FROM (SELECT row_id, {_order(1, 'row_id')} AS ordem FROM scored) AS a JOIN (SELECT y, p, {_order(2, 'row_id')} AS ordem FROM scored) AS b USING (ordem)""", "scored"), ["p"])
def global_permutation(spark, folder):
    """Two columns moved together among all rows."""
    return resample.permute(B.scored(spark, folder).select("row_id", "y", "p"), ["y", "p"], ["row_id"], SEED)


@query("top_units", B.with_ctes("SELECT id_municipio, n, taxa FROM u ORDER BY peso DESC, id_municipio LIMIT 50", "scored", extra={"u": UNITS}), ["taxa"])
def top_units(spark, folder):
    return sampling.top_k(units(spark, folder), "peso", "id_municipio", 50).select("id_municipio", "n", "taxa")


@query("bottom_units", B.with_ctes("SELECT id_municipio, n, taxa FROM u ORDER BY peso ASC, id_municipio LIMIT 50", "scored", extra={"u": UNITS}), ["taxa"])
def bottom_units(spark, folder):
    return sampling.top_k(units(spark, folder), "peso", "id_municipio", 50, largest=False).select("id_municipio", "n", "taxa")


@query("seeded_row_sample", B.with_ctes(f"SELECT row_id, y FROM scored ORDER BY {md5_order("'42:0:' || row_id")}, row_id LIMIT 1000", "scored"))
def seeded_row_sample(spark, folder):
    return sampling.sample_rows(B.scored(spark, folder).select("row_id", "y"), 1000, ["row_id"])


@query("whole_group_sample", B.with_ctes(f"""
SELECT id_municipio, n AS k, n FROM (
  SELECT id_municipio, n, sum(n) OVER (ORDER BY ordem) - n AS before, sum(n) OVER () AS total FROM (
    SELECT id_municipio, count(*) AS n, {_order(0, 'id_municipio')} AS ordem FROM scored GROUP BY 1) AS s) AS t WHERE before < total // 2""", "scored"))
def whole_group_sample(spark, folder):
    """Whole municipalities up to a budget of half the rows: rows kept of each and rows it has."""
    rows = B.scored(spark, folder).select("row_id", "id_municipio")
    budget = rows.count() // 2
    kept = sampling.sample_groups(rows, "id_municipio", budget).groupBy("id_municipio").agg(F.count(F.lit(1)).alias("k"))
    sizes = rows.groupBy("id_municipio").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(sizes, "id_municipio").select("id_municipio", "k", "n")
