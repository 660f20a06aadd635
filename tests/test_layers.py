"""Raw files to analysis tables end to end on small untidy CSVs, and every gate."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.functions import cleaning
from cohortspark.operators import quality
from cohortspark.plans import features, medallion
from cohortspark.sources import tables

FILES = {
    C.STATE_DIRECTORY.file: "Sigla,Nome,Região\nAA,Alfa,Norte\nBB,Beta,Sul\n",
    C.MUNICIPAL_DIRECTORY.file: "ID Município,Nome,Sigla UF,Nome UF,Nome Região\n0000001,Um,AA,Alfa,Norte\n0000002,Dois,AA,Alfa,Norte\n0000003,Três,BB,Beta,Sul\n",
    C.STATE_RESULTS.file: "Ano,Sigla UF,Série,Rede,Taxa Alfabetização,Média Português\n2024,AA,2,5,55.5,750.0\n2024,BB,2,5,60.5,760.0\n",
    C.MUNICIPAL_RESULTS.file: (
        "Ano,ID Município,Série,Rede,Taxa Alfabetização,Média Português\n2024.0, 0000001 ,2,5,50.0,745.0\n2024,0000002,2,5,n/d,\n"
        "2024,0000003,2,3,70.0,760.0\n2024,0000003,2,3,71.0,761.0\n2024,9999999,2,5,40.0,730.0\n2024,0000003,2,0,66.0,750.0\n2024,0000002,2,3,52.0,748.0\n"),
    C.MUNICIPAL_GOALS.file: (
        "Ano,ID Município,Rede,Taxa Alfabetização,Percentual Participação,Nível Alfabetização,Meta Alfabetização 2024,Meta Alfabetização 2025\n"
        "2024,0000003,Municipal,70,95,4,68,72\n2024,0000002,Comunitária,50,90,3,55,60\n"),
    C.STATE_GOALS.file: "Ano,Sigla UF,Rede,Taxa Alfabetização,Percentual Participação,Meta Alfabetização 2024\n2024,AA,Pública,55,90,60\n2024,BB,Pública,60,92,58\n",
    C.STUDENTS.file: (
        "Ano,ID Município,ID Escola,ID Aluno,Caderno,Série,Rede,Presença,Preenchimento Caderno,Alfabetizado,Proficiência,Peso Aluno\n"
        "2024,0000001,10,100,1,2,2,1,1,1,750,1.0\n2024,0000001,10,101,1,2,3,1,1,0,700,3.0\n2024,0000001,10,102,1,2,3,0,0,0,,\n"
        "2024,0000001,10,102,1,2,3,0,0,0,,\n2024,0000002,11,103,1,2,4,0,0,0,,\n2024,0000003,12,104,1,2,3,1,1,1,800,2.0\n"),
}


@pytest.fixture(scope="module")
def layers(spark):
    landing = tempfile.mkdtemp(prefix="cohortspark-landing-")
    for name, text in FILES.items():
        with open(os.path.join(landing, name), "w", encoding="utf-8") as f:
            f.write(text)
    written = medallion.run_bronze(spark, landing, "t_bronze")
    reports = medallion.run_silver(spark, "t_bronze", "t_silver", max_orphan_pct=60.0)
    medallion.run_gold(spark, "t_silver", "t_gold")
    return written, reports


def test_missing_file_is_skipped_and_raw_is_text(spark, layers):
    assert C.COUNTRY_GOALS.name not in layers[0] and len(layers[0]) == 7
    raw = spark.table(f"t_bronze.{C.MUNICIPAL_RESULTS.name}")
    assert {"ano", "id_municipio", "_bronze_source_file", "_bronze_source_entity", "_pipeline_stage"} <= set(raw.columns)
    assert raw.schema["taxa_alfabetizacao"].dataType.simpleString() == "string"


def test_clean_layer(spark, layers):
    t = spark.table(f"t_silver.{C.MUNICIPAL_RESULTS.name}")
    assert t.count() == 6 and layers[1][C.MUNICIPAL_RESULTS.name].removed == 1
    rows = {(r.id_municipio, r.rede): r for r in t.collect()}
    assert rows["0000001", "5"].ano == 2024 and rows["0000001", "5"].nome_municipio == "Um"
    assert rows["0000002", "5"].taxa_alfabetizacao is None and rows["0000002", "5"].media_portugues is None
    assert rows["0000003", "3"].taxa_alfabetizacao == 70.0 and rows["0000003", "3"].rede_nome == "Municipal"
    assert rows["9999999", "5"].nome_municipio is None
    assert layers[1][C.MUNICIPAL_RESULTS.name].orphans == 1 and layers[1][C.STUDENTS.name].removed == 1


def test_analysis_layer(spark, layers):
    g = {(r.id_municipio, r.rede): r for r in spark.table("t_gold.analise").collect()}
    one = g["0000001", "5"]
    assert (one.alunos_total, one.alunos_presentes, one.alunos_alfabetizados) == (3, 2, 1)
    assert one.proporcao_presenca == 66.67 and one.taxa_alfabetizacao_observada == 50.0 and one.proficiencia_media_ponderada == 712.5
    assert one.consistencia_taxa_municipio == "Consistente" and one.meta_atingida_municipio == "Sem meta"
    assert one.taxa_alfabetizacao_brasil == 58.0 and one.meta_alfabetizacao_uf == 60.0 and one.meta_atingida_uf == "Abaixo"
    three = g["0000003", "3"]
    assert three.meta_alfabetizacao_municipio == 68.0 and three.meta_atingida_municipio == "Atingida" and three.consistencia_taxa_municipio == "Divergente"
    s = {r.id_aluno: r for r in spark.table("t_gold.ml_aluno").collect()}
    assert set(s) == {"100", "101", "104"} and "proficiencia" not in spark.table("t_gold.ml_aluno").columns
    assert s["104"].meta_alfabetizacao_municipio == 68.0 and s["100"].meta_alfabetizacao_municipio is None and s["100"].meta_alfabetizacao_uf == 60.0


def test_failed_gate_leaves_the_published_table(spark, layers):
    """A layer that fails is staged, measured and thrown away; versions left by broken-off runs go with the next publication."""
    name = f"t_silver.{C.STATE_RESULTS.name}"
    before = spark.table(name).collect()
    versions = lambda: {t.name for t in spark.catalog.listTables("t_silver") if t.name.startswith(f"{C.STATE_RESULTS.name}{tables.VERSION}")}
    first = versions()
    bad = spark.table(f"t_bronze.{C.STATE_RESULTS.name}").withColumn("taxa_alfabetizacao", F.lit("n/d"))
    spark.sql("CREATE SCHEMA IF NOT EXISTS t_bad")
    for entity in (C.STATE_DIRECTORY, C.MUNICIPAL_DIRECTORY):
        tables.save_table(spark.table(f"t_bronze.{entity.name}"), f"t_bad.{entity.name}")
    tables.save_table(bad, f"t_bad.{C.STATE_RESULTS.name}")
    with pytest.raises(quality.QualityError):
        medallion.run_silver(spark, "t_bad", "t_silver", [C.STATE_RESULTS])
    assert spark.table(name).collect() == before and versions() == first and len(first) == 1
    tables.save_table(bad, tables.staged_name(name))
    reports = medallion.run_silver(spark, "t_bronze", "t_silver", [C.STATE_RESULTS])
    assert reports[C.STATE_RESULTS.name] == layers[1][C.STATE_RESULTS.name] and spark.table(name).count() == len(before)
    assert len(versions()) == 2 and first < versions()
    medallion.run_silver(spark, "t_bronze", "t_silver", [C.STATE_RESULTS])
    assert len(versions()) == 2 and not first & versions()
    plan = spark.table(name).where("ano = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan


def test_observed_measures_equal_the_aggregate(spark):
    df = spark.createDataFrame([(2023, "1", None, 2), (2024, "2", 5.0, 0), (None, None, 1.0, 0)], "ano int, id_municipio string, taxa double, _s long")
    df = df.withColumn("nome_municipio", F.when(F.col("id_municipio") == "1", "a"))
    for rows in (df, df.limit(0), df.drop("ano", "nome_municipio")):
        seen_rows, seen = quality.observed(rows, ["taxa", "absent"], "municipio", "_s")
        assert seen_rows.count() == rows.count()
        assert quality.report_of(seen.get, ["taxa", "absent"]) == quality.quality_report(rows, ["taxa", "absent"], "municipio", "_s")


def test_gates(spark):
    df = spark.createDataFrame([(2024, "1", None), (2024, "2", 5.0)], "ano int, id_municipio string, taxa double")
    report = quality.quality_report(df, ["taxa", "absent_column"])
    assert report.null_pct == {"taxa": 50.0} and report.years == [2024]
    with pytest.raises(quality.QualityError):
        quality.enforce(report, "x")
    quality.enforce(report, "x", max_null_pct=50.1)
    orphan = df.withColumn("nome_municipio", F.when(F.col("id_municipio") == "1", "a"))
    with pytest.raises(quality.QualityError):
        quality.enforce(quality.quality_report(orphan, [], "municipio"), "x")


def test_guards(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    twice = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(quality.QualityError):
        quality.guarded_left_join(left, twice, ["k"])
    with pytest.raises(quality.QualityError):
        quality.guarded_left_join(left, twice.limit(1), ["k"], not_null="v")
    rows = spark.createDataFrame([("1", "AA"), ("1", "BB")], "id_municipio string, sigla_uf string")
    with pytest.raises(quality.QualityError):
        quality.build_directory(rows)
    with pytest.raises(ValueError):
        cleaning.rename_ascii(spark.createDataFrame([(1, 2)], "`São` int, `sao ` int"))
    with pytest.raises(tables.MissingInput):
        tables.load_tables(spark, "t_nowhere", ["a"], ["a"])
    with pytest.raises(ValueError):
        features.model_matrix(spark.createDataFrame([(1, 2)], f"proficiencia int, {C.TARGET} int"), ["proficiencia"])


def test_dedup_survivor_ignores_order(spark):
    df = spark.createDataFrame([(1, None, 3), (1, 2, 1), (2, 5, 5)], "k int, a int, b int")
    first = quality.deduplicate(df, ["k", "gone"]).orderBy("k").collect()
    second = quality.deduplicate(df.orderBy(F.col("b").desc()).repartition(4), ["k"]).orderBy("k").collect()
    assert first == second and len(first) == 2


def test_product_files(spark):
    folder = tempfile.mkdtemp(prefix="cohortspark-products-")
    df = spark.createDataFrame([(2023, 1, 0.5), (2024, 2, 0.7), (2024, 3, None)], "ano int, id int, taxa double")
    counts = {r.ano: r.n for r in tables.write_by_year(df, f"{folder}/p", [2023, 2024]).collect()}
    assert counts == {2023: 1, 2024: 2}
    read = tables.read_product(spark, f"{folder}/p", ["id", "taxa"], 2024)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan and read.count() == 2
    for fmt in ("csv", "json"):
        tables.write_product(df, f"{folder}/{fmt}", fmt)
        assert spark.read.format(fmt).load(f"{folder}/{fmt}").count() >= 3
    with pytest.raises(tables.MissingInput):
        tables.read_product(spark, f"{folder}/absent")
    a, b = tables.fingerprint(df, "x"), tables.fingerprint(df.orderBy("id").repartition(3), "x")
    assert tables.check_manifest(a, b).count() == 0
    assert tables.check_manifest(a, tables.fingerprint(df.limit(2), "x")).count() == 1
    text = df.select(*[F.col(c).cast("string") for c in df.columns])
    tables.write_product(text, f"{folder}/typed", "csv")
    typed = tables.read_typed_csv(spark, f"{folder}/typed", df.schema, df.columns, ["taxa"])
    assert typed.columns == ["ano", "id"] and typed.agg(F.sum("id")).first()[0] == 6


def test_features_come_from_the_lag_year_only(spark, folder):
    from cohortspark.queries import bindings as B
    rows = B.unique_students(spark, folder).drop("codigo_uf")
    args = (B.published_municipal(spark, folder), B.published_state(spark, folder), B.goals_municipal(spark, folder), B.territory(spark, folder), B.LAG)
    changed = rows.withColumn("alfabetizado", F.when(F.col("ano") == B.TARGET, 1 - F.col("alfabetizado")).otherwise(F.col("alfabetizado")))
    a, b = features.feature_store(rows, *args), features.feature_store(changed, *args)
    for name in a:
        assert a[name].count() > 0 and a[name].exceptAll(b[name]).count() == 0


def test_leak_gate(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("y"), (F.col("id") % 2 + 0.001).alias("leak"), (F.col("id") * 7 % 11).alias("ok"))
    quality.enforce_no_leak(df, "y", ["ok"])
    with pytest.raises(quality.QualityError):
        quality.enforce_no_leak(df, "y", ["ok", "leak"])


def test_years_are_replaced_and_pruned_one_by_one(spark, tmp_path):
    """A second delivery of one year leaves the others; a joined list of years reads its partitions alone."""
    path = str(tmp_path / "por_ano")
    rows = spark.createDataFrame([(y, i, float(i)) for y in (2021, 2022, 2023) for i in range(20)] + [(None, 1, 1.0)], "ano int, id int, valor double")
    assert {(r["ano"], r["n"]) for r in tables.write_by_year(rows, path, [2021, 2022, 2023]).collect()} == {(2021, 20), (2022, 20), (2023, 20)}
    again = rows.where("ano = 2022 AND id < 5")
    assert [(r["ano"], r["n"]) for r in tables.write_by_year(again, path, [2022]).collect()] == [(2022, 5)]
    listed = str(tmp_path / "anos")
    spark.createDataFrame([(2022, "a"), (2022, "a"), (2023, "b"), (None, "a"), (1999, "a")], "ano int, grupo string").write.parquet(listed)
    wanted = spark.read.parquet(listed).where(F.col("grupo") == "a")
    found = tables.in_years(tables.read_product(spark, path), wanted)
    assert found.groupBy("ano").count().collect() == [(2022, 5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert tables.in_years(tables.read_product(spark, path), wanted.where("false")).count() == 0


def test_a_merged_table_keeps_the_width_of_its_work(spark):
    """Small outputs are merged by size at the write, not by one task that also does all the work before it."""
    spark.sql("CREATE SCHEMA IF NOT EXISTS t_width")
    rows = spark.range(0, 4000, 1, 8).selectExpr("id % 3 AS ano", "id AS x", "sha2(string(id), 512) AS t")
    try:
        tables.save_table(rows, "t_width.small", 1)
        assert len(spark.table("t_width.small").where("ano = 1").inputFiles()) == 1 and spark.table("t_width.small").count() == 4000
        before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
        try:
            tables.save_table(rows, "t_width.large", 1)
        finally:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
        assert len(spark.table("t_width.large").where("ano = 1").inputFiles()) > 1 and spark.table("t_width.large").count() == 4000
    finally:
        spark.sql("DROP SCHEMA IF EXISTS t_width CASCADE")
