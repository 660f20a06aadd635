"""Declarative contracts of the literacy cohort data: entities, code lists and feature blocks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Entity:
    """What a raw entity is called, how it is typed, keyed, enriched and written."""

    name: str
    file: str
    integers: tuple[str, ...] = ()
    doubles: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    dimension: str | None = None
    critical: tuple[str, ...] = ()
    output_files: int | None = 1
    delimiter: str = ","


# Entity names, source files, column contracts and code lists of the published data.
STATE_RESULTS = Entity(
    name="avaliacao_alfabetizacao_uf",
    file="br_inep_avaliacao_alfabetizacao_uf.csv",
    integers=("ano",),
    doubles=("taxa_alfabetizacao", "media_portugues"),
    strings=("sigla_uf", "serie", "rede"),
    keys=("ano", "sigla_uf", "serie", "rede"),
    dimension="uf",
    critical=("ano", "sigla_uf", "taxa_alfabetizacao", "media_portugues"),
)
MUNICIPAL_RESULTS = Entity(
    name="avaliacao_alfabetizacao_municipio",
    file="br_inep_avaliacao_alfabetizacao_municipio.csv",
    integers=("ano",),
    doubles=("taxa_alfabetizacao", "media_portugues"),
    strings=("id_municipio", "serie", "rede"),
    keys=("ano", "id_municipio", "serie", "rede"),
    dimension="municipio",
    critical=("ano", "id_municipio", "taxa_alfabetizacao", "media_portugues"),
)
COUNTRY_GOALS = Entity(
    name="avaliacao_alfabetizacao_meta_alfabetizacao_brasil",
    file="br_inep_avaliacao_alfabetizacao_meta_alfabetizacao_brasil.csv",
    integers=("ano",),
    doubles=("taxa_alfabetizacao", "percentual_participacao"),
    strings=("rede",),
    keys=("ano", "rede"),
    critical=("ano", "taxa_alfabetizacao"),
)
STATE_GOALS = Entity(
    name="avaliacao_alfabetizacao_meta_alfabetizacao_uf",
    file="br_inep_avaliacao_alfabetizacao_meta_alfabetizacao_uf.csv",
    integers=("ano",),
    doubles=("taxa_alfabetizacao", "percentual_participacao"),
    strings=("sigla_uf", "rede"),
    keys=("ano", "sigla_uf", "rede"),
    dimension="uf",
    critical=("ano", "sigla_uf", "taxa_alfabetizacao"),
)
MUNICIPAL_GOALS = Entity(
    name="avaliacao_alfabetizacao_meta_alfabetizacao_municipio",
    file="br_inep_avaliacao_alfabetizacao_meta_alfabetizacao_municipio.csv",
    integers=("ano", "nivel_alfabetizacao"),
    doubles=("taxa_alfabetizacao", "percentual_participacao"),
    strings=("id_municipio", "rede"),
    keys=("ano", "id_municipio", "rede"),
    dimension="municipio",
    critical=("ano", "id_municipio", "taxa_alfabetizacao"),
)
STUDENTS = Entity(
    name="avaliacao_alfabetizacao_aluno",
    file="br_inep_avaliacao_alfabetizacao_aluno.csv",
    integers=("ano", "alfabetizado", "presenca"),
    doubles=("preenchimento_caderno", "proficiencia", "peso_aluno"),
    strings=("id_municipio", "id_escola", "id_aluno", "caderno", "serie", "rede"),
    keys=("ano", "id_aluno", "id_escola"),
    dimension="municipio",
    critical=("ano", "id_aluno", "alfabetizado"),
    output_files=None,
)
STATE_DIRECTORY = Entity(name="dim_uf", file="br_bd_diretorios_brasil_uf.csv")
MUNICIPAL_DIRECTORY = Entity(name="dim_municipio", file="br_bd_diretorios_brasil_municipio.csv")

CLEAN_ENTITIES = (STATE_RESULTS, MUNICIPAL_RESULTS, COUNTRY_GOALS, STATE_GOALS, MUNICIPAL_GOALS, STUDENTS)
RAW_ENTITIES = CLEAN_ENTITIES + (STATE_DIRECTORY, MUNICIPAL_DIRECTORY)
REQUIRED_FOR_GOLD = (MUNICIPAL_RESULTS.name, STATE_RESULTS.name)
DOUBLE_PREFIXES = ("proporcao_aluno_nivel_", "meta_alfabetizacao_")

NETWORK_LABELS = {
    "0": "Total (Federal, Estadual, Municipal e Privada)",
    "1": "Federal",
    "2": "Estadual",
    "3": "Municipal",
    "4": "Privada",
    "5": "Pública (Estadual e Municipal)",
    "6": "Pública (Federal, Estadual e Municipal)",
}
GRADE_LABELS = {"2": "2º ano do Ensino Fundamental"}
GOAL_NETWORK_CODES = {
    "Federal": "1",
    "Estadual": "2",
    "Municipal": "3",
    "Privada": "4",
    "Pública": "5",
    "Total": "0",
}
PUBLIC_NETWORKS = ("2", "3")
PUBLIC_CODE, TOTAL_CODE = "5", "0"

MAX_CRITICAL_NULL_PCT = 50.0
MAX_ORPHAN_PCT = 20.0
CONSISTENCY_TOLERANCE_PP = 5.0
LITERACY_CUT = 743.0
SEED = 42
SMOOTHING_K = 30.0
NOISE_FLOOR = 0.002
TARGET = "risco_nao_alfabetizacao"
GROUP = "id_municipio"
WEIGHT = "peso_aluno"
SOURCE_GOLD, SOURCE_R5, SOURCE_R3, SOURCE_NONE = "gold", "agregado_r5", "agregado_r3", "sem_historico"

FORBIDDEN_FEATURES = (
    "proficiencia", "peso_aluno", "id_aluno", "id_escola", "id_municipio", "nome_municipio",
    "nome_uf", "serie", "serie_nome", "rede_nome", "taxa_alfabetizacao", "preenchimento_caderno",
    "percentual_participacao_municipio", "percentual_participacao_uf", "percentual_participacao_brasil",
)
OPERATIONAL_COLUMNS = (GROUP, WEIGHT, TARGET)

MUNICIPAL_FEATURES = (
    "mun_taxa_alfab_lag1", "mun_media_portugues_lag1", "mun_nivel_alfabetizacao_lag1",
    "mun_meta_2024_lag1", "mun_taxa_presenca_lag1", "mun_n_alunos_lag1", "mun_n_escolas_lag1",
    "mun_share_rede_estadual_lag1", "mun_desvio_vs_uf",
)
DISTRIBUTION_FEATURES = (
    "mun_prof_p25_lag1", "mun_prof_p50_lag1", "mun_prof_p75_lag1", "mun_prof_iqr_lag1", "mun_prof_sd_lag1",
)
STATE_FEATURES = ("uf_taxa_alfab_lag1", "uf_media_portugues_lag1", "uf_taxa_presenca_lag1")
COVERAGE_FEATURES = (
    "tem_historico_municipio", "tem_historico_escola", "fonte_lag_municipal", "fonte_lag_uf",
)
STRUCTURAL_FEATURES = ("rede_grupo", "nome_regiao", "sigla_uf", "caderno")
SCHOOL_FEATURES = (
    "esc_taxa_alfab_lag1", "esc_taxa_alfab_lag1_suav", "esc_taxa_presenca_lag1", "esc_n_alunos_lag1",
    "esc_prof_p25_lag1", "esc_prof_p50_lag1", "esc_prof_p75_lag1", "esc_prof_iqr_lag1", "esc_prof_sd_lag1",
)
MODEL_FEATURES = MUNICIPAL_FEATURES + STATE_FEATURES + COVERAGE_FEATURES + STRUCTURAL_FEATURES
PRUNED_FEATURES = (
    "mun_taxa_alfab_lag1", "mun_taxa_presenca_lag1", "mun_n_alunos_lag1",
    "mun_share_rede_estadual_lag1", "uf_taxa_alfab_lag1", "tem_historico_municipio",
    "rede_grupo", "nome_regiao",
)
CATEGORICAL_FEATURES = ("rede_grupo", "nome_regiao", "sigla_uf", "fonte_lag_municipal", "fonte_lag_uf")
RARE_CATEGORICAL_FEATURES = ("caderno",)
FEATURE_SETS = {
    "A_sem_percentis": MODEL_FEATURES,
    "B_com_percentis": MODEL_FEATURES + DISTRIBUTION_FEATURES,
    "C_com_escola": MODEL_FEATURES + DISTRIBUTION_FEATURES + SCHOOL_FEATURES,
}
FEATURE_FAMILIES = {
    "historico_municipal": (
        "mun_taxa_alfab_lag1", "mun_media_portugues_lag1", "mun_taxa_presenca_lag1", "mun_n_alunos_lag1",
        "mun_n_escolas_lag1", "mun_share_rede_estadual_lag1", "mun_desvio_vs_uf",
    ),
    "metas": ("mun_meta_2024_lag1", "mun_nivel_alfabetizacao_lag1"),
    "territorial": (
        "uf_taxa_alfab_lag1", "uf_media_portugues_lag1", "uf_taxa_presenca_lag1", "sigla_uf", "nome_regiao",
    ),
    "historico_escolar": ("tem_historico_escola",),
    "estrutural": (
        "rede_grupo", "caderno", "tem_historico_municipio", "fonte_lag_municipal", "fonte_lag_uf",
    ),
}
PROFICIENCY_LEVELS = tuple(f"proporcao_aluno_nivel_{i}" for i in range(9))
GOLD_COLUMNS = (
    "ano", "id_municipio", "nome_municipio", "sigla_uf", "nome_uf", "nome_regiao", "serie_nome",
    "rede", "rede_nome", "alunos_total", "alunos_presentes", "alunos_alfabetizados",
    "proporcao_presenca", "taxa_alfabetizacao_observada", "diferenca_taxa_observada_municipio_pp",
    "consistencia_taxa_municipio", "proficiencia_media", "proficiencia_media_ponderada",
    "taxa_alfabetizacao_municipio", "media_portugues_municipio", "meta_alfabetizacao_municipio",
    "percentual_participacao_municipio", "meta_atingida_municipio", "meta_atingida_presenca_municipio",
    "taxa_alfabetizacao_uf", "media_portugues_uf", "meta_alfabetizacao_uf",
    "percentual_participacao_uf", "meta_atingida_uf", "meta_atingida_presenca_uf",
    "taxa_alfabetizacao_brasil", "media_portugues_brasil", "taxa_alfabetizacao_brasil_oficial",
    "meta_alfabetizacao_brasil", "percentual_participacao_brasil", "meta_atingida_brasil",
    "meta_atingida_presenca_brasil",
)
GOLD_STUDENT_COLUMNS = (
    "ano", "id_aluno", "id_escola", "id_municipio", "nome_municipio", "sigla_uf", "nome_uf",
    "nome_regiao", "serie", "serie_nome", "rede", "rede_nome", "caderno", "preenchimento_caderno",
    "meta_alfabetizacao_municipio", "percentual_participacao_municipio", "meta_alfabetizacao_uf",
    "percentual_participacao_uf", "meta_alfabetizacao_brasil", "percentual_participacao_brasil",
    "alfabetizado",
)
RANKING_COLUMNS = (
    "id_municipio", "nome_municipio", "sigla_uf", "nome_regiao", "n_alunos_avaliados",
    "populacao_estimada", "taxa_presenca_2024", "risco_medio_oof", "risco_suavizado",
    "posicao_por_taxa", "decil_por_taxa", "criancas_em_risco", "posicao_por_volume",
    "decil_por_volume", "taxa_alfabetizacao_2024", "taxa_observada_de_risco",
    "taxa_observada_ajustada", "mun_taxa_alfab_lag1", "modelo_avaliado",
    "faixa_shap_taxa_municipal", "incerteza_posicao_quantificada",
)
