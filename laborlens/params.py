"""Parameters of the datasets: code lists, bands, lookup tables.

Everything in the block marked FIXED VALUES must equal the published survey,
registry and feed conventions for results to be right; it is stated here as
plain data in natural order.  Anything else is a default a caller may override.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the survey / registry / feed conventions)
# ---------------------------------------------------------------------------

# IT occupation families (CBO, 4 digits) used for the household survey.
IT_CODES_SURVEY = (
    "1330", "2434", "2511", "2512", "2513", "2514", "2519", "2521",
    "2522", "2523", "2529", "3511", "3512", "3513", "3514", "3522",
)

# IT occupation families used for the employer registry and the hire/dismissal feed.
IT_CODES_REGISTRY = (
    "1425", "2120", "2122", "2123", "2124", "2141", "2142", "2143", "2149",
    "3171", "3172", "3173",
)

# Older, shorter IT list used by the consolidated-study scripts.
IT_CODES_LEGACY = ("1425", "2120", "2122", "2123", "2124", "2125", "3171", "3172", "3173")

# Closed integer age bands (label, low, high); values outside every band -> "Outros".
AGE_BANDS_SURVEY = (
    ("18-24", 18, 24), ("25-34", 25, 34), ("35-44", 35, 44),
    ("45-54", 45, 54), ("55-64", 55, 64), ("65+", 65, 100),
)
AGE_BANDS_REGISTRY = (
    ("18-24", 18, 24), ("25-34", 25, 34), ("35-44", 35, 44),
    ("45-54", 45, 54), ("55-64", 55, 64), ("65+", 65, 999),
)
AGE_BAND_OTHER = "Outros"

# Right-closed cut edges and labels, (lo, hi].
AGE_CUTS_DISTRIBUTION = ((0, 24, 34, 44, 54, 64, 120),
                         ("<=24", "25-34", "35-44", "45-54", "55-64", "65+"))
AGE_CUTS_HEATMAP = ((0, 29, 39, 49, 55, 120),
                    ("<=29", "30-39", "40-49", "50-55", "56+"))
# Ageism-study bands: 18-25 / 26-35 / 36-45 / 46-55 / 56+ / Indefinida.
AGE_BANDS_AGEISM = (("18-25", 18, 25), ("26-35", 26, 35), ("36-45", 36, 45),
                    ("46-55", 46, 55), ("56+", 56, None))
AGE_BAND_UNDEFINED = "Indefinida"

# Monthly minimum wage (BRL) by year.
MINIMUM_WAGE = {
    2012: 622, 2013: 678, 2014: 724, 2015: 788, 2016: 880, 2017: 937,
    2018: 954, 2019: 998, 2020: 1045, 2021: 1100, 2022: 1212, 2023: 1320, 2024: 1412,
}

# IBGE state code -> state abbreviation.
UF_CODE_TO_SIGLA = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO",
    21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL", 28: "SE", 29: "BA",
    31: "MG", 32: "ES", 33: "RJ", 35: "SP",
    41: "PR", 42: "SC", 43: "RS",
    50: "MS", 51: "MT", 52: "GO", 53: "DF",
}
UF_SIGLA_TO_CODE = {v: k for k, v in UF_CODE_TO_SIGLA.items()}

# Highest course attended: code -> label, survey years up to 2015 and after.
EDUCATION_UP_TO_2015 = {
    1: "Creche / Pre-Escola",
    2: "Alfabetizacao de Jovens/Adultos",
    3: "Antigo primario (elementar)",
    4: "Antigo ginasio (medio 1 ciclo)",
    5: "Ensino Fundamental (1 Grau)",
    6: "EJA - Ensino Fundamental",
    7: "Antigo cientifico, classico, etc. (medio 2 ciclo)",
    8: "Regular do ensino medio ou do 2 grau",
    9: "Educacao de jovens e adultos (EJA) ou supletivo do ensino medio",
    10: "Superior - Graduacao",
    11: "Mestrado",
    12: "Doutorado",
}
EDUCATION_AFTER_2015 = {
    1: "Creche",
    2: "Pre-Escola",
    3: "Classe de Alfabetizacao",
    4: "Alfabetizacao de Jovens/Adultos",
    5: "Antigo Primario",
    6: "Antigo Ginasio",
    7: "Ensino Fundamental",
    8: "EJA - Ensino Fundamental",
    9: "Antigo Cientifico/Classico",
    10: "Ensino Medio",
    11: "EJA - Ensino Medio",
    12: "Superior - Graduacao",
    13: "Especializacao Superior",
    14: "Mestrado",
    15: "Doutorado",
}
EDUCATION_ERA_SPLIT_YEAR = 2015  # years <= this use EDUCATION_UP_TO_2015

# Registry schooling code (1..11) -> harmonised survey level.
REGISTRY_SCHOOLING = {
    1: "fundamental_incompleto", 2: "fundamental_incompleto", 3: "fundamental_incompleto",
    4: "fundamental_incompleto", 5: "fundamental_completo", 6: "medio_incompleto",
    7: "medio_completo", 8: "superior_incompleto", 9: "superior_completo",
    10: "pos_graduacao", 11: "pos_graduacao",
}
REGISTRY_SCHOOLING_GRANULAR = {**REGISTRY_SCHOOLING, 1: "sem_instrucao"}
# Ordered harmonised levels (sort key = position).
SCHOOLING_LEVELS = (
    "sem_instrucao", "fundamental_incompleto", "fundamental_completo", "medio_incompleto",
    "medio_completo", "superior_incompleto", "superior_completo", "pos_graduacao",
)

SEX_LABELS = {1: "Homens", 2: "Mulheres"}
SEX_LABELS_TABLE = {1: "Masculino", 2: "Feminino"}
SEX_TEXT_TO_CODE = {"1": "M", "2": "F", "m": "M", "f": "F", "masc": "M", "fem": "F",
                    "masculino": "M", "feminino": "F"}

# Feed movement type codes.
MOVE_HIRE = (10,)
MOVE_EXIT = (20, 31, 32, 40)

# Flag words (lower case) read as 1 / 0.
FLAG_TRUE = ("true", "sim", "s", "1", "1.0", "yes", "y", "t")
FLAG_FALSE = ("false", "nao", "n", "0", "0.0", "no", "f")

# Generation cut-offs by age projected to 2020: <=25 Z, <=40 Millennial, <=55 X, else Boomer.
GENERATION_REFERENCE_YEAR = 2020
GENERATIONS = (("Gen Z", 25), ("Millennial", 40), ("Gen X", 55))
GENERATION_OLDEST = "Boomer"

# COVID period split: before 2020, 2020-2021, after 2021.
COVID_PERIODS = (("Pre-Pandemia", None, 2019), ("Pandemia", 2020, 2021), ("Pos-Pandemia", 2022, None))

# Threshold sweep 0.05 .. 0.95 (19 steps) and calibration bins.
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
CALIBRATION_BINS = 20

# Survey fixed-width layout: (name, start, end), 1-based inclusive.
SURVEY_LAYOUT = (
    ("ano", 1, 4), ("trimestre", 5, 5), ("uf", 6, 7), ("grupo_amostra", 30, 31),
    ("tipo_area", 34, 34), ("peso_populacional", 50, 64), ("sexo", 95, 95),
    ("ano_nascimento", 100, 103), ("idade", 104, 106), ("cor_raca", 107, 107),
    ("curso_mais_elevado_antes_2015", 123, 124), ("curso_mais_elevado", 125, 126),
    ("curso_anterior_concluido", 135, 135), ("cbo_ocupacao", 152, 155),
    ("codigo_atividade_empresa", 158, 162), ("carteira_assinada", 195, 195),
    ("rendimento_bruto_mensal", 200, 207), ("nivel_instrucao", 405, 405),
    ("anos_estudo", 406, 407), ("forca_trabalho", 409, 409), ("ocupado", 410, 410),
    ("rendimento_trabalho_principal", 427, 434), ("horas_trabalhadas_semana", 462, 464),
)
SURVEY_INT_COLUMNS = ("ano", "trimestre", "uf", "sexo", "ano_nascimento", "idade", "cor_raca",
                      "curso_mais_elevado_antes_2015", "curso_mais_elevado",
                      "curso_anterior_concluido", "carteira_assinada", "nivel_instrucao",
                      "anos_estudo", "forca_trabalho", "ocupado", "horas_trabalhadas_semana")
SURVEY_DOUBLE_COLUMNS = ("peso_populacional", "rendimento_bruto_mensal",
                         "rendimento_trabalho_principal")

# Feed header (28 columns, in file order).
FEED_HEADER = (
    "competênciamov", "região", "uf", "município", "seção", "subclasse", "saldomovimentação",
    "cbo2002ocupação", "categoria", "graudeinstrução", "idade", "horascontratuais",
    "raçacor", "sexo", "tipoempregador", "tipoestabelecimento", "tipomovimentação",
    "tipodedeficiência", "indtrabintermitente", "indtrabparcial", "salário",
    "tamestabjan", "indicadoraprendiz", "origemdainformação", "competênciadec",
    "indicadordeforadoprazo", "unidadesaláriocódigo", "valorsaláriofixo",
)

# Feed header -> standard names.
FEED_RENAME = {
    "idade": "idade", "sexo": "sexo", "cbo2002ocupação": "cbo_ocupacao",
    "competênciamov": "competencia", "município": "municipio", "seção": "setor_atividade",
    "salário": "salario", "graudeinstrução": "grau_instrucao", "raçacor": "raca_cor",
    "saldomovimentação": "saldo_movimentacao", "categoria": "categoria",
    "horascontratuais": "horas_contratuais", "tipoempregador": "tipo_empregador",
    "tamestabjan": "tamanho_estabelecimento",
}

# ---------------------------------------------------------------------------
# Defaults (parameters, not fixed values)
# ---------------------------------------------------------------------------

AGE_MIN_DEFAULT = 14
AGE_MAX_DEFAULT = 80
MISSING_FAMILY_ALERT = 0.30
SEED = 42


@dataclass(frozen=True)
class DatasetSpec:
    """Description of one dataset, passed to operators (not an engine)."""

    name: str
    it_codes: tuple = IT_CODES_REGISTRY
    age_bands: tuple = AGE_BANDS_REGISTRY
    delimiter: str = ";"
    encoding: str = "ISO-8859-1"
    layout: tuple = ()
    rename: dict = field(default_factory=dict)
    essential_columns: tuple = ()


SURVEY = DatasetSpec("pnad", IT_CODES_SURVEY, AGE_BANDS_SURVEY, layout=SURVEY_LAYOUT,
                     essential_columns=("ano", "trimestre", "uf", "idade", "cbo_ocupacao",
                                        "peso_populacional"))
REGISTRY = DatasetSpec("rais", essential_columns=("ano", "idade", "cbo_ocupacao"))
FEED = DatasetSpec("caged", encoding="UTF-8", essential_columns=("competencia", "idade",
                                                                  "cbo_ocupacao"))

# FIXED VALUES: names of the raw survey variables and of the registry's columns, as
# the published files have them.
RAW_NAMES = {"ano": "Ano", "trimestre": "Trimestre", "uf": "UF", "peso_populacional": "V1028",
             "sexo": "V2007", "idade": "V2009", "cbo_ocupacao": "V4010", "ocupado": "VD4002",
             "rendimento_trabalho_principal": "VD4016"}
MUN_CANDIDATES = ("mun_trab", "municipio", "codigo_municipio", "mun_estbl")
SEX_CANDIDATES = ("sexo_trabalhador", "sexo")
EDU_CANDIDATES = ("escolaridade_apos_2005", "escolaridade", "grau_instrucao")
SAL_CANDIDATES = ("vl_remun_media_nom", "vl_remuneracao_media_nom", "vl_remun_media_sm", "salario")
ACTIVE_CANDIDATES = ("vinculo_ativo_31_12", "vinculo_ativo_3112", "ind_vinculo_ativo_3112",
                     "ativo_3112", "ind_vinculo_ativo", "indicador_vinculo_ativo_31_12",
                     "ind_vinculo_ativo_31_12")
SITUATION_CANDIDATES = ("situacao_vinculo", "situacao", "classe_desligamento")
