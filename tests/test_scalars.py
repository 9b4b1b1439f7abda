"""Literal-row checks of the parsing / harmonisation rules (fixtures of FIXTURES.md §1)."""

from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import schema as SC


def _col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_it_classification(spark):
    cbo = ["1425", "2120", "3171", "9999", "2141", "1234"]
    got = _col(spark, cbo, lambda c: X.is_it(X.cbo_family(c), P.IT_CODES_REGISTRY))
    assert got == [True, True, True, False, True, False]


def test_cbo_family_cases(spark):
    vals = ["", "0000", "7", "142-5", "142530", "3221.0", None, "Brand#17"]
    assert _col(spark, vals, X.cbo_family) == [None, None, "0007", "1425", "1425", "3221", None, "0017"]


def test_cbo_repair_keeps_last_four(spark):
    vals = ["3221.0", "142530", "7", "0000", "", None, "12.9"]
    assert _col(spark, vals, X.cbo_repair) == ["3221", "2530", "0007", None, None, None, "0012"]


def test_numbers(spark):
    assert _col(spark, ["1.234,56", "1,234", "12.5", "1d", "NaN", "abc"], X.parse_locale_number) == \
        [1234.56, 1.234, 12.5, None, None, None]   # "1,234" reads as decimal comma first
    assert _col(spark, ["12.5", "13.5", " 7 ", "x"], lambda c: X.to_number(c, to_int=True)) == [12, 14, 7, None]


def test_states(spark):
    assert _col(spark, ["SP", "sp", "35", "35.0", "XX"], X.uf_code) == [35, 35, 35, 35, None]
    assert _col(spark, ["SP", "35", "XX", "18"], X.uf_sigla) == ["SP", "SP", None, None]
    assert _col(spark, ["355030", "3550308", "11001"], X.uf_from_municipio) == [35, 35, 1]


def test_education(spark):
    got = _col(spark, ["FUNDAMENTAL INCOMPLETO", "5", "12", "Médio completo", "SUPERIOR INCOMPLETO"],
               X.education_level)
    assert got == ["fundamental_incompleto", "fundamental_completo", None, "medio_completo",
                   "superior_incompleto"]


def test_education_from_words(spark):
    texts = ["Analfabeto", "Até 5ª incompleto", "6ª a 9ª fundamental", "Fundamental completo", "FUND. INCOMPLETO",
             "Médio", "Ensino médio incompleto", "Superior completo", "Mestrado", "Pós-graduação", "", None, "outro"]
    got = _col(spark, texts, X.education_level)
    assert got == ["fundamental_incompleto", "fundamental_incompleto", "fundamental_incompleto", "fundamental_completo",
                   "fundamental_incompleto", None, "medio_incompleto", "superior_completo", "pos_graduacao",
                   "pos_graduacao", None, None, None]
    assert _col(spark, ["Analfabeto"], lambda c: X.education_level(c, True)) == ["sem_instrucao"]


def test_wage_targets(spark):
    got = _col(spark, [9540.0, 9541.0, None], lambda c: X.above_wages(c, X.minimum_wage(F.lit(2018)), 10), "double")
    assert got == [0, 1, None]
    assert _col(spark, [1.0], lambda c: X.above_wages(c, X.minimum_wage(F.lit(1990)), 10), "double") == [None]


def test_age_bands(spark):
    ages = [13.0, 14.0, 17.0, 18.0, 24.0, 24.5, 25.0, 65.0, 100.0, 101.0, None]
    got = _col(spark, ages, lambda c: X.age_band(c, P.AGE_BANDS_SURVEY), "double")
    assert got == ["Outros", "Outros", "Outros", "18-24", "18-24", "Outros", "25-34", "65+", "65+",
                   "Outros", "Outros"]


def test_period_year(spark):
    assert _col(spark, ["202001", "202002", "202003", "202004"], X.period_year) == [2020] * 4


def test_flags_and_sex(spark):
    assert _col(spark, ["SIM", "nao", "true", "0", "talvez"], X.parse_flag) == [1, 0, 1, 0, None]
    assert _col(spark, ["1", "2", "masculino", "F", "x"], X.sex_norm) == ["M", "F", "M", "F", "x"]


def test_generation_nulls(spark):
    df = spark.createDataFrame([(25, 2020), (None, 2020), (60, 2020)], "i int, a int")
    assert [r[0] for r in df.select(X.generation("i", "a")).collect()] == ["Gen Z", None, "Boomer"]


def test_header_rules(spark):
    assert SC.dedupe_names(["nome", "idade", "nome", "salario", "idade", "nome"]) == \
        ["nome", "idade", "nome_1", "salario", "idade_1", "nome_2"]
    assert SC.normalize_name("Vínculo Ativo 31/12") == "vinculo_ativo_3112"
    for name in ["cbo", "CBO", "cdo", "cbo_2002", "cbo ocupacao", "cbo_ocupacao_2002"]:
        df = spark.createDataFrame([(1, 25)], f"`{name}` int, idade int")
        out = SC.resolve_occupation_column(df)
        assert out.columns == ["cbo_ocupacao", "idade"]


def test_flag_from_name(spark):
    df = spark.createDataFrame([("x/rais_nao_ti.parquet",), ("x/rais_ti.parquet",), ("x/rais.parquet",)],
                               "arquivo string")
    from laborlens.sources.files import flag_from_name
    assert [r[0] for r in df.select(flag_from_name()).collect()] == [0, 1, None]
