"""The accounts history dump: extended ``INSERT`` statements as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.schema import DUMP_FIELDS, DUMP_POSITIONS, ORG

_STRING = r"'[^'\\]*(?:\\.[^'\\]*)*'"
_TUPLE = rf"\([^()']*(?:{_STRING}[^()']*)*\)"
_FIELD = rf"\s*({_STRING}|[^,']*)\s*(?:,|$)"


def read_sql_dump(spark: SparkSession, path: str, positions: dict[str, int] = DUMP_POSITIONS) -> DataFrame:
    """Rows of the dump's value lists, as text columns picked by position.

    Strings may hold commas, parentheses and escaped quotes. Rows with too few
    fields, a key that is not nine digits or a year that is not four are dropped.
    """
    lines = spark.read.text(path).filter(F.col("value").startswith("INSERT INTO"))
    tuples = lines.select(F.explode(F.regexp_extract_all("value", F.lit(_TUPLE), F.lit(0))).alias("t"))
    inner = F.expr("substring(t, 2, length(t) - 2)")
    fields = tuples.select(F.regexp_extract_all(inner, F.lit(_FIELD), F.lit(1)).alias("f"))
    kept = fields.filter(F.size("f") >= DUMP_FIELDS)
    picked = kept.select(
        *[F.regexp_replace(F.trim(F.col("f")[i]), r"^'|'$", "").alias(name) for name, i in positions.items()]
    )
    return picked.filter(F.col("orgnr").rlike(r"^\d{9}$") & F.col("aar").rlike(r"^\d{4}$"))


def history_accounts(dump: DataFrame, companies: DataFrame) -> DataFrame:
    """Dump rows as accounts of known companies: a full period, amounts, and the derived sums."""
    year, month = F.col("aar").cast("int"), F.col("mnd").try_cast("int")
    amounts = [c for c in DUMP_POSITIONS if c not in ("orgnr", "aar", "mnd")]
    rows = dump.select(
        F.col("orgnr").alias(ORG),
        F.lit("SELSKAP").alias("regnskapstype"),
        C.period_end(year, month).alias("periode_til"),
        C.period_start(year, month).alias("periode_fra"),
        F.lit(None).cast("string").alias("valuta"),
        F.lit("historikk").alias("kilde"),
        *[C.from_thousands(F.col(c)).alias(c) for c in amounts],
    )
    derived = rows.withColumns(
        {
            "sum_driftskostnad": (F.col("sum_driftsinntekter") - F.col("driftsresultat")).cast("decimal(20,2)"),
            "sum_eiendeler": (F.col("sum_anleggsmidler") + F.col("sum_omloepsmidler")).cast("decimal(20,2)"),
        }
    )
    return derived.join(companies.select(ORG), ORG, "left_semi")
