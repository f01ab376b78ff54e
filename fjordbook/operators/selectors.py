"""Which companies need work: accounts to fetch, descriptions to embed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.functions.hashing import text_hash
from fjordbook.operators.keyed import row_numbers
from fjordbook.schema import ORG

MIN_DESCRIPTION = 12


def targets(companies: DataFrame, accounts: DataFrame, attempts: DataFrame, mode: str,
            as_of: date | None = None, stale_days: int = 90, seed_year: int = 2024, seed_employees: int = 50) -> DataFrame:
    """Companies to fetch accounts for, with their place in the queue.

    ``attempts`` holds the latest attempt per company. Modes: ``nye`` (filed a
    year newer than any we hold), ``alle`` (every filer, longest waiting first),
    ``seed`` (large recent filers never tried), ``gamle`` (last success older
    than ``stale_days``).
    """
    active = companies.filter(F.col("slettet_dato").isNull())
    filed = active.filter(F.col("siste_innsendte_aarsregnskap").isNotNull())
    biggest = F.desc_nulls_last("antall_ansatte")
    if mode == "nye":
        held = accounts.groupBy(ORG).agg(F.year(F.max("periode_til")).alias("_held"))
        rows = filed.join(held, ORG, "left").filter(F.col("siste_innsendte_aarsregnskap") > F.coalesce("_held", F.lit(0)))
        return _queued(rows, biggest)
    if mode == "alle":
        rows = filed.join(attempts.select(ORG, "forsokt_at"), ORG, "left")
        return _queued(rows, F.asc_nulls_first("forsokt_at"), biggest)
    if mode == "seed":
        large = (F.col("siste_innsendte_aarsregnskap") >= seed_year) & (F.col("antall_ansatte") >= seed_employees)
        return _queued(active.filter(large).join(attempts.select(ORG), ORG, "left_anti"), biggest)
    if mode == "gamle":
        old = F.col("forsokt_at") < F.date_sub(F.lit(as_of), stale_days)
        return _queued(attempts.filter((F.col("status") == "ok") & old), F.asc("forsokt_at"))
    raise ValueError(f"unknown mode: {mode}")


def _queued(rows: DataFrame, *order: Column) -> DataFrame:
    """The keys with their place in the queue, from 1."""
    return row_numbers(rows.orderBy(*order, F.asc(ORG)).select(ORG), "plass")


def embedding_text(companies: DataFrame) -> DataFrame:
    """The text that stands for each active, described company, and its hash."""
    described = companies.filter(F.col("slettet_dato").isNull() & (F.length(C.description()) >= MIN_DESCRIPTION))
    text = F.concat(F.col("navn"), F.lit(". "), C.description())
    return described.select(ORG, text.alias("tekst"), text_hash(text).alias("tekst_hash"))


def needs_embedding(companies: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Companies never embedded, embedded from another text, or by another model."""
    done = vectors.filter(F.col("modell") == model).select(ORG, "tekst_hash")
    return embedding_text(companies).join(done, [ORG, "tekst_hash"], "left_anti")


def embedding_coverage(companies: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embedded and eligible companies, both counted over the same population."""
    have = vectors.select(ORG).distinct().withColumn("_done", F.lit(1))
    rows = embedding_text(companies).join(have, ORG, "left")
    done, total = F.count("_done"), F.count(F.lit(1))
    return rows.agg(
        done.alias("gjort"), total.alias("totalt"),
        F.when(total > 0, F.round(F.lit(100) * done / total, 1)).otherwise(0.0).alias("andel"),
        ((total > 0) & (done >= total)).alias("ferdig"),
    )
