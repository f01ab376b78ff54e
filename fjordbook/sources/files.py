"""Readers for the register's bulk files and API documents.

Every reader returns a DataFrame over the whole file. Formats that Spark can
only read in one task per file (multi-line CSV and JSON) are spread out again
right after; with ``land`` they are also landed as Parquet, in as many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.schema import ACCOUNT_KEY, ACCOUNT_PATHS, COMPANY_MAPPING, ORG, ROLE_DOCUMENT
from fjordbook.session import busy, durable, growing


def _spread(df: DataFrame, land: str | None) -> DataFrame:
    if land is None:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    busy(df).write.mode("overwrite").parquet(land)
    return df.sparkSession.read.parquet(land)


def _column(header: str) -> Column:
    return F.col(f"`{header}`")


def typed_projection(raw: DataFrame, mapping=COMPANY_MAPPING, keep=()) -> DataFrame:
    """Typed columns named by ``mapping``, plus ``feil_kolonner``: the columns that did not fit.

    The placeholder industry code clears both the code and its description.
    Columns to ``keep`` pass through.
    """
    columns = []
    for header, name, kind in mapping:
        value = C.typed(_column(header), kind)
        if name == "naeringskode1_kode":
            value = C.real_industry(value)
        elif name == "naeringskode1_beskrivelse":
            value = C.real_industry(_column("naeringskode1.kode"), value)
        columns.append(value.alias(name))
    bad = [F.when(C.unreadable(_column(h), k), F.lit(n)) for h, n, k in mapping if k != "text"]
    return raw.select(*keep, *columns, F.array_compact(F.array(*bad)).alias("feil_kolonner"))


def read_mapped_csv(
    spark: SparkSession, path: str, mapping=COMPANY_MAPPING, land: str | None = None, **fmt
) -> tuple[DataFrame, DataFrame]:
    """A headed CSV as typed rows and rejects (rows with a value that does not fit its column).

    Quoted fields may span lines and hold doubled quotes; gzip is read as is.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "sep": ",", "inferSchema": False}
    raw = _spread(spark.read.csv(path, **{**options, **fmt}), land)
    rows = typed_projection(raw, mapping)
    rows = rows if land is None else durable(rows)  # a landed file is typed once for all that is read of it
    good = F.size("feil_kolonner") == 0
    return rows.filter(good).drop("feil_kolonner"), rows.filter(~good)


# The columns of the shareholder file, by position.
HOLDING_COLUMNS = [
    "orgnr", "selskap", "aksjeklasse", "eier_navn", "fodselsaar_orgnr",
    "postnr_sted", "landkode", "antall_aksjer", "antall_aksjer_selskap",
]


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Shareholder file: semicolons, a byte-order mark, and quote characters that mean nothing.

    Lines are records, so the file is split between tasks as it is read.
    """
    schema = ", ".join(f"{c} string" for c in HOLDING_COLUMNS)
    return spark.read.csv(path, schema=schema, sep=";", quote="\x01", header=True, enforceSchema=True)


def read_postcodes(spark: SparkSession, path: str) -> DataFrame:
    """Postcode file: tab-separated Latin-1 without a header; short lines are dropped."""
    schema = "postnummer string, poststed string, kommunenummer string, kommunenavn string, kategori string"
    rows = spark.read.csv(path, schema=schema, sep="\t", encoding="ISO-8859-1", quote="", lineSep="\n")
    return (
        rows.withColumn("kategori", F.regexp_replace("kategori", r"\r$", ""))
        .filter(F.col("kategori").isNotNull())
    )


def read_nested_json(spark: SparkSession, path: str, schema: str = ROLE_DOCUMENT, land: str | None = None) -> DataFrame:
    """A file holding one JSON array of documents, or one document per line split over lines.

    One task parses a whole file. A large array is read by
    :func:`fjordbook.sources.jsonarray.read_json_array`.
    """
    return _spread(spark.read.json(path, schema=schema, multiLine=True), land)


def explode_roles(documents: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """One row per role. Companies without groups and groups without roles drop out.

    With ``companies`` given, roles of companies outside the register are left out.
    """
    if companies is not None:
        documents = documents.join(growing(companies.select(ORG)), ORG, "left_semi")
    groups = documents.select(ORG, F.explode("rollegrupper").alias("g"))
    roles = groups.select(ORG, "g", F.explode("g.roller").alias("r"))
    person, unit = "r.person", "r.enhet"
    return roles.select(
        ORG,
        F.col("g.type.kode").alias("rollegruppe_kode"),
        F.col("g.type.beskrivelse").alias("rollegruppe_beskrivelse"),
        C.typed(F.col("g.sistEndret"), "date").alias("rollegruppe_sist_endret"),
        F.col("r.type.kode").alias("rolletype_kode"),
        F.col("r.type.beskrivelse").alias("rolletype_beskrivelse"),
        F.col("r.rekkefolge").alias("rekkefolge"),
        F.coalesce("r.avregistrert", F.lit(False)).alias("avregistrert"),
        F.col("r.valgtAv").alias("valgt_av"),
        F.col(f"{person}.navn.fornavn").alias("person_fornavn"),
        F.col(f"{person}.navn.mellomnavn").alias("person_mellomnavn"),
        F.col(f"{person}.navn.etternavn").alias("person_etternavn"),
        C.typed(F.col(f"{person}.fodselsdato"), "date").alias("person_fodselsdato"),
        F.col(f"{person}.erDoed").alias("person_er_doed"),
        F.col(f"{unit}.organisasjonsnummer").alias("innehaver_orgnr"),
        F.array_join(f"{unit}.navn", " ").alias("innehaver_navn"),
        F.col(f"{unit}.organisasjonsform.kode").alias("innehaver_organisasjonsform"),
        F.col(f"{unit}.erSlettet").alias("innehaver_er_slettet"),
    )


def nested_schema(paths: dict[str, str]) -> str:
    """Schema text for documents whose leaves sit at dotted ``paths``, each with its type."""
    tree: dict = {}
    for path, kind in paths.items():
        *parents, leaf = path.split(".")
        node = tree
        for parent in parents:
            node = node.setdefault(parent, {})
        node[leaf] = kind

    def text(node: dict, mark: str) -> str:
        return ", ".join(
            f"`{name}`{mark}{'struct<' + text(sub, ': ') + '>' if isinstance(sub, dict) else sub}"
            for name, sub in node.items()
        )

    return text(tree, " ")


# Where the change-feed document differs from the bulk file's header.
_DOCUMENT_PATHS = {
    "registrertIMvaRegisteret": "registrertIMvaregisteret",
    "registreringsdatoenhetsregisteret": "registreringsdatoEnhetsregisteret",
    "overordnetEnhet": "overordnetEnhet.organisasjonsnummer",
}


def settled(rows: DataFrame) -> DataFrame:
    """The same rows out of a generator, so that conditions on their columns stay above it.

    Pushed below, to the text, a condition would parse a document anew for every
    field that it names.
    """
    return rows.select(F.inline(F.array(F.struct(*[_column(c) for c in rows.columns]))))


def company_documents(documents: DataFrame, body: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Change-feed documents (the company key and JSON text) as ``(rows, rejects)`` in the company table's columns.

    The key is the feed's, not the document's. Address lines arrive as arrays and
    are joined with a comma. A column the document lacks is null. A document that
    cannot be parsed, names another company or holds a value that does not fit
    its column is a reject, with ``feil_kolonner`` naming what is wrong.
    """
    paths = {h: _DOCUMENT_PATHS.get(h, h) for h, _, _ in COMPANY_MAPPING}
    lines = "array<string>"
    schema = nested_schema({p: lines if p.endswith("adresse.adresse") else "string" for p in paths.values()})
    options = {"columnNameOfCorruptRecord": "_unreadable"}
    parsed = documents.select(F.col(ORG).alias("_key"), F.from_json(F.col(body), f"{schema}, _unreadable string", options).alias("d"))
    flat = parsed.select(
        "_key", (F.col("d").isNull() | F.col("d._unreadable").isNotNull()).alias("_empty"),
        *[
            (F.array_join(f"d.{p}", ", ") if p.endswith("adresse.adresse") else F.col(f"d.{p}")).alias(h)
            for h, p in paths.items()
        ]
    )
    header = next(h for h, name, _ in COMPANY_MAPPING if name == ORG)
    typed = typed_projection(flat, keep=["_key", "_empty", F.nullif(F.trim(_column(header)), F.lit("")).alias("_stated")])
    other = F.col("_empty") | (F.col("_stated") != F.col("_key"))
    wrong = F.concat("feil_kolonner", F.when(F.coalesce(other, F.lit(False)), F.array(F.lit(ORG))).otherwise(F.array().cast("array<string>")))
    rows = settled(typed.withColumn("feil_kolonner", wrong).withColumn(ORG, F.col("_key")).drop("_key", "_empty", "_stated"))
    good = F.size("feil_kolonner") == 0
    return rows.filter(good).drop("feil_kolonner"), rows.filter(~good)


def read_accounts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accounts API documents landed as JSON lines, each with its company key and one period, as ``(rows, rejects)``."""
    return account_rows(spark.read.text(path).withColumnRenamed("value", "raw"))


def account_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: typed account rows from raw documents; amounts are rounded to the thousand, ids are not.

    A document that cannot be parsed, has no company, period end or type, or holds a
    value that does not fit its column is a reject as a whole, with ``feil_kolonner``
    naming what is wrong: what is stored of its period stays. A missing or blank
    value is null. Blank lines are no documents.
    """
    paths = {ORG: "string", **{path: "string" for path, _ in ACCOUNT_PATHS.values()}}
    options = {"columnNameOfCorruptRecord": "_unreadable"}
    lines = documents.filter(F.trim("raw") != "")
    parsed = lines.select(F.from_json("raw", f"{nested_schema(paths)}, _unreadable string", options).alias("d"), "raw")

    def value(path: str, kind: str) -> Column:
        text = C.blank_to_null(F.col(f"d.{path}"))
        if kind == "amount":
            return C.to_thousand(text.try_cast("decimal(20,2)"))
        return text if kind == "string" else text.try_cast(kind)

    values = {name: value(path, kind) for name, (path, kind) in ACCOUNT_PATHS.items()}
    stated = {name: C.blank_to_null(F.col(f"d.{path}")) for name, (path, _) in ACCOUNT_PATHS.items()}
    unread = F.col("d").isNull() | F.col("d._unreadable").isNotNull()
    wrong = [F.when(unread, "raw"), F.when(C.blank_to_null(F.col(f"d.{ORG}")).isNull(), ORG)]
    for name, typed in values.items():
        blank = F.coalesce(F.trim(stated[name]) == "", F.lit(True))
        missing = typed.isNull() | blank if name in ACCOUNT_KEY else typed.isNull() & ~blank
        wrong.append(F.when(missing, name))
    faults = F.when(unread, F.array(F.lit("raw"))).otherwise(F.array_compact(F.array(*wrong)))
    typed = settled(parsed.select(F.col(f"d.{ORG}").alias(ORG), *[c.alias(n) for n, c in values.items()], F.lit("brreg-api").alias("kilde"), "raw", faults.alias("feil_kolonner")))
    good = F.size("feil_kolonner") == 0
    return typed.filter(good).drop("feil_kolonner"), typed.filter(~good)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A classification document: a list of codes, each with its level and parent."""
    schema = "codes array<struct<code:string,name:string,level:string,parentCode:string,validFrom:string,validTo:string>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.inline("codes"))
    return rows.select(
        F.col("code").alias("kode"),
        F.col("name").alias("navn"),
        F.col("level").try_cast("smallint").alias("niva"),
        C.blank_to_null(F.col("parentCode")).alias("parent_kode"),
        C.typed(F.col("validFrom"), "date").alias("gyldig_fra"),
        C.typed(F.col("validTo"), "date").alias("gyldig_til"),
    )


def read_first_names(spark: SparkSession, path: str) -> DataFrame:
    """Name statistics metadata: codes and names in parallel arrays; the code's prefix is the gender."""
    schema = "variables array<struct<text:string,values:array<string>,valueTexts:array<string>>>"
    variables = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("variables").alias("v"))
    names = variables.filter(F.col("v.text").ilike("%navn%"))
    pairs = names.select(F.inline(F.arrays_zip("v.values", "v.valueTexts")).alias("kode", "navn"))
    gender = F.when(F.col("kode").startswith("1"), "K").when(F.col("kode").startswith("2"), "M")
    listed = pairs.select(C.blank_to_null(F.upper(F.trim("navn"))).alias("fornavn"), gender.alias("kjonn"))
    return listed.dropna()


def gender_by_name(names: DataFrame) -> DataFrame:
    """One row per first name: its gender, or ``?`` when it is in both lists."""
    ambiguous = F.min("kjonn") != F.max("kjonn")
    return names.groupBy("fornavn").agg(F.when(ambiguous, "?").otherwise(F.min("kjonn")).alias("kjonn"))
