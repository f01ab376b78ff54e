"""Filter specs: a closed vocabulary of fields and operators, compiled to column expressions.

A spec is ``{"filtre": [{"felt", "op", "verdi"}], "sorter", "retning", "grense"}``.
Anything outside the vocabulary is refused before a plan exists.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordbook.operators.accounts import newest_any_currency
from fjordbook.operators.keyed import lookup
from fjordbook.schema import ORG


class SpecError(ValueError):
    """The spec uses a field, operator or value outside the vocabulary."""


class Field(NamedTuple):
    column: Column
    kind: str
    ops: tuple[str, ...]


_TEXT = ("er", "inneholder")
_RANGE = ("minst", "hoyst", "mellom")


def vocabulary() -> dict[str, Field]:
    """Every field a filter may use."""
    # Field names, their types and operators.
    return {
        "navn": Field(F.col("navn"), "tekst", ("inneholder",)),
        "fylke": Field(F.col("fylke"), "tekst", _TEXT),
        "kommune": Field(F.col("kommune"), "tekst", _TEXT),
        "poststed": Field(F.col("forretningsadresse_poststed"), "tekst", _TEXT),
        "naering": Field(F.col("naering"), "tekst", ("inneholder",)),
        "naeringskode": Field(F.col("naeringskode1_kode"), "tekst", ("starter_med", "er")),
        "organisasjonsform": Field(F.col("organisasjonsform_kode"), "tekst", ("er",)),
        "ansatte": Field(F.col("antall_ansatte"), "tall", ("er", *_RANGE)),
        "stiftet_aar": Field(F.year("stiftelsesdato"), "tall", ("er", *_RANGE)),
        "konkurs": Field(F.col("konkurs"), "bool", ("er",)),
        "under_avvikling": Field(F.col("under_avvikling"), "bool", ("er",)),
        "aksjekapital": Field(F.col("kapital_belop"), "tall", _RANGE),
        "driftsinntekter": Field(F.col("sum_driftsinntekter"), "tall", _RANGE),
        "aarsresultat": Field(F.col("aarsresultat"), "tall", _RANGE),
    }


# Sort names and their columns.
SORTABLE = {
    "navn": "navn",
    "ansatte": "antall_ansatte",
    "driftsinntekter": "sum_driftsinntekter",
    "aarsresultat": "aarsresultat",
    "aksjekapital": "kapital_belop",
    "stiftet": "stiftelsesdato",
}


def _value(kind: str, raw):
    if kind == "tall":
        try:
            number = float(raw)
        except (TypeError, ValueError):
            raise SpecError(f"{raw!r} is not a number") from None
        if not math.isfinite(number):
            raise SpecError(f"{raw!r} is not a number")
        return int(number) if number.is_integer() else number
    if kind == "bool":
        return raw is True or raw == "true"
    return str(raw)


def _pair(kind: str, raw) -> tuple:
    if not isinstance(raw, (list, tuple)) or len(raw) < 2 or None in raw[:2]:
        raise SpecError("mellom needs two values")
    return _value(kind, raw[0]), _value(kind, raw[1])


def _same(c: Column, kind: str, raw) -> Column:
    value = _value(kind, raw)
    if kind != "tekst":
        return c == F.lit(value)
    # A place may carry its name in a second language after a dash.
    return c.ilike(value) | c.ilike(f"{value} - %")


OPERATORS = {
    "er": _same,
    "inneholder": lambda c, kind, raw: c.ilike(f"%{raw}%"),
    "starter_med": lambda c, kind, raw: c.startswith(str(raw)),
    "minst": lambda c, kind, raw: c >= F.lit(_value(kind, raw)),
    "hoyst": lambda c, kind, raw: c <= F.lit(_value(kind, raw)),
    "mellom": lambda c, kind, raw: c.between(*map(F.lit, _pair(kind, raw))),
}


def compile_spec(spec: dict) -> Column:
    """The spec's filters as one condition over :func:`spec_rows`."""
    fields = vocabulary()
    condition = F.col("slettet_dato").isNull()
    for item in spec.get("filtre") or []:
        field = fields.get(item.get("felt"))
        if field is None:
            raise SpecError(f"unknown field: {item.get('felt')}")
        if item.get("op") not in field.ops:
            raise SpecError(f"operator {item.get('op')!r} does not apply to {item['felt']}")
        condition = condition & OPERATORS[item["op"]](field.column, field.kind, item.get("verdi"))
    return condition


def spec_order(spec: dict) -> list[Column]:
    column = SORTABLE.get(spec.get("sorter"), "antall_ansatte")
    first = F.asc_nulls_last(column) if spec.get("retning") == "asc" else F.desc_nulls_last(column)
    return [first, F.asc(ORG)]


def spec_limit(spec: dict) -> int:
    """Rows asked for: 25 where nothing is said. What is no whole number from 1 on is refused, never made smaller."""
    asked = spec.get("grense")
    if asked is None:
        return 25
    try:
        wanted = float(asked)
    except (TypeError, ValueError):
        raise SpecError(f"limit {asked!r} is no number") from None
    if not wanted.is_integer() or wanted < 1:
        raise SpecError(f"limit {asked!r} is no whole number from 1 on")
    return int(wanted)


def spec_rows(companies: DataFrame, municipalities: DataFrame, counties: DataFrame, industries: DataFrame,
              accounts: DataFrame) -> DataFrame:
    """Companies with the dimension names and newest accounts (any currency) the vocabulary refers to."""
    places = municipalities.select(
        F.col("kommunenummer").alias("forretningsadresse_kommunenummer"), F.col("navn").alias("kommune"), "fylkesnummer"
    )
    regions = counties.select("fylkesnummer", F.col("navn").alias("fylke"))
    codes = industries.select(F.col("kode").alias("naeringskode1_kode"), F.col("navn").alias("naering"))
    figures = newest_any_currency(accounts).select(
        ORG, "sum_driftsinntekter", "aarsresultat", F.col("periode_til").alias("regnskapsaar")
    )
    rows = lookup(companies, places, "forretningsadresse_kommunenummer", ORG)
    rows = lookup(rows, regions, "fylkesnummer", ORG)
    return lookup(rows, codes, "naeringskode1_kode", ORG).join(figures, ORG, "left")


SPEC_COLUMNS = [
    ORG, "navn", "organisasjonsform_kode", "antall_ansatte", "har_registrert_antall_ansatte",
    "forretningsadresse_poststed", "kommune", "fylke", "naeringskode1_kode", "naering", "konkurs",
    "under_avvikling", "kapital_belop", "sum_driftsinntekter", "aarsresultat", "regnskapsaar",
]


def run_spec(rows: DataFrame, spec: dict) -> DataFrame:
    """The top rows for a spec over :func:`spec_rows`, each with the number of matches in all."""
    matches = rows.filter(compile_spec(spec))
    total = matches.select(F.count(F.lit(1))).scalar()
    top = matches.orderBy(*spec_order(spec)).limit(spec_limit(spec))
    return top.select(*SPEC_COLUMNS, total.alias("totalt"))


def spec_schema() -> dict:
    """JSON schema of a spec, generated from the vocabulary the compiler checks against."""
    fields = vocabulary()
    ops = list(dict.fromkeys(op for f in fields.values() for op in f.ops))
    pair = {"type": "array", "items": {"type": "number"}, "minItems": 2, "maxItems": 2}
    scalar = [{"type": "string"}, {"type": "number"}, {"type": "boolean"}]
    filter_item = {
        "type": "object",
        "properties": {
            "felt": {"type": "string", "enum": list(fields)},
            "op": {"type": "string", "enum": ops},
            "verdi": {"anyOf": [*scalar, pair]},
        },
        "required": ["felt", "op", "verdi"],
    }
    return {
        "type": "object",
        "properties": {
            "filtre": {"type": "array", "items": filter_item},
            "sorter": {"type": "string", "enum": list(SORTABLE)},
            "retning": {"type": "string", "enum": ["asc", "desc"]},
            "grense": {"type": "integer"},
        },
        "required": ["filtre"],
    }


def vocabulary_text() -> str:
    """The field list as text, one field per line."""
    return "\n".join(f"- {name} ({f.kind}): {', '.join(f.ops)}" for name, f in vocabulary().items())


SPEC_TYPE = "filtre array<struct<felt:string,op:string,verdi:string>>, sorter string, retning string, grense int"


def parse_specs(replies: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Specs found in free-text replies: the outermost ``{…}`` of each, parsed.

    Returns ``(specs, rejects)``; a reject holds no object, or one without a
    filter list, or an unknown field or operator.
    """
    body = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    parsed = replies.withColumn("spec", F.from_json(body, SPEC_TYPE))
    allowed = F.array(*[F.lit(f"{n}:{op}") for n, f in vocabulary().items() for op in f.ops])
    numeric = F.array(*[F.lit(n) for n, f in vocabulary().items() if f.kind == "tall"])
    known = F.forall(
        "spec.filtre",
        lambda f: F.array_contains(allowed, F.concat_ws(":", f["felt"], f["op"])) & f["verdi"].isNotNull() & (
            ~F.array_contains(numeric, f["felt"]) | f["verdi"].rlike(r"^\s*\[?\s*-?\d+(\.\d+)?([eE]\+?\d+)?\s*(,\s*-?\d+(\.\d+)?([eE]\+?\d+)?\s*)?\]?\s*$")),
    )
    reason = (
        F.when(body.isNull(), "ingen spesifikasjon")
        .when(F.col("spec.filtre").isNull(), "ingen filtre")
        .when(~known, "ukjent felt eller operator")
    )
    checked = parsed.withColumn("grunn", reason)
    return checked.filter("grunn is null").drop("grunn"), checked.filter("grunn is not null").drop("spec")


def spec_of(row) -> dict:
    """A parsed spec row as the dictionary :func:`compile_spec` takes."""
    spec = row.asDict(recursive=True)
    for item in spec.get("filtre") or []:
        if isinstance(item["verdi"], str) and item["verdi"].startswith("["):
            item["verdi"] = json.loads(item["verdi"])
    return spec
