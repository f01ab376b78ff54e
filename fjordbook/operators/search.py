"""Company search: one filter shared by the list, its page, and its counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.functions import text as T
from fjordbook.operators.retrieval import near
from fjordbook.operators.tree import expand_to_leaves
from fjordbook.schema import ORG

# Range filters and the column of the latest accounts each one reads.
AMOUNT_FIELDS = {
    "omsetning": "sum_driftsinntekter",
    "driftsresultat": "driftsresultat",
    "resultat": "aarsresultat",
    "egenkapital": "sum_egenkapital",
    "eiendeler": "sum_eiendeler",
    "gjeld": "sum_gjeld",
}

PLACE = "forretningsadresse_kommunenummer"

ACCOUNT_SORTS = {"omsetning": "sum_driftsinntekter", "resultat": "aarsresultat"}


@dataclass
class SearchSpec:
    """What to search for; everything is optional."""

    q: str = ""
    gjor: str = ""
    kommune: str = ""
    fylke: str = ""
    nace: list[str] = field(default_factory=list)
    orgform: str = ""
    ansatte: int | None = None
    ansatte_maks: int | None = None
    konkurs: bool = False
    avvikling: bool = False
    nye: bool = False
    aktive: bool = False
    belop: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    sorter: str = "ansatte"

    @property
    def needs_accounts(self) -> bool:
        return bool(self.belop) or self.sorter in ACCOUNT_SORTS


def in_kroner(bounds: tuple[float | None, float | None]) -> tuple[int | None, int | None]:
    """Bounds typed in thousands as the amounts they stand for."""
    low, high = (None if b is None else round(b * 1000) for b in bounds)
    return low, high


def keyword_filter(query: str, text: Column, language: str = "norsk") -> Column:
    """Web-style search: words are all required, ``"…"`` is a phrase, ``or`` and a leading ``-`` work.

    ``or`` binds weaker than the words on either side of it, and stop words are
    ignored. Both sides are reduced to stems, so the test is row-local: no
    index, no shuffle, one pass over the text column.
    """
    groups: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            groups.append([])
        else:
            groups[-1].append((bool(minus), phrase or word))

    def matches(haystack: Column) -> Column:
        """Terms are stemmed as constants of the plan; one of stop words alone decides nothing."""
        wanted = [F.lit(False)]
        for group in filter(None, groups):
            needles = [(minus, T.stems(F.lit(term), language)) for minus, term in group]
            hits = [(needle == "") | (F.contains(haystack, F.concat(F.lit(" "), needle, F.lit(" "))) != F.lit(minus)) for minus, needle in needles]
            wanted.append(reduce(and_, hits) & reduce(or_, [needle != "" for _, needle in needles]))
        return reduce(or_, wanted)

    # Bound to a lambda, the stems of a row are computed once for all terms.
    return F.exists(F.array(F.concat(F.lit(" "), T.stems(text, language), F.lit(" "))), matches)


def _name_filter(text: str) -> Column:
    if re.fullmatch(r"\d{9}", text):
        return F.col(ORG) == text
    return F.col("navn").ilike(f"%{text}%")


def _status_filter(spec: SearchSpec, as_of: date) -> Column | None:
    chosen = []
    if spec.konkurs:
        chosen.append(F.col("konkurs"))
    if spec.avvikling:
        chosen.append(F.col("under_avvikling") | F.col("under_tvangsavvikling"))
    if spec.nye:
        chosen.append(F.col("registreringsdato_enhetsregisteret") >= F.lit(as_of - timedelta(days=90)))
    if chosen:
        return reduce(or_, chosen)
    if spec.aktive:
        return ~F.col("konkurs") & ~F.col("under_avvikling") & ~F.col("under_tvangsavvikling")
    return None


def search(
    companies: DataFrame, spec: SearchSpec, as_of: date, latest: DataFrame | None = None,
    municipalities: DataFrame | None = None, counties: DataFrame | None = None, industries: DataFrame | None = None,
) -> DataFrame:
    """All matching companies. Dimension tables are only joined when the search needs them.

    Predicates on stored columns come first, so they reach the scan; name
    lookups are semi-joins; accounts are joined for a range or an accounts sort,
    and then only plausible ones count.
    """
    rows = companies.filter(F.col("slettet_dato").isNull())
    place = F.col(PLACE)
    if spec.q.strip():
        rows = rows.filter(_name_filter(spec.q.strip()))
    if spec.orgform:
        rows = rows.filter(F.col("organisasjonsform_kode") == spec.orgform)
    if spec.ansatte is not None:
        rows = rows.filter(F.col("antall_ansatte") >= spec.ansatte)
    if spec.ansatte_maks is not None:
        rows = rows.filter(F.col("antall_ansatte") <= spec.ansatte_maks)
    status = _status_filter(spec, as_of)
    if status is not None:
        rows = rows.filter(status)

    if re.fullmatch(r"\d{4}", spec.kommune):
        rows = rows.filter(place == spec.kommune)
    elif spec.kommune.isdigit():
        rows = rows.filter(place.startswith(spec.kommune))
    elif spec.kommune:
        named = municipalities.filter(F.col("navn").ilike(f"%{spec.kommune}%"))
        rows = rows.join(named.select(F.col("kommunenummer").alias(PLACE)), PLACE, "left_semi")
    if spec.fylke.isdigit():
        rows = rows.filter(C.county_of(place) == spec.fylke.zfill(2))
    elif spec.fylke:
        named = counties.filter(F.col("navn").ilike(f"%{spec.fylke}%"))
        inside = municipalities.join(named.select("fylkesnummer"), "fylkesnummer", "left_semi")
        rows = rows.join(inside.select(F.col("kommunenummer").alias(PLACE)), PLACE, "left_semi")
    if spec.nace:
        leaves = expand_to_leaves(industries, spec.nace)
        rows = rows.join(leaves.select(F.col("kode").alias("naeringskode1_kode")), "naeringskode1_kode", "left_semi")
    if spec.gjor.strip():
        rows = rows.filter(keyword_filter(spec.gjor, searchable_text()))

    if spec.needs_accounts:
        amounts = latest.filter("rimelig")
        for name, (low, high) in spec.belop.items():
            column = F.col(AMOUNT_FIELDS[name])
            if low is not None:
                amounts = amounts.filter(column >= low)
            if high is not None:
                amounts = amounts.filter(column <= high)
        rows = rows.join(amounts.select(ORG, "aar", *AMOUNT_FIELDS.values()), ORG)
    return rows


def searchable_text() -> Column:
    """Name, activity and purpose: the text a keyword search looks in."""
    return F.concat_ws(" ", "navn", "aktivitet", "vedtektsfestet_formaal")


def semantic(rows: DataFrame, vectors: DataFrame, question: list[float] | Column, ceiling: float, model: str) -> DataFrame:
    """Search results near a question, nearest first by ``avstand``.

    ``rows`` is a filtered result of :func:`search`; ``question`` the question's
    vector, made by ``model`` (as :func:`retrieval.embed_question` does); only
    descriptions embedded by the same model are compared. Matches carry
    their similarity and a snippet of the description. The order replaces any
    other sort; take a page of it rather than counting it.
    """
    found = rows.join(near(vectors.filter(F.col("modell") == model), question, ceiling, ORG), ORG)
    return found.withColumns({"likhet": F.round(1 - F.col("avstand"), 3), "utdrag": C.snippet(C.description())})


def sort_order(sort: str = "ansatte") -> list[Column]:
    """Ordering of a result list; every order ends in the key, so pages never overlap."""
    ties = [F.asc_nulls_last("navn"), F.asc(ORG)]
    first = {
        "navn": [],
        "nyest": [F.desc_nulls_last("registreringsdato_enhetsregisteret")],
        "eldst": [F.asc_nulls_last("stiftelsesdato")],
        "omsetning": [F.desc_nulls_last("sum_driftsinntekter")],
        "resultat": [F.desc_nulls_last("aarsresultat")],
        "relevans": [F.asc("avstand")],
    }.get(sort, [F.desc_nulls_last("antall_ansatte")])
    return [*first, *ties]


def pick_places(municipalities: DataFrame, text: str = "", county: str | None = None) -> DataFrame:
    """Municipalities whose name contains ``text`` or whose number starts with it, in one county if given."""
    rows = municipalities
    if county:
        rows = rows.filter(F.col("fylkesnummer") == county)
    if text:
        named = F.contains(F.lower("navn"), F.lit(text.lower()))
        rows = rows.filter(named | F.col("kommunenummer").startswith(text))
    return rows
