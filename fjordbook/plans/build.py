"""Building and indexing the stored ranking lists."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordbook.operators.keyed import row_numbers
from fjordbook.plans.rankings import RANKINGS, Ranking, Register
from fjordbook.sources.tables import TableStore

log = logging.getLogger(__name__)

PREFIX = "topplister/"


def build_rankings(store: TableStore, register: Register, names: list[str] | None = None, lists: dict[str, Ranking] | None = None) -> dict[str, str]:
    """Refresh the derived tables and store every list, or just the named ones.

    A list that fails keeps its previous rows and its error is recorded. Lists
    no longer defined are retired, but only when all lists are built. Returns
    the outcome of each list. ``lists`` are the definitions, all by default.

    A register's derived tables are derived by its first build; a further one, of
    whatever store, stores them again as they are. A new day's tables are a new register.
    """
    lists = RANKINGS if lists is None else lists
    unknown = set(names or ()) - set(lists)
    if unknown:
        raise ValueError(f"unknown lists: {', '.join(sorted(unknown))}")
    register.stored["latest"] = register.latest = store.publish("regnskap_siste", register.latest)
    register.stored["edges"] = register.edges = store.publish("eierskap_kant", register.edges)

    outcomes = {}
    for name in names or lists:
        entry = lists[name]
        properties = {"tittel": entry.title, "beskrivelse": entry.description, "kategori": entry.category, "kolonner": json.dumps(entry.shown())}
        try:
            store.publish(PREFIX + name, numbered(entry.rows(register)), properties)
            outcomes[name] = "ok"
        except Exception as error:  # one broken list must not take the others down
            log.exception("list %s failed", name)
            store.fail(PREFIX + name, str(error))
            outcomes[name] = "feilet"
    if names is None:
        live = [r.navn for r in ranking_index(store).select("navn").collect()]
        for name in live:
            if name not in lists:
                store.retire(PREFIX + name)
    return outcomes


def numbered(top: DataFrame) -> DataFrame:
    """A list, already in order, with its positions, however long it is."""
    return row_numbers(top, "nr")


def list_rows(store: TableStore, name: str) -> DataFrame:
    return store.read(PREFIX + name).orderBy("nr")


def list_json(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of a stored list as one JSON array in list order."""
    columns = [c for c in rows.columns if c != "nr"]
    rows = rows.filter(F.col("nr") <= k)
    entry = F.struct("nr", F.struct(*columns).alias("rad"))
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["rad"])
    return rows.agg(F.to_json(ordered).alias("data"), F.count(F.lit(1)).alias("antall"))


def ranking_index(store: TableStore) -> DataFrame:
    """The live lists with title, description, category, size, age and last error, by category and title."""
    lists = store.manifest().filter(F.col("navn").startswith(PREFIX))
    return lists.select(
        F.replace("navn", F.lit(PREFIX), F.lit("")).alias("navn"),
        F.col("egenskaper.tittel").alias("tittel"), F.col("egenskaper.beskrivelse").alias("beskrivelse"), F.col("egenskaper.kategori").alias("kategori"),
        F.col("egenskaper.kolonner").alias("kolonner"), "antall", "publisert", "varighet_ms", "feilmelding",
    ).orderBy("kategori", "tittel", "navn")


def teasers(store: TableStore, names: list[str], show: int = 3) -> DataFrame:
    """The first ``show`` values of the leading column of some lists, and when the oldest of them was made."""
    index = {r.navn: r for r in ranking_index(store).collect()}
    oldest = min((index[n].publisert for n in names if n in index), default=None)
    parts = []
    for name in names:
        if name not in index:
            continue
        lead = json.loads(index[name].kolonner)[0]["felt"]
        first = list_rows(store, name).filter(F.col("nr") <= show)
        values = F.transform(F.sort_array(F.collect_list(F.struct("nr", F.col(lead).cast("string").alias("v")))), lambda e: e["v"])
        parts.append(first.agg(F.lit(name).alias("navn"), F.slice(values, 1, show).alias("topp"), F.lit(len(index)).alias("lister"),
                               F.lit(oldest).alias("eldste")))
    if not parts:
        raise KeyError("none of the lists is stored")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
