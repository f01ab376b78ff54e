"""Row hashes, role fingerprints and the token hash behind hashed vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published 32-bit FNV-1a parameters.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


def content_hash(columns: Sequence[str]) -> Column:
    """Fingerprint of a row. Null and empty differ, and column order matters."""
    row = F.struct(*[F.col(c) for c in columns])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def role_fingerprint() -> Column:
    """Identity of a role: who holds which seat where, without its attributes."""
    parts = [
        F.col("organisasjonsnummer"),
        F.col("rollegruppe_kode"),
        F.col("rolletype_kode"),
        F.col("innehaver_orgnr"),
        F.col("person_etternavn"),
        F.col("person_fornavn"),
        F.unix_date("person_fodselsdato").cast("string"),
        F.col("rekkefolge").cast("string"),
    ]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def fnv1a(texts: pd.Series, behind: str = "") -> tuple[np.ndarray, np.ndarray]:
    """32-bit FNV-1a over UTF-16 code units of each text, and of each with ``behind`` added, all texts at once.

    Texts are taken from the longest on, so those that still have a unit at a position stand first.
    """
    joined = "\0".join(texts) + "\0"
    if joined.count("\0") == len(texts):
        units = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        ends = np.flatnonzero(units == 0)
        lengths = np.diff(ends, prepend=-1) - 1
        starts = ends - lengths
    else:
        encoded = [t.encode("utf-16-le") for t in texts]
        units = np.frombuffer(b"".join(encoded), np.uint16)
        lengths = np.fromiter((len(e) // 2 for e in encoded), np.int64, len(encoded))
        starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, shrinking = starts[order], -lengths[order]
    sorted_hashes = np.full(len(texts), FNV_OFFSET, np.uint32)
    prime = np.uint32(FNV_PRIME)
    for position in range(int(lengths.max(initial=0))):
        left = sorted_hashes[:np.searchsorted(shrinking, -position)]
        left ^= units[starts[:len(left)] + position]
        left *= prime
    hashes = np.empty_like(sorted_hashes)
    hashes[order] = sorted_hashes
    more = hashes.copy()
    for unit in np.frombuffer(behind.encode("utf-16-le"), np.uint16):
        more ^= np.uint32(unit)
        more *= prime
    return hashes, more


_SLOT = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("sign", T.IntegerType())])


def signed_slots(tokens: pd.Series) -> np.ndarray:
    """Where each token lands in a 4096-wide hashed vector; places of negative sign are given as ``-1 - slot``."""
    return slots_of(*fnv1a(tokens, "#sign"))


def slots_of(place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """:func:`signed_slots` of the hashes of tokens and of tokens with the mark of the sign."""
    slot = (place % 4096).astype(np.int32)
    return np.where(sign % 2 == 0, slot, -1 - slot)


@F.pandas_udf(_SLOT)
def token_slot(token: pd.Series) -> pd.DataFrame:
    """Where a token lands in a 4096-wide hashed vector, and with which sign."""
    place = signed_slots(token)
    negative = place < 0
    return pd.DataFrame({"slot": np.where(negative, -1 - place, place).astype(np.int32), "sign": np.where(negative, -1, 1).astype(np.int32)})
