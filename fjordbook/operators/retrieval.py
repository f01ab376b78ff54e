"""Retrieval over a table of texts: hashed vectors, nearest neighbours, quoting, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fjordbook.functions import text as T
from fjordbook.functions.hashing import fnv1a, signed_slots, slots_of
from fjordbook.operators.keyed import top_per_key
from fjordbook.session import busy, durable, shuffles_freed, small_batches

WIDTH = 4096

# Relevance floor and distance ceiling of each embedding model family.
FLOORS = {"hashed": 0.07, "hosted": 0.22, "local": 0.50}
CEILINGS = {"hosted": 0.62, "local": 0.45, "hashed": 1.0}
RELATIVE_FLOOR = 0.45

#: Bytes of a block of queries and of a block of vectors, both as dense numbers.
BLOCK_BYTES, PART_BYTES = 16 << 20, 64 << 20

#: Texts whose terms are named once, in parts of ``TEXT_HELD``, and bytes of text behind a share of all terms.
PIECE_PARTS, SHARE_TEXT = 2, 16 << 20

#: Tokens of questions that are sent to every task to pick their weights.
SENT_TOKENS = 1 << 18

#: Passes over the shares of all terms, at most.
PASSES = 4

#: Terms hashed at once, and rows of texts and of vectors sent to Python at once.
HASHED, SENT_ROWS = 1 << 16, 500

#: Entries of the questions that are sent to the tasks together.
QUESTION_ENTRIES = 4_000_000

#: Scores a task holds at once.
SCORES_HELD = 4_000_000

#: Bytes of text and entries of vectors that a task works on at once, however many rows a batch has.
TEXT_HELD, ENTRIES_HELD = 2 << 20, 1 << 20


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in consecutive parts whose ``sizes`` add up to ``most`` or less; a row that is larger is a part of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        yield batch.slice(start, max(1, stop - start))
        start = max(start + 1, stop)


def chunk(documents: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text",
          cap: int = 900, overlap: int = 100) -> DataFrame:
    """Retrievable pieces: sections at ``##`` headings, cut at ``cap``, headed ``Title > Heading``.

    Row-local: a document is split where it is read.
    """
    parts = documents.select(key, F.col(title).alias("_title"), F.posexplode(T.sections(F.col(text))).alias("seksjon", "s"))
    pieces = parts.select(key, "_title", "seksjon", F.col("s.heading").alias("overskrift"),
                          F.posexplode(T.windows(F.col("s.body"), cap, overlap)).alias("del", "tekst"))
    head = F.concat_ws(" > ", "_title", F.nullif("overskrift", F.lit("")))
    return pieces.withColumn("tekst", F.concat(head, F.lit("\n\n"), F.col("tekst"))).drop("_title")


def _text_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``_words`` in parts of ``TEXT_HELD`` bytes."""
    return (part for whole in batches for part in _parts(whole, pc.binary_length(whole.column("_words")).fill_null(0).to_numpy(), TEXT_HELD))


def _terms_of(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different unigrams and bigrams of some texts of spaced words, and ``(text, term, tf)`` by text and term."""
    split = pc.split_pattern(words.fill_null(""), " ")
    words = split.flatten().dictionary_encode()
    stems = T.stem_each(words.dictionary).take(words.indices)
    full = pc.is_valid(stems).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy())[full]
    words = stems.drop_null()
    follows = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = pc.binary_join_element_wise(words.take(pa.array(follows)), words.take(pa.array(follows + 1)), "_")
    found = pa.concat_arrays([words, pairs]).dictionary_encode()
    code = found.indices.to_numpy().astype(np.int64)
    each, tf = np.unique(np.concatenate([owner, owner[follows]]) * max(1, len(found.dictionary)) + code, return_counts=True)
    doc, code = np.divmod(each, max(1, len(found.dictionary)))
    return found.dictionary, doc, code, tf


def counted_terms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, tokens, tf, places)``: the different unigrams and bigrams of each document, how often each occurs, and its hashed place.

    A place is a slot, or below zero where the slot's sign is. Counted inside the row: the different words of some texts are stemmed once,
    and all are counted as arrays. The texts of a large table are not shuffled.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text_parts(batches):
            terms, doc, code, tf = _terms_of(batch.column("_words"))
            at = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)), pa.int32())
            values = [terms.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(signed_slots(terms.to_pandas())[code], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.ListArray.from_arrays(at, v) for v in values]], [key, "tokens", "tf", "places"])

    kind = documents.schema[key].dataType.simpleString()
    return _spaced(documents, key, text).mapInArrow(count, f"{key} {kind}, tokens array<string>, tf array<long>, places array<int>")


def _spaced(documents: DataFrame, key: str, text: str) -> DataFrame:
    return busy(documents.select(key, text)).select(key, T.spaced_words(F.col(text)).alias("_words"))


def exploded_counts(counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, token, tf, slot, sign)`` rows of :func:`counted_terms`."""
    each = counted.select(key, F.explode(F.arrays_zip("tokens", "tf", "places")).alias("t")).select(key, F.col("t.tokens").alias("token"), F.col("t.tf").alias("tf"), F.col("t.places").alias("_p"))
    return each.select(key, "token", "tf", F.when(F.col("_p") < 0, -1 - F.col("_p")).otherwise(F.col("_p")).alias("slot"), F.when(F.col("_p") < 0, -1).otherwise(1).alias("sign"))


def term_counts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each unigram and bigram occurs in each document, a row each."""
    return exploded_counts(counted_terms(documents, key, text), key).select(key, "token", "tf")


def _each(df: DataFrame, values: Column, name: str, *keep: str) -> DataFrame:
    """One row per array element.

    The outer form: the plain one is optimised to also test the array's size
    below the explode, which would compute an expensive array twice.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def idf(counts: DataFrame, n_documents: Column) -> DataFrame:
    """Document frequency and smoothed inverse document frequency of each token."""
    df = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.ln((n_documents + 1) / (F.col("df") + 1)) + 1)


def count_of(documents: DataFrame) -> Column:
    return documents.select(F.count(F.lit(1))).scalar()


def _unit_vectors(weighted: DataFrame, key: str) -> DataFrame:
    """Vectors from ``(key, tf, idf, slot, sign)`` rows: one shuffle, by document."""
    weight = F.col("sign") * (1 + F.ln("tf")) * F.col("idf")
    return _unit_length(weighted.select(key, "slot", weight.alias("w")), key)


def _unit_length(entries: DataFrame, key: str) -> DataFrame:
    """Vectors from ``(key, slot, w)`` rows."""
    slots = entries.repartition(F.col(key)).groupBy(key, "slot").agg(F.sum("w").alias("w"))
    entries = F.sort_array(F.collect_list(F.struct("slot", "w")))
    rows = slots.groupBy(key).agg(entries.alias("e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.filter("norm > 0").select(
        key, F.col("e.slot").alias("slots"), F.transform("e", lambda e: e["w"] / F.col("norm")).alias("values")
    )


def _packed(data: np.ndarray | bytes, level: int = 3) -> bytes:
    """Numbers, all first bytes before all second ones, or text, compressed behind its length."""
    raw = data if isinstance(data, bytes) else data.view(np.uint8).reshape(len(data), data.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _unpacked(data: bytes, kind: type | None = None) -> np.ndarray | bytes:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return raw if kind is None else np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _lines(data: bytes) -> pa.Array:
    """The terms of a packed share, one a line."""
    raw = _unpacked(data)
    whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(raw)])), pa.py_buffer(raw))
    return pc.split_pattern(whole, "\n").flatten().cast(pa.string())


def _released(work, *given):
    """What ``work`` returns, after its memory went back to the system: idle Python workers live on beside others."""
    found = work(*given)
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    return found


def _named_once(documents: DataFrame, key: str, text: str, shares: int, passes: int) -> DataFrame:
    """``(piece, row, keys, counts, terms0, terms1, …)``: the counted terms of pieces of some texts each, with every term of a piece named once.

    A piece has a row without a number: its documents' keys, and as packed numbers the terms of
    each, how far each term stands behind the one before it, how often it occurs, and the
    places of all terms of the piece. The terms themselves stand in numbered rows, in order, with
    the number of documents that have each. A share is a part of all terms by their hash; a row
    has a share for each pass, in columns of their own, so that a pass reads its shares alone.
    """
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for part in _text_parts(batches):
            terms, *counts = _terms_of(part.column("_words"))
            held.append((part.column(key), terms, *[c.astype(np.int32) for c in counts]))
            size += pc.sum(pc.binary_length(part.column("_words"))).as_py() or 0
            if size >= PIECE_PARTS * TEXT_HELD:
                yield _released(piece, number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield _released(piece, number, held)

    def piece(number: int, held: list) -> pa.RecordBatch:
        keys = pa.concat_arrays([h[0] for h in held])
        codes = pa.concat_arrays([h[1] for h in held]).dictionary_encode()
        terms, codes = codes.dictionary, codes.indices.to_numpy()
        first = np.cumsum([0, *[len(h[1]) for h in held]])
        before = np.cumsum([0, *[len(h[0]) for h in held]])
        doc = np.concatenate([h[2] + np.int32(b) for h, b in zip(held, before, strict=False)])
        code = np.concatenate([codes[f + h[3]] for h, f in zip(held, first, strict=False)])
        tf = np.concatenate([h[4] for h in held])
        held.clear()
        hashed = [fnv1a(terms.slice(start, HASHED).to_pandas(), "#sign") for start in range(0, len(terms), HASHED)] or [fnv1a(terms.to_pandas(), "#sign")]
        hashes, more = (np.concatenate(h) for h in zip(*hashed, strict=True))
        order = pc.sort_indices(terms).to_numpy()
        share = ((hashes >> 12) % shares).astype(np.int32)
        order = order[np.argsort(share[order], kind="stable")]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        code = rank[code]
        by = np.argsort(doc * np.int64(max(1, len(order))) + code, kind="stable")
        doc, code, tf = doc[by], code[by], tf[by]
        behind = np.diff(code, prepend=np.int32(0))
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        behind[begins] = code[begins]
        sizes = np.bincount(doc, minlength=len(keys)).astype(np.int32)
        places = slots_of(hashes, more)[order].astype(np.int16)
        counts = [_packed(sizes), _packed(behind), _packed(tf), _packed(places)]
        have = np.bincount(code, minlength=len(order)).astype(np.int32)
        ends = np.searchsorted(share[order], np.arange(shares + 1))
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), terms.take(pa.array(order))), "\n")
        packed = [[_packed(line.as_buffer().to_pybytes(), 6), _packed(have[low:high])] if high > low else None for line, low, high in zip(lines, ends, ends[1:], strict=False)]
        rows = shares // passes
        columns = [pa.array([None, *packed[p * rows:(p + 1) * rows]], pa.list_(pa.binary())) for p in range(passes)]
        held_by = pa.ListArray.from_arrays(pa.array([0, *[len(keys)] * (rows + 1)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([
            pa.array([number] * (rows + 1), pa.int64()), pa.array([None, *range(rows)], pa.int32()), held_by, pa.array([counts, *[None] * rows], pa.list_(pa.binary())), *columns,
        ], ["piece", "row", "keys", "counts", *[f"terms{p}" for p in range(passes)]])

    kind = documents.schema[key].dataType.simpleString()
    columns = "".join(f", terms{p} array<binary>" for p in range(passes))
    return _spaced(documents, key, text).mapInArrow(name, f"piece long, row int, keys array<{kind}>, counts array<binary>{columns}")


def _answered(named: pa.Table) -> pa.Table:
    return _released(_share_answered, named)


def _share_answered(named: pa.Table) -> pa.Table:
    """A share of all terms: a row of its different terms and their document frequencies, and for each piece those of its own terms."""
    share, pieces, data = named.column("share")[0].as_py(), named.column("piece").to_pylist(), named.column("data").to_pylist()
    lists = [_lines(d[0]) for d in data]
    ends = np.cumsum([0, *[len(x) for x in lists]])
    lists = pa.concat_arrays(lists)
    codes = lists.dictionary_encode()
    del lists
    terms, codes = codes.dictionary, codes.indices.to_numpy()
    df = np.bincount(codes, np.concatenate([_unpacked(d[1], np.int32) for d in data]), len(terms)).astype(np.int64)
    order = pc.sort_indices(terms)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(terms)], pa.int64()), terms.take(order)), "\n")[0].as_buffer().to_pybytes()
    rows = [[_packed(joined, 6), _packed(df[order.to_numpy()])], *[[_packed(df[codes[low:high]])] for low, high in zip(ends, ends[1:], strict=False)]]
    return pa.table({"piece": pa.array([None, *pieces], pa.int64()), "share": pa.array([share] * len(rows), pa.int32()), "data": pa.array(rows, pa.list_(pa.binary()))})


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(token, df)`` rows of packed shares."""
    for data in (d for batch in batches for d in batch.column("data").to_pylist()):
        rows = pa.RecordBatch.from_arrays([_lines(data[0]), pa.array(_unpacked(data[1], np.int64))], ["token", "df"])
        yield from _parts(rows, np.ones(len(rows), np.int64), 1 << 16)


def index_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(weights, vectors)`` of a table of documents. Texts are tokenised once; the counts are stored.

    Terms are rows nowhere but in ``weights``. A piece of the texts names each of its terms once;
    the names are shuffled packed, by shares of all terms, and what comes back to a piece is one
    number a term, in the order in which it named them. Vectors are made of a piece's packed counts.
    """
    n, size = documents.select(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    cores = documents.sparkSession.sparkContext.defaultParallelism
    rows = max(cores, -(-(size or 0) // SHARE_TEXT))
    passes = min(PASSES, -(-rows // cores))
    rows = min(-(-rows // passes), (1 << 20) // passes)
    kind = documents.schema[key].dataType.simpleString()
    small_batches(documents.sparkSession, SENT_ROWS)
    with shuffles_freed(documents.sparkSession):
        named = durable(_named_once(documents, key, text, rows * passes, passes))
        answers = None
        for p in range(passes):  # one after another: only the terms of one pass are on disk a second time
            asked = named.filter(F.col(f"terms{p}").isNotNull()).select("piece", (F.col("row") + p * rows).alias("share"), F.col(f"terms{p}").alias("data"))
            answered = durable(asked.repartition(rows, "share").groupBy("share").applyInArrow(_answered, "piece long, share int, data array<binary>"))
            answers = answered if answers is None else answers.unionByName(answered)
    weights = answers.filter("piece is null").select("data").mapInArrow(_frequencies, "token string, df long")
    weights = weights.withColumn("idf", F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1)

    def vectors(rows: pa.Table) -> pa.Table:
        return _released(vectors_of, rows)

    def vectors_of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("share")  # the row without a share stands last
        data = rows.column("data").to_pylist()
        df = np.concatenate([_unpacked(d[0], np.int64) for d in data[:-1]] or [np.empty(0, np.int64)])
        sizes, behind, tf, places = (_unpacked(d, kind) for d, kind in zip(data[-1], (np.int32, np.int32, np.int32, np.int16), strict=True))
        if rows.column("share")[-1].as_py() is not None or len(df) != len(places):
            raise ValueError("terms of a piece without an answer")
        doc = np.repeat(np.arange(len(sizes)), sizes)
        steps = np.cumsum(behind, dtype=np.int64)
        begins = (np.cumsum(sizes) - sizes)[sizes > 0]
        code = steps - np.repeat(steps[begins] - behind[begins], sizes[sizes > 0])
        places = places.astype(np.int64)
        weight = np.where(places < 0, -1.0, 1.0) * (np.log((n + 1) / (df + 1)) + 1)
        slot = np.where(places < 0, -1 - places, places)
        at = doc * WIDTH + slot[code]
        order = np.argsort(at, kind="stable")
        each, first = np.unique(at[order], return_index=True)
        w = np.add.reduceat(((1 + np.log(tf)) * weight[code])[order], first) if len(each) else np.empty(0)
        owner, slot = np.divmod(each, WIDTH)
        norm = np.sqrt(np.bincount(owner, w * w, len(sizes)))
        ends = pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32())
        values = np.divide(w, norm[owner], out=w.copy(), where=norm[owner] > 0)
        return pa.table({
            key: rows.column("keys").combine_chunks()[-1].values, "slots": pa.ListArray.from_arrays(ends, pa.array(slot, pa.int32())),
            "values": pa.ListArray.from_arrays(ends, pa.array(values)), "norm": pa.array(norm),
        })

    counted = named.filter("row is null").select("piece", F.col("row").alias("share"), F.col("counts").alias("data"), "keys")
    back = answers.filter("piece is not null").select("piece", "share", "data", F.lit(None).cast(f"array<{kind}>").alias("keys"))
    made = counted.unionByName(back).groupBy("piece").applyInArrow(vectors, f"{key} {kind}, slots array<int>, values array<double>, norm double")
    return weights, _merged(made, documents.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_k")), key)


def _merged(vectors: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Vectors by key: those of the keys in ``again``, which several rows have, are added up."""
    whole = vectors.filter("norm > 0").select(key, "slots", "values")
    if again.isEmpty():
        return whole
    same = F.col(key).eqNullSafe(F.col("_k"))
    entries = vectors.join(again, same, "left_semi").select(key, "norm", F.explode(F.arrays_zip("slots", "values")).alias("e"))
    added = _unit_length(entries.select(key, F.col("e.slots").alias("slot"), F.when(F.col("norm") > 0, F.col("e.values") * F.col("norm")).otherwise(F.col("e.values")).alias("w")), key)
    return whole.join(again, same, "left_anti").unionByName(added)


def _known(weights: DataFrame, asked: DataFrame) -> DataFrame:
    """``(token, idf)`` of the tokens in ``asked``. A bounded number of these is sent to the tasks, and the weights of all others stay where they are read."""
    tokens = durable(asked.select("token").distinct())
    few = tokens.count() <= SENT_TOKENS
    return durable(weights.select("token", "idf").join(F.broadcast(tokens) if few else tokens, "token", "left_semi"))


def embed_questions(questions: DataFrame, weights: DataFrame, n_documents: Column, key: str = "query_id", text: str = "text") -> DataFrame:
    """Vectors of questions, with the weights of the documents alone; a token no document has is weighted as the rarest."""
    counts = durable(exploded_counts(counted_terms(questions, key, text), key))
    weighted = counts.join(_known(weights, counts), "token", "left").withColumn("idf", F.coalesce("idf", F.ln(n_documents + 1) + 1))
    return _unit_vectors(weighted, key)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; zero when either has no length, an error when widths differ."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.size(a) == F.size(b)
    return F.when(~same, F.raise_error(F.lit("vector widths differ"))).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _matrix(pdf: pd.DataFrame, width: int) -> np.ndarray:
    """Unit rows from a batch of ``embedding`` arrays."""
    if (pdf["embedding"].map(len) != width).any():
        raise ValueError("vector widths differ")
    dense = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    norms = np.linalg.norm(dense, axis=1, keepdims=True)
    return np.divide(dense, norms, out=np.zeros_like(dense), where=norms > 0)


def near(vectors: DataFrame, question: list[float] | Column, ceiling: float, key: str = "doc_id") -> DataFrame:
    """``(key, avstand)`` of the vectors whose cosine distance to one question is below ``ceiling``.

    The question is a list of numbers, or a column such as a scalar subquery.
    """
    if isinstance(question, Column):
        asked = vectors.select(key, "embedding", question.alias("_question"))
        return asked.select(key, (1 - cosine(F.col("embedding"), F.col("_question"))).alias("avstand")).filter(F.col("avstand") < ceiling)
    asked = np.asarray(question, dtype=np.float64)
    asked = asked / (np.linalg.norm(asked) or 1.0)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            distance = 1 - _matrix(pdf, len(asked)) @ asked
            out = pd.DataFrame({key: pdf[key].to_numpy(), "avstand": distance})
            yield out[out["avstand"] < ceiling]

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "embedding").mapInPandas(measure, f"{key} {kind}, avstand double")


def _best_of_batch(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, row) of each query's ``k`` best rows; equal scores go by key."""
    by_key = np.argsort(keys, kind="stable")
    ordered = np.argsort(-scores[:, by_key], axis=1, kind="stable")[:, :k]
    rows = by_key[ordered]
    return np.repeat(np.arange(len(scores)), rows.shape[1]), rows.ravel()


def _best(parts: list[pd.DataFrame], query_key: str, key: str, k: int) -> pd.DataFrame:
    """The ``k`` best rows of each query over several batches."""
    rows = pd.concat(parts).sort_values(["score", key], ascending=[False, True], kind="stable")
    return rows.groupby(query_key, sort=False).head(k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "doc_id",
        digits: int = 6) -> DataFrame:
    """The ``k`` nearest vectors of each query by cosine, exactly: ``(query, key, score, rank)``.

    A product of blocks: both sides are dealt to every pair of a query block and a
    vector block, each of bounded size, and a task multiplies the pair that meets in
    it and answers with at most ``k`` rows per query. Nothing goes through the
    driver but the two counts. Scores are ranked to twelve digits, which keeps the
    order independent of summation order, and shown with ``digits``; ties go by
    key. Both sides may carry a ``model`` column, and then only vectors of one model
    are compared.
    """
    if "slots" in vectors.columns:
        return knn_sparse(queries, vectors, k, query_key, key, digits)
    shape = ["embedding"]
    extra = ["model"] if "model" in vectors.columns else []
    wanted, stored = durable(queries.select(query_key, *extra, *shape)), vectors.select(key, *extra, *shape)
    asked, wide = wanted.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-asked * 8 * (wide or 1) // BLOCK_BYTES))
    parts = max(1, -(-stored.count() * 8 * (wide or 1) // PART_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    ids = ["_q", "_v"]
    left = wanted.withColumns({"_q": F.col(query_key), "_v": F.lit(None).cast(stored.schema[key].dataType), "_block": mine(query_key, blocks)})
    right = stored.withColumns({"_q": F.lit(None).cast(wanted.schema[query_key].dataType), "_v": F.col(key), "_part": mine(key, parts)})
    columns = ["_block", "_part", *ids, *extra, *shape]
    pairs = left.withColumn("_part", every(parts)).select(*columns).unionByName(right.withColumn("_block", every(blocks)).select(*columns))
    kinds = wanted.schema[query_key].dataType.simpleString(), stored.schema[key].dataType.simpleString()

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["_q"].notna()
        questions, rows = pdf[is_query], pdf[~is_query]
        empty = pd.DataFrame({query_key: questions["_q"][:0], key: rows["_v"][:0], "score": np.empty(0)})
        if questions.empty or rows.empty:
            return empty
        wide = len(questions["embedding"].iloc[0])
        matrix, asked = _matrix(questions, wide), questions["_q"].to_numpy()
        step, found = min(max(SCORES_HELD // len(asked), 16), 1024), []
        for start in range(0, len(rows), step):
            part = rows.iloc[start:start + step]
            scores = np.round(matrix @ _matrix(part, wide).T, 12)
            if "model" in part:
                scores[questions["model"].to_numpy()[:, None] != part["model"].to_numpy()[None, :]] = -np.inf
            keys = part["_v"].to_numpy()
            q, r = _best_of_batch(scores, keys, k)
            hits = pd.DataFrame({query_key: asked[q], key: keys[r], "score": scores[q, r]})
            found.append(hits[np.isfinite(hits["score"])])
            if sum(map(len, found)) > max(SCORES_HELD, 4 * k * len(asked)):
                found = [_best(found, query_key, key, k)]
        return _best(found, query_key, key, k)

    hits = pairs.groupBy("_block", "_part").applyInPandas(multiply, f"{query_key} {kinds[0]}, {key} {kinds[1]}, score double")
    return _ranked(hits, query_key, key, k).withColumn("score", F.round("score", digits))


class _Slots:
    """Vectors of one batch as postings by slot, each list with its largest and its least value."""

    def __init__(self, slots: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int):
        order = np.argsort(slots, kind="stable")
        self.n, self.rows, self.values = n, owner[order], values[order]
        self.slots, self.first = np.unique(slots[order], return_index=True)
        self.ends = np.append(self.first[1:], len(order))
        self.most = np.maximum.reduceat(self.values, self.first) if len(order) else self.values
        self.least = np.minimum.reduceat(self.values, self.first) if len(order) else self.values

    def scores(self, slots: np.ndarray, values: np.ndarray, needed: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may score ``needed`` or more against one question, and their scores.

        Lists are added from the one that can matter most on, until those left cannot
        lift a new row to ``needed``; after that only rows that still can are looked up.
        """
        at = np.searchsorted(self.slots, slots)
        known = at < len(self.slots)
        known[known] = self.slots[at[known]] == slots[known]
        at, values = at[known], values[known]
        reach = np.maximum(np.maximum(values * self.most[at], values * self.least[at]), 0.0)
        order = np.argsort(-reach, kind="stable")
        at, values = at[order], values[order]
        left = np.append(np.cumsum(reach[order][::-1])[::-1], 0.0) + 1e-9
        sums, done = np.zeros(self.n), 0
        while done < len(at) and left[done] >= needed:
            s = slice(self.first[at[done]], self.ends[at[done]])
            sums[self.rows[s]] += values[done] * self.values[s]
            done += 1
        rows = np.flatnonzero(sums + left[done] >= needed)
        found = sums[rows]
        for i in range(done, len(at)):
            alive = found + left[i] >= needed
            rows, found = rows[alive], found[alive]
            if not len(rows):
                break
            low, high = self.first[at[i]], self.ends[at[i]]
            where = np.minimum(low + np.searchsorted(self.rows[low:high], rows), high - 1)
            found = found + np.where(self.rows[where] == rows, values[i] * self.values[where], 0.0)
        return rows, found


def knn_sparse(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "doc_id",
               digits: int = 6, entries: int = QUESTION_ENTRIES) -> DataFrame:
    """:func:`knn` of ``(slots, values)`` vectors of unit length, through postings by slot.

    Vectors stay where they are read: a task turns a batch of them into postings and
    looks up the questions, skipping what cannot reach a question's ``k``-th score so
    far. It returns at most ``k`` rows a question. Questions are sent to the tasks in
    blocks of about ``entries`` entries; further blocks read the vectors again.
    """
    extra = ["model"] if "model" in vectors.columns else []
    wanted = durable(queries.select(query_key, *extra, "slots", "values"))
    size = wanted.agg(F.sum(F.size("slots"))).first()[0] or 0
    blocks = max(1, -(-size // entries))
    kinds = wanted.schema[query_key].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    schema = f"{query_key} {kinds[0]}, {key} {kinds[1]}, score double"
    found = None
    for block in range(blocks):
        asked = wanted.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == block).toArrow()
        names, slots, values = asked.column(query_key), _flat(asked.column("slots")), _flat(asked.column("values"))
        ends = np.concatenate([[0], np.cumsum(asked.column("slots").combine_chunks().value_lengths().to_numpy())]) if len(asked) else np.zeros(1, int)
        models = asked.column("model").to_pylist() if extra else [None] * len(asked)

        def search(batches, names=names, slots=slots, values=values, ends=ends, models=models):
            best_keys: list = [None] * len(names)
            best = [np.empty(0)] * len(names)
            for batch in (part for whole in batches for part in _parts(whole, whole.column("slots").value_lengths().to_numpy(), ENTRIES_HELD)):
                rows = pa.Table.from_batches([batch])
                for model in set(models):
                    part = rows.filter(pc.equal(rows.column("model"), model)) if extra else rows
                    if not len(part):
                        continue
                    lists = part.column("slots").combine_chunks()
                    owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                    held = _Slots(_flat(part.column("slots")), _flat(part.column("values")), owner, len(part))
                    keys = part.column(key)
                    for q in range(len(names)):
                        if models[q] != model:
                            continue
                        needed = best[q][-1] - 1e-9 if len(best[q]) == k else -np.inf
                        at, scores = held.scores(slots[ends[q]:ends[q + 1]], values[ends[q]:ends[q + 1]], needed)
                        if not len(at):
                            continue
                        scores = np.round(scores, 12)
                        if len(at) > k:  # all that tie with the k-th are ordered by key
                            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                            at, scores = at[scores >= edge], scores[scores >= edge]
                        near = keys.take(pa.array(at)).to_pylist()
                        both = sorted(zip([*(-best[q]).tolist(), *(-scores).tolist()], [*(best_keys[q] or []), *near], strict=True))[:k]
                        best[q], best_keys[q] = -np.array([b[0] for b in both]), [b[1] for b in both]
            counts = [len(b) for b in best]
            hits = [x for b in best_keys for x in (b or [])]
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(np.repeat(np.arange(len(names)), counts))).combine_chunks(), pa.array(hits, batch_type), pa.array(np.concatenate([*best, np.empty(0)])),
            ], [query_key, key, "score"])

        batch_type = to_arrow_type(vectors.schema[key].dataType)
        hits = vectors.select(key, *extra, "slots", "values").mapInArrow(search, schema)
        found = hits if found is None else found.unionByName(hits)
    return _ranked(found, query_key, key, k).withColumn("score", F.round("score", digits) + F.lit(0.0))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy()


def _ranked(hits: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    return top_per_key(hits, [query_key], [F.desc("score"), F.asc(key)], k, rank="rank")


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "doc_id",
               tables: int = 8, length: float = 0.9, seed: int = 7) -> DataFrame:
    """Near neighbours through random projections: candidates share a bucket and are ranked exactly.

    Keys meet in their buckets by an equi-join, which adaptive execution splits
    when a bucket is hot; vectors are fetched for the candidates alone, and all
    candidates are scored. What it misses is measured with :func:`recall`.
    """
    unit_length = Normalizer(inputCol="_raw", outputCol="_unit")

    def unit(df: DataFrame, name: str) -> DataFrame:
        return unit_length.transform(df.select(name, array_to_vector(F.col("embedding").cast("array<double>")).alias("_raw")))

    points, asked = unit(vectors, key), unit(queries, query_key)
    lsh = BucketedRandomProjectionLSH(inputCol="_unit", outputCol="_h", numHashTables=tables, bucketLength=length, seed=seed)
    model = lsh.fit(points)
    buckets = F.array(*[vector_to_array(F.col("_h")[i])[0].cast("long") for i in range(tables)])

    def bucketed(df: DataFrame, name: str) -> DataFrame:
        return model.transform(df).select(name, F.posexplode(buckets).alias("_table", "_bucket"))

    pairs = bucketed(points, key).join(bucketed(asked, query_key), ["_table", "_bucket"]).select(query_key, key).distinct()
    with_vectors = pairs.join(points.select(key, vector_to_array("_unit").alias("_v")), key)
    both = with_vectors.join(asked.select(query_key, vector_to_array("_unit").alias("_q")), query_key)
    score = F.round(F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p), 6)
    return _ranked(both.select(query_key, key, score.alias("score")), query_key, key, k)


def relevance(ranked: DataFrame, floor: float, relative: float = RELATIVE_FLOOR, query_key: str = "query_id") -> DataFrame:
    """Marks hits good enough to use: at least ``floor`` and ``relative`` times the query's best.

    A query has at most the ``k`` hits it was ranked with.
    """
    best = F.max("score").over(Window.partitionBy(query_key))
    cut = ranked.withColumn("grense", F.greatest(F.lit(floor), F.lit(relative) * best))
    return cut.withColumn("beholdt", F.col("score") >= F.col("grense"))


def within_distance(ranked: DataFrame, ceiling: float) -> DataFrame:
    """Hits closer than the model's distance ceiling, with their similarity as shown."""
    return ranked.filter(1 - F.col("score") < ceiling).withColumn("likhet", F.round("score", 3))


def extractive_answers(questions: DataFrame, passages: DataFrame, weights: DataFrame, n_documents: Column, k: int = 3,
                       query_key: str = "query_id", passage_key: str = "rank", headed: bool = False) -> DataFrame:
    """The ``k`` sentences of each question's passages that overlap it most, quoted with their marker.

    ``headed`` passages, as :func:`chunk` makes them, begin with a heading line,
    which is no sentence to quote.

    ``questions`` has the question's ``text``; ``passages`` one row per question
    and passage, with its ``text``. A sentence scores the weights of the words
    it shares with the question over the square root of its length.
    """
    asked = _each(questions, F.array_distinct(T.tokens(F.col("text"))), "token", query_key)
    unseen = F.ln(n_documents + 1) + 1
    asked = asked.join(_known(weights, asked), "token", "left").withColumn("idf", F.coalesce("idf", unseen))
    quoted = passages.select(query_key, passage_key, F.posexplode(T.sentences(F.regexp_replace("text", r"^[^\n]*\n\n", "") if headed else F.col("text"))).alias("nr", "setning"))
    place = [query_key, passage_key, "nr"]
    found = _each(quoted, T.tokens(F.col("setning")), "token", *place, "setning").groupBy(*place, "setning", "token")
    counted = found.agg(F.count(F.lit(1)).alias("_tf"))
    overlap = counted.join(asked, [query_key, "token"], "left").groupBy(*place, "setning")
    scored = overlap.agg(F.round(F.sum("idf") / F.sqrt(F.sum("_tf")), 6).alias("score")).filter("score is not null")
    order = [F.desc("score"), F.asc(passage_key), F.asc("nr")]
    top = top_per_key(scored, [query_key], order, k, rank="plass")
    line = F.concat(F.trim(F.regexp_replace("setning", r"\s+", " ")), F.lit(" [S"), F.col(passage_key).cast("string"), F.lit("]"))
    return top.withColumn("linje", line)


def assemble_context(kept: DataFrame, query_key: str = "query_id") -> DataFrame:
    """One context per question: its kept passages in rank order, numbered ``[S1]``, ``[S2]``, …

    ``kept`` has ``rank``, ``source``, ``overskrift`` and ``text``; a question
    keeps only as many passages as its search asked for.
    """
    block = F.concat(
        F.lit("[S"), F.col("rank").cast("string"), F.lit("] ("),
        F.concat_ws(" > ", "source", "overskrift"), F.lit(")\n"), F.col("text"),
    )
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda e: e["b"])
    return kept.groupBy(query_key).agg(F.array_join(blocks, "\n\n").alias("kontekst"))


def evaluate(ranked: DataFrame, expected: DataFrame, k: int = 3, query_key: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Top-1 and recall at ``k`` over a golden set of ``(query, key)`` rows."""
    found = ranked.filter(F.col("rank") <= k).select(query_key, key, "rank")
    best = expected.join(found, [query_key, key], "left").groupBy(query_key).agg(F.min("rank").alias("rank"))
    n = F.count(F.lit(1))
    return best.agg(
        n.alias("spoersmaal"),
        (F.count_if(F.col("rank") == 1) / n).alias("topp1"),
        (F.count("rank") / n).alias("gjenfinning"),
    )


def recall(approximate: DataFrame, exact: DataFrame, query_key: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Share of the exact neighbours the approximate search found."""
    found = approximate.select(query_key, key, F.lit(1).alias("_found"))
    return exact.join(found, [query_key, key], "left").agg((F.count("_found") / F.count(F.lit(1))).alias("recall"))


# What models that were trained with task marks want ahead of a stored text and of a question.
TASK_PREFIXES = {"nomic-embed-text": ("search_document: ", "search_query: ")}


def _prefixes(model: str) -> tuple[str, str]:
    """A model's marks, whatever tag follows its name; none for models without them."""
    return TASK_PREFIXES.get(model.partition(":")[0], ("", ""))


def embed_question(embed, question: str, model: str) -> list[float]:
    """The vector of one question, marked as its model wants questions; see :func:`embed_texts`."""
    (_, vector), = embed([_prefixes(model)[1] + question])
    return vector


def embed_texts(rows: DataFrame, embed, key: str, model: str, text: str = "tekst", batch: int = 256) -> DataFrame:
    """Vectors from a batch embedder, a picklable ``embed(list of texts) -> list of (index, vector)``.

    Texts are marked as their model wants stored texts. Replies are put back in the order of the texts, whatever order they come in.
    """
    kind, mark = rows.schema[key].dataType.simpleString(), _prefixes(model)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                replies = sorted(embed([mark + t for t in part[text]]), key=lambda reply: reply[0])
                if len(replies) != len(part):
                    raise ValueError(f"{len(replies)} vectors for {len(part)} texts")
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [vector for _, vector in replies]})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
