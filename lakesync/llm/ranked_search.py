"""Ranked lexical search by NRA: impact-sorted posting lists read in order, score intervals, no look-ups.

Documents are tokenised once and written as narrow rows (row, doc_id, length, query terms with counts).  Their totals give
every term's weight.  Blocks of documents then answer all queries side by side: a block keeps one list of postings for each
term, sorted by what a posting adds to a score, and reads the lists of a query from the top in rounds of falling impact.  A
document that has been met has a lower bound (what was read) and an upper bound (that, and for every list where it was not met
the highest impact still unread).  Reading goes on until no unmet document and none with a lower upper bound can reach the first
``top`` lower bounds, ties included, and until the bounds of those that can have met, so that scores are exact.  A block's first
``top`` of each query hold every document that is among the first of all; Spark ranks them together.

Queries are taken in portions of at most ``PORTION_TERMS`` terms, which bounds what is broadcast; every portion reads all
documents.  Scores are whole numbers, so no order of summing changes them.

Defined results: null and empty texts have no terms and are not counted; a query without known terms has no rows; equal scores
are ranked by doc_id, null ids last, rows of one id in table order; every row of a repeated item or document is one by itself; an
empty table gives an empty result; a very long text is read whole; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesync.llm.common import materialise, text_or_empty

TOP = 10
#: Parts in a thousand: the weight of a count, of a document's length, and the scale of scores.
SCALE, LENGTH_PERCENT, GROWTH = 1_000_000_000, 90, 8
PORTION_TERMS = 1 << 17
#: Postings that a block of documents may hold in memory at once.
BLOCK_POSTINGS = 2 << 20
ROWS_BELOW = 33  # bits of a row number that count within a task

_TABLE = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalnum() else 32 if i < 128 else i for i in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_TABLE).split()


def _poster(known):
    """For mapInArrow over (row, doc_id, text as bytes): (row, doc_id, n, terms, tfs) of the documents with a term."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            kept, lengths, offsets, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column(2)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                found = [(number[w], counts[w]) for w in counts.keys() & number.keys()]
                kept.append(i)
                lengths.append(len(words))
                terms.extend(t for t, _ in found)
                tfs.extend(c for _, c in found)
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lengths, pa.int64()), *lists],
                                             ["row", "doc_id", "n", "terms", "tfs"])

    return post


class _Lists:
    """Postings of a block of documents: for every term, places of documents and impacts, highest impact first."""

    def __init__(self, place: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((place, -impact, term))
        self.place, self.falling = place[order], -impact[order]
        terms, begin = np.unique(term[order], return_index=True)
        self.of = {int(t): (int(b), int(e)) for t, b, e in zip(terms, begin, [*begin[1:], len(order)], strict=True)}

    def get(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Places and negated impacts, which rise."""
        at = self.of.get(term)
        return at and (self.place[slice(*at)], self.falling[slice(*at)])


def search_block(lists: _Lists, query: list[int], documents: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of every document whose score is among the ``top`` highest, ties included.

    One round reads every list down to the round's impact, half of that of the round before.
    """
    open_lists = [found for t in query if (found := lists.get(t)) is not None]
    if not open_lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower, missing, met = np.zeros(documents, np.int64), np.zeros(documents, np.int64), np.zeros(documents, bool)
    read = [0] * len(open_lists)
    depth = max(-int(falling[0]) for _, falling in open_lists)
    candidates, admitting = np.zeros(0, np.int64), True
    while True:
        depth //= 2
        unread = []  # the highest impact that each list still holds
        for k, (place, falling) in enumerate(open_lists):
            end = int(np.searchsorted(falling, -depth, side="right")) if depth else len(falling)
            fresh = slice(read[k], end)
            read[k] = end
            unread.append(-int(falling[end]) if end < len(falling) else 0)
            lower[place[fresh]] -= falling[fresh]
            if admitting:
                met[place[fresh]] = True
        if admitting:
            candidates = np.flatnonzero(met)
        bound = sum(unread)
        missing[candidates] = bound
        for k, (place, _) in enumerate(open_lists):
            if unread[k]:
                missing[place[:read[k]]] -= unread[k]
        enough = len(candidates) >= top
        least = int(np.partition(lower[candidates], -top)[-top]) if enough else 0
        if admitting and (bound == 0 or (enough and bound < least)):
            admitting = False  # a document not met so far cannot even tie
        if enough:
            candidates = candidates[lower[candidates] + missing[candidates] >= least]
        if not admitting and not missing[candidates].any():
            return candidates, lower[candidates]


def _searcher(queries, weights, total_rows: int, total_terms: int, top: int):
    """For mapInArrow over postings rows: (query, row, doc_id, score), for each block and query the first ``top``."""
    def block_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        sizes = np.diff(batch.column(3).offsets.to_numpy())
        term, tf = batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy().astype(np.int64)
        place = np.repeat(np.arange(len(n)), sizes)
        length = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * total_rows) // total_terms
        impact = weights.value[term] * ((SCALE * tf) // (1000 * tf + GROWTH * length[place]))
        useful = impact > 0
        lists = _Lists(place[useful], term[useful], impact[useful])
        ids = batch.column(1)
        id_order = np.where(ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy(), np.iinfo(np.int64).max)
        out = []
        for q, query in enumerate(queries.value):
            places, scores = search_block(lists, query, len(n), top)
            first = np.lexsort((row[places], id_order[places], -scores))[:top]
            out.append((np.full(len(first), q), places[first], scores[first]))
        q, places, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(row[places]), ids.take(pa.array(places)), pa.array(scores)],
                                         ["query", "row", "doc_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(3).flatten()) + len(batch)
            if size >= BLOCK_POSTINGS:
                yield from block_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
        if sum(len(b) for b in held):
            yield from block_of(pa.Table.from_batches([b for b in held if len(b)]).combine_chunks().to_batches()[0])

    return search


def _portions(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The queries, row by row over the driver, in lists of at most PORTION_TERMS terms (or of one longer query)."""
    held, size = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        if held and size + len(terms) > PORTION_TERMS:
            yield held
            held, size = [], 0
        held.append((row["item_id"], terms))
        size += len(terms)
    if held:
        yield held


def _search_portion(docs: DataFrame, portion: list[tuple[object, list[bytes]]], item_type: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    number = {t: k for k, t in enumerate(sorted({t for _, terms in portion for t in terms}))}
    known = spark.sparkContext.broadcast(number)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    posted = materialise(numbered.mapInArrow(_poster(known), "row long, doc_id long, n long, terms array<int>, tfs array<int>"), "search-postings")
    totals = posted.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weights = np.zeros(max(len(number), 1), np.int64)
    # One row for each term of the portion.
    for row in posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        weights[row["term"]] = math.floor(1000 * math.log((2 * totals["rows"] + 2) / (2 * row["df"] + 1)))
    queries = spark.sparkContext.broadcast([[number[t] for t in terms] for _, terms in portion])
    search = _searcher(queries, spark.sparkContext.broadcast(weights), totals["rows"], totals["terms"], top)
    found = posted.mapInArrow(search, "query long, row long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    items = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(portion)], f"query long, item_id {item_type}")
    return ranked.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")  # items of one portion


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for every item the ``top`` documents with the highest scores above 0."""
    item_type = items.schema["item_id"].dataType.simpleString()
    found = None
    for portion in _portions(items):
        part = materialise(_search_portion(docs, portion, item_type, top), "search-results")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    return found


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL13 = r"""
    WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                                             lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts FROM documents),
    q AS (SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                                             lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS term FROM benchmark),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS all_terms FROM d WHERE len(ts) > 0),
    t AS (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
    f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, n, term),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
    c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // all_terms))))::BIGINT AS score
          FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
    FROM c WHERE score > 0 QUALIFY rank <= 10
"""
