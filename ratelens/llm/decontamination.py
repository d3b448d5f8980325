"""Operator 2: find benchmark passages in training documents, exact, edited or paraphrased.

Words are runs without white space and ASCII punctuation, A-Z as a-z. Sequences are 3 words in a row, and 3 words of which the
third is left out before the last (so that a copy with every third word replaced still holds some). The seeds of a test item are the
rarest of its sequences that the corpus holds, by the number of documents that hold them: a share of each item's own sequences, so an
item that leaked into every third document keeps its seeds. Documents that hold a seed are joined to the item, and the
Smith-Waterman alignment of the item with the text around its seeds scores the copy. The benchmark is the stated query set: it
goes through the corpus in blocks of bounded size, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ratelens.llm import text
from ratelens.llm.common import small, written

GRAM, RARE_SHARE = 3, 0.75
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Characters of benchmark text that go through the corpus at once.
BLOCK_CHARS = 4 << 20


def sequences(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and first words of all sequences, those in a row before the spaced ones. Rows of fewer words than GRAM have
    their whole sequence."""
    g, r, start = text.shingles(h, row, rows, GRAM)
    at = np.arange(max(len(h) - GRAM, 0))
    at = at[row[at] == row[at + GRAM]]
    spaced = text.mix(text.mix(h[at], 21) + text.mix(h[at + 1], 22) + text.mix(h[at + GRAM], 23), 24)
    return np.concatenate([g, spaced]), np.concatenate([r, row[at]]), np.concatenate([start, at])


@dataclass(frozen=True)
class Items:
    ids: list
    words: list[np.ndarray]  # word hashes of each item
    grams: np.ndarray  # sorted distinct sequence hashes
    gram: np.ndarray  # for each place of a sequence in an item, by sequence: its index in grams
    item: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(rows: list) -> Items:
        data, at = text.utf8(pa.array([r["text"] for r in rows], pa.string()))
        h, row, _, _ = text.words(data, at, 0, len(rows), text.LOOSE)
        g, item, start = sequences(h, row, len(rows))
        size = np.bincount(row, minlength=len(rows))
        whole = size[item] >= GRAM  # items of fewer words can't be told from chance
        g, item, start = g[whole], item[whole], start[whole]
        grams, gram = np.unique(g, return_inverse=True)
        order = np.argsort(gram, kind="stable")
        first = np.cumsum(size) - size
        return Items([r["id"] for r in rows], np.split(h, np.cumsum(size)[:-1]), grams, gram[order], item[order],
                     (start - first[item])[order])

    def rarest(self, documents: np.ndarray) -> Items:
        """With the places of each item's rarest sequences only, of those that some document holds (``documents``: how many hold
        each of ``grams``)."""
        held = np.flatnonzero(documents[self.gram] > 0)
        order = held[np.lexsort((self.grams[self.gram[held]], documents[self.gram[held]], self.item[held]))]
        size = np.bincount(self.item[held], minlength=len(self.ids))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        kept = np.sort(order[rank < np.ceil(RARE_SHARE * size)[self.item[order]]])
        return Items(self.ids, self.words, self.grams, self.gram[kept], self.item[kept], self.offset[kept])


class _Finder:
    """Places of sequences in texts: a table of low bits lets most words pass before the search."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(self.bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        x = np.minimum(np.searchsorted(self.grams, g[near]), len(self.grams) - 1)
        hit = self.grams[x] == g[near]
        return near[hit], x[hit]


def _counted(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = _Finder(items.grams), np.zeros(len(items.grams), np.int64)
        for batch in text.returned(batches):
            data, at = text.utf8(batch.column(0))
            for i, j in text.chunks(at):
                h, row, _, _ = text.words(data, at, i, j, text.LOOSE)
                g, r, _ = sequences(h, row, j - i)
                place, x = find(g)
                both = np.unique(r[place] * len(total) + x)
                total += np.bincount(both % len(total), minlength=len(total))
        x = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(total[x])], ["gram", "n"])
    return run


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of word hashes: best score, and the first and end word of the window it aligns."""
    n = len(window)
    h, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = -GAP * np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        step = np.where(window == w, MATCH, MISMATCH)
        up, diagonal = h + GAP, np.concatenate([[0], h[:-1] + step])
        t = np.maximum(np.maximum(up, diagonal), 0)
        source = np.where(t == 0, np.arange(n + 1), np.where(diagonal >= up, np.concatenate([[0], begin[:-1]]), begin))
        lifted = np.maximum.accumulate(t + ramp)
        last = np.maximum.accumulate(np.where(t + ramp == lifted, np.arange(n + 1), 0))
        h, begin = lifted - ramp, source[last]
        top = int(h.argmax())
        if h[top] > best[0]:
            best = (int(h[top]), int(begin[top]), top)
    return best


def _scored(items: Items, id_type: pa.DataType, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(items.grams)
        first_place = np.searchsorted(items.gram, np.arange(len(items.grams) + 1))
        length = np.array([len(w) for w in items.words])
        for batch in text.returned(batches):
            data, at = text.utf8(batch.column(1))
            out = []
            for i, j in text.chunks(at):
                h, row, first, end = text.words(data, at, i, j, text.LOOSE)
                g, r, start = sequences(h, row, j - i)
                place, x = find(g)
                count = first_place[x + 1] - first_place[x]
                hit = np.repeat(np.arange(len(place)), count)  # every item a sequence stands in
                index = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + first_place[x][hit]
                item, own = items.item[index], r[place][hit]
                begin = start[place][hit] - items.offset[index]
                slack = length[item] // 2 + 2
                low, high = begin - slack, begin + length[item] + slack
                order = np.lexsort((low, item, own))
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                k = 0
                while k < len(order):  # windows of one row and item that overlap are one
                    a = order[k]
                    left, right = low[a], high[a]
                    k += 1
                    while k < len(order) and own[order[k]] == own[a] and item[order[k]] == item[a] and low[order[k]] <= right:
                        right = max(right, high[order[k]])
                        k += 1
                    left, right = max(left, bounds[own[a]]), min(right, bounds[own[a] + 1])
                    score, x0, x1 = align(items.words[item[a]], h[left:right])
                    if score >= threshold * MATCH * length[item[a]]:
                        span = bytes(data[first[left + x0]:end[left + x1 - 1]])
                        out.append((i + own[a], int(item[a]), score / (MATCH * length[item[a]]),
                                    int(left + x0 - bounds[own[a]]), int(x1 - x0), span.decode("utf8", "replace")))
            best = {}
            for x in out:
                if (x[0], x[1]) not in best or x[2] > best[x[0], x[1]][2]:
                    best[x[0], x[1]] = x
            found = [best[x] for x in sorted(best)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())),
                 pa.array([items.ids[x[1]] for x in found], id_type), pa.array([x[2] for x in found], pa.float64()),
                 pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64()),
                 pa.array([x[5] for x in found], pa.string())],
                ["doc_id", "item_id", "score", "first_word", "n_words", "passage"])
    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, score, first_word, n_words, passage)`` for each document row and test item whose best
    alignment scores at least ``threshold`` of the item's own (a word that matches gives 2; one that is replaced,
    inserted or left out costs 1).

    ``first_word`` counts words from 0, ``passage`` is the aligned part of the text. Null or empty texts and items match
    nothing, nor do items of fewer than 3 words. Items with equal texts match alike. Rows that repeat an id are
    documents of their own; a null id is returned as null. Of several copies in a document the best (then first) is given.
    Other columns are ignored. No rows on either side, no rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = benchmark.schema[item_col].dataType
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("item_id", kind),
                         StructField("score", DoubleType()), StructField("first_word", LongType()),
                         StructField("n_words", LongType()), StructField("passage", StringType())])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    queries = benchmark.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    for items in _blocks(queries):  # one at a time: its matches are written before the next is read
        if not len(items.grams):
            continue
        held = texts.select("text").mapInArrow(_counted(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        documents = np.zeros(len(items.grams), np.int64)
        for r in held.collect():  # a row a sequence of the block at most
            documents[r["gram"]] = r["n"]
        matches = texts.mapInArrow(_scored(items.rarest(documents), to_arrow_type(kind), threshold), schema)
        found = found.union(written(matches, "matches"))
    return found


def _blocks(queries: DataFrame) -> Iterator[Items]:
    """The items in blocks of at most BLOCK_CHARS (or one longer item)."""
    block, size = [], 0
    for r in queries.toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_CHARS:
            yield Items.of(block)
            block, size = [], 0
        block, size = [*block, r], size + len(r["text"])
    if block:
        yield Items.of(block)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold a test item. A row is told by its id and text, so a null id that holds an item goes, and
    other texts under the id of a row that holds one stay."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    leaked = benchmark_matches(keyed, benchmark, "key", "text", threshold=threshold)
    leaked = written(leaked.select(F.col("doc_id.id").alias("_leaked_id"), F.col("doc_id.hash").alias("_leaked_hash")).distinct(), "leaked")
    leaked = small(leaked, 24)
    same = docs[id_col].eqNullSafe(leaked["_leaked_id"]) & (F.xxhash64(docs[text_col]) == leaked["_leaked_hash"])
    return docs.join(leaked, same, "left_anti").select(docs.columns)
