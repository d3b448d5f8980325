"""Operator 8: secret scanning with a random forest that removes false findings.

Candidates are runs of 16 or more token characters, whole values of any length that are assigned to a secret's name, and
passwords of user:password@host. A finding's features are its length and character classes, the mean
log-probability of its character transitions and the share that dictionary words cover (transitions and dictionary are counted
over the whole corpus), marks of paths, and its neighbouring words. A random forest learns from labelled findings and
scores all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm import text
from ratelens.llm.common import written

LEAST_CHARS = 16
#: Words that announce a secret, and beginnings that only keys of well-known services have (fixed values).
NAMES = ("api", "apikey", "auth", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
SERVICE = re.compile(rb"(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|xox[abp]-|AIza|eyJ)")
UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
#: Bounds: words of the dictionary (3 to 6 letters), labelled findings of each kind, trees.
DICTIONARY, FINDINGS, TREES, DEPTH = 50_000, 5_000, 40, 8
SIZES = range(3, 7)
CONTEXT = 48
FEATURES = ("n", "digits", "uppers", "lowers", "others", "distinct", "entropy", "transitions", "worst", "covered", "slashes",
            "dots_before", "scheme", "uuid", "service", "named", "assigned", "quoted", "name_before", "words_before",
            "words_after", "login")
#: The value, quoted or up to white space, that = or : assigns to a name.
ASSIGNED = re.compile(rb"(?i)(?<![a-z])(?:" + "|".join(NAMES).encode() + rb""")(?=["'`]?[ \t]*(?::=|=+>?|:)[ \t]*(?:"""
                      rb""""((?:[^"\\\r\n]|\\.)+)"|'((?:[^'\\\r\n]|\\.)+)'|`([^`\r\n]+)`|["'`]?([^\s"'`]\S*)))""")
#: What may hold user:password@host.
PART = re.compile(rb"[^\s\"'`<>/]+")
_TOKEN = np.ones(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte transitions (kind 0, key 256 a + b) and of words of SIZES letters (kind 1, key their hash)."""
    steps, words, times = np.zeros(1 << 16, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(words), np.int32)), pa.array(words.view(np.int64)),
                                           pa.array(times)], ["kind", "key", "n"])

    for batch in batches:
        data, at = text.utf8(batch.column(0))
        for i, j in text.chunks(at):
            b = data[int(at[i]):int(at[j])].astype(np.int64)
            if len(b) > 1:
                steps += np.bincount(b[:-1] * 256 + b[1:], minlength=1 << 16)
            h, _, first, end = text.words(data, at, i, j, ~_LETTER)
            size = end - first
            h = h[(size >= SIZES[0]) & (size <= SIZES[-1])]
            words, place = np.unique(np.concatenate([words, h]), return_inverse=True)
            times = np.bincount(place, np.concatenate([times, np.ones(len(h), np.int64)]), len(words)).astype(np.int64)
            if len(words) > 200_000:
                yield flushed()
                words, times = words[:0], times[:0]
    yield flushed()
    x = np.flatnonzero(steps)
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(x), pa.array(steps[x])], ["kind", "key", "n"])


def corpus_statistics(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of byte transitions, and sorted hashes of the DICTIONARY most frequent short words, of all texts."""
    counts = docs.select(text_col).mapInArrow(_counts, "kind int, key long, n long").groupBy("kind", "key").agg(
        F.sum("n").alias("n"))
    counts = written(counts, "secret-counts")
    steps = np.ones((256, 256))
    for r in counts.where("kind = 0").collect():  # 65,536 rows at most
        steps[r["key"] >> 8, r["key"] & 255] += r["n"]
    words = counts.where("kind = 1 and n > 2").orderBy(F.col("n").desc(), "key").limit(DICTIONARY).collect()
    known = np.sort(np.array([r["key"] for r in words], np.int64).view(np.uint64))
    return np.log(steps / steps.sum(1, keepdims=True)), known


def _covered(token: bytes, known: np.ndarray) -> float:
    """Share of the token that dictionary words cover, the longest first from the left."""
    if not len(known):
        return 0.0
    held = {}
    data = np.frombuffer(token, np.uint8)
    for size in SIZES:
        starts = np.arange(len(token) - size + 1)
        if not len(starts):
            break
        grid = np.concatenate([np.append(data[s:s + size], 32) for s in starts])
        at = np.array([0, len(grid)], np.int64)
        h, _, first, end = text.words(grid.astype(np.uint8), at, 0, 1, ~_LETTER)
        whole = end - first == size
        x = np.minimum(np.searchsorted(known, h[whole]), len(known) - 1)
        held[size] = set((first[whole][known[x] == h[whole]] // (size + 1)).tolist())
    place = covered = 0
    while place < len(token):
        size = next((s for s in reversed(SIZES) if place in held.get(s, ())), 0)
        covered += size
        place += max(size, 1)
    return covered / len(token)


def _values(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """Begin and end of the values assigned to a secret's name, and (True) of the passwords of addresses."""
    for m in ASSIGNED.finditer(data):
        yield *m.span(m.lastindex), False
    if b"@" in data:
        for m in PART.finditer(data):
            part = m.group()
            colon, end = part.find(b":"), part.rfind(b"@")
            user = colon > 0 or colon == 0 and data[max(m.start() - 3, 0):m.start()] == b"://"
            if user and colon + 1 < end < len(part) - 1:
                yield m.start() + colon + 1, m.start() + end, True


def _described(token: bytes, before: bytes, after: bytes, login: bool, steps: np.ndarray, known: np.ndarray) -> list[float]:
    n = len(token)
    c = np.bincount(np.frombuffer(token, np.uint8), minlength=256)
    p = c[c > 0] / n
    b = np.frombuffer(token, np.uint8)
    moves = steps[b[:-1], b[1:]]
    words = re.findall(rb"[a-z]+", before.lower())
    named = bool(words) and words[-1].decode() in NAMES
    return [n, c[48:58].sum() / n, c[65:91].sum() / n, c[97:123].sum() / n, 1 - (c[48:58].sum() + c[65:91].sum() + c[97:123].sum()) / n,
            (c > 0).sum() / n, float(-(p * np.log2(p)).sum()), float(moves.mean()) if n > 1 else 0.0, float(moves.min()) if n > 1 else 0.0, _covered(token, known),
            token.count(b"/"), before[-8:].count(b"."), float(b"://" in before[-24:]), float(bool(UUID.match(token))),
            float(bool(SERVICE.match(token))), float(named), float(bool(re.search(rb"[=:]\s*[\"']?$", before))),
            float(before[-1:] in (b'"', b"'", b"`") and after[:1] == before[-1:]),
            float(any(w.decode() in NAMES for w in words[-4:])), len(words),
            len(re.findall(rb"[a-z]+", after.lower())), float(login)]


def _found(steps: np.ndarray, known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text.utf8(batch.column(1))
            for i, j in text.chunks(at):
                _, row, first, end = text.words(data, at, i, j, _TOKEN)
                long = end - first >= LEAST_CHARS
                rows, tokens, starts, described = [], [], [], []
                spans = {(r, a, z): False for r, a, z in zip(row[long].tolist(), first[long].tolist(), end[long].tolist())}
                for r in range(j - i):
                    begin = int(at[i + r])
                    for a, z, login in _values(bytes(data[begin:int(at[i + r + 1])])):
                        spans[r, begin + a, begin + z] = spans.get((r, begin + a, begin + z), False) or login
                last, chars = int(at[i]), 0  # the place so far, and its code points from its row's start
                for (r, a, z), login in sorted(spans.items()):
                    token = bytes(data[a:z])
                    if last <= int(at[i + r]):
                        last, chars = int(at[i + r]), 0
                    chars += len(bytes(data[last:a]).decode("utf8"))
                    last = a
                    lead = bytes(data[max(int(at[i + r]), a - CONTEXT):a])
                    rows.append(i + r)
                    tokens.append(token.decode("utf8"))
                    starts.append(chars)
                    described.append(_described(token, lead, bytes(data[z:min(z + CONTEXT, int(at[i + r + 1]))]),
                                                login, steps, known))
                columns = np.array(described, float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(tokens, pa.string()),
                     *[pa.array(columns[:, k]) for k in range(len(FEATURES))]], ["doc_id", "start", "token", *FEATURES])
    return run


def findings(docs: DataFrame, statistics: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(doc_id, start, token, features...)`` of every candidate; ``start`` counts code points from 0. Null and empty
    texts have none; rows that repeat an id each give theirs; a null id is returned as null."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        _found(*statistics), f"doc_id {kind}, start long, token string, " + ", ".join(f"{f} double" for f in FEATURES))


def rule_labels(found: DataFrame) -> DataFrame:
    """Findings whose label is beyond doubt, with ``label``: 1 for quoted values assigned to a secret's name, keys of
    known services and passwords of addresses; 0 for plain words, numbers, UUIDs and other parts of addresses."""
    secret = ((F.col("assigned") == 1) & (F.col("named") == 1) & (F.col("entropy") >= 3) & (F.col("digits") > 0)
              & (F.col("covered") < 0.5)) | (F.col("service") == 1) & (F.col("entropy") >= 3.5)
    secret = secret | (F.col("login") == 1) & (F.col("scheme") == 1)
    letters = (F.col("digits") == 0) & (F.col("uppers") + F.col("lowers") == 1)
    other = (F.col("digits") == 1) | (F.col("uuid") == 1) | (F.col("scheme") == 1)
    false = (letters | other) & (F.col("named") == 0) & (F.col("login") == 0) | letters & (F.col("covered") == 1)
    return found.withColumn("label", F.when(secret, 1).when(false, 0)).where("label is not null")


def train(labelled: DataFrame, bound: int = FINDINGS, trees: int = TREES) -> PipelineModel | float:
    """A forest from labelled findings (``label`` 0 or 1): at most ``bound`` of each label, in order of a seeded hash of the
    token. With one label only, that label is every score; without any, 0."""
    order = [F.xxhash64(F.lit(11), "token"), F.col("token"), F.col("doc_id"), F.col("start")]
    known = written(labelled.where("label = 1").orderBy(*order).limit(bound).union(
        labelled.where("label = 0").orderBy(*order).limit(bound)).withColumn("label", F.col("label").cast("double")), "findings")
    kinds = [r["label"] for r in known.select("label").distinct().collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=DEPTH, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(known)


def score(found: DataFrame, model: PipelineModel | float, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, start, token, score, secret)`` of all findings."""
    if isinstance(model, float):
        out = found.withColumn("score", F.lit(model))
    else:
        out = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return out.select("doc_id", "start", "token", "score", (F.col("score") >= threshold).alias("secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = 0.5) -> DataFrame:
    """``score`` of every finding of ``docs``. ``labelled``: findings ``(doc_id, start, label)`` to learn from; without
    them, the findings that ``rule_labels`` is sure of. No rows, no rows; other columns are ignored."""
    found = written(findings(docs, corpus_statistics(docs, text_col), id_col, text_col), "candidates")
    known = rule_labels(found) if labelled is None else found.join(
        labelled.select("doc_id", "start", "label"), ["doc_id", "start"])
    return score(found, train(known), threshold)
