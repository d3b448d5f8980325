"""Operator 13: exact duplicates, owned by the terminal nodes of Patricia tries.

Texts are normalised and described by length and content hash. Only classes of two rows or more can hold equal texts; the
texts of those are put into compressed radix tries (each edge a byte string), first within the map tasks, so that of a text
that a third of all rows hold each task ships one copy, then in partitions by length and content hash. A terminal node
is a whole text: it keeps the smallest identifier and the number of copies. Where a trie outgrows TRIE_BYTES, its
largest subtree is spilled: its texts, and all that reach its place later, are left for the next round, whose table they make. So
memory is bounded, nothing is kept on an executor's disk, and a lost task is run again from a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import drop_written, small, written

#: Bytes a trie may hold (labels, and NODE_BYTES for each node); one text may exceed it alone.
TRIE_BYTES = 48 << 20
NODE_BYTES = 400
#: Texts' bytes in an outgoing batch.
OUT_BYTES = 4 << 20

SPACES = r"[\x20\x09-\x0D]+"


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Node:
    __slots__ = ("label", "children", "owner", "copies")

    def __init__(self, label: bytes, owner: int | None = None, copies: int = 0):
        self.label, self.children, self.owner, self.copies = label, {}, owner, copies


class Trie:
    """A compressed radix trie of byte strings. ``copies`` > 0 marks a node where a string ends; ``owner`` is the smallest
    identifier of its copies. A child of None is a spilled subtree: no string enters it any more."""

    def __init__(self):
        self.root, self.bytes, self.strings = Node(b""), 0, 0

    def add(self, s: bytes, owner: int | None, copies: int) -> bool:
        """Insert; False if the string belongs to a spilled subtree."""
        node, at = self.root, 0
        while at < len(s):
            if s[at] not in node.children:
                node.children[s[at]] = Node(s[at:], owner, copies)
                self.bytes += len(s) - at + NODE_BYTES
                self.strings += 1
                return True
            child = node.children[s[at]]
            if child is None:
                return False
            if not s.startswith(child.label, at):
                same = shared_prefix(child.label, s, at)
                upper = Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[s[at]] = child = upper
                self.bytes += NODE_BYTES
            node, at = child, at + len(child.label)
        if not node.copies:
            self.strings += 1
        node.owner = least(node.owner, owner) if node.copies else owner
        node.copies += copies
        return True

    def strings_below(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Of all strings in the subtree of ``node``, whose own label ends ``prefix``: the string, its owner and copies."""
        stack = [(node, prefix)]
        while stack:
            x, s = stack.pop()
            if x.copies:
                yield s, x.owner, x.copies
            stack += [(c, s + c.label) for c in x.children.values() if c is not None]

    def _sizes(self) -> dict[int, int]:
        """Bytes of each node's subtree, by the node's identity."""
        order, stack = [], [self.root]
        while stack:
            x = stack.pop()
            order.append(x)
            stack += [c for c in x.children.values() if c is not None]
        out: dict[int, int] = {}
        for x in reversed(order):
            out[id(x)] = len(x.label) + NODE_BYTES + sum(out[id(c)] for c in x.children.values() if c is not None)
        return out

    def spill(self) -> list[tuple[bytes, int | None, int]]:
        """Cut off the largest subtree of at most half of the trie (or a leaf) and return its strings. Something stays."""
        size = self._sizes()
        node, prefix = self.root, b""
        while True:
            key, child = max(((k, c) for k, c in node.children.items() if c is not None), key=lambda x: size[id(x[1])])
            alone = not any(c is not None for c in child.children.values())
            if alone or size[id(child)] * 2 <= size[id(self.root)]:
                break
            node, prefix = child, prefix + child.label
        gone = list(self.strings_below(child, prefix + child.label))
        node.children[key] = None
        self.bytes -= size[id(child)]
        self.strings -= len(gone)
        return gone


def shared_prefix(label: bytes, s: bytes, at: int) -> int:
    """Bytes that ``label`` and ``s`` from ``at`` on have in common, by halving."""
    low, high = 0, min(len(label), len(s) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if s.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class _Out:
    """Rows gathered into batches of bounded bytes."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size + 64
        if self.bytes >= OUT_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), self.types)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, self.names)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows with each text's bytes taken one at a time."""
    others = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
    for k, (n, h, owner, copies) in enumerate(zip(*others)):
        yield n, h, batch.column(2)[k].as_py(), owner, copies


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map side: rows ``(n, h, text, owner, copies)`` with equal texts as one; a full trie is emptied and begun anew."""
    out = _Out(["n", "h", "text", "owner", "copies"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()])
    trie, hashes = Trie(), {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for s, owner, copies in trie.strings_below(trie.root, b""):
            yield from out.add((len(s), hashes[s], s, owner, copies), len(s))

    for batch in batches:
        for _, h, s, owner, copies in _rows(batch):
            before = trie.strings
            trie.add(s, owner, copies)
            if trie.strings > before:
                hashes[s] = h
            if trie.bytes > TRIE_BYTES // 2:  # the strings are held here, too
                yield from emptied()
                trie, hashes = Trie(), {}
    yield from emptied()
    yield from out.flush()


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition by length and hash: ``(sha, owner, copies)`` of its texts, and as ``(n, h, text, owner, copies)`` those of spilled
    subtrees."""
    out = _Out(["n", "h", "text", "sha", "owner", "copies"],
               [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()])
    trie, hashes = Trie(), {}
    for batch in batches:
        for n, h, s, owner, copies in _rows(batch):
            before = trie.strings
            if not trie.add(s, owner, copies):
                yield from out.add((n, h, s, None, owner, copies), n)
            elif trie.strings > before:
                hashes[hashlib.sha256(s).digest()] = h
            while trie.bytes > TRIE_BYTES and trie.strings > 1:
                for t, own, c in trie.spill():
                    yield from out.add((len(t), hashes.pop(hashlib.sha256(t).digest()), t, None, own, c), len(t))
    for s, owner, copies in trie.strings_below(trie.root, b""):
        sha = hashlib.sha256(s)
        yield from out.add((len(s), hashes[sha.digest()], None, sha.hexdigest(), owner, copies), 0)
    yield from out.flush()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``: of the rows whose texts are equal after each
    run of space and 0x09-0x0D became one space, the smallest id, their number, and whether this row is the one that stays.

    Null counts as empty, and empty texts are equal. A null id is larger than any other: it is kept only where all ids of the group are
    null (``keep_id`` is null then). Of rows that repeat both text and id exactly one stays. Texts are compared whole, byte by byte;
    other columns are ignored. No rows, no rows."""
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), normal.alias("text"))
    n, h = F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("h")
    rows = written(texts.select("id", n, h, F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-rows")
    shared = rows.groupBy("n", "h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("n", "h")
    shared = written(shared, "exact-classes")
    some = texts.select("id", n, h, "text").join(small(shared, 16), ["n", "h"], "left_semi")
    some = some.select("n", "h", F.col("text").cast("binary").alias("text"), F.col("id").alias("owner"), F.lit(1).cast("long").alias("copies"))
    left = some.mapInArrow(_combined, "n long, h long, text binary, owner long, copies long")
    owners, spilled = None, None
    while True:
        found = left.repartition("n", "h").mapInArrow(_owned, "n long, h long, text binary, sha string, owner long, copies long")
        found = written(found, "exact-owners")
        if spilled is not None:
            drop_written(spilled)
        done = found.where("text is null").select("n", "h", "sha", "owner", "copies")
        owners = done if owners is None else owners.union(done)
        left = found.where("text is not null").select("n", "h", "text", "owner", "copies")
        if left.isEmpty():
            break
        left = spilled = written(left, "exact-spilled")
    owners = written(owners.where("copies > 1"), "exact-owners")
    named = rows.join(small(owners, 128), ["n", "h", "sha"], "left")
    alone = F.col("copies").isNull()
    named = named.select("id", "sha", "row", F.when(alone, F.col("id")).otherwise(F.col("owner")).alias("keep_id"),
                         F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"))
    # rows of the owner's text and id may repeat: the first stays
    again = (named.where("group_size > 1 and id <=> keep_id").groupBy("sha").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("first"))
                  .where("times > 1").select("sha", "first"))
    again = written(again, "exact-again")
    out = named.join(small(again, 96), "sha", "left")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                      (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("first").isNull() | (F.col("row") == F.col("first")))).alias("kept"),
                      F.col("sha").alias("text_sha256"))


ORACLE_SQL = r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal
"""
