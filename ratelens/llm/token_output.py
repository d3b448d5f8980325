"""Operator 4: token ids as flat binary files with 64-bit document offsets, read back memory-mapped.

Rows are ranged by id (and a text hash, so a repeated id can be split), sorted, encoded and written by each task as

    part-NNNNN-<attempt>.ids      unsigned little-endian ids, 16 bits if the vocabulary fits, else 32
    part-NNNNN-<attempt>.offsets  unsigned 64-bit little-endian: first id of each document in this file, then the end
    part-NNNNN-<attempt>.docs     signed 64-bit little-endian document ids (rows with null ids come first and hold 0)

Every attempt of a task writes names of its own and the manifest lists those of the attempt that ended well, so
a retried or speculative task can't spoil a file. The manifest has a row for each part; a part's base is the prefix sum
of the ids before it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.llm import text
from ratelens.llm.common import setting

#: Words whose ids a worker remembers; the memory starts anew beyond that.
REMEMBERED = 1_000_000
#: New words handed to the tokenizer at once: its own records of them take far more memory than their ids.
AT_ONCE = 2000
#: Bytes of whole texts in an Arrow batch while files are written.
BATCH_BYTES = 4 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Punctuation that no contraction and no special token holds: white space may be thought between it and an ASCII letter.
_MARK = np.zeros(256, bool)
_MARK[[*b'!"#$%&()*+,-./:;=?@[]^_`{}~']] = True


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


class Encoder:
    """Texts to ids. ``by_word``: each distinct word is encoded once, for tokenizers that drop white space, lower-case
    ASCII letters and end a token where letters meet punctuation, so that a text's ids are those of its words."""

    def __init__(self, path: str, dtype: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.by_word = Tokenizer.from_file(path), np.dtype(dtype), by_word
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, x in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[x] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        # sorted hashes and the place of each; by place, in order of learning: where its ids begin and how many they are
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def __call__(self, data: np.ndarray, at: np.ndarray, i: int, j: int, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in rows i..j, each with ``end`` behind, and how many each has."""
        if not self.by_word:
            texts = [bytes(data[x:y]).decode("utf8") for x, y in zip(at[i:j].tolist(), at[i + 1:j + 1].tolist())]
            lists = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return self._joined(np.concatenate([np.array(x, self.dtype) for x in lists]), np.array([len(x) for x in lists]), end)
        h, row, first, stop = text.words(data, at, i, j, cut=_cut)
        place = self._known(h, data, first, stop)
        size = self.size[place]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[place] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        return self._joined(ids, np.bincount(row, size, j - i).astype(np.int64), end)

    def _joined(self, ids: np.ndarray, size: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end is None:
            return ids, size
        out = np.full(len(ids) + len(size), end, self.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
        return out, size + 1

    def _known(self, h: np.ndarray, data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places of the words in the memory, after it has learned the new ones."""
        h, example, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.hashes, h)
        new = np.ones(len(h), bool)
        new[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != h[at < len(self.hashes)]
        if new.any():
            which = np.flatnonzero(new)
            a, b = first[example[which]].tolist(), stop[example[which]].tolist()
            order, size, ids = self._encoded([bytes(data[x:y]).decode("utf8") for x, y in zip(a, b)])
            own = np.empty(len(which), np.int64)
            own[order] = len(self.size) + np.arange(len(which))
            self.hashes = np.insert(self.hashes, at[which], h[which])
            self.place = np.insert(self.place, at[which], own)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
            at = np.searchsorted(self.hashes, h)
        return self.place[at][back] if len(h) else back

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after the other: the words' order in them, their numbers of ids, the ids."""
        parts = [(i, *self._some(new[i:i + AT_ONCE])) for i in range(0, len(new), AT_ONCE)]
        return (np.concatenate([order + i for i, order, _, _ in parts]), np.concatenate([size for _, _, size, _ in parts]),
                np.concatenate([ids for _, _, _, ids in parts]))

    def _some(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of letters go as one text, whose ids are told apart by the tokens that end a word."""
        plain = [k for k, w in enumerate(new) if w.isalpha()]
        ids = np.array(self.tokenizer.encode(" ".join([new[k] for k in plain]), add_special_tokens=False).ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(plain) or len(ids) and ends[-1] != len(ids):  # a letter that is not one word's part
            plain, ids, ends = [], ids[:0], ends[:0]
        chosen = set(plain)
        rest = [k for k in range(len(new)) if k not in chosen]
        lists = [e.ids for e in self.tokenizer.encode_batch([new[k] for k in rest], add_special_tokens=False)]
        size = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in lists], np.int64)])
        return np.array(plain + rest, np.int64), size, np.concatenate([ids, np.array([y for x in lists for y in x], self.dtype)])


def _cut(b: np.ndarray) -> np.ndarray:
    """Where an ASCII letter and punctuation meet."""
    letter, mark = _LETTER[b], _MARK[b]
    out = np.zeros(len(b), bool)
    out[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return out


#: Encoders of this worker, kept between tasks.
_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str, by_word: bool) -> Encoder:
    key = (path, dtype, by_word)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def vocabulary_dtype(path: str, end_id: int | None) -> str:
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
    return "<u2" if most < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = 2, by_word: bool = False) -> DataFrame:
    """Write the ids of every text (then ``end_id``) in ascending id order to ``out_dir``, a folder that driver and
    executors share, and return the manifest, also kept there: ``(part, name, dtype, docs, nulls, ids, base)``.

    Null ids come first; rows that repeat an id are ordered by a hash of the text, then the text, and all
    kept. Null or empty text is ``end_id`` alone. A task holds about half a MB of text at a time (or one longer text).
    Other columns are ignored. No rows: an empty manifest."""
    dtype = vocabulary_dtype(tokenizer_path, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, dtype, by_word)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        fs, folder = filesystem(out_dir)
        fs.create_dir(folder, recursive=True)
        rows = nulls = total = 0
        with fs.open_output_stream(f"{folder}/{name}.ids") as ids, fs.open_output_stream(f"{folder}/{name}.offsets") as at, \
                fs.open_output_stream(f"{folder}/{name}.docs") as own:
            at.write(np.zeros(1, "<u8").tobytes())
            for batch in text.returned(batches):
                own.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nulls += batch.column(0).null_count
                data, places = text.utf8(batch.column(1))
                for i, j in text.chunks(places):
                    got, size = encode(data, places, i, j, end_id)
                    ends = total + np.cumsum(size)
                    ids.write(got.astype(dtype).tobytes())
                    at.write(ends.astype("<u8").tobytes())
                    total, rows = int(ends[-1]), rows + j - i
        if rows:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "dtype": dtype, "docs": rows, "nulls": nulls,
                                               "ids": total}])
        else:
            for kind in ("ids", "offsets", "docs"):
                fs.delete_file(f"{folder}/{name}.{kind}")

    clean = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), clean)
                   .repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text"))
                   .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text"))
    parts = ordered.mapInArrow(write, "part long, name string, dtype string, docs long, nulls long, ids long")
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        parts.write.parquet(f"{out_dir}/parts")
    parts = docs.sparkSession.read.schema(parts.schema).parquet(f"{out_dir}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    manifest = parts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    manifest.write.parquet(f"{out_dir}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{out_dir}/manifest")


def read_tokens(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """The documents of files that ``write_tokens`` made: ``(doc_id, start, n_tokens, ids_crc32)`` and, if asked
    for, ``ids``. ``start`` counts the ids of all documents before; ``ids_crc32`` is of the ids as unsigned
    32-bit little-endian integers. A task maps the files of its parts and holds one document's ids at a time."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(out_dir)

        def mapped(name: str, dtype: str) -> np.ndarray:
            if isinstance(fs, pa.fs.LocalFileSystem):
                path = f"{folder}/{name}"
                return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
            with fs.open_input_file(f"{folder}/{name}") as f:
                return np.frombuffer(f.read(), dtype)

        for batch in batches:
            for p in batch.to_pylist():
                ids, at = mapped(f"{p['name']}.ids", p["dtype"]), mapped(f"{p['name']}.offsets", "<u8").astype(np.int64)
                own = mapped(f"{p['name']}.docs", "<i8")
                for i in range(0, p["docs"], 2000):
                    j = min(i + 2000, p["docs"])
                    each = [ids[at[x]:at[x + 1]].astype("<u4") for x in range(i, j)]
                    cols = [pa.array(own[i:j], mask=np.arange(i, j) < p["nulls"]), pa.array(at[i:j] + p["base"]),
                            pa.array(np.diff(at[i:j + 1])), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    manifest = spark.read.parquet(f"{out_dir}/manifest")
    tasks = max(1, manifest.count())  # a row a part
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.repartition(tasks, "part").mapInArrow(read, schema)
