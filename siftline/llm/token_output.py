"""Token ids as flat binary files with 64-bit document offsets.

Format of a written folder:

- ``ids-*.bin``: the ids of one range of documents, one after the other, as little-endian unsigned
  integers of ``width`` bytes (2 if the vocabulary allows it, else 4), nothing else;
- ``docs-*.bin``: n int64 document ids, then n + 1 int64 offsets into the ids file, in ids;
- ``manifest/``: a Parquet table with a row per pair of files: ``part``, both names, ``n_docs``,
  ``n_null`` (leading documents without id), ``n_tokens``, ``width`` and ``base``, the number of
  ids in all earlier parts, by prefix sums over the parts.

Parts follow each other in ascending doc_id order. A task writes files of a name of its own and
reports them in the manifest, which Spark commits; what a lost or repeated attempt wrote is never
listed. Files are memory-mapped where the folder is local to the task, otherwise read by range.

Edge cases: a null text is empty (just the end id); null doc_ids come first and stay null; equal
doc_ids follow each other, ordered by text; an empty table gives an empty manifest; other columns
are not read.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import filesystem, prefix_sums, task_count, text_bytes, travels, worker_cache

travels(__name__)

PART_BYTES = 24 << 20
PIECES_KEPT = 300_000
WORDS_KEPT = 800_000
PIECES_AT_ONCE = 200_000
WORDS_AT_ONCE = 500
TEXTS_AT_ONCE = 1 << 20
BATCH = 4 << 20
TAIL = ",.;:!?)"

#: Fixed value: the split pattern of which a word after a single space always begins a piece.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on which all Unicode versions agree about letters, numbers and spaces.
PLAIN = r"[^\t\n\r\x20-\x7e\xa1-ɏ]"

MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_null long, n_tokens long, width int"


class Overlay(dict):
    """A dict that falls back to another."""

    def __init__(self, own: dict, base: dict):
        super().__init__(own)
        self.base = base

    def __missing__(self, key):
        return self.base[key]


class PieceEncoder:
    """Encodes by the pieces of the tokenizer's pre-tokenizer and remembers the ids of pieces.

    A byte-level BPE encodes each piece on its own, so the ids of a text are those of its pieces.
    With the pattern ``WORDWISE``, a space or line end between two other characters begins a piece, so
    texts whose white space is all of that kind are looked up word by word, without the pattern; it
    is applied to new words only. Texts with characters outside ``PLAIN``, and tokenizers of another
    build, go through the tokenizer whole.
    """

    def __init__(self, path: str, pattern: str | None):
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        shape = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        plain_bpe = shape.get("type") == "ByteLevel" and not shape.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.split = regex.compile(pattern) if pattern and plain_bpe else None
        self.odd = re.compile(PLAIN)
        self.known: dict[str, bytes] = {}
        self.wordwise = pattern == WORDWISE
        self.inner: dict[str, bytes] = {}  # words after a space, or after a line end that they begin with

    def packed(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of words of letters after a space: they split where they are joined, so many go through the tokenizer as one text."""
        new: dict[str, bytes] = {}
        for i in range(0, len(words), WORDS_AT_ONCE):
            some = words[i : i + WORDS_AT_ONCE]
            done = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            first = np.flatnonzero(np.diff(np.array(done.word_ids, np.int64), prepend=-1)) * self.width
            if len(first) == len(some):
                packed = self.packed(done.ids)
                new.update(zip(some, map(packed.__getitem__, map(slice, first.tolist(), [*first[1:].tolist(), len(packed)]))))
            else:
                new.update((w, self.packed(e.ids)) for w, e in zip(some, self.tokenizer.encode_batch_fast([" " + w for w in some], add_special_tokens=False)))
        return new

    def _coded(self, lists: list[list[str]]) -> list[bytes]:
        """The packed ids of each list of pieces."""
        fresh = list(set(chain.from_iterable(lists)).difference(self.known))
        done = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
        known, new = self.known, {p: self.packed(e.ids) for p, e in zip(fresh, done)}
        if len(known) + len(new) <= PIECES_KEPT:
            known.update(new)
        elif new:  # the pieces met first, which are the frequent ones, stay known
            known = Overlay(new, known)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in lists]

    @staticmethod
    def _split(text: str) -> list[str] | None:
        """The words of a text, those that begin a line with the line end before; None where white space is of another kind."""
        if "\t" in text or "\r" in text or "\n\n" in text or "  " in text or " \n" in text:
            return None
        words = text.replace("\n", " \n").split(" ")
        return words if words[0] and words[-1] else None

    def _by_words(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of texts, given as their words; the first word of each is taken off its list."""
        firsts = [words.pop(0) for words in texts]
        whole = dict.fromkeys(firsts)
        whole = dict(zip(whole, self._coded([self.split.findall(w) for w in whole])))
        inner = self.inner
        held = set(chain.from_iterable(texts))
        fresh = held.difference(inner)
        tailed = [w for w in fresh if w[-1] in TAIL and w[:-1].isalpha()]
        stems = {w[:-1] for w in tailed}.difference(inner)
        new = self._words([*stems, *(w for w in fresh if w not in stems and w.isalpha())])
        # A mark after letters is a piece of its own.
        marks = dict(zip(TAIL, self._coded([[mark] for mark in TAIL]))) if tailed else {}
        new.update({w: (new.get(w[:-1]) or inner[w[:-1]]) + marks[w[-1]] for w in tailed})
        rest = list(fresh.difference(new))
        new.update(zip(rest, self._coded([self.split.findall(w if w[0] == "\n" else " " + w) for w in rest])))
        if len(inner) + len(new) <= WORDS_KEPT:
            inner.update(new)
        elif new:  # the words met first, which are the frequent ones, stay known
            held.difference_update(new)
            inner = new | dict(zip(held, map(inner.__getitem__, held)))
        find = inner.__getitem__
        return [whole[first] + b"".join(map(find, words)) for first, words in zip(firsts, texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = [b""] * len(texts)
        short, worded = [], []
        for i, t in enumerate(texts):
            if self.odd.search(t):
                out[i] = self.packed(self.tokenizer.encode(t, add_special_tokens=False).ids)
            elif len(t) > TEXTS_AT_ONCE:
                found, parts = (m[0] for m in self.split.finditer(t)), []
                while some := list(islice(found, PIECES_AT_ONCE)):
                    parts += self._coded([some])
                out[i] = b"".join(parts)
            elif self.wordwise and (words := self._split(t)):
                worded.append((i, words))
            else:
                short.append((i, self.split.findall(t)))
        for (i, _), coded in zip(worded, self._by_words([words for _, words in worded])):
            out[i] = coded
        for (i, _), coded in zip(short, self._coded([pieces for _, pieces in short])):
            out[i] = coded
        return out


def encoder(path: str, pattern: str | None) -> PieceEncoder:
    cache = worker_cache("piece_encoders")
    if (path, pattern) not in cache:
        cache[path, pattern] = PieceEncoder(path, pattern)
    return cache[path, pattern]


def _some(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in lists of about ``BATCH`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _writer(tokenizer: str, pattern: str | None, end_id: int, folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, pattern)
        end = enc.packed([end_id])
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = filesystem(folder)
        ids, lengths, nulls, out = [], [], 0, None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{root}/ids-{part:06d}-{name}.bin")
            nulls += int(batch["is_null"].sum())
            ids.append(batch["doc_id"].to_numpy(np.int64))
            for texts in _some(batch["text"]):
                for coded in enc.encode(texts):
                    out.write(coded)
                    out.write(end)
                    lengths.append(len(coded) // enc.width + 1)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        with fs.open_output_stream(f"{root}/docs-{part:06d}-{name}.bin") as f:
            f.write(np.concatenate(ids).astype("<i8").tobytes())
            f.write(offsets.astype("<i8").tobytes())
        yield pd.DataFrame([{
            "part": part, "ids_file": f"ids-{part:06d}-{name}.bin", "docs_file": f"docs-{part:06d}-{name}.bin",
            "n_docs": len(lengths), "n_null": nulls, "n_tokens": int(offsets[-1]), "width": enc.width,
        }])

    return write


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, pattern: str | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode ``text`` of all rows into ``folder`` in ascending ``doc_id`` order; returns the manifest.

    ``pattern`` is the split pattern of a byte-level tokenizer; with it, ids of repeated pieces are
    looked up instead of computed again.
    """
    spark = docs.sparkSession
    number = F.col(doc_id).cast("long")
    rows = docs.select(number.isNull().alias("is_null"), F.coalesce(number, F.lit(0)).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("is_null").desc(), F.col("doc_id")]
    parts = task_count(spark, text_bytes(rows, "text"), PART_BYTES)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    written = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order, F.col("text").asc_nulls_first())
        .mapInPandas(_writer(tokenizer, pattern, end_id, folder), MANIFEST)
    )
    written.write.parquet(f"{folder}/parts")
    prefix_sums(spark.read.schema(MANIFEST).parquet(f"{folder}/parts"), "part", "n_tokens", "base").coalesce(1).write.parquet(
        f"{folder}/manifest"
    )
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, base long").parquet(f"{folder}/manifest")


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """An array over a file: memory-mapped where it is local, else read."""
    from pyarrow.fs import LocalFileSystem

    if isinstance(fs, LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _documents(root: str, row, fs) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of each document of one part."""
    index = _mapped(fs, f"{root}/{row.docs_file}", "<i8")
    ids = _mapped(fs, f"{root}/{row.ids_file}", f"<u{row.width}")
    n = int(row.n_docs)
    offsets = index[n:].tolist()
    for i, doc in enumerate(index[:n].tolist()):
        yield (None if i < row.n_null else doc), int(row.base) + offsets[i], ids[offsets[i] : offsets[i + 1]]


def _reader(folder: str, digest: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        for batch in batches:
            for row in batch.itertuples():
                rows, size = [], 0
                for doc, start, ids in _documents(root, row, fs):
                    whole = ids.astype("<u4")
                    rows.append((doc, start, len(ids), zlib.crc32(whole.tobytes()) if digest else whole.tolist()))
                    size += 1 if digest else len(ids)
                    if size >= 50_000:
                        yield _frame(rows, digest)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, digest)

    return read


def _frame(rows: list, digest: bool) -> pd.DataFrame:
    docs, starts, lengths, last = zip(*rows)
    return pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "start": starts, "n_tokens": lengths, "ids_crc32" if digest else "ids": last})


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """The documents of a written folder: doc_id, start, n_tokens and ``ids``, or their ``ids_crc32``."""
    manifest = read_manifest(spark, folder)
    tasks = min(max(manifest.count(), 1), 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = "ids_crc32 long" if digest else "ids array<long>"
    return manifest.repartition(tasks).mapInPandas(_reader(folder, digest), f"doc_id long, start long, n_tokens long, {last}")
