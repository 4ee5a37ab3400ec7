"""Token-id output: texts to ids of a public tokenizer, into checksummed range-coded files, and back.

Documents are range-partitioned by id and sorted; each task cuts its stream of ids into files of about ``FILE_IDS`` ids
at document ends. A file is an image in the format of ``range_coder`` held by one Parquet row, so that Spark's own
committer writes it: on any store, once, whatever executors are lost. A file's first position is the sum of the ids of
those before it, from a table with one row a file.

Words are encoded once and remembered: this tokenizer drops white space and never joins across it, so a text's ids are
those of its white-space separated words. The memo is bounded and only saves time.

Defined cases: null and empty texts have the end id alone; null ids come first and are read back as null; repeated
rows follow each other; an empty table gives no file and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, read, saved, slices, text_chunks
from .range_coder import BLOCK, read_file, write_file

END_ID = 1
FILE_IDS = 8 << 20
#: Bytes of text that a task gets, about.
TASK = 32 << 20
MEMO = 1_000_000
_NO_ID = -(1 << 63)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII punctuation other than an apostrophe: after a letter, the tokenizer always cuts before it.
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_MARKS = _PUNCTUATION.encode()


def _byte_letters() -> str:
    """The printable character that stands for each byte in byte-level vocabularies: its own, or the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


class Encoder:
    """Ids of texts as little-endian 16-bit bytes, by way of remembered words.

    A word of letters that the tokenizer's normalizer leaves alone and its pre-tokenizer keeps together goes to the
    tokenizer's model at once; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo: dict[bytes, bytes] = {}
        self.letters: dict[str, str | None] = {}
        self.byte_letters = _byte_letters()

    def _letter(self, c: str) -> str | None:
        """The byte letters of a letter that stays as it is, with those around it; None for any other character."""
        if self.tokenizer.normalizer.normalize_str(c) != c or len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a")) > 1:
            return None
        return c.encode().decode("latin-1").translate(self.byte_letters)

    def _in_letters(self, text: str) -> str | None:
        """``text`` in byte letters, if it is letters that stay as they are and together."""
        try:
            each = list(map(self.letters.__getitem__, text))
        except KeyError:
            self.letters |= {c: self._letter(c) for c in set(text) - self.letters.keys()}
            each = list(map(self.letters.__getitem__, text))
        if None in each or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return None
        return "".join(each)

    def _modelled(self, text: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _learn(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        head = text.rstrip(_PUNCTUATION)
        letters = self._in_letters(head)
        if not letters:
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        marks = text[len(head) :]
        return self._modelled(letters) + (self._modelled(marks) if marks else b"")

    def word(self, word: bytes) -> bytes:
        """Ids of a word in lower case; marks after a letter are words of their own."""
        ids = self.memo.get(word)
        if ids is None:
            head = word.rstrip(_MARKS)
            if len(head) < len(word) and head[-1:].islower() and b"<|" not in word:
                ids = self.word(head) + self.word(word[len(head) :])
            else:
                ids = self._modelled(word.decode()) if word.isalpha() else self._learn(word)
            self.memo[word] = ids
        return ids

    def _lower(self, text: bytes) -> bytes:
        """ASCII in lower case, but for words that may hold a special token."""
        return text.lower() if b"<|" not in text else b" ".join([w if b"<|" in w else w.lower() for w in text.split()])

    def texts(self, texts: list[bytes]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        strings = pa.array([self._lower(t) for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False)
        split = pc.ascii_split_whitespace(strings)
        coded = split.flatten().dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()
        places, data = np.frombuffer(offsets, dtype=np.int64, count=len(coded.dictionary) + 1).tolist(), data.to_pybytes() if data else b""
        known = [self.word(data[i:j]) for i, j in zip(places, places[1:], strict=False)]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 2
        each = coded.indices.to_numpy()
        sizes = size.take(each)
        ends = np.r_[0, np.cumsum(sizes)]
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size).take(each) - ends[:-1], sizes)
        ids = np.frombuffer(b"".join(known), dtype="<u2").take(at).tobytes()
        edges = (ends[split.offsets.to_numpy()] * 2).tolist()
        return [ids[i:j] for i, j in zip(edges, edges[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _written(path: str, end_id: int, file_ids: int, block: int):
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        coder = encoder(path)
        parts: list[bytes] = []
        ids: list[int] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal serial, parts, ids, held
            sizes = np.array([len(p) // 2 for p in parts], dtype=np.int64)
            image = write_file(np.frombuffer(b"".join(parts), dtype="<u2"), np.array(ids, dtype=np.int64), sizes, block)
            row = pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "serial": pa.array([serial], pa.int64()), "ids": pa.array([held], pa.int64()), "docs": pa.array([len(ids)], pa.int64()), "image": pa.array([image], pa.binary())})
            serial, parts, ids, held = serial + 1, [], [], 0
            return row

        for some in slices(batches, 1, 8 << 20):
            if some.num_rows:
                for doc, coded in zip(some.column(0).to_pylist(), coder.texts(some.column(1).to_pylist()), strict=True):
                    ids.append(_NO_ID if doc is None else doc)
                    parts.append(coded + end)
                    held += len(coded) // 2 + 1
                    if held >= file_ids:
                        yield out()
        if parts:
            yield out()

    return run


def write_files(docs: DataFrame, path: str, end_id: int = END_ID, file_ids: int = FILE_IDS, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """Files of whole ``docs`` (doc_id, text) in ascending doc_id order: (task, serial, ids, docs, image), written."""
    n = text_chunks(docs, size=task)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("t"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.length("t"), "t")
    return saved(ordered.mapInArrow(_written(path, end_id, file_ids, block), "task long, serial long, ids long, docs long, image binary"), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, docs, sizes = read_file(batch.column(2)[i].as_py())
            wide = ids.astype("<u4")
            ends = np.cumsum(sizes)
            begin = ends - sizes
            check = [zlib.crc32(wide[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            mask = docs == _NO_ID
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())), pa.array(docs, mask=mask), pa.array(begin), pa.array(sizes), pa.array(check, pa.int64())], names=["task", "serial", "doc_id", "begin", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from files; checksums of all blocks are verified."""
    before = W.orderBy("task", "serial").rowsBetween(W.unboundedPreceding, -1)
    places = files.select("task", "serial", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    rows = files.select("task", "serial", "image").mapInArrow(_read, "task long, serial long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return rows.join(saved(places, "token-places"), ["task", "serial"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through files and back."""
    return read_documents(write_files(read(spark, sf_dir, "documents"), tokenizer_path()))
