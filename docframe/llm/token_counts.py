"""Token counts of whole texts under a sentencepiece BPE model, most of them without merging anything.

BPE joins two neighbouring symbols only if their concatenation is a piece of the vocabulary. So where no piece holds two
given characters side by side, no join ever crosses the place between them, and the texts on both sides can be encoded
apart. ``proved`` shows that, from the vocabulary alone, for the place before a run of spaces (a space is ``U+2581`` inside
the model) and for both sides of a line feed. Texts are cut there into pre-tokens: a run of spaces or a line feed, and what
follows it. ``proved`` also asks the model which vocabulary strings, standing alone as such a pre-token, are one token.

A pre-token that is one of these is counted by looking it up; only the rest is merged, each different one once a batch.
Texts are cut and looked up as Arrow arrays, in their own partitions: nothing is shuffled.

Defined cases: null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows keep their rows; an empty table
gives an empty result; very long texts are cut like others, alone in their batch; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, read, slices

LIMIT = 4_096
#: Different pre-tokens whose counts a worker remembers; saves time only.
MEMO = 500_000
_SPACE = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def proved(path: str) -> dict[str, int]:
    """Tokens of each pre-token that needs no merging: " x" for one token, and a line feed with x for two.

    Raises ValueError for a model whose vocabulary doesn't allow the cuts, or that rewrites texts.
    """
    model = _model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
        raise ValueError("a piece of the vocabulary crosses a cut")
    probe = "".join(dict.fromkeys("".join(pieces))) + "\n\t a  b \n"
    if model.normalize(probe) != _SPACE + probe.replace(" ", _SPACE) or [x for x in model.encode("a ", out_type=str)[1:]] != [_SPACE] or len(model.encode("\n")) != 2:
        raise ValueError("the model rewrites texts")
    spaced = [p for p in pieces if p.startswith(_SPACE) and p != _SPACE]
    bare = [p for p in pieces if not p.startswith(_SPACE)]
    alone = {" ": 1, "\n": 1}
    alone |= {p.replace(_SPACE, " "): 1 for p, found in zip(spaced, model.encode([p[1:] for p in spaced], out_type=str, num_threads=1), strict=True) if found == [p]}
    # The line feed stands between the space that the model puts before every text and the string.
    alone |= {"\n" + p: 2 for p, found in zip(bare, model.encode(["\n" + p for p in bare], out_type=str, num_threads=1), strict=True) if found[2:] == [p]}
    return alone


def whole_tokens(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(pre_token, n_tokens): the table that ``proved`` makes of a vocabulary."""
    return spark.createDataFrame(sorted(proved(path or model_path()).items()), "pre_token string, n_tokens int")


def _pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of binary texts, each text after the space that the model adds, and the number of each one's text."""
    texts = pc.replace_substring(texts, _SPACE.encode(), b" ")
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    data = np.frombuffer(b"".join(b" " + t if t else b"" for t in texts.to_pylist()), dtype=np.uint8)
    ends = np.cumsum(np.where(sizes > 0, sizes + 1, 0))
    space = data == 32
    cut = data == 10
    cut[1:] |= space[1:] & ~space[:-1]
    cut[(ends - sizes - 1)[sizes > 0]] = True
    at = np.flatnonzero(cut)
    offsets = np.append(at, len(data))
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return made, np.searchsorted(ends, at, side="right")


def _merged(model: sentencepiece.SentencePieceProcessor, pre_tokens: list[bytes]) -> list[int]:
    texts = [p.decode() for p in pre_tokens]
    # The model puts a space before the text: that is the first of a run's own, or one token more before a line feed.
    found = model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
    return [len(ids) - (t[0] == "\n") for ids, t in zip(found, texts, strict=True)]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_merged) of docs (doc_id, text); n_merged: tokens from pre-tokens that were merged."""
    path = path or model_path()
    proved(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _model(path), proved(path)
        strings = pa.array([k.encode() for k in table], pa.large_binary())
        tokens = np.array(list(table.values()), dtype=np.int64)
        memo: dict[bytes, int] = {}
        for batch in slices(batches, 1):
            pre, text = _pre_tokens(batch.column(1))
            coded = pre.dictionary_encode()
            at = pc.index_in(coded.dictionary, value_set=strings)
            counts = np.where(known := np.asarray(at.is_valid()), tokens[np.asarray(at.fill_null(0))], 0)
            left = np.flatnonzero(~known)
            rest = coded.dictionary.take(pa.array(left)).to_pylist()
            new = [p for p in rest if p not in memo]
            if len(memo) + len(new) > MEMO:
                memo, new = {}, rest
            memo.update(zip(new, _merged(model, new), strict=True))
            counts[left] = [memo[p] for p in rest]
            order = np.asarray(coded.indices)
            n = np.bincount(text, weights=counts[order], minlength=batch.num_rows).astype(np.int64)
            merged = np.bincount(text, weights=(counts * ~known)[order], minlength=batch.num_rows).astype(np.int64)
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit), pa.array(merged)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_merged"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", as_bytes("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_merged long")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``: (doc_id, n_bytes, n_tokens, over_limit, n_merged)."""
    return count_tokens(read(spark, sf_dir, "documents"))
