"""Sub-word tokens of public vocabularies, read from a file that every executor can open.

A vocabulary file is a parameter: ``.json`` for byte-level or word tokenizers, ``.model`` for
pieces. Tokens are the ids as text, so that counts and perplexity take them like words, or numbers.
Encoding is costly: ``stored_tokens`` does it once and writes the ids to the shared folder.
Encoders hold some hundred bytes a token, so a task encodes and hands on texts in short runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitledger.operators.corpus import Tokenizer
from bitledger.session import scratch_path

# Documents of a corpus are joined by a blank line.
JOINER = "\n\n"
AFTER = "a"
# Characters of texts encoded together; a longer text is encoded alone.
RUN_CHARS = 500_000
_LOADED: dict[str, Callable[[list[str]], list[list[int]]]] = {}


def _load(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The encoder of a vocabulary file, loaded once in a worker."""
    if path not in _LOADED:
        if path.endswith(".json"):
            import os

            from tokenizers import Tokenizer as Vocabulary

            # Spark has a task per core already.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            vocabulary = Vocabulary.from_file(path)
            vocabulary.encode_special_tokens = True
            _LOADED[path] = lambda texts: [e.ids for e in vocabulary.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: pieces.encode(texts, num_threads=1)
        else:
            raise ValueError(f"a vocabulary file ends in .json or .model: {path}")
    return _LOADED[path]


def _check(path: str) -> None:
    if not path.endswith((".json", ".model")):
        raise ValueError(f"a vocabulary file ends in .json or .model: {path}")


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of ``RUN_CHARS`` together at most, or one text that is longer."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > RUN_CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def vocabulary_tokenizer(path: str) -> Tokenizer:
    """A tokenizer for ``corpus.with_tokens``: the ids of each text as text, special tokens of
    the vocabulary read as plain text. A null text has a null list."""
    _check(path)

    def tokenize(texts: pd.Series) -> pd.Series:
        encode, names = _load(path), {}
        present = texts.notna()
        # A token that comes again is the same object.
        found = chain.from_iterable(
            [[names.setdefault(k, str(k)) for k in ids] for ids in encode(run)] for run in _runs(texts[present].tolist())
        )
        return pd.Series([next(found) if there else None for there in present], index=texts.index, dtype=object)

    return tokenize


def _ids(lists: list[list[int] | None]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def _in_runs(batch: pa.RecordBatch, texts: list[str | None]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Neighbouring rows of a batch, their first column and their texts; nulls have no length."""
    at = 0
    for run in _runs([t or "" for t in texts]):
        yield batch.column(0).slice(at, len(run)), texts[at : at + len(run)]
        at += len(run)


def token_ids(df: DataFrame, path: str, at_most: int | None = None) -> DataFrame:
    """Texts as ``(doc_id, ids)``, cut at ``at_most``: a calibration sample as a model reads it."""
    _check(path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _load(path)
        for batch in batches:
            for keys, texts in _in_runs(batch, batch.column(1).to_pylist()):
                found = iter(encode([t for t in texts if t is not None]))
                ids = _ids([None if t is None else next(found)[:at_most] for t in texts])
                yield pa.RecordBatch.from_arrays([keys, ids], ["doc_id", "ids"])

    schema = T.StructType([df.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select("doc_id", "text").mapInArrow(encoded, schema)


def _part_encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens of a text and, but for the last one, of the blank line after it, as they are where
    a letter follows: a letter is encoded with them and its token left out."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _load(path)
        ((*_, after),) = encode([JOINER + AFTER])
        for batch in batches:
            last = iter(batch.column(2).to_pylist())
            for keys, texts in _in_runs(batch, batch.column(1).to_pylist()):
                ends = [next(last) for _ in texts]
                lists = encode([t or "" if end else f"{t or ''}{JOINER}{AFTER}" for t, end in zip(texts, ends)])
                for ids, end in zip(lists, ends):
                    if not end and ids.pop() != after:
                        raise ValueError("the vocabulary joins a letter to the line break before it")
                yield pa.RecordBatch.from_arrays([keys, _ids(lists)], ["doc_id", "tokens"])

    return encoded


def stored_tokens(df: DataFrame, path: str, as_text: bool = True) -> DataFrame:
    """The corpus as ``(doc_id, tokens)`` for windows and perplexity, encoded once and written to
    the shared folder as numbers, from where each use reads it.

    Without ``as_text`` the tokens stay numbers, which take a quarter of the space where they move.

    A document's part is its text and, but for the last one, the blank line that joins it to the
    next. With a byte-level vocabulary the parts are the tokens of the corpus encoded as one string
    wherever a text starts with a character that is no space; pieces mark the start of each
    document as that of a text. A null text counts as empty.
    """
    _check(path)
    place = scratch_path(df.sparkSession, "tokens")
    schema = T.StructType([df.schema["doc_id"], T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    last = F.col("doc_id") == df.agg(F.max("doc_id")).scalar()
    df.select("doc_id", "text", last.alias("last")).mapInArrow(_part_encoder(path), schema).write.parquet(place)
    stored = df.sparkSession.read.parquet(place)
    return stored.withColumn("tokens", F.col("tokens").cast("array<string>")) if as_text else stored
