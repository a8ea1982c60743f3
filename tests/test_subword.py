"""Sub-word tokens against the libraries called directly, and windows over them."""

import random
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pytest

from bitledger.catalog.corpus import VOCABULARY
from bitledger.operators import context_model as cm
from bitledger.operators import corpus, subword
from tests.test_context_model import model_of, windowed

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="vocabularies are absent")


def texts():
    rng = random.Random(4)
    plain = [" ".join(rng.choice(["river", "stone's", "12,5", "naïve", "日本", "don't", "x\ty"]) for _ in range(rng.randrange(1, 40))) for _ in range(20)]
    return ["First text.", "", *plain, "<|endoftext|> is text", "trailing  \n", "end"]


def docs(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


def whole(values, path=VOCABULARY):
    return [str(k) for k in subword._load(path)([subword.JOINER.join(values)])[0]]


def test_stream_equals_the_corpus_encoded_as_one_string(spark):
    values = [t for t in texts() if t]
    rows = subword.stored_tokens(docs(spark, values), VOCABULARY).orderBy("doc_id").collect()
    assert [k for r in rows for k in r.tokens] == whole(values)


def test_windows_and_perplexity_run_on_sub_words(spark):
    values = [t for t in texts() if t]
    stream = whole(values)
    tokens = subword.stored_tokens(docs(spark, values), VOCABULARY)
    windows = {r.begin: r for r in corpus.window_tokens(tokens, 16, 32).collect()}
    previous = 0
    for begin in range(0, len(stream), 16):
        end = min(begin + 32, len(stream))
        assert windows[begin].tokens == stream[begin:end] and windows[begin].target_len == end - previous
        previous = end
        if end == len(stream):
            break
    row = cm.context_perplexity(tokens, stride=16, max_length=32).first()
    assert (row.n_tokens, row.perplexity) == (len(stream), pytest.approx(windowed(stream, model_of(stream), 16, 32), abs=1e-3))


@pytest.mark.parametrize("path", [VOCABULARY, PIECES])
def test_sample_ids_are_cut_and_nulls_stay(spark, path):
    values = [*texts(), None]
    rows = {r.doc_id: r.ids for r in subword.token_ids(docs(spark, values), path, 10).collect()}
    for k, text in enumerate(values):
        assert rows[k] == (None if text is None else subword._load(path)([text])[0][:10])
    assert subword.token_ids(docs(spark, []), path).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        subword.vocabulary_tokenizer("ranks.txt")


def test_texts_are_encoded_in_short_runs(monkeypatch):
    held = []
    encode = subword._load(VOCABULARY)
    monkeypatch.setitem(subword._LOADED, VOCABULARY, lambda texts: held.append(sum(map(len, texts))) or encode(texts))
    values = ["some words of a text " * 500] * 200 + [None, ""]
    found = subword.vocabulary_tokenizer(VOCABULARY)(pd.Series(values))
    assert found.iloc[0] == [str(k) for k in encode(values[:1])[0]] and found.iloc[-2] is None and found.iloc[-1] == []
    assert len(held) > 1 and max(held) <= subword.RUN_CHARS
    held.clear()
    batch = pa.RecordBatch.from_arrays([pa.array(range(202)), pa.array(values), pa.array([False] * 202)], ["doc_id", "text", "last"])
    parts = list(subword._part_encoder(VOCABULARY)([batch]))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(202))
    assert len(parts) > 1 and max(held) <= subword.RUN_CHARS + 3 * 202
