"""The language network: gradients against differences, held-out accuracy, awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import langid
from mnemoframe.llm.queries import op1_language_id
from tests.llm.fixtures import documents, nothing


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    network = langid.new_network(["a", "b"], hidden=3)
    inputs, recurrent = network.inputs[0].astype(np.float64), network.recurrent[0].astype(np.float64)
    data, weights = rng.integers(97, 100, (5, 4)), rng.normal(size=(5, 3, 4))

    def loss(i, r):
        return float((langid._states(i.astype(np.float32), r.astype(np.float32), data) * weights).sum())

    tape = []
    langid._states(inputs.astype(np.float32), recurrent.astype(np.float32), data, tape)
    of_inputs, of_recurrent = langid._backpropagate(recurrent.astype(np.float32), data, tape, weights.astype(np.float32))
    step = 1e-2
    for at in [(0, 97), (4, 98), (8, 99)]:
        up, down = inputs.copy(), inputs.copy()
        up[at] += step
        down[at] -= step
        assert abs((loss(up, recurrent) - loss(down, recurrent)) / (2 * step) - of_inputs[at]) < 2e-3
    for at in [(0, 0), (4, 2), (8, 1)]:
        up, down = recurrent.copy(), recurrent.copy()
        up[at] += step
        down[at] -= step
        assert abs((loss(inputs, up) - loss(inputs, down)) / (2 * step) - of_recurrent[at]) < 2e-3


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op1_language_id(spark, folder).collect()
    assert len(rows) == len(truth)
    right = seen = 0
    for r in rows:
        lang, text = truth[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and lang is not None and len(text) >= 40:
            seen += 1
            right += r["lang_pred"] == lang
    assert seen > 100 and right / seen > 0.95


def test_awkward_rows(spark):
    docs = documents(spark, clash=("score", "lang_pred", "_text"))
    found = langid.identify(docs, langid.learnt(docs))
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == ("en" if letters else "und")
        assert 0 <= r["score"] <= 1 and (letters or r["score"] == 0)
    assert {r["_text"] for r in rows} == {"own"}


def test_nothing_to_learn(spark):
    assert langid.learnt(nothing(spark)) is None
    assert langid.learnt(documents(spark).withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.identify(documents(spark), None).collect()} == {"und"}
    assert langid.identify(nothing(spark), None).collect() == []


def test_long_text_is_the_mean_over_positions():
    network = langid.new_network(["a", "b"])
    data = np.frombuffer(b"some words of a text " * 40, dtype=np.uint8)
    whole = langid.document_probabilities(network, data, np.array([0, len(data)]))
    sizes = [min(langid.SEGMENT, len(data) - s) for s in range(0, len(data), langid.SEGMENT)]
    parts = [langid.document_probabilities(network, data[s : s + langid.SEGMENT], np.array([0, n])) * n for s, n in zip(range(0, len(data), langid.SEGMENT), sizes, strict=True)]
    assert np.allclose(whole, sum(parts) / len(data), atol=1e-5)


def test_predictions_equal_a_plain_loop():
    """Every position's label, one document, one segment and one step at a time."""
    network = langid.new_network(["a", "b", "c"], hidden=3, seed=8)
    texts = ["é", "some words of a text " * 5, "x" * 64, "", None, "Zeilen\nund Wörter " * 9]

    def states(way, data):
        state, out, h = np.zeros(3), [], 3
        for byte in data:
            x, r = network.inputs[way][:, byte].astype(float), network.recurrent[way].astype(float) @ state
            reset, update = ((1 + np.tanh(x[k : k + h] + r[k : k + h])) / 2 for k in (0, h))
            candidate = np.tanh(x[2 * h :] + reset * r[2 * h :])
            state = update * state + (1 - update) * candidate
            out.append(state)
        return out

    def plain(text):
        data = (text or "").encode()
        sums = np.zeros(3)
        for start in range(0, len(data), langid.SEGMENT):
            piece = data[start : start + langid.SEGMENT]
            for ahead, back in zip(states(0, piece), states(1, piece[::-1])[::-1], strict=True):
                logits = network.out.astype(float) @ np.concatenate([ahead, back]) + network.bias
                sums += np.exp(logits) / np.exp(logits).sum()
        return sums / max(len(data), 1)

    for first, (languages, scores) in langid._scorer(network)(pa.array(texts)):
        for k, (language, score) in enumerate(zip(languages.to_pylist(), scores.to_pylist(), strict=True)):
            wanted = plain(texts[first + k])
            if texts[first + k]:
                assert language == network.languages[wanted.argmax()] and score == pytest.approx(wanted.max(), abs=1e-5)
            else:
                assert (language, score) == ("und", 0.0)


def test_segments_are_bounded_and_from_the_text(spark):
    text = "".join(chr(97 + k % 26) + "ü" for k in range(4000))
    row = spark.createDataFrame([(text, 5), ("ab", 6)], "text string, draw long").select("text", langid._drawn_segments(F.col("text"), F.col("draw")).alias("s")).collect()
    assert len(row[0]["s"]) == langid.TRAIN_SEGMENTS and all(len(s) == langid.SEGMENT and bytes(s) in text.encode() for s in row[0]["s"])
    assert [bytes(s) for s in row[1]["s"]] == [b"ab"] and langid._filled([b"ab"]).tobytes() == b"ab" * 32
