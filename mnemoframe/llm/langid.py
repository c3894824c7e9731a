"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in segments of ``SEGMENT``, forwards and
backwards, and labels every position; a document's probabilities are the means
over all its positions.  It is trained in numpy by backpropagation through
time.  Segments are the columns of each matrix, so one step of the recurrence
handles thousands of positions.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from . import bytesvec
from .columns import scored
from .samples import per_class

UNDETERMINED = "und"
SEGMENT = 64
HIDDEN = 12
#: Documents of each language, and segments of each document, that training reads at most.
TRAIN_DOCUMENTS, TRAIN_SEGMENTS = 400, 4
EPOCHS, BATCH, RATE = 6, 128, 0.02
#: Steps of training at least: few segments are gone through more often.
LEAST_STEPS = 200
#: Segments that are scored at once.
_COLUMNS = 4096


@dataclass
class Network:
    """Weights of both directions (axis 0) and of the output layer.

    ``inputs`` has a column of 3 * HIDDEN values for each byte (reset, update
    and candidate), ``recurrent`` the matrix that acts on the state.
    """

    languages: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    return Network(
        languages,
        draw(2, 3 * hidden, 256, scale=0.3),
        draw(2, 3 * hidden, hidden, scale=0.5 / hidden**0.5),
        draw(len(languages), 2 * hidden, scale=0.5 / hidden**0.5),
        np.zeros(len(languages), dtype=np.float32),
    )


def _states(inputs: np.ndarray, recurrent: np.ndarray, data: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States after each row of ``data`` (steps x columns); gates are ``(1 + tanh) / 2``.  ``tape`` gets what backpropagation needs."""
    steps, columns = data.shape
    hidden = recurrent.shape[1]
    states = np.empty((steps, hidden, columns), dtype=np.float32)
    state = np.zeros((hidden, columns), dtype=np.float32)
    from_input, from_state = (np.empty((3 * hidden, columns), dtype=np.float32) for _ in range(2))
    for t in range(steps):
        np.take(inputs, data[t], axis=1, out=from_input, mode="clip")
        np.matmul(recurrent, state, out=from_state)
        gates = from_input[: 2 * hidden]
        gates += from_state[: 2 * hidden]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        reset, update = gates[:hidden], gates[hidden:]
        candidate = from_state[2 * hidden :]
        if tape is not None:
            tape.append((state, gates.copy(), candidate.copy()))
        candidate *= reset
        candidate += from_input[2 * hidden :]
        np.tanh(candidate, out=candidate)
        if tape is not None:
            tape[-1] += (candidate.copy(),)
        np.subtract(state, candidate, out=states[t])
        states[t] *= update
        states[t] += candidate
        state = states[t]
    return states


def _backpropagate(recurrent: np.ndarray, data: np.ndarray, tape: list, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input and the recurrent weights, given those of the states."""
    hidden, columns = recurrent.shape[1], data.shape[1]
    of_inputs = np.zeros((256, 3 * hidden), dtype=np.float32)
    of_recurrent = np.zeros_like(recurrent)
    carried = np.zeros((hidden, columns), dtype=np.float32)
    for t in range(len(tape) - 1, -1, -1):
        before, gates, projected, candidate = tape[t]
        reset, update = gates[:hidden], gates[hidden:]
        carried = carried + upstream[t]
        pre_candidate = carried * (1 - update) * (1 - candidate**2)
        pre_update = carried * (before - candidate) * 2 * update * (1 - update)
        pre_reset = pre_candidate * projected * 2 * reset * (1 - reset)
        by_input = np.concatenate([pre_reset, pre_update, pre_candidate])
        by_state = np.concatenate([pre_reset, pre_update, pre_candidate * reset])
        np.add.at(of_inputs, data[t], by_input.T)
        of_recurrent += by_state @ before.T
        carried = carried * update + recurrent.T @ by_state
    return of_inputs.T, of_recurrent


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=0)
    np.exp(logits, out=logits)
    return logits / logits.sum(axis=0)


def train(segments: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int | None = None, seed: int = 3) -> Network:
    """Fit a network to segments (rows of SEGMENT bytes) and the index of each one's language, with Adam.

    Every position of a segment is to be labelled with its language.
    """
    epochs = epochs or max(EPOCHS, -(-LEAST_STEPS // -(-len(segments) // BATCH)))
    network, rng = new_network(languages, seed=seed), np.random.default_rng(seed)
    weights = [network.inputs, network.recurrent, network.out, network.bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    done = 0
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(segments))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            data = np.ascontiguousarray(segments[rows].T)
            tapes: tuple[list, list] = ([], [])
            ahead = _states(network.inputs[0], network.recurrent[0], data, tapes[0])
            back = _states(network.inputs[1], network.recurrent[1], data[::-1], tapes[1])[::-1]
            both = np.concatenate([ahead, back], axis=1)
            error = np.stack([_softmax(network.out @ both[t] + network.bias[:, None]) for t in range(len(data))])
            error[:, labels[rows], np.arange(len(rows))] -= 1
            error /= len(rows) * len(data)
            upstream = np.einsum("kh,tkc->thc", network.out, error, optimize=True)
            hidden = ahead.shape[1]
            one = _backpropagate(network.recurrent[0], data, tapes[0], upstream[:, :hidden])
            other = _backpropagate(network.recurrent[1], data[::-1], tapes[1], upstream[::-1, hidden:])
            gradients = [np.stack([one[0], other[0]]), np.stack([one[1], other[1]]), np.einsum("tkc,thc->kh", error, both, optimize=True), error.sum(axis=(0, 2))]
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in gradients))))
            done += 1
            for weight, gradient, (m, v) in zip(weights, gradients, moments, strict=True):
                gradient = gradient / norm
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient**2 - v)
                weight -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
    return network


def document_probabilities(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities (documents x languages) over all bytes of each document; zeros for an empty one."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    first = offsets[owner] + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(offsets[owner + 1] - first, SEGMENT)
    sums = np.zeros((len(lengths), len(network.languages)))
    # Segments of one length go together, so that none is padded.
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        steps = int(size[order[at]])
        same = order[at : at + _COLUMNS]
        same = same[: int(np.searchsorted(-size[same], -steps, side="right"))]
        at += len(same)
        columns = data[first[same][None, :] + np.arange(steps)[:, None]]
        ahead = _states(network.inputs[0], network.recurrent[0], columns)
        back = _states(network.inputs[1], network.recurrent[1], columns[::-1])[::-1]
        hidden, total = ahead.shape[1], 0.0
        for t in range(steps):
            logits = network.out[:, :hidden] @ ahead[t]
            logits += network.out[:, hidden:] @ back[t]
            logits += network.bias[:, None]
            total = total + _softmax(logits)
        np.add.at(sums, owner[same], total.T)
    return sums / np.maximum(lengths, 1)[:, None]


def _drawn_segments(text: Column, draw: Column) -> Column:
    """Up to TRAIN_SEGMENTS segments of a text's bytes at places that ``draw`` decides; a shorter text is its only one."""
    data = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    count = F.least(F.lit(TRAIN_SEGMENTS), F.greatest(F.lit(1), F.floor(n / F.lit(SEGMENT)))).cast("int")
    starts = F.greatest(n - F.lit(SEGMENT), F.lit(0)) + F.lit(1)
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.substring(data, (F.pmod(F.xxhash64(draw, k), starts.cast("long")) + F.lit(1)).cast("int"), F.lit(SEGMENT)))


def _filled(segments: list[bytes]) -> np.ndarray:
    """Segments as rows of bytes; shorter ones are repeated to fill one."""
    return np.array([np.frombuffer((s * (SEGMENT // len(s) + 1))[:SEGMENT], dtype=np.uint8) for s in segments])


def learnt(docs: DataFrame, for_training: Column | None = None) -> Network | None:
    """A network for the languages named in ``lang``, or None where no labelled row has a text with a letter.

    Reads TRAIN_SEGMENTS segments of at most TRAIN_DOCUMENTS documents for each
    language, those with the smallest hashes of their ids and texts.  Segments
    are cut in the tasks: the driver gets a few hundred bytes a document.
    """
    labelled = docs if for_training is None else docs.where(for_training)
    labelled = labelled.where(F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("hash"))
    labelled = labelled.select("lang", "hash", _drawn_segments(F.col("text"), F.col("hash")).alias("segments"))
    rows = per_class(labelled, "lang", F.col("hash"), TRAIN_DOCUMENTS)
    if not rows:
        return None
    languages = sorted({row["lang"] for row in rows})
    segments = [(bytes(s), languages.index(row["lang"])) for row in rows for s in row["segments"]]
    return train(_filled([s for s, _ in segments]), np.array([k for _, k in segments]), languages)


def _has_letter(block: bytesvec.Block) -> np.ndarray:
    """Whether each text has a letter; texts without an ASCII letter are decoded to see."""
    lower = bytesvec.LOWER_ASCII[block.data]
    counts = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    found = np.diff(counts[block.offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(block.offsets) > 0)):
        found[i] = any(c.isalpha() for c in block.text_bytes(i).decode("utf-8", "replace"))
    return found


def _scorer(network: Network):
    """Each text's language and its score."""

    def run(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for block in bytesvec.blocks(texts):
            has_letter = _has_letter(block)
            probabilities = document_probabilities(network, block.data, block.offsets)
            best = probabilities.argmax(axis=1)
            score = np.where(has_letter, np.clip(probabilities[np.arange(len(block)), best], 0, 1), 0.0)
            found = [network.languages[k] if has else UNDETERMINED for k, has in zip(best, has_letter, strict=True)]
            yield block.first, [pa.array(found, pa.string()), pa.array(score)]

    return run


def identify(docs: DataFrame, network: Network | None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` (a learnt language) and ``score`` (its mean probability, 0 to 1).

    A null text, or one without a letter, gives ``und`` and score 0; so does
    every text where there is no network.  Ties go to the language that sorts
    first.  Repeated rows are each scored alike; an empty table stays empty.
    Columns that are already called ``lang_pred`` or ``score`` are replaced;
    without ``keep_text`` the text is left out.
    """
    docs = docs.drop("lang_pred", "score")
    if network is None:
        return (docs if keep_text else docs.drop("text")).withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    return scored(docs, _scorer(network), {"lang_pred": StringType(), "score": DoubleType()}, keep_text)
