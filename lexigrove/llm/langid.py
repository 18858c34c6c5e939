"""Language identification by a bidirectional gated recurrent network over bytes.

The network (two GRUs of ``HIDDEN`` units, one in each direction, and a softmax layer on both states) is trained in numpy
by backpropagation through time, and labels every byte of a text; a document's probabilities are the mean of its bytes'.
A text is read in windows of ``WINDOW`` bytes, from its first byte to its last, with fresh states in each, in training
and in prediction alike, so any number of windows go through one matrix product and a result does not depend on how rows
are grouped.

Training uses at most ``SAMPLE`` documents for each language that occurs, those with the smallest id hashes, and of a long one a piece of ``PIECE`` characters that its hash selects. Prediction covers whole texts.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; so does everything if there is
nothing to learn from; ties go to the first language by name; a null id is predicted like any other but not learned from;
repeated rows get equal results; columns named ``lang_pred`` and ``score`` in the input are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import give_back, string_buffers

HIDDEN, WINDOW, STEPS, BATCH, RATE = 8, 64, 240, 192, 0.02
SAMPLE, PIECE = 300, 2000
UNKNOWN = "und"


@dataclass
class Network:
    """Weights by direction: ``byte`` 2 x 256 x 3h (update, reset, candidate), ``gate`` 2 x h x 2h, ``cand`` 2 x h x h."""

    langs: list[str]
    byte: np.ndarray
    gate: np.ndarray
    cand: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("byte", "gate", "cand", "out", "bias")}


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    byte = draw(2, 256, 3 * hidden)
    return Network(langs, byte, draw(2, hidden, 2 * hidden), draw(2, hidden, hidden), draw(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) + np.float32(0.5) * np.tanh(np.float32(0.5) * x)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of windows x (time x batch bytes) with labels y (batch), by backpropagation through time."""
    steps, batch = x.shape
    h = net.cand.shape[1]
    both = np.stack([x, x[::-1]], 1)  # time x direction x batch
    direction = np.arange(2)[:, None]
    state, past = np.zeros((2, batch, h), np.float32), []
    states = np.empty((steps, 2, batch, h), np.float32)
    for t in range(steps):
        a = net.byte[direction, both[t]]
        zr = _sigmoid(a[..., : 2 * h] + state @ net.gate)
        z, r = zr[..., :h], zr[..., h:]
        c = np.tanh(a[..., 2 * h :] + (r * state) @ net.cand)
        past.append((state, z, r, c))
        state = state + z * (c - state)
        states[t] = state
    joint = np.concatenate([states[:, 0], states[::-1, 1]], -1)  # time x batch x 2h
    logits = joint @ net.out + net.bias
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    rows = np.arange(batch)
    loss = float(-np.log(p[:, rows, y] + 1e-9).mean())
    d = p
    d[:, rows, y] -= 1
    d /= steps * batch
    g = {"out": np.einsum("tbh,tbk->hk", joint, d), "bias": d.sum((0, 1))}
    into = d @ net.out.T
    into = np.stack([into[..., :h], into[::-1, :, h:]], 1)
    d_gate, d_cand = np.zeros_like(net.gate), np.zeros_like(net.cand)
    d_in = np.empty((steps, 2, batch, 3 * h), np.float32)
    carry = np.zeros((2, batch, h), np.float32)
    gate_t, cand_t = net.gate.transpose(0, 2, 1), net.cand.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        old, z, r, c = past[t]
        carry = carry + into[t]
        dc = carry * z * (1 - c * c)
        dz = carry * (c - old) * z * (1 - z)
        back = dc @ cand_t
        dr = back * old * r * (1 - r)
        dzr = np.concatenate([dz, dr], -1)
        d_cand += (r * old).transpose(0, 2, 1) @ dc
        d_gate += old.transpose(0, 2, 1) @ dzr
        d_in[t, ..., : 2 * h], d_in[t, ..., 2 * h :] = dzr, dc
        carry = carry * (1 - z) + back * r + dzr @ gate_t
    d_byte = np.zeros_like(net.byte)
    for k in range(2):
        seen, rows_in = both[:, k].ravel(), d_in[:, k].reshape(-1, 3 * h)
        order = np.argsort(seen, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(seen[order].astype(np.int16)) != 0])
        d_byte[k, seen[order][starts]] = np.add.reduceat(rows_in[order], starts)
    return loss, g | {"byte": d_byte, "gate": d_gate, "cand": d_cand}


def train(texts: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> Network:
    """A network fitted to (language, text) pairs by Adam; every language has an equal share of the batches."""
    langs = sorted({lang for lang, _ in texts})
    net = fresh(langs, seed=seed)
    if len(langs) < 2:
        return net
    pools = []
    for lang in langs:
        raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for x, t in texts if x == lang and t]
        joined = np.concatenate([np.r_[r, np.zeros(-len(r) % WINDOW, np.uint8)] for r in raw] or [np.zeros(WINDOW, np.uint8)])
        pools.append(np.r_[joined, joined[: -len(joined) % WINDOW]])
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(w) for k, w in net.weights().items()}
    second = {k: np.zeros_like(w) for k, w in net.weights().items()}
    for step in range(1, steps + 1):
        turn = (step - 1) * BATCH if len(langs) > BATCH else 0  # more languages than a batch holds take turns
        y = (np.arange(BATCH) + turn) % len(langs)
        x = np.empty((WINDOW, BATCH), np.uint8)
        for i, k in enumerate(y):
            at = int(rng.integers(0, len(pools[k]) - WINDOW + 1))
            x[:, i] = pools[k][at : at + WINDOW]
        _, g = gradients(net, x, y)
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, w in net.weights().items():
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] * g[k]
            w -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Predictor:
    """A network laid out for prediction: units are rows, windows columns."""

    BLOCK = 2048

    def __init__(self, net: Network):
        h = net.cand.shape[1]
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.h, self.langs = h, net.langs
        self.byte = [np.ascontiguousarray((net.byte[k] * half).T) for k in range(2)]
        self.gate = [np.ascontiguousarray((net.gate[k] * np.float32(0.5)).T) for k in range(2)]
        self.cand = [np.ascontiguousarray(net.cand[k].T) for k in range(2)]
        self.out = np.ascontiguousarray(net.out.T)
        self.bias = net.bias[:, None]

    def windows(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of the first ``lengths`` bytes: languages x windows. x: time x windows."""
        h, (steps, n) = self.h, x.shape
        x = x.astype(np.intp)
        states = np.empty((2, steps, h, n), np.float32)
        for k in range(2):
            state = np.zeros((h, n), np.float32)
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                a = self.byte[k].take(x[t], axis=1)
                zr = a[: 2 * h]
                zr += self.gate[k] @ state
                np.tanh(zr, out=zr)
                zr += np.float32(1)
                zr *= np.float32(0.5)
                c = a[2 * h :]
                c += self.cand[k] @ (zr[h:] * state)
                np.tanh(c, out=c)
                c -= state
                c *= zr[:h]
                state = np.add(state, c, out=states[k, t])
        total = np.zeros((len(self.langs), n), np.float32)
        for t in range(steps):
            p = self.out[:, :h] @ states[0, t]
            p += self.out[:, h:] @ states[1, t]
            p += self.bias
            np.exp(p, out=p)
            p *= (lengths > t) / p.sum(0)
            total += p
        return total

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities, texts x languages, of the texts data[offsets[i]:offsets[i + 1]]; zeros for empty ones."""
        sizes = np.diff(offsets)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = offsets[:-1][owner] + within * WINDOW
        length = np.minimum(WINDOW, offsets[1:][owner] - begin)
        out = np.zeros((len(sizes), len(self.langs)))
        ramp = np.arange(WINDOW)
        for at in range(0, len(owner), self.BLOCK):
            part = slice(at, at + self.BLOCK)
            where = np.minimum(begin[part, None] + ramp, len(data) - 1)
            x = np.where(ramp < length[part, None], data[where], 0).T
            sums = self.windows(x, length[part])
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(owner[part], sums[k], len(sizes))
        return out / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """The bounded sample as (language, text): one pass counts languages, one reads the selected rows."""
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    counts = known.groupBy(lang_col).count().collect()
    if not counts:
        return []
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    # 1.5 times the wanted number is expected below the limit; all if there are few
    share = [F.lit(x) for lang, n in counts for x in (lang, min(1.0, (1.5 * SAMPLE + 30) / n) * (1 << 30))]
    share = F.create_map(*share)[F.col(lang_col)]
    letters = F.col(text_col).rlike(r"\p{L}")
    begin = F.pmod(hashed, F.greatest(F.length(text_col) - PIECE, F.lit(0)) + 1).cast("int") + 1
    rows = known.where((hashed < share) & letters).select(
        F.col(lang_col).cast("string").alias("lang"), hashed.alias("h"), F.substring(F.col(text_col), begin, F.lit(PIECE)).alias("t")
    )
    by_lang: dict[str, list] = {}
    for lang, h, t in rows.collect():
        by_lang.setdefault(lang, []).append((h, t))
    return [(lang, t) for lang in sorted(by_lang) for _, t in sorted(by_lang[lang])[:SAMPLE]]


def identify(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*columns, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("l_letter"))
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = columns.index(text_col)

    def predict(batches):
        predictor = Predictor(sent.value)
        names = np.array([*sent.value.langs, UNKNOWN], object)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                letter = part.column(len(columns)).to_numpy(zero_copy_only=False)
                if len(names) > 1:
                    p = predictor.texts(*string_buffers(part.column(at)))
                    best = np.where(letter, p.argmax(1), len(names) - 1)
                    score = np.where(letter, p.max(1), 0.0)
                else:
                    best, score = np.zeros(len(letter), int), np.zeros(len(letter))
                made = [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *made], [*columns, "lang_pred", "score"])
        give_back()

    return kept.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the rows of ``docs`` that are not held out and labels all of them."""
    net = train(training_sample(docs, ~held_out(F.col(id_col)), id_col, text_col, lang_col))
    return identify(docs, net, text_col)
