"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled
rows. It reads whole texts as segments of bytes, labels every byte from both directions and pools
the probabilities of all positions of a document. Gates use the soft sign x / (1 + |x|), whose
derivative is simple and which needs no exponential.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, packed, small, unpacked

#: Hidden units of each direction, bytes of a segment, segments advanced together.
HIDDEN, STEPS, LANES = 8, 64, 2048
#: Segments of a row that are learned from.
PIECES = 8
#: Bound of the training sample: rows of each language.
ROWS_PER_LANGUAGE = 400
#: Range of the hash that draws the sample.
SPREAD = 1 << 31
#: A document whose pooled probability is lower is rejected by `accepted`.
FLOOR = 0.3
UNKNOWN = "und"


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _run(model: dict, side: str, x: np.ndarray, keep: bool = False):
    """States (steps, lanes, hidden) of one direction over x (steps, lanes); with keep, also what the backward pass needs."""
    wx, wh = ([np.ascontiguousarray(w) for w in np.split(model[f"w{kind}{side}"], 3, 1)] for kind in "xh")
    steps, lanes = x.shape
    h = np.zeros((lanes, wh[0].shape[0]), np.float32)
    out = np.empty((steps, *h.shape), np.float32)
    a, size = np.empty_like(h), np.empty_like(h)
    half, saved = np.float32(0.5), []

    def soft_of(k: int, add: np.ndarray) -> np.ndarray:
        np.take(wx[k], x[t], 0, out=a, mode="clip")
        np.add(a, add, out=a)
        np.abs(a, out=size)
        np.add(size, 1, out=size)
        return a / size

    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        sz, sr, inner = soft_of(0, h @ wh[0]), soft_of(1, h @ wh[1]), h @ wh[2]
        z, r = (sz * half + half, sr * half + half) if keep else (np.add(np.multiply(sz, half, out=sz), half, out=sz), np.add(np.multiply(sr, half, out=sr), half, out=sr))
        new = soft_of(2, r * inner)
        if keep:
            saved.append((t, h, np.concatenate([sz, sr], 1), z, r, inner, new))
        h = np.subtract(h, new, out=out[t])
        h *= z
        h += new
    return (out, saved) if keep else out


def _back(model: dict, side: str, x: np.ndarray, saved: list, dout: np.ndarray, grad: dict) -> None:
    """Backpropagation through time of one direction."""
    wh = model[f"wh{side}"]
    size = wh.shape[0]
    dh = np.zeros(dout.shape[1:], np.float32)
    for t, h, soft, z, r, inner, new in reversed(saved):
        dh = dh + dout[t]
        dnew = dh * (1 - z) * (1 - np.abs(new)) ** 2
        dgate = np.concatenate([dh * (h - new), dnew * inner], 1) * 0.5 * (1 - np.abs(soft)) ** 2
        db = np.concatenate([dgate, dnew * r], 1)
        np.add.at(grad[f"wx{side}"], x[t], np.concatenate([dgate, dnew], 1))
        grad[f"wh{side}"] += h.T @ db
        dh = dh * z + db @ wh.T


def _logits(model: dict, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    half = forward.shape[2]
    return forward @ model["wo"][:half] + backward @ model["wo"][half:] + model["bo"]


def _softmax(x: np.ndarray) -> np.ndarray:
    """States lie between -1 and 1, so the exponentials are safe without a shift."""
    x = np.exp(np.clip(x, -60, 60, out=x), out=x)
    x /= x @ np.ones((x.shape[-1], 1), np.float32)
    return x


def cut(text: str, rng: np.random.Generator) -> list[bytes]:
    """At most PIECES segments of STEPS bytes of a text, drawn at random, filled up with spaces."""
    raw = text.encode("utf-8", "replace")
    return [raw[at : at + STEPS].ljust(STEPS) for at in rng.integers(0, max(1, len(raw) - STEPS + 1), min(PIECES, 1 + len(raw) // STEPS)).tolist()]


def train(texts: list[str], labels: list[str], epochs: int = 6, seed: int = 7) -> dict:
    """The network for (text, label) rows; the same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    return train_segments([(label, cut(text, rng)) for text, label in zip(texts, labels, strict=True)], epochs, seed)


def train_segments(rows: list[tuple[str, list[bytes]]], epochs: int = 6, seed: int = 7) -> dict:
    """The network for (label, segments) rows."""
    names = sorted({label for label, _ in rows})
    rng = np.random.default_rng(seed)
    segments = [np.frombuffer(piece, np.uint8) for _, pieces in rows for piece in pieces]
    of = [names.index(label) for label, pieces in rows for _ in pieces]
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    model = {f"w{kind}{side}": draw(256 if kind == "x" else HIDDEN, 3 * HIDDEN) for kind in "xh" for side in "fb"}
    model |= {"wo": draw(2 * HIDDEN, len(names)), "bo": np.zeros(len(names), np.float32)}
    if len(names) > 1:
        data, target = np.array(segments), np.array(of)
        weight = (len(target) / len(names) / np.bincount(target, minlength=len(names))).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in model.items()}
        second = {k: np.zeros_like(v) for k, v in model.items()}
        step, size = 0, 256
        total = epochs * -(-len(data) // size)
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(data), size):
                use = order[at : at + size]
                x = data[use].T
                (f, sf), (b, sb) = _run(model, "f", x, True), _run(model, "b", x, True)
                d = _softmax(_logits(model, f, b))
                d[:, np.arange(len(use)), target[use]] -= 1
                d *= weight[target[use]][None, :, None] / d[..., 0].size
                grad = {k: np.zeros_like(v) for k, v in model.items()}
                half = f.shape[2]
                grad["wo"][:half] = np.tensordot(f, d, ((0, 1), (0, 1)))
                grad["wo"][half:] = np.tensordot(b, d, ((0, 1), (0, 1)))
                grad["bo"] = d.sum((0, 1))
                _back(model, "f", x, sf, d @ model["wo"][:half].T, grad)
                _back(model, "b", x, sb, d @ model["wo"][half:].T, grad)
                step += 1
                rate = 0.03 * (1 - step / (total + 1)) + 0.001
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    model[k] = (model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model | {"names": names}


def _pooled(model: dict, data: list[bytes]) -> np.ndarray:
    """Mean probabilities over all bytes of each text; no text is empty."""
    out = np.zeros((len(data), len(model["names"])))
    sizes = np.array([len(x) for x in data])
    segments = -(-sizes // STEPS)
    of = np.repeat(np.arange(len(data)), segments)
    whole = np.frombuffer(b"".join(x.ljust(n * STEPS) for x, n in zip(data, segments.tolist(), strict=True)), np.uint8).reshape(-1, STEPS)
    held = np.full(len(of), STEPS)
    held[np.cumsum(segments) - 1] -= segments * STEPS - sizes
    for at in range(0, len(of), LANES):
        lane = slice(at, at + LANES)
        x = np.ascontiguousarray(whole[lane].T)
        p = _softmax(_logits(model, _run(model, "f", x), _run(model, "b", x)))
        total = p.sum(0, dtype=np.float64)
        for i in np.flatnonzero(held[lane] < STEPS).tolist():
            total[i] = p[: held[at + i], i].sum(0, dtype=np.float64)
        np.add.at(out, of[lane], total)
    return out / sizes[:, None]


def classify(model: dict, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, pooled probability) of each text; `und`, 0 for null and for a text without a letter."""
    use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    out = [(UNKNOWN, 0.0)] * len(texts)
    if not model["names"]:
        return out
    at = 0
    while at < len(use):
        data, n, first = [], 0, at
        while at < len(use) and (not data or n < STEPS * LANES * 4):
            data.append(texts[use[at]].encode("utf-8", "replace"))
            n += len(data[-1])
            at += 1
        pooled = _pooled(model, data)
        for i, k, p in zip(use[first:at], pooled.argmax(1).tolist(), pooled.max(1).tolist(), strict=True):
            out[i] = (model["names"][k], min(1.0, float(p)))
    return out


def held_out() -> F.Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> dict:
    """Train on at most `rows` rows of each language, chosen by a hash of the id over all rows.

    The rows of least hash are taken; a language's count tells below which hash about four times as
    many lie, so only those are read whole, and only their segments leave a task: the driver gets at most
    PIECES * STEPS bytes of a row, whatever its length. Rows without id, language or
    text, and held-out rows, are not used. Without a labelled row the
    network knows no language and every text is `und`.
    """
    docs = docs.select("doc_id", "text", "lang")
    usable = docs.filter("doc_id is not null and lang is not null and text is not null and text <> ''").filter(~held_out())
    usable = usable.withColumn("key", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    counts = checkpointed(usable.groupBy("lang").agg(F.count("*").alias("n")))

    @F.arrow_udf("array<binary>")
    def pieces(text: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array([cut(t, np.random.default_rng(k)) for t, k in zip(text.to_pylist(), key.to_pylist(), strict=True)], pa.list_(pa.binary()))

    likely = usable.join(small(counts), "lang").filter(F.col("key") <= F.lit(4.0 * rows * SPREAD) / F.col("n"))
    likely = checkpointed(likely.select("lang", "key", "doc_id", pieces("text", "key").alias("pieces")))
    order = Window.partitionBy("lang").orderBy("key", "doc_id", "pieces")
    chosen = likely.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows)
    return train_segments(sorted((r["lang"], [bytes(x) for x in r["pieces"]]) for r in chosen.collect()))


def predictor(model: dict):
    """An Arrow UDF: text to (lang_pred, score)."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 500):
                out += classify(model, batch.slice(at, 500).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; ids, languages and sources never enter a prediction."""
    model = model or fit(docs)
    out = docs.select("doc_id", held_out().alias("held_out"), predictor(model)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, floor: float = FLOOR, model: dict | None = None) -> DataFrame:
    """docs without the rows that have no letter or whose pooled probability is under floor."""
    model = model or fit(docs)
    marked = packed(docs).select("_row", predictor(model)("_row.text").alias("_p"))
    return unpacked(marked.filter((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= floor)), docs.columns)
