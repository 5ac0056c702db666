"""Language of texts by a bidirectional gated recurrent network over bytes, trained here by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import held_out, text_bytes, text_chunks

HIDDEN = 8
#: Bytes that the network reads in one go; a text is cut into stretches of this length.
STRETCH = 64
PAD = 256
#: Bound on what training sees: stretches of text per language, from as many documents.
SAMPLE_PER_LANGUAGE = 1000
SAMPLE_CHARS = 60
STEPS = 220
BATCH = 256
#: Stretches that are labelled at once; bounds a task's memory.
AT_ONCE = 2048


def _halves(hidden: int) -> np.ndarray:
    """Gates are computed as (1 + tanh(x / 2)) / 2."""
    return np.concatenate([np.full(2 * hidden, 0.5), np.ones(hidden)]).astype(np.float32)


@dataclass
class Network:
    """Weights: for each direction the input table (byte to gates), gate and candidate matrices; the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def new(languages: list[str], hidden: int = HIDDEN, seed: int = 4) -> Network:
        random = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"{d}_in"] = random.normal(0, 0.4, (257, 3 * hidden))
            w[f"{d}_in"][:, :hidden] -= 1  # gates begin nearly shut: long memory
            w[f"{d}_gates"] = random.normal(0, hidden**-0.5, (hidden, 2 * hidden))
            w[f"{d}_new"] = random.normal(0, hidden**-0.5, (hidden, hidden))
            w[f"{d}_out"] = random.normal(0, hidden**-0.5, (hidden, len(languages)))
        w["bias"] = np.zeros(len(languages))
        return Network(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, d: str, x: np.ndarray, trace: bool = False):
        """States after each byte; ``x`` is (time, stretch). At padding the state stays as it is."""
        w, hidden = self.weights, self.weights[f"{d}_new"].shape[0]
        table = w[f"{d}_in"].copy()
        table[PAD, :hidden] = -40  # the update gate is shut
        tables = [np.ascontiguousarray(m) for m in np.split(table * _halves(hidden), 3, axis=1)]
        into_z, into_r = (np.ascontiguousarray(m) for m in np.split(w[f"{d}_gates"] * np.float32(0.5), 2, axis=1))
        new = w[f"{d}_new"]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        states = np.empty((*x.shape, hidden), np.float32)
        h = np.zeros((x.shape[1], hidden), np.float32)
        kept = {}
        for t in steps:
            z, r, c = (m.take(x[t], axis=0) for m in tables)
            for gate, into in ((z, into_z), (r, into_r)):
                gate += h @ into
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
            c += (r * h) @ new
            np.tanh(c, out=c)
            if trace:
                kept[t] = (h, z, r, c)
            move = c - h
            move *= z
            h = np.add(h, move, out=states[t])
        return states, kept

    def position_scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities as (language, time, stretch) at each position of ``x`` (time, stretch)."""
        w = self.weights
        out = self._run("f", x)[0].reshape(x.size, -1) @ w["f_out"]
        out += self._run("b", x)[0].reshape(x.size, -1) @ w["b_out"]
        out += w["bias"]
        p = np.ascontiguousarray(out.T)
        np.minimum(p, 60, out=p)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, *x.shape)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradient, through all time steps of both directions."""
        w = self.weights
        runs = {d: self._run(d, x, trace=True) for d in "fb"}
        logits = runs["f"][0] @ w["f_out"] + runs["b"][0] @ w["b_out"] + w["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        real = (x != PAD).astype(np.float32)
        total = max(real.sum(), 1)
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(np.maximum(p[:, rows, label], 1e-12)) * real).sum() / total)
        error = p
        error[:, rows, label] -= 1
        error *= (real / total)[:, :, None]
        grads = {"bias": error.sum(axis=(0, 1))}
        for d in "fb":
            states, kept = runs[d]
            hidden = states.shape[2]
            grads[f"{d}_out"] = np.einsum("tbh,tbk->hk", states, error)
            from_out = error @ w[f"{d}_out"].T
            table, gates, new = np.zeros_like(w[f"{d}_in"]), np.zeros_like(w[f"{d}_gates"]), np.zeros_like(w[f"{d}_new"])
            back = np.zeros_like(from_out[0])
            for t in (range(len(x) - 1, -1, -1) if d == "f" else range(len(x))):
                h, z, r, c = kept[t]
                back = back + from_out[t]
                dc = back * z * (1 - c * c)
                inner = dc @ w[f"{d}_new"].T
                dz = back * (c - h) * z * (1 - z)
                dr = inner * h * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                new += (r * h).T @ dc
                gates += h.T @ dg
                np.add.at(table, x[t], np.concatenate([dg, dc], axis=1))
                back = back * (1 - z) + inner * r + dg @ w[f"{d}_gates"].T
            table[PAD] = 0
            grads |= {f"{d}_in": table, f"{d}_gates": gates, f"{d}_new": new}
        return loss, grads


def train(stretches: list[bytes], labels: list[str], steps: int = STEPS, batch: int = BATCH, hidden: int = HIDDEN, seed: int = 4) -> Network | None:
    """A network for the languages among ``labels``; batches hold the languages equally often. None without labels."""
    languages = sorted(set(labels))
    if not languages:
        return None
    network = Network.new(languages, hidden, seed)
    x = padded(stretches, STRETCH)
    y = np.searchsorted(languages, labels)
    random = np.random.default_rng(seed)
    groups = [np.flatnonzero(y == k) for k in range(len(languages))]
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([random.choice(g, max(1, batch // len(groups))) for g in groups])
        _, grads = network.gradients(x[:, pick], y[pick])
        rate = 0.03 * min(1, step / 20) * (1 - step / (steps + 1))
        norm = max(1, float(np.sqrt(sum((g**2).sum() for g in grads.values()))))
        for k, g in grads.items():
            g = g / norm
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            network.weights[k] = (network.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def padded(stretches: list[bytes], length: int) -> np.ndarray:
    """Bytes as (time, stretch), padded at the end."""
    out = np.full((len(stretches), length), PAD, np.intp)
    for row, s in zip(out, stretches, strict=True):
        row[: min(len(s), length)] = np.frombuffer(s[:length], np.uint8)
    return np.ascontiguousarray(out.T)


def labelled(network: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: summed probabilities over all positions, and how many positions each language wins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pieces = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(sizes) - sizes)[owner] + within * STRETCH
    lengths = np.minimum(sizes[owner] - within * STRETCH, STRETCH)
    data = np.frombuffer(b"".join(texts) + bytes(STRETCH), np.uint8)
    k = len(network.languages)
    sums, wins = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64)
    steps = np.arange(STRETCH)[:, None]
    for at in range(0, len(owner), AT_ONCE):
        own, size = owner[at : at + AT_ONCE], lengths[at : at + AT_ONCE]
        x = data[starts[None, at : at + AT_ONCE] + steps].astype(np.intp)
        real = steps < size
        x[~real] = PAD
        p = network.position_scores(x)
        p *= real
        best = p.max(axis=0)
        taken = ~real
        for c in range(k):
            sums[:, c] += np.bincount(own, p[c].sum(axis=0), len(texts))
            won = (p[c] == best) & ~taken
            taken |= won
            wins[:, c] += np.bincount(own, won.sum(axis=0), len(texts)).astype(np.int64)
    return sums, wins


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``per_language`` stretches of each language, one of a document, from rows that :func:`held_out` leaves.

    The number of rows of each language gives the share of rows, by a hash of the id, that are looked at, about three
    times what is needed; so a language with most rows is not gathered in one place.
    """
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0)).select("lang", "doc_id", "text")
    sizes = usable.groupBy("lang").count()
    share = F.least(F.lit(1.0), 3.0 * per_language / F.col("count"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    at = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    some = usable.join(F.broadcast(sizes), "lang").filter((F.pmod(order, F.lit(1_000_000)) / 1_000_000.0) < share)
    some = some.select("lang", F.substring(F.col("text"), at, F.lit(chars)).alias("stretch"), order.alias("o"))
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "stretch"))).filter(F.col("r") <= per_language)
    return [(r["lang"], r["stretch"]) for r in ranked.orderBy("lang", "r").collect()]


def identified(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, shares`` for each row of ``docs`` (``doc_id, text, lang``).

    The network labels every byte of the whole text; probabilities are averaged over the text, ``score`` is
    that of the predicted language, ``shares`` the part of positions that each language wins. Training sees a bounded sample
    of labelled rows (:func:`training_sample`). Null texts and texts without a letter are ``und`` with score 0, as are all
    texts if nothing is labelled; repeated rows give a row each; an empty table none; other columns are not used.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sample = training_sample(docs)
    network = train([s.encode() for _, s in sample], [lang for lang, _ in sample], steps)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                if not part.num_rows:
                    continue
                sums, wins = labelled(network, text_bytes(part.column("text")))
                whole = np.maximum(sums.sum(axis=1), 1e-9)
                best = sums.argmax(axis=1)
                shares = (wins / np.maximum(wins.sum(axis=1), 1)[:, None]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("letters"), pa.array([network.languages[b] for b in best]),
                     pa.array(np.clip(sums[np.arange(len(best)), best] / whole, 0, 1)),
                     pa.array([list(zip(network.languages, s, strict=True)) for s in shares], pa.map_(pa.string(), pa.float64()))],
                    names=["doc_id", "letters", "best", "p", "shares"],
                )

    asked = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if network is None:
        none = F.lit(None).cast("map<string,double>")
        out = asked.select("doc_id", F.lit(False).alias("letters"), F.lit("und").alias("best"), F.lit(0.0).alias("p"), none.alias("shares"))
    else:
        out = asked.mapInArrow(predict, "doc_id bigint, letters boolean, best string, p double, shares map<string,double>")
    return out.select(
        "doc_id", held_out().alias("held_out"), F.when(F.col("letters"), F.col("best")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"), "shares",
    )
