"""Operator 8: language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes forwards and backwards, across words, and labels every position with probabilities of
the languages; a document's probabilities are the mean over its letters. Letters are lower-cased, and what stands
between two words is one blank. States begin anew every SPAN bytes, so a task reads many stretches of many texts at once.

It is trained here, by backpropagation through time in numpy, on a bounded sample of the labelled
documents that are not held out: about `most` documents, the same number of each language (one at least, so every
language can be predicted), drawn by a hash of doc_id and text, and stretches from anywhere in their texts.
Predictions see texts only.

The network has one output more, for no language: it learns it from noise, stretches of the sample with their bytes in
disorder and random letters. A text is rejected (`accepted`, the pipeline's stage) if it is `und`, or if more than NONE of
its positions' probability is for none. PRIOR further positions without any doubt are counted, so that a few odd letters
reject no short text; texts in several languages stay, since each of their positions has one.

Defined results: a null text or one without any letter gets `und` and score 0, as does everything where no
labelled document can be learned from; a null doc_id counts as an empty text in the split; each row is
judged by itself; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import kernels as K

HIDDEN = 16
#: Bytes that are read in one go, and stretches of them that are read side by side.
SPAN, ROWS = 64, 2048
#: What may be for no language of a text's probability, and the positions without doubt that are counted with its own.
NONE, PRIOR = 0.7, 32
UNKNOWN = "und"

#: Bytes that belong to words: ASCII letters, and all bytes of other characters.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class BiGRU:
    """weights: for each direction x (256, 3H), u (H, 3H), b (3H); out (2H, languages and none) and its bias."""

    def __init__(self, langs: list[str], seed: int = 8):
        rng, h, n = np.random.default_rng(seed), HIDDEN, len(langs) + 1
        self.langs = langs
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.w["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.w["c" + d] = np.zeros(3 * h, np.float32)
        self.w["o"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, n)).astype(np.float32)
        self.w["p"] = np.zeros(n, np.float32)

    def states(self, chars: np.ndarray, alive: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """(SPAN, rows, H): the state after each byte, read from either end; chars (SPAN, rows), of which the first alive[t] are real."""
        h, kind = HIDDEN, self.w["u" + d].dtype
        # a sigmoid is half a tanh of half its argument
        gates, new = 0.5 * (self.w["x" + d] + self.w["c" + d])[:, : 2 * h], (self.w["x" + d] + self.w["c" + d])[:, 2 * h :]
        ugates, unew = np.ascontiguousarray(0.5 * self.w["u" + d][:, : 2 * h]), np.ascontiguousarray(self.w["u" + d][:, 2 * h :])
        gates, new = gates.astype(kind), np.ascontiguousarray(new)
        out = np.zeros((*chars.shape, h), kind)
        state = np.zeros((chars.shape[1], h), kind)
        for t in range(len(chars)) if d == "f" else range(len(chars) - 1, -1, -1):
            k = int(alive[t])
            s = state[:k]
            zr = gates.take(chars[t, :k], axis=0)
            zr += s @ ugates
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            q = s @ unew
            n = r * q
            n += new.take(chars[t, :k], axis=0)
            np.tanh(n, out=n)
            after = s - n
            if tape is not None:
                tape.append((t, s.copy(), z, r, n, q))
            after *= z
            after += n
            state[:k] = after
            out[t, :k] = after
        return out

    def probabilities(self, chars: np.ndarray, length: np.ndarray, tapes: dict | None = None) -> tuple[np.ndarray, ...]:
        """(SPAN, rows, languages and none) for rows (rows, SPAN) in descending order of length; which places are real; the states."""
        tapes = {"f": None, "b": None} if tapes is None else tapes
        turned = np.ascontiguousarray(chars[:, : int(length[0])].T)
        inside = np.arange(len(turned))[:, None] < length
        alive = inside.sum(1)
        f, b = (self.states(turned, alive, d, tapes[d]) for d in "fb")
        p = f @ self.w["o"][:HIDDEN] + b @ self.w["o"][HIDDEN:] + self.w["p"]
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        return p, inside, f, b

    def gradients(self, chars: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Backpropagation through time of the mean over positions of the truth's negative log probability."""
        h, tapes = HIDDEN, {"f": [], "b": []}
        p, inside, f, b = self.probabilities(chars, length, tapes)
        turned, rows = chars[:, : len(p)].T, np.arange(len(chars))
        loss = -float(np.log(p[:, rows, label] + 1e-9)[inside].mean())
        p[:, rows, label] -= 1
        p *= inside[:, :, None] / inside.sum()
        p = p.astype(f.dtype)
        grads = {"o": np.concatenate([np.tensordot(s, p, ([0, 1], [0, 1])) for s in (f, b)]), "p": p.sum((0, 1))}
        for d, weights in (("f", self.w["o"][:h]), ("b", self.w["o"][h:])):
            dout = p @ weights.T
            du, read, dgates = np.zeros_like(self.w["u" + d]), [], []
            carry = np.zeros((len(chars), h), f.dtype)
            for t, s, z, r, n, q in reversed(tapes[d]):
                k = len(s)
                dh = carry[:k] + dout[t, :k]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (s - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                dq = np.concatenate([dz, dr, dn * r], 1)
                read.append(turned[t, :k])
                dgates.append(np.concatenate([dz, dr, dn], 1))
                du += s.T @ dq
                carry[:k] = dh * z + dq @ self.w["u" + d].T
            read, dgates = np.concatenate(read), np.concatenate(dgates)
            order = np.argsort(read, kind="stable")
            found, first = np.unique(read[order], return_index=True)
            dx = np.zeros_like(self.w["x" + d])
            dx[found] = np.add.reduceat(dgates[order], first, axis=0)
            grads |= {"x" + d: dx, "u" + d: du, "c" + d: dgates.sum(0)}
        return loss, grads

    def train(self, chars: np.ndarray, length: np.ndarray, label: np.ndarray, steps: int = 280, batch: int = 128, rate: float = 0.01, seed: int = 8) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        loss, order = 0.0, np.zeros(0, int)
        for step in range(1, steps + 1):
            while len(order) < min(batch, len(length)):
                order = np.append(order, rng.permutation(len(length)))
            rows, order = order[:batch], order[batch:]
            rows = rows[np.argsort(-length[rows], kind="stable")]
            loss, grads = self.gradients(chars[rows], length[rows], label[rows])
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def letters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is read of the texts: their words in lower case with a blank after each, and where each text begins."""
    starts, ends, _ = K.spans(buf, off, ~_LETTER)
    keep = np.zeros(len(buf) + 1, bool)
    keep[:-1] = _LETTER[buf]
    keep[ends] = True  # the byte after a word, which belongs to no word or to the next text
    low = np.where(_LETTER[buf], _LOWER[buf], 32).astype(np.uint8)
    return low[keep[:-1]], np.append(0, np.cumsum(keep[:-1]))[off]


def stretches(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths (SPAN but for the last) and texts of the stretches that texts are read in, longest first."""
    parts = -(-np.diff(off) // SPAN)
    text = np.repeat(np.arange(len(parts)), parts)
    part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = off[text] + part * SPAN
    length = np.minimum(SPAN, off[text + 1] - starts)
    order = np.argsort(-length, kind="stable")
    return starts[order], length[order], text[order]


def matrix(low: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(rows, SPAN) of bytes."""
    at = starts[:, None] + np.arange(SPAN)
    return np.where(np.arange(SPAN) < length[:, None], low[np.minimum(at, max(len(low) - 1, 0))] if len(low) else 0, 0).astype(np.uint8)


def held_out():
    """Fixed by the contract: the documents that nothing is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, most: int = 1600, pieces: int = 9600) -> BiGRU | None:
    """Learns from about `most` documents, or one of each language, and about `pieces` stretches of them, 6 to 32 of each."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    found = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not found:
        return None
    names, each = sorted(found), max(1, most // len(found))
    per_doc = min(32, max(6, pieces // sum(min(each, n) for n in found.values())))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    # about three times as many as needed are drawn before rows are ranked; of a rare language, all
    share = F.element_at(F.create_map(*[F.lit(x) for lang in names for x in (lang, min(1.0, 3 * each / found[lang]))]), F.col("lang"))
    drawn = known.select("text", "lang", draw.alias("draw")).filter(F.col("draw") < share * float(1 << 40)).dropDuplicates(["lang", "draw"])
    first = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("rank") <= each)
    place = lambda i: (1 + F.pmod(F.xxhash64("draw", i), F.greatest(F.lit(1), F.length("text") - SPAN + 1))).cast("int")
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(per_doc)), lambda i: F.substring(F.col("text"), place(i), F.lit(SPAN))))
    sample = first.select("lang", "draw", F.posexplode(cuts).alias("i", "t")).toPandas().sort_values(["lang", "draw", "i"])
    model = BiGRU(names)
    low, off = letters(*K.flat(pa.array(sample["t"], pa.string())))
    starts, length, text = stretches(off)
    label = np.searchsorted(names, sample["lang"].to_numpy(dtype=str))[text] if len(text) else np.zeros(0, np.int64)
    if not len(length):
        return None
    chars, length, label = with_noise(matrix(low, starts, length), length, label, len(names))
    model.train(chars, length, label)
    return model


def with_noise(chars: np.ndarray, length: np.ndarray, label: np.ndarray, langs: int, seed: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows and, as one class more of their mean number, noise: rows in disorder, random letters, and one letter again and again."""
    rng = np.random.default_rng(seed)
    rows = rng.choice(len(chars), -(-len(chars) // langs))
    own = chars[rows].copy()
    kind = np.arange(len(rows)) % 3
    for i in np.flatnonzero(kind == 0):
        own[i, : length[rows[i]]] = rng.permutation(own[i, : length[rows[i]]])
    known = np.flatnonzero(_LETTER & (_LOWER == np.arange(256)))
    random = rng.choice(known, own.shape).astype(np.uint8)
    ascii_ = rng.random(len(rows)) < 0.5
    random[ascii_] = rng.integers(97, 123, (int(ascii_.sum()), own.shape[1]))
    random[rng.random(own.shape) < 0.12] = 32
    own[kind == 1] = random[kind == 1]
    own[kind == 2] = random[kind == 2, :1]
    length, label = np.append(length, length[rows]), np.append(label, np.full(len(rows), langs))
    chars = np.concatenate([chars, own])
    order = np.argsort(-length, kind="stable")
    return chars[order], length[order], label[order]


class Labeller:
    """Labels the positions of texts, and pools them."""

    def __init__(self, model: BiGRU | None):
        self.model = model
        self.langs = model.langs if model else []

    def __call__(self, texts: pa.Array, letter: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, its score, and the share of its probability that is for no language."""
        n, langs = len(texts), self.langs
        total, count = np.zeros((n, len(langs) + 1)), np.zeros(n)
        if self.model:
            low, off = letters(*K.flat(texts))
            starts, length, text = stretches(off)
            for k in range(0, len(length), ROWS):
                some = slice(k, k + ROWS)
                chars = matrix(low, starts[some], length[some])
                p, inside, _, _ = self.model.probabilities(chars, length[some])
                worded = inside & (chars[:, : len(p)].T != 32)
                p *= worded[:, :, None]
                for j, own in enumerate(p.sum(0).T):
                    total[:, j] += np.bincount(text[some], weights=own, minlength=n)
                count += np.bincount(text[some], weights=worded.sum(0), minlength=n)
        known = letter.fill_null(False).to_numpy(zero_copy_only=False) & (count > 0)
        top = total[:, :-1].argmax(1) if langs else np.zeros(n, int)
        score = np.where(known, total[np.arange(n), top] / np.maximum(count, 1), 0.0)
        none = np.where(known, total[:, -1] / (count + PRIOR), 1.0)
        return [langs[b] if k else UNKNOWN for b, k in zip(top, known, strict=True)], np.clip(score, 0.0, 1.0), none


def _letter():
    return F.col("text").rlike("\\p{L}")


def languages(spark: SparkSession, docs: DataFrame, **sample) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = spark.sparkContext.broadcast(fit(docs, **sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(model.value)
        for whole in batches:
            for batch in K.pieces(whole):
                pred, score, _ = label(batch.column(2), batch.column(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text", _letter().alias("letter")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(spark: SparkSession, docs: DataFrame, **sample) -> DataFrame:
    """The rows of docs that the network does not take for noise, a missing lang filled in by its prediction.

    Without labels to learn from, all that have a letter, as they are.
    """
    model = spark.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang"), **sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(model.value)
        for whole in batches:
            for batch in K.pieces(whole):
                letter = batch.column(batch.num_columns - 1)
                pred, _, none = label(batch.column(batch.schema.get_field_index("text")), letter)
                at, columns = batch.schema.get_field_index("lang"), list(batch.columns)
                if label.model:
                    columns[at] = pc.coalesce(columns[at], pa.array(pred, columns[at].type))
                keep = pa.array(none <= NONE) if label.model else letter.fill_null(False)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns[:-1]], names=batch.schema.names[:-1])

    return docs.select("*", _letter().alias("_has_letter")).mapInArrow(run, docs.schema)
