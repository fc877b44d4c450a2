"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a segment, forward and backward, and gives each byte position
a distribution over the languages; it is trained here, in numpy, by backpropagation through time,
on the label of every position. A segment is a word (a run of letters and non-ASCII bytes, A-Z in
lower case) with a space on both sides, so that the state starts anew at each word; equal words are
therefore read once in a task and their positions' results kept in a bounded cache. Positions
between words have no label. A document pools all of its positions: the sums of the positions'
log probabilities, weighted by POOL, give document probabilities by a softmax.

Training takes a bounded sample: of each language an equal part of sample_rows labelled documents
(LEAST_ROWS at least), chosen by a hash of their doc_id, at most doc_words random words of each
document and at most sample_words words of each language; of a long word a random segment.
Prediction sees whole texts only; lang, source and doc_id are never part of it. The weights, some
30 KB, travel with the task.

The network does not see across words: a choice that lets equal words be read once, so that whole
texts can be read at all, and that costs what word order and neighbours would tell.

Defined results: a null text, and one without a letter, gets `und` with score 0; of languages of one
probability the first by name is predicted. Very long texts are read whole, as their words are. Null
labels are not learned from; without any label all predictions are `und`. Null and repeated doc_ids
stay rows of their own; an empty table gives an empty result. Other columns are left alone, whatever
their names. The sample's texts reach the driver by words only: at most doc_words words of a document,
each of at most WORD_BYTES bytes, so that long documents do not fill it.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table

SAMPLE_ROWS, SAMPLE_WORDS, DOC_WORDS, LEAST_ROWS = 2000, 6000, 200, 20
EMBED, HIDDEN, STEPS, BATCH, RATE, SEED = 12, 16, 400, 256, 0.01, 5
#: A word's bytes beyond this are read as further segments.
SEGMENT, POOL, CACHE_WORDS, WORD_BYTES = 24, 0.25, 300_000, 1 << 10
#: The pipeline keeps texts whose label's score is at least so far from a guess (0) to certainty (1).
LEAST_MARGIN = 0.1
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_TO_SPACE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


class BiGRU:
    """Weights by name; a direction d is "f" or "b". Sequences come as byte matrices (rows, time) with lengths."""

    def __init__(self, n_out: int, seed: int = SEED, embed: int = EMBED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {"E": rng.normal(0, 0.3, (256, embed))}
        for d in "fb":
            self.w |= {f"W{d}": rng.normal(0, embed**-0.5, (embed, 3 * hidden)), f"U{d}": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"c{d}": np.zeros(3 * hidden)}
        self.w |= {"V": rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, n_out)), "o": np.zeros(n_out)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States at every position, (time, rows, hidden). The gates are z (update), r (reset) and the candidate n."""
        n, w, h = self.hidden, self.w, np.zeros((x.shape[0], self.hidden), np.float32)
        inputs = (w["E"] @ w[f"W{d}"] + w[f"c{d}"])[x.T]
        out, tape = np.zeros((x.shape[1], x.shape[0], n), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, u, m = inputs[t], h @ w[f"U{d}"], mask[:, t : t + 1]
            zr = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
            new = m * (z * h + (1 - z) * c) + (1 - m) * h
            if keep:
                tape.append((t, h, z, r, c, u[:, 2 * n :], m))
            h = new
            out[t] = h
        return out, tape

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities at every position, (time, rows, languages), of sequences of one length."""
        n, w, both = self.hidden, self.w, np.empty((x.shape[1], x.shape[0], 2 * self.hidden), np.float32)
        for i, d in enumerate("fb"):
            by_byte, h, u = w["E"] @ w[f"W{d}"] + w[f"c{d}"], np.zeros((x.shape[0], n), np.float32), w[f"U{d}"]
            for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
                a, ux = by_byte[x[:, t]], h @ u
                gates = _sigmoid(a[:, : 2 * n] + ux[:, : 2 * n])
                c = np.tanh(a[:, 2 * n :] + gates[:, n:] * ux[:, 2 * n :])
                h = c + gates[:, :n] * (h - c)
                both[t, :, i * n : (i + 1) * n] = h
        logits = both @ w["V"] + w["o"]
        logits -= logits.max(2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        n, w = self.hidden, self.w
        mask = (np.arange(x.shape[1]) < lengths[:, None]).astype(np.float32)
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        h = np.concatenate([runs[d][0] for d in "fb"], 2)
        logits = h @ w["V"] + w["o"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        rows, weight = np.arange(len(y)), mask.T / mask.sum()
        loss = -float((np.log(p[:, rows, y] + 1e-12) * weight).sum())
        dl = p * weight[:, :, None]
        dl[:, rows, y] -= weight
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["V"], g["o"] = np.einsum("trh,trk->hk", h, dl), dl.sum((0, 1))
        dh_out = dl @ w["V"].T
        for i, d in enumerate("fb"):
            dh, by_byte = np.zeros((len(y), n), np.float32), np.zeros((256, 3 * n), np.float32)
            for t, before, z, r, c, u, m in reversed(runs[d][1]):
                dh = dh + dh_out[t, :, i * n : (i + 1) * n]
                inner = dh * m
                dc = inner * (1 - z) * (1 - c * c)
                dz = inner * (before - c) * z * (1 - z)
                dr = dc * u * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                g[f"U{d}"] += before.T @ du
                np.add.at(by_byte, x[:, t], da)
                dh = dh * (1 - m) + inner * z + du @ w[f"U{d}"].T
            g[f"c{d}"] = by_byte.sum(0)
            g[f"W{d}"] = w["E"].T @ by_byte
            g["E"] += by_byte @ w[f"W{d}"].T
        return loss, g


def segments(word: bytes, size: int = SEGMENT) -> list[bytes]:
    """The word between spaces, in parts of at most size bytes."""
    return [b" " + word[i : i + size] + b" " for i in range(0, len(word), size)]


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    wide = int(lengths.max())
    return np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), np.uint8).reshape(len(parts), wide), lengths


def train(words: dict[str, list[bytes]], seed: int = SEED, steps: int = STEPS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages in order and the weights, from words of each language; Adam on balanced batches."""
    langs = sorted(k for k, v in words.items() if v)
    net, rng = BiGRU(len(langs), seed), random.Random(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1 if langs else 1):
        y = np.array([rng.randrange(len(langs)) for _ in range(BATCH)])
        parts = [rng.choice(segments(rng.choice(words[langs[k]]))) for k in y]
        _, g = net.gradients(*_matrix(parts), y)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, v in g.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return langs, net.w


class Reader:
    """Document scores from a cache of what a word's positions say."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray], cache_words: int = CACHE_WORDS):
        self.net, self.langs, self.limit = BiGRU(max(1, len(langs))), langs, cache_words
        self.net.w = weights
        self.serial: dict[bytes, int] = {}
        self.says = np.zeros((0, max(1, len(langs))))

    def _learn(self, new: list[bytes]) -> None:
        parts, owner = [], []
        for i, w in enumerate(new):
            for s in segments(w):
                parts.append(s)
                owner.append(i)
        sums = np.zeros((len(new), self.says.shape[1]))
        owner_of, lengths = np.array(owner, int), np.array([len(p) for p in parts], int)
        order = np.argsort(lengths, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            for i in range(0, len(same), 1024):
                at = same[i : i + 1024]
                np.add.at(sums, owner_of[at], self.net.positions(_matrix([parts[k] for k in at])[0]).sum(0))
        base = len(self.says)
        self.says = np.concatenate([self.says, sums])
        self.serial.update(zip(new, range(base, base + len(new)), strict=True))

    def positions(self, text: bytes) -> list[tuple[int, str, float]]:
        """Byte offset, language and probability at every position of the text's words."""
        plain, out, at = text.lower().translate(_TO_SPACE), [], 0
        for word in plain.split():
            at = plain.index(word, at)
            for k, s in enumerate(segments(word)):
                p = np.exp(self.net.positions(_matrix([s])[0])[1:-1, 0])
                out += [(at + k * SEGMENT + j, self.langs[q.argmax()], float(q.max())) for j, q in enumerate(p)]
            at += len(word)
        return out

    def documents(self, texts: list[bytes]) -> list[tuple[str, float]]:
        lists = [words_of(t) for t in texts]
        if len(self.serial) > self.limit:
            self.serial, self.says = {}, self.says[:0]
        if self.langs and (new := [w for w in set().union(*lists) if w not in self.serial]):
            self._learn(sorted(new))
        get, out = self.serial.__getitem__, []
        for text, words in zip(texts, lists, strict=True):
            if not self.langs or not has_letter(text):
                out.append((UNDETERMINED, 0.0))
                continue
            pooled = POOL * self.says[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            p = np.exp(pooled - pooled.max())
            best = int(p.argmax())
            out.append((self.langs[best], float(p[best] / p.sum())))
        return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS, seed: int = SEED, doc_words: int = DOC_WORDS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Train on a bounded sample of (text, lang); labelled has doc_id too, by whose hash rows are chosen."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return train({}, seed)
    quota = max(LEAST_ROWS, sample_rows // len(counts))
    bound = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, quota * 0.9 / n))), F.col("lang"))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.filter(share <= bound).select("doc_id", "lang", F.col("text").cast("string").alias("text")).limit(max(sample_rows, quota * len(counts)))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                found = words_of(text)
                own.append([w[:WORD_BYTES] for w in random.Random(f"{seed} {doc_id} {len(text)}").sample(found, min(len(found), doc_words))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(own, pa.list_(pa.binary()))], names=["doc_id", "lang", "words"])

    words: dict[str, list[bytes]] = {}
    rng = random.Random(seed)
    sampled = chosen.mapInArrow(some, "doc_id string, lang string, words array<binary>")
    for row in sorted(sampled.collect(), key=lambda r: (str(r.doc_id), r.lang, r.words)):
        words.setdefault(row.lang, []).extend(map(bytes, row.words))
    words = {k: rng.sample(v, min(len(v), sample_words)) for k, v in sorted(words.items())}
    return train(words, seed)


def predict(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], keep: list[str], names: tuple[str, str] = ("lang_pred", "score"), cache_words: int = CACHE_WORDS) -> DataFrame:
    """The columns in keep, then the predicted language and its score under the given names, for every row of docs."""
    text = F.col("text").cast("string")
    inner = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)), *([] if "text" in keep else [text.alias("text")]))
    where = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*model, cache_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = reader.documents([x or b"" for x in part.column(where).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(inner)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*inner, "pred", "prob"])

    schema = rows.select(*inner).withColumns({"pred": F.lit("x"), "prob": F.lit(0.0)}).schema
    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)), F.col("pred").alias(names[0]), F.col("prob").alias(names[1]))


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fitted(docs: DataFrame, **options) -> tuple[list[str], dict[str, np.ndarray]]:
    """The model learned from the rows of docs that are not held out."""
    return fit(docs.select("doc_id", "text", "lang").filter(~_held_out()), **options)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, learned from the rows not held out."""
    return predict(docs, fitted(docs), ["doc_id"]).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def stays(docs: DataFrame, least: float = LEAST_MARGIN) -> F.Column:
    """Whether a row of docs has a letter and a label whose score is at least `least` of the way from a guess to 1; without a model, whether it has a letter.

    A condition on the text alone, judged in the scan that keeps or drops the row.
    """
    langs, weights = fitted(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if not langs:
        return text.rlike(r"\p{L}")
    enough = 1 / len(langs) + least * (1 - 1 / len(langs))

    @F.arrow_udf("boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(langs, weights)
        for batch in batches:
            said = []
            for at in range(0, len(batch), 1000):
                said += [lang != UNDETERMINED and score >= enough for lang, score in reader.documents(batch.slice(at, 1000).cast(pa.binary()).to_pylist())]
            yield pa.array(said, pa.bool_())

    return judged(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def accuracy(rows: list[tuple[str, str]]) -> dict[str, float]:
    """Share of right predictions by true language, from pairs (true, predicted)."""
    right, all_of = Counter(t for t, p in rows if t == p), Counter(t for t, _ in rows)
    return {t: right[t] / n for t, n in all_of.items()}
