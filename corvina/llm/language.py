"""Language identification by a byte convolutional network: filters of several widths, max pooling, softmax.

It is trained in numpy on the driver on windows of a bounded sample of labelled rows (``train_rows``, at most
``train_windows`` windows of each, spread over the text) and sent to the executors. Every text is cut whole into
windows of LENGTH bytes (the last filled up with zeros), which run through the network in batches; a text's prediction
is the class with the highest mean log probability over its windows, its score the softmax of those means.

Null texts and texts without a letter are ``und`` with score 0; so is everything where no labelled row has text.
ASCII capitals are lower-cased, nothing else is changed. Rows are judged each for itself, repeated rows alike. A language
with a single labelled row is a class like any other. Of classes with equal scores the first by name is taken. A carried
column named lang_pred or score comes as ``<name>_given``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, map_texts

LENGTH = 256
WIDTHS = (2, 3, 4)
BATCH = 512
#: Letters, and number signs such as those in circles, of which ``has_letter`` tells letters apart.
MAYBE_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    classes: list[str]
    embed: np.ndarray  # 256 x dim
    filters: dict[int, np.ndarray]  # w: w x dim x n
    bias: dict[int, np.ndarray]
    out: np.ndarray  # all filters x classes
    b: np.ndarray

    def single(self) -> dict[int, list[np.ndarray]]:
        """For each width and place in the filter: what each byte adds to the filters' sums."""
        return {w: [self.embed @ f[j] for j in range(w)] for w, f in self.filters.items()}

    def paired(self) -> dict[int, list[tuple[int, int, np.ndarray]]]:
        """The same for two neighbouring bytes at once: (place, bytes, table)."""
        out = {}
        for w, parts in self.single().items():
            steps = []
            for j in range(0, w - 1, 2):
                steps.append((j, 2, np.ascontiguousarray((parts[j][:, None, :] + parts[j + 1][None, :, :]).reshape(65536, -1))))
            if w % 2:
                steps.append((w - 1, 1, parts[w - 1]))
            out[w] = steps
        return out


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def windows_of(data: bytes) -> np.ndarray:
    """Windows x LENGTH, filled up with zeros."""
    n = -(-len(data) // LENGTH)
    return np.frombuffer(data.ljust(n * LENGTH, b"\0"), np.uint8).reshape(n, LENGTH)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def log_probs(model: Model, paired: dict, windows: np.ndarray) -> np.ndarray:
    out = np.empty((len(windows), len(model.classes)), np.float32)
    for i in range(0, len(windows), BATCH):
        x = windows[i : i + BATCH]
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        feats = []
        for w, steps in paired.items():
            places = LENGTH - w + 1
            total = None
            for j, k, table in steps:
                part = table[(pair if k == 2 else x)[:, j : j + places]]
                total = part if total is None else np.add(total, part, out=total)
            feats.append(np.maximum(total.max(axis=1) + model.bias[w], 0))
        out[i : i + BATCH] = log_softmax(np.concatenate(feats, axis=1) @ model.out + model.b)
    return out


def fit(x: np.ndarray, y: np.ndarray, classes: list[str], dim: int = 8, n: int = 16, steps: int = 1000, rate: float = 0.01, seed: int = 5) -> Model:
    """Adam on cross entropy over batches of 64 windows; the gradient of a maximum goes to the place that has it."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    m = Model(classes, rng.normal(0, 0.3, (256, dim)).astype(f32), {w: rng.normal(0, 0.3, (w, dim, n)).astype(f32) for w in WIDTHS}, {w: np.zeros(n, f32) for w in WIDTHS}, rng.normal(0, 0.2, (n * len(WIDTHS), len(classes))).astype(f32), np.zeros(len(classes), f32))
    if len(classes) < 2:
        return m
    m.embed[0] = 0
    params = [m.embed, m.out, m.b, *m.filters.values(), *m.bias.values()]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # classes weigh alike, whatever their share
    weight = len(y) / (len(classes) * np.maximum(1, np.bincount(y, minlength=len(classes))))
    for step in range(1, steps + 1):
        batch = rng.integers(0, len(x), 64)
        xb, yb = x[batch], y[batch]
        tables = m.single()
        feats, where = [], {}
        for w, parts in tables.items():
            places = LENGTH - w + 1
            total = parts[0][xb[:, :places]]
            for j in range(1, w):
                total += parts[j][xb[:, j : j + places]]
            where[w] = total.argmax(axis=1)
            feats.append(np.take_along_axis(total, where[w][:, None, :], 1)[:, 0] + m.bias[w])
        pre = np.concatenate(feats, axis=1)
        act = np.maximum(pre, 0)
        p = np.exp(log_softmax(act @ m.out + m.b))
        p[np.arange(len(yb)), yb] -= 1
        err = (p * weight[yb][:, None] / len(yb)).astype(f32)
        g_act = (err @ m.out.T) * (pre > 0)
        g_embed, g_filters, g_bias = np.zeros_like(m.embed), [], []
        for k, (w, f) in enumerate(m.filters.items()):
            g = g_act[:, k * n : (k + 1) * n]
            g_bias.append(g.sum(0))
            gf = np.empty_like(f)
            for j in range(w):
                g_table = np.zeros((256, n), f32)
                np.add.at(g_table, (np.take_along_axis(xb, where[w] + j, 1), np.arange(n)[None, :]), g)
                gf[j] = m.embed.T @ g_table
                g_embed += g_table @ f[j].T
            g_filters.append(gf)
        grads = [g_embed, act.T @ err + 1e-4 * m.out, err.sum(0), *g_filters, *g_bias]
        lr = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for q, g, a, v in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            q -= lr * a / (np.sqrt(v) + 1e-8)
        m.embed[0] = 0
    return m


def train(docs: DataFrame, learns: Column | None = None, train_rows: int = 3000, train_windows: int = 4, seed: int = 5) -> Model | None:
    """``docs``: doc_id, text, lang. Takes about ``train_rows`` of the labelled rows that ``learns`` allows, chosen by a
    hash of doc_id, but rows of rare languages first: each language gives up to its equal share."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    known = (known if learns is None else known.where(learns)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    share = train_rows / len(counts)
    limits = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, int((1 << 20) * min(1.0, share / n)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.try_element_at(limits, F.col("lang")))
    size = F.octet_length("text")
    # windows are cut where the text is, so that no long text comes to the driver
    span = F.greatest(F.lit(1), F.ceil(F.length("text") / LENGTH)).cast("int")
    picks = F.transform(F.sequence(F.lit(0), F.least(span, F.lit(train_windows)) - 1), lambda i: F.col("text").substr((F.floor(i * span / F.least(span, F.lit(train_windows))) * LENGTH + 1).cast("int"), F.lit(LENGTH)))
    rows = sorted((r["lang"], str(r["doc_id"]), r["part"]) for r in chosen.where(size > 0).select("doc_id", "lang", F.explode(picks).alias("part")).toLocalIterator())
    classes = sorted({r[0] for r in rows})
    at = {c: i for i, c in enumerate(classes)}
    x, y = [], []
    for lang, _, part in rows:
        data = part.encode("utf-8", "surrogatepass").lower()[:LENGTH]
        if data:
            x.append(np.frombuffer(data.ljust(LENGTH, b"\0"), np.uint8))
            y.append(at[lang])
    return fit(np.stack(x), np.array(y), classes, seed=seed) if x else None


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id) with lang_pred and score."""
    keep = ["doc_id"] if keep is None else keep
    if model is None:
        names = carried(keep, ["lang_pred", "score"])
        return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    def make():
        m = sent.value
        paired = m.paired()

        def work(texts: list[str]) -> dict:
            letters = [has_letter(t) for t in texts]
            cut = [windows_of(t.encode("utf-8", "surrogatepass").lower()) for t, ok in zip(texts, letters) if ok]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if cut:
                sizes = np.array([len(c) for c in cut])
                logs = log_probs(m, paired, np.concatenate(cut)).astype(np.float64)
                means = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
                p = np.exp(log_softmax(means))
                best = p.argmax(axis=1)
                for k, i in enumerate(np.flatnonzero(letters)):
                    lang[i], score[i] = m.classes[best[k]], float(min(1.0, p[k, best[k]]))
            return {"lang_pred": lang, "score": score}

        return work

    return map_texts(docs, make, "lang_pred string, score double", keep=keep)
