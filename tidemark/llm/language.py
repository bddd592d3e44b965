"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent, with calibrated rejection.

Subwords are the byte 2-, 3- and 4-grams of the text (ASCII lower-cased, white space as one blank) that have no blank inside; a blank may
begin or end one. Their hashes index an embedding table; a text is the mean of its subwords' embeddings, and a linear softmax gives the
languages. Training cuts the sampled texts into pieces of 8 to 400 bytes, so that short texts are learned too. After training the table is
multiplied with the softmax weights once: a text's logits are then the mean of a few numbers per subword, and prediction has no
matrix product.

The sample: of the labelled rows allowed for training, about `rows_per_lang` of each language, chosen by a hash of the id; of a text with more
than `max_chars` characters a stretch of as many, which begins where the hash says. The `max_langs` languages with the most rows are learned.
A tenth of the sample is kept out of training; its pieces fit the temperature and the least score.

A softmax is sure of texts in no learned language too, so rejection also goes by the share of a text's subwords that the sample has. What
share is usual is learned from pieces of all sampled texts: the share of a piece's subwords that some other sampled text
has. A text is rejected where its share is below the `reject` quantile of the pieces, or its score below that of right answers.

Defined results: null text, and text without a letter, is `und` with score 0 and rejected; if nothing was learned everything is; null
doc_id counts as crc32 remainder 0; of labels with equally many rows the first by code point are learned; repeated rows have equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, unused, values
from tidemark.llm.wordhash import tidy, trim

GRAMS = (2, 3, 4)
BLANK = bytes(0x20 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))


def gram_ids(data: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of all subwords of text already lower-cased and with blanks only."""
    b = np.frombuffer(data, dtype=np.uint8)
    blank = b == 0x20
    x = b.astype(np.uint32)
    at, ids = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) ^ x[j : j + m]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bad = blank[:m] & blank[n - 1 :] if n == 2 else blank[1 : 1 + m]
        for j in range(2, n - 1):
            bad = bad | blank[j : j + m]
        ok = np.flatnonzero(~bad)
        at.append(ok)
        ids.append(((h ^ (h >> np.uint32(12))) & np.uint32(buckets - 1))[ok])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(at), np.concatenate(ids)


def normal(text: str) -> bytes:
    """The form that subwords are taken from: one blank at both ends."""
    return b" " + text.encode(errors="replace").lower().translate(BLANK) + b" "


def train(texts: list[str], labels: list[str], buckets: int = 1 << 16, dim: int = 12, steps: int = 1500, rate: float = 1.0, seed: int = 5, reject: float = 0.001) -> dict | None:
    """The model: {langs, table (buckets x langs), bias, temperature, least, seen (by bucket), usual (least share of seen subwords)}."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y_of = {x: i for i, x in enumerate(langs)}
    held = rng.random(len(texts)) < 0.1
    pieces, ys = [], []
    for t, label, out in zip(texts, labels, held, strict=True):
        if out:
            continue
        for piece in cut(normal(t), lambda: int(rng.integers(8, 400))):
            pieces.append(gram_ids(piece, buckets)[1].astype(np.uint16 if buckets <= 1 << 16 else np.uint32))
            ys.append(y_of[label])
    e = (rng.standard_normal((buckets, dim)) / dim).astype(np.float32)
    w, bias = np.zeros((dim, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    ys = np.array(ys, dtype=np.int64)
    share = np.maximum(np.bincount(ys, minlength=len(langs)), 1) if len(ys) else np.ones(len(langs))
    weight = len(ys) / (len(langs) * share)
    batch, step = 64, 0
    epochs = min(100, max(2, -(-steps * batch // max(1, len(pieces)))))  # small samples are seen more often
    total = max(1, epochs * len(pieces) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for i in range(0, len(order), batch):
            pick = [j for j in order[i : i + batch] if len(pieces[j])]
            if not pick:
                continue
            n = np.array([len(pieces[j]) for j in pick])
            ids, starts = np.concatenate([pieces[j] for j in pick]), np.cumsum(n) - n
            h = np.add.reduceat(e[ids], starts, axis=0) / n[:, None]
            p = softmax(h @ w + bias)
            p[np.arange(len(pick)), ys[pick]] -= 1
            p *= (np.minimum(weight[ys[pick]], 10.0) / len(pick))[:, None]
            lr = rate * (1 - step / total) if step < total else 0.01
            back = ((p @ w.T) / n[:, None]).astype(np.float32)
            w -= (lr * (h.T @ p)).astype(np.float32)
            bias -= (lr * p.sum(0)).astype(np.float32)
            uniq, inv = np.unique(ids, return_inverse=True)
            rows = np.repeat(np.arange(len(pick)), n)
            for d in range(dim):
                e[uniq, d] -= lr * len(pick) * np.bincount(inv, weights=back[rows, d], minlength=len(uniq)).astype(np.float32)
            step += 1
    seen, usual = familiar(texts, buckets, reject)
    model = {"langs": langs, "table": (e @ w).astype(np.float32), "bias": bias, "temperature": 1.0, "least": 0.0, "seen": seen, "usual": usual}
    sizes = np.random.default_rng(seed + 1)
    calib = [(piece.decode(errors="replace"), y_of[x]) for t, x, out in zip(texts, labels, held, strict=True) if out for piece in cut(normal(t), lambda: int(sizes.integers(8, 400)))]
    if calib:
        z, y = logits([t for t, _ in calib], model)[0], np.array([k for _, k in calib])
        # one right and one wrong answer more than there are (Platt), so that no score is certain
        doubt = 1 / (len(y) + 2)
        target = np.full(z.shape, doubt / max(1, len(langs) - 1))
        target[np.arange(len(y)), y] = 1 - doubt
        loss = lambda s: -(target * np.log(np.maximum(softmax(z / s), 1e-12))).sum(1).mean()
        model["temperature"] = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p = softmax(z / model["temperature"])
        right = p.max(1)[p.argmax(1) == y]
        model["least"] = float(np.quantile(right, reject, method="lower")) if len(right) else 0.0
    return model


def cut(data: bytes, size) -> Iterator[bytes]:
    """Pieces of size() bytes each."""
    lo = 0
    while lo < len(data) - 4:
        hi = lo + size()
        yield data[lo:hi]
        lo = hi


def familiar(texts: list[str], buckets: int, reject: float) -> tuple[np.ndarray, float]:
    """(1 for each bucket with a subword of the texts, the least usual share of such subwords)."""
    rng = np.random.default_rng(7)
    data = [normal(t) for t in sorted(set(texts))]
    n_texts = np.zeros(buckets, dtype=np.int32)
    for x in data:
        n_texts[np.unique(gram_ids(x, buckets)[1])] += 1
    shares = []
    for x in data:
        for piece in cut(x, lambda: int(2 ** rng.uniform(3, 12))):
            ids = gram_ids(piece, buckets)[1]
            if len(ids):
                shares.append((n_texts[ids] > 1).mean())
    return (n_texts > 0).astype(np.float32), float(np.quantile(shares, reject, method="lower")) if shares else 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def logits(texts: list[str], model: dict, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Mean contributions of the subwords of each whole text, and whether it is unfamiliar; work arrays are bounded by `chunk` numbers."""
    table, c = model["table"], len(model["langs"])
    total, count, seen = np.zeros((len(texts), c)), np.zeros(len(texts)), np.zeros(len(texts))
    step = max(1000, chunk // c)
    held, owners, size = [], [], 0

    def flush():
        nonlocal held, owners, size
        data = b"".join(held)
        at, ids = gram_ids(data, len(table))
        ends = np.cumsum([len(x) for x in held])
        # grams across two pieces have a blank inside or begin and end with one
        who = np.array(owners)[np.searchsorted(ends, at, side="right")]
        for k in range(c):
            total[:, k] += np.bincount(who, weights=table[ids, k], minlength=len(texts))
        seen[:] += np.bincount(who, weights=model["seen"][ids], minlength=len(texts))
        count[:] += np.bincount(who, minlength=len(texts))
        held, owners, size = [], [], 0

    for i, t in enumerate(texts):
        data = normal(t)
        for lo in range(0, len(data), step):
            part = data[max(0, lo - 3) : lo + step] if lo else data[:step]
            if lo:  # counted from the third byte before; what lay wholly before is counted twice for at most 3 bytes
                held.append(b" ")
                owners.append(i)
                size += 1
            held.append(part)
            owners.append(i)
            size += len(part)
            if size >= step:
                flush()
    if held:
        flush()
    count = np.maximum(count, 1)
    return total / count[:, None] + model["bias"], seen / count < model["usual"]


def _predict(shared):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for s in tidy(batches):
            texts = [t if isinstance(t, str) and model and any(map(str.isalpha, t)) else None for t in s]
            some = [i for i, t in enumerate(texts) if t is not None]
            lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for lo in range(0, len(some), 256):
                part = some[lo : lo + 256]
                z, strange = logits([texts[i] for i in part], model)
                p = softmax(z / model["temperature"])
                for i, k, v, new in zip(part, p.argmax(1).tolist(), p.max(1).tolist(), strange.tolist(), strict=True):
                    lang[i], score[i], rejected[i] = model["langs"][k], min(1.0, v), new or v < model["least"]
            yield pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    return F.pandas_udf(run, "lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 3 == 1


def fit(docs: DataFrame, rows_per_lang: int = 250, max_chars: int = 20_000, max_langs: int = 1000, **options) -> dict | None:
    """Trains on a bounded sample of the labelled rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not n:
        return None
    # rows with one id, or none, are told apart by their texts
    h = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.crc32(F.col("text").cast("binary")))
    place = F.pmod(h, F.lit(1_000_000_007))
    bound = values(docs.sparkSession, [(lang, int(1_000_000_007 * min(1.0, rows_per_lang / k))) for lang, k in sorted(n.items())], "lang STRING, bound LONG")
    spare = F.greatest(F.length("text") - max_chars, F.lit(0))
    part = F.substring(F.col("text"), F.pmod(F.xxhash64(h, F.lit(1)), spare + 1).cast("int") + 1, F.lit(max_chars))
    chosen = rows.join(F.broadcast(bound), "lang").where(place < F.col("bound")).select("doc_id", "lang", part.alias("text")).distinct()
    sample = sorted((r["doc_id"] or 0, r["lang"], r["text"]) for r in chosen.collect())
    sample = [(lang, t) for _, lang, t in sample if any(map(str.isalpha, t))]
    model = train([t for _, t in sample], [lang for lang, _ in sample], **options)
    del sample
    trim()
    return model


def with_language(docs: DataFrame, **options) -> DataFrame:
    """docs with lang_id: a struct of lang_pred, score and rejected, in place of a column of that name."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))  # buckets x languages numbers at most
    return docs.withColumn("lang_id", _predict(model)("text"))


def without_rejected(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))
    name = unused("lang_id", docs.columns)
    return docs.withColumn(name, _predict(model)("text")).where(~F.col(f"{name}.rejected")).drop(name)


def predict_language(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs."""
    out = with_language(docs.select("doc_id", "text", "lang"), **options)
    return out.select("doc_id", held_out().alias("held_out"), "lang_id.*")
