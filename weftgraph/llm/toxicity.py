"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import WordSplitter, mix
from .cluster import add_columns, ship_code, without

#: The chain is fitted on the labelled documents with the smallest hashes of their ids, so many
#: at most.
SAMPLE_DOCS = 8_000
#: Features that a link of the chain looks at: those that tell most about its category.
FEATURES = 2_048
#: ... if chance alone would give as much to so many features at most.
BY_CHANCE = 1.0
#: ... and that so many texts of the sample have.
LEAST_TEXTS = 3
FOLDS = 5
#: A cut may have this part of the best F1.
NEARLY = 0.99
#: Of a text in the sample so many features at most are looked at, those with the smallest hashes.
MOST_IN_TEXT = 50_000
#: Besides a word itself its first bytes are features, so that other forms of it count too.
STEMS = (4, 5)

_LETTERS = np.array([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def text_features(texts):
    """For blocks of consecutive texts: (index of first, 32-bit features, text of each, number of
    texts). A feature is a word or the first bytes of one; it counts once for a text."""
    splitter = WordSplitter(_LETTERS)
    for i, data, cuts, starts, ends, first, hashes in splitter.batches(texts):
        found = [mix(hashes)]
        for n in STEMS:
            longer = ends - starts > n
            found.append(np.where(longer, mix(splitter.hashes(data, starts, np.minimum(starts + n, ends)) + np.uint64(n)), found[0]))
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        yield i, [(f >> np.uint64(32)).astype(np.uint32) for f in found], owner, len(first) - 1


class Link:
    """One linear model of the chain: weights of features, of the probabilities before it, bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, before: np.ndarray, bias: float):
        self.keys, self.weights, self.before, self.bias = keys, weights, before, bias

    def scores(self, text: np.ndarray, at: np.ndarray, n: int, chain: np.ndarray) -> np.ndarray:
        """Probabilities; text and at: which text has which of this link's features."""
        z = np.bincount(text, weights=self.weights[at], minlength=n) + self.bias
        if chain.shape[1]:
            z = z + chain @ self.before
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def present(self, features: list[np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, index of feature) once for each feature of the link that a text has."""
        n = len(self.keys)
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pairs = []
        for f in features:
            at = np.searchsorted(self.keys, f)
            at[at == n] = 0
            hit = np.flatnonzero(self.keys[at] == f)
            pairs.append(owner[hit] * n + at[hit])
        both = np.unique(np.concatenate(pairs))
        return both // n, both % n


def _fit_linear(text: np.ndarray, at: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, decay: float = 0.05, rounds: int = 12, inner: int = 25):
    """Logistic regression with a quadratic penalty by Newton steps, each solved by conjugate
    gradients. Returns the weights of the text's features and then of `dense`, and the bias."""
    n = len(y)
    columns = np.column_stack([dense, np.ones(n)])
    penalty = np.append(np.full(width + dense.shape[1], decay), 1e-6)

    def forward(w):
        return np.bincount(text, weights=w[at], minlength=n) + columns @ w[width:]

    def back(v):
        return np.concatenate([np.bincount(at, weights=v[text], minlength=width), columns.T @ v])

    def loss(w, z):
        return float(np.logaddexp(0, z).sum() - z @ y + 0.5 * penalty @ (w * w))

    w = np.zeros(width + columns.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    z = forward(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        r = -(back(p - y) + penalty * w)
        curve = p * (1 - p)
        step, d, size = np.zeros_like(w), r.copy(), float(r @ r)
        target = 1e-4 * size
        for _ in range(inner):
            if size <= target or size < 1e-12:
                break
            hd = back(curve * forward(d)) + penalty * d
            a = size / float(d @ hd)
            step += a * d
            r = r - a * hd
            new = float(r @ r)
            d = r + new / size * d
            size = new
        scale, now = 1.0, loss(w, z)
        while scale > 1e-3 and loss(w + scale * step, forward(w + scale * step)) > now:
            scale /= 2
        if scale <= 1e-3 or not step.any():
            break
        w = w + scale * step
        z = forward(w)
    return w[:-1], float(w[-1])


def _select(text: np.ndarray, at: np.ndarray, width: int, own: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Of `width` features those that say most about y in the texts `own`, by the G statistic."""
    mine = own[text]
    df = np.bincount(at[mine], minlength=width).astype(float)
    mine &= (y > 0)[text]
    hit = np.bincount(at[mine], minlength=width).astype(float)
    n, pos = own.sum(), y[own].sum()
    enough = df >= LEAST_TEXTS
    a, b = hit + 0.5, df - hit + 0.5
    c, d = np.maximum(pos - hit, 0) + 0.5, np.maximum(n - pos - df + hit, 0) + 0.5
    total = a + b + c + d
    cell = lambda x, r, k: x * np.log(x * total / (r * k))
    g = np.where(enough, cell(a, a + b, a + c) + cell(b, a + b, b + d) + cell(c, c + d, a + c) + cell(d, c + d, b + d), -1)
    best = np.argsort(-g, kind="stable")[:most]
    return np.sort(best[g[best] > np.log(max(1, enough.sum()) / BY_CHANCE)])


def common_features(text: np.ndarray, feature: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that `least` texts have, in order, and which text has which of them by place."""
    ordered = np.sort(feature)
    keys = np.unique(ordered[least - 1 :][ordered[least - 1 :] == ordered[: len(ordered) - least + 1]]) if len(ordered) >= least else ordered[:0]
    del ordered
    texts, places = [text[:0].astype(np.int32)], [np.zeros(0, np.int32)]
    for i in range(0, len(feature) if len(keys) else 0, 1 << 20):
        part = feature[i : i + (1 << 20)]
        at = np.searchsorted(keys, part)
        at[at == len(keys)] = 0
        hit = keys[at] == part
        texts.append(text[i : i + (1 << 20)][hit].astype(np.int32))
        places.append(at[hit].astype(np.int32))
    return keys, np.concatenate(texts), np.concatenate(places)


class Chain:
    """Links in order; each sees the probabilities of the categories before it."""

    def __init__(self, categories: list[str], links: list[Link], cuts: list[float]):
        self.categories, self.links, self.cuts = categories, links, cuts

    @classmethod
    def fit(cls, categories: list[str], text: np.ndarray, feature: np.ndarray, labels: np.ndarray, folds: int = FOLDS, most: int = FEATURES) -> Chain:
        """text and feature: which of the texts has which feature; labels: texts by categories.

        What a later link learns from are out-of-fold probabilities, as it will meet probabilities
        for texts that the earlier links have not seen. Texts with the same features are in one
        fold, so that no copy of a text is among those that its probability is learned from. A
        category's cut is where the out-of-fold probabilities of both classes are told apart
        best."""
        n = len(labels)
        digest = np.zeros(n, dtype=np.uint64)
        np.add.at(digest, text, mix(feature.astype(np.uint64)))
        keys, text, at = common_features(text, feature, LEAST_TEXTS)
        del feature
        fold = (digest % np.uint64(folds)).astype(np.int64)
        chain = np.zeros((n, 0))
        links, cuts = [], []
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            unseen = np.zeros(n)
            for f in range(folds):
                own = fold != f
                link, t, i = cls._link(keys, text, at, y, chain, own, most)
                unseen[~own] = link.scores(t, i, n, chain)[~own]
            links.append(cls._link(keys, text, at, y, chain, np.ones(n, dtype=bool), most)[0])
            cuts.append(best_cut(unseen, y))
            chain = np.column_stack([chain, unseen])
        return cls(categories, links, cuts)

    @staticmethod
    def _link(keys, text, at, y, chain, own, most) -> tuple[Link, np.ndarray, np.ndarray]:
        """A link fitted on the texts `own`, and which of all texts has which of its features."""
        best = _select(text, at, len(keys), own, y, most)
        place = np.full(len(keys), -1)
        place[best] = np.arange(len(best))
        chosen = place[at]
        t, i = text[chosen >= 0].astype(np.int64), chosen[chosen >= 0]
        mine = own[t]
        row = np.cumsum(own) - 1
        weights, bias = _fit_linear(row[t[mine]], i[mine], len(best), chain[own], y[own])
        return Link(keys[best], weights[: len(best)], weights[len(best) :], bias), t, i

    def predict(self, texts) -> np.ndarray:
        """Probabilities, texts by categories."""
        out = []
        for _, features, owner, n in text_features(texts):
            chain = np.zeros((n, 0))
            for link in self.links:
                chain = np.column_stack([chain, link.scores(*link.present(features, owner), n, chain)])
            out.append(chain)
        return np.concatenate(out) if out else np.zeros((0, len(self.links)))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle between two neighbouring probabilities: the lowest such cut with an F1 above it of
    nearly the largest, which finds the most; 0.5 if y has one class only."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    q, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][q[:-1] == q[1:]] = 0
    i = int(np.flatnonzero(f1 >= NEARLY * f1.max())[-1])
    return float((q[i] + (q[i + 1] if i + 1 < len(q) else 0.0)) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """(h, y, f): id hash, labels and packed features of the sampled labelled documents, one row for
    each id. Of several texts under one id one is taken, of several labels the largest."""
    ship_code(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_l"), *[F.expr(e).cast("int").alias(f"_y{k}") for k, e in enumerate(categories.values())]).where(
        " and ".join(f"_y{k} is not null" for k in range(len(categories)))
    )
    once = known.groupBy("_l").agg(*[F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(categories))])
    chosen = once.orderBy(F.xxhash64("_l"), "_l").limit(sample_docs)
    # The sample has sample_docs rows at most, of a few numbers each.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where("_t is not null")
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_l"))
    rows = rows.select("_t", F.col("_l").cast("string"), F.xxhash64("_l").alias("_h"), F.array(*[f"_y{k}" for k in range(len(categories))]).alias("_y"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            packed = []
            for _, features, owner, n in text_features(batch.column(0)):
                both = np.unique(np.concatenate([(owner.astype(np.uint64) << np.uint64(32)) | f.astype(np.uint64) for f in features]))
                cuts = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
                own = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                packed += [own[a : min(b, a + MOST_IN_TEXT)].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (1, 2, 3)], pa.array(packed, pa.binary())], names=["l", "h", "y", "f"])

    found = rows.mapInArrow(run, "l string, h long, y array<int>, f binary")
    return found.groupBy("l").agg(F.min(F.struct("h", "y", "f")).alias("r")).select("r.h", "r.y", "r.f")


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS
) -> Chain:
    """A chain for `categories` ({name: expression over labels, 0 or 1}), in their order, fitted on
    `sample_docs` labelled documents at most, those with the smallest hashes of their ids.

    Defined cases: labels or documents without id or text, and labels with a null in any category,
    are left out; where labels of one id contradict, the larger counts; an id on several rows counts
    once; of a very long text MOST_IN_TEXT features are learned from; features that say equally
    much are taken by their hash; without any labels every probability is a half and nothing is
    called; other columns are ignored, whatever their names."""
    categories = categories or {"low_quality": "1 - quality", "toxic": "toxic"}
    table = training_rows(docs, labels, categories, id_col, text_col, sample_docs).toArrow()
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    table = table.take(order)
    y = np.array(table.column("y").to_pylist(), dtype=np.int64).reshape(len(order), len(categories))
    packed = table.column("f").combine_chunks() if len(order) else None
    sizes = np.diff(np.frombuffer(packed.buffers()[1], dtype=np.int32)[: len(order) + 1]) // 4 if len(order) else np.zeros(0, np.int64)
    feature = np.frombuffer(packed.buffers()[2], dtype=np.uint32)[: int(sizes.sum())] if len(order) else np.zeros(0, np.uint32)
    text = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
    return Chain.fit(list(categories), text, feature, y)


def score_toxicity(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with _p_<category> (double) and _is_<category> for each category of the chain.

    Whole texts are read. Defined cases: a null text is scored as an empty one, by the biases
    alone; without labels or with one class only nothing is told apart and every document gets the
    class's rate; a probability equal to the cut is not called; an input column with the name of a
    result is replaced; repeated rows each give a row; an empty table gives an empty table.
    """
    fields = [T.StructField(f"_p_{c}", T.DoubleType()) for c in chain.categories] + [T.StructField(f"_is_{c}", T.BooleanType()) for c in chain.categories]
    shipped = docs.sparkSession.sparkContext.broadcast([(x.keys, x.weights, x.before, x.bias) for x in chain.links])
    categories, cuts = chain.categories, chain.cuts

    def make(batches):
        own = Chain(categories, [Link(*x) for x in shipped.value], cuts)
        for (texts,) in batches:
            p = own.predict(texts)
            yield [*[p[:, k] for k in range(p.shape[1])], *[p[:, k] > cuts[k] for k in range(p.shape[1])]]

    return add_columns(without(docs, [f.name for f in fields]), make, fields, [text_col])
