"""Toxicity: a linear-chain conditional random field tags toxic tokens; forward-backward marginals give document scores
and offending offsets."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHE, chunked, sweep, table

#: Bound of the sample the field is fitted on: documents of either label, drawn by a hash of doc_id.
TOXIC_DOCS, CLEAN_DOCS = 1200, 2400
#: Letters of a document that may be drawn, and of all that are: what the driver holds is bounded by the latter.
DOC_LETTERS, SAMPLE_LETTERS = 200_000, 32_000_000
#: Of their lines without a toxic token, drawn by a hash, the field is fitted on so many tokens at most.
CLEAN_TOKENS = 300_000
#: Features are hashed to so many weights.
DIM = 1 << 18
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN, NOISE = 0.5, 0.1
#: Share of the toxic documents that a toxic word or stem is found in at least.
RARE = 0.01
STEPS = 50
#: Tokens whose marginals are held at once while the field is fitted.
BLOCK = 1 << 16


def features(word: str) -> tuple[list[int], list[int]]:
    """Hashed features of a word: for its own label, and for its neighbours' labels."""
    w = word.lower().encode("utf-8", "surrogatepass")
    of = lambda kind, s: zlib.crc32(s, kind * 0x3D4D51CB) & (DIM - 1)
    own = [of(1, w), of(2, w[:3]), of(3, w[:4]), of(4, w[:5]), of(5, w[:6]), of(6, w[-3:]), of(7, w[-5:]), of(8, bytes([min(len(w), 20)]))]
    return own, [of(9, w), of(10, w[:4])]


class Field:
    """Two labels; the weight of label 1 over 0 by own, left and right features, and log transitions from i to j."""

    def __init__(self):
        self.own, self.left, self.right = (np.zeros(DIM, np.float32) for _ in range(3))
        self.start, self.trans = 0.0, np.zeros((2, 2))
        self.scale, self.shift = 1.0, 0.0


def emissions(own: np.ndarray, left: np.ndarray, right: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per token; chains lie end to end and begin at starts (its last entry is the end)."""
    e = own.astype(np.float64)
    if len(e) > 1:
        first = np.zeros(len(e) + 1, bool)
        first[starts] = True
        inner = ~first[1:-1]
        e[1:] += np.where(inner, left[:-1], 0)
        e[:-1] += np.where(inner, right[1:], 0)
    return np.clip(e, -30, 30)


def marginals(e: np.ndarray, starts: np.ndarray, start: float, trans: np.ndarray, pairs: bool = False):
    """Odds of label 1 for each token by forward and backward odds; with pairs, the summed transition marginals too.

    All chains go together, longest first; step t holds the chains that reach t.
    """
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    n, first = n[order], starts[:-1][order]
    x, t = np.exp(e), np.exp(trans)
    f, b = np.empty_like(x), np.ones_like(x)
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    for s, a in enumerate(active):
        at = first[:a] + s
        if s:
            p = f[at - 1]
            f[at] = np.clip(x[at] * (t[0, 1] + t[1, 1] * p) / (t[0, 0] + t[1, 0] * p), 1e-30, 1e30)
        else:
            f[at] = x[at] * np.exp(start)
    for s in range(len(active) - 2, -1, -1):
        at = first[: active[s + 1]] + s
        y = x[at + 1] * b[at + 1]
        b[at] = np.clip((t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y), 1e-30, 1e30)
    odds = f * b
    if not pairs:
        return odds
    inner = np.ones(len(e), bool)
    inner[starts[:-1][np.diff(starts) > 0]] = False
    at = np.flatnonzero(inner)
    y, p = x[at] * b[at], f[at - 1]
    w = np.stack([np.stack([t[0, 0] + 0 * y, t[0, 1] * y], -1), np.stack([t[1, 0] * p, t[1, 1] * p * y], -1)], 1)
    return odds, (w / w.sum((1, 2), keepdims=True)).sum(0), at


def chains(text: str) -> list[list[str]]:
    """The words of each line."""
    return [WORD.findall(x) for x in text.split("\n")]


def token_labels(docs: Callable[[], Iterable[tuple[int, set[str]]]]) -> set[str]:
    """Lower-case words that count as toxic tokens: they, or their first four or five letters in several forms, are
    found in at least RARE of the toxic documents and hardly in others, by document frequencies of the labelled sample.

    docs() yields (label, lower-case words) of each document, anew at each call: only words of toxic documents are
    counted, so the others aren't held."""
    total = [0, 0]
    once: list[bool] = []
    owners: dict[int, list[int]] = {}
    for d, (y, ws) in enumerate(docs()):
        least = sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in ws if len(w) > 6)[:16]
        like = Counter(o for h in least for o in owners.get(h, ()))
        once.append(not like or 2 * max(like.values()) <= len(least))
        if once[-1]:  # near copies of one document count once
            for h in least:
                owners.setdefault(h, []).append(d)
            total[y] += 1
    del owners
    stems_of = lambda ws: {w[:n] for w in ws for n in (4, 5) if len(w) > n}
    words, stems = Counter(), Counter()
    for first, (y, ws) in zip(once, docs(), strict=True):
        if first and y:
            words.update(ws)
            stems.update(stems_of(ws))
    forms = Counter(s for w in words for s in stems_of([w]))
    clean_words, clean_stems = Counter(), Counter()
    for first, (y, ws) in zip(once, docs(), strict=True):
        if first and not y:
            clean_words.update(ws & words.keys())
            clean_stems.update(stems_of(ws) & stems.keys())
    clean, toxic = total
    much = lambda n, of, least: n >= max(least, RARE * toxic) and n / (toxic + 1) >= 25 * ((of + 0.1) / (clean + 1))
    good = {s for s, n in stems.items() if forms[s] >= 4 and much(n, clean_stems[s], 2)}
    return {w for w, n in words.items() if much(n, clean_words[w], 4) or (not clean_words[w] and any(w[:k] in good for k in (4, 5) if len(w) > k))}


class Sample:
    """Labelled documents as arrays: word ids end to end, the ends of their lines that have words, and of each document
    the number of these lines."""

    def __init__(self, docs: Iterable[tuple[int, str]]):
        ids, ends, lines, labels = array("i"), array("q", [0]), array("q", [0]), array("b")
        index: dict[str, int] = {}
        for y, text in docs:
            for words in chains(text):
                if words:
                    ids.extend([index.setdefault(w, len(index)) for w in words])
                    ends.append(len(ids))
            lines.append(len(ends) - 1)
            labels.append(y)
        self.words = list(index)
        self.ids, self.ends, self.lines, self.labels = (np.array(x) for x in (ids, ends, lines, labels))

    def tokens(self, line: int) -> np.ndarray:
        return self.ids[self.ends[line] : self.ends[line + 1]]

    def documents(self):
        for y, a, b in zip(self.labels.tolist(), self.lines[:-1], self.lines[1:], strict=True):
            yield y, {self.words[i].lower() for i in set(self.ids[self.ends[a] : self.ends[b]].tolist())}


def feature_table(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    own, near = np.empty((len(words), 8), np.int32), np.empty((len(words), 2), np.int32)
    for i, w in enumerate(words):
        own[i], near[i] = features(w)
    return own, near


def fit(sample: Iterable[tuple[int, str]], steps: int = STEPS) -> Field:
    """Fit on labelled documents (label 0 or 1, text) by full-batch Adam on the field's conditional likelihood. Without
    documents of both labels, or without tokens to tell them by, the field scores every document low."""
    field = Field()
    part = Sample(sample)
    del sample
    labels = part.labels.astype(np.int64)
    bad = token_labels(part.documents)
    toxic = np.fromiter((w.lower() in bad for w in part.words), bool, len(part.words))
    length = np.diff(part.ends)
    marks = toxic[part.ids] & np.repeat(np.repeat(labels == 1, np.diff(part.lines)), length)
    hit = np.add.reduceat(marks, part.ends[:-1], dtype=np.int64) > 0 if len(length) else np.zeros(0, bool)
    if not hit.any() or len(set(labels.tolist())) < 2:
        field.shift = -5.0
        return field
    clean = np.flatnonzero(~hit)
    drawn = np.array([zlib.crc32(" ".join(part.words[i] for i in part.tokens(x)).encode("utf-8", "surrogatepass")) for x in clean], np.int64)
    clean = clean[np.argsort(drawn, kind="stable")]
    before = np.cumsum(length[clean]) - length[clean]
    used = np.r_[np.flatnonzero(hit), clean[before < CLEAN_TOKENS]]
    used = used[np.argsort(-length[used], kind="stable")]  # so that lines of one block are about as long
    starts = np.r_[0, np.cumsum(length[used])]
    at = np.arange(starts[-1]) + np.repeat(part.ends[used] - starts[:-1], length[used])
    y, ids = marks[at], part.ids[at]
    del at, marks, clean, drawn, before
    kinds = np.unique(ids)
    ids = np.searchsorted(kinds, ids).astype(np.int32)
    index = [part.words[i] for i in kinds]
    own, near = feature_table(index)
    used_own, own = np.unique(own, return_inverse=True)
    used_near, near = np.unique(near, return_inverse=True)
    own, near = own.astype(np.int32).reshape(len(index), -1), near.astype(np.int32).reshape(len(index), -1)
    sizes = [len(used_own), len(used_near), len(used_near), 1, 4]
    cuts = np.cumsum([0, *sizes])
    w = np.zeros(cuts[-1])
    w[cuts[3]] = -3.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    edges = np.r_[np.flatnonzero(np.diff(starts[:-1] // BLOCK, prepend=-1)), len(used)]
    l2 = 1e-6 * len(ids)
    for step in range(1, steps + 1):
        wo, wl, wr, ws, wt = (w[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        to, tl, tr = wo[own].sum(1), wl[near].sum(1), wr[near].sum(1)
        per_own, per_left, per_right = (np.zeros(len(index)) for _ in range(3))
        begin, pairs = 0.0, np.zeros((2, 2))
        for i, j in zip(edges[:-1], edges[1:], strict=True):  # what a step holds is bounded by a block of lines
            of, tag, at = ids[starts[i] : starts[j]], y[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
            odds, expected, next_ = marginals(emissions(to[of], tl[of], tr[of], at), at, float(ws[0]), wt.reshape(2, 2), pairs=True)
            g = odds / (1 + odds) - tag
            per_own += np.bincount(of, g, len(index))
            per_left += np.bincount(of[next_ - 1], g[next_], len(index))
            per_right += np.bincount(of[next_], g[next_ - 1], len(index))
            begin += g[at[:-1]].sum()
            pairs += expected - np.bincount(2 * tag[next_ - 1].astype(int) + tag[next_], minlength=4).reshape(2, 2)
        summed = lambda features, of, n: sum(np.bincount(features[:, k], of, n) for k in range(features.shape[1]))
        grad = np.concatenate([summed(own, per_own, sizes[0]), summed(near, per_left, sizes[1]), summed(near, per_right, sizes[2]), [begin], pairs.ravel()])
        grad += l2 * 0.1 * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w = w - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.own[used_own], field.left[used_near], field.right[used_near] = w[: cuts[1]], w[cuts[1] : cuts[2]], w[cuts[2] : cuts[3]]
    field.start, field.trans = float(w[cuts[3]]), w[cuts[4] :].reshape(2, 2).copy()
    of = np.empty((len(part.words), 3), np.float32)
    for i in range(0, len(of), 20_000):
        own, near = feature_table(part.words[i : i + 20_000])
        of[i : i + 20_000] = np.stack([field.own[own].sum(1), field.left[near].sum(1), field.right[near].sum(1)], 1)
    logits, first = [], 0
    for d in range(len(labels)):  # a part of the sample at a time
        a, b = part.ends[part.lines[first]], part.ends[part.lines[d + 1]]
        if b - a >= BLOCK or d == len(labels) - 1:
            ids, starts = part.ids[a:b], part.ends[part.lines[first] : part.lines[d + 1] + 1] - a
            odds = marginals(emissions(of[ids, 0], of[ids, 1], of[ids, 2], starts), starts, field.start, field.trans)
            logits.append(document_logit(odds, part.ends[part.lines[first : d + 2]] - a))
            first = d + 1
    x = np.concatenate(logits)
    for _ in range(200):  # Platt scaling of the summed odds
        p = 1 / (1 + np.exp(-(field.scale * x + field.shift)))
        h = np.maximum(p * (1 - p), 1e-6)
        target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
        hess = np.array([[np.sum(h * x * x) + 1e-3, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-3]])
        move = np.linalg.solve(hess, [np.sum((p - target) * x), np.sum(p - target)])
        field.scale, field.shift = field.scale - float(np.clip(move[0], -0.5, 0.5)), field.shift - float(np.clip(move[1], -0.5, 0.5))
    field.scale = max(field.scale, 1e-3)
    return field


def document_logit(odds: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of each document, whose tokens lie between its cuts, the log of its summed odds; those under NOISE hardly count,
    so that length alone makes no document toxic."""
    sums = np.r_[0.0, np.cumsum(np.where(odds < NOISE, 1e-4 * odds, np.minimum(odds, 1e4)))]
    return np.log(np.maximum(sums[cuts[1:]] - sums[cuts[:-1]], 0) + 1e-2)


def training_sample(docs: DataFrame, labels: DataFrame, usable=None) -> list[tuple[int, str]]:
    """At most TOXIC_DOCS and CLEAN_DOCS labelled documents, those with the smallest hashes of their doc_id, of one row
    each and DOC_LETTERS letters at most; of these, by the same order, as many as have SAMPLE_LETTERS in all."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if usable is not None:
        one = one.where(usable)
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = one.where("toxic = 1").orderBy(*by).limit(TOXIC_DOCS).unionByName(one.where("toxic = 0").orderBy(*by).limit(CLEAN_DOCS))
    rows = docs.select("doc_id", "text").where(F.length("text") <= DOC_LETTERS).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of rows that share a doc_id, one
    so_far = F.sum(F.length("text")).over(Window.orderBy(*by))  # no more than TOXIC_DOCS + CLEAN_DOCS rows
    rows = rows.withColumn("letters", so_far).where(F.col("letters") <= SAMPLE_LETTERS).select("doc_id", "toxic", "text").collect()
    sweep(docs.sparkSession)  # the fit, in the driver's Python, comes next
    return [(r.toxic, r.text) for r in sorted(rows, key=lambda r: r.doc_id)]


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, spans for every row of docs(doc_id, text), each text tagged whole, line by line.

    spans: (start, end) character offsets of runs of tokens with a marginal of SPAN or more. Null texts and texts
    without words get the score of no toxic token and no spans. Rows with null or repeated doc_id are scored alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)

    def tag(batches):
        field = model.value

        class Types(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                new.append(word)
                return n

        of, new, index = np.zeros((0, 3), np.float32), [], Types()
        for c in chunked(batches, 1 << 21):
            if len(index) > CACHE:
                index.clear()
                of = of[:0]
            ids, starts, lines = [], [0], [0]
            get = index.__getitem__
            for t in c["text"]:
                for words in chains(t or ""):
                    if words:
                        ids.extend(map(get, words))
                        starts.append(len(ids))
                lines.append(len(starts) - 1)
            if new:
                both = [features(w) for w in new]
                own, near = np.array([a for a, _ in both]), np.array([b for _, b in both])
                of = np.r_[of, np.stack([field.own[own].sum(1), field.left[near].sum(1), field.right[near].sum(1)], 1)]
                new.clear()
            k, at = np.array(ids, np.int64), np.array(starts)
            odds = marginals(emissions(of[k, 0], of[k, 1], of[k, 2], at), at, field.start, field.trans)
            tokens = at[np.array(lines)]
            p = 1 / (1 + np.exp(-(field.scale * document_logit(odds, tokens) + field.shift)))
            hit = odds >= SPAN / (1 - SPAN)
            any_hit = np.r_[0, np.cumsum(hit)]
            spans = []
            for t, a, b in zip(c["text"], tokens[:-1], tokens[1:], strict=True):
                s: list[tuple[int, int]] = []
                if any_hit[b] > any_hit[a]:
                    last = -2
                    for j, m in enumerate(WORD.finditer(t)):
                        if hit[a + j]:
                            if last == j - 1 and "\n" not in t[s[-1][1] : m.start()]:
                                s[-1] = (s[-1][0], m.end())
                            else:
                                s.append(m.span())
                            last = j
                spans.append([{"start": x, "end": z} for x, z in s])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(p, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tag, "doc_id long, score double, spans array<struct<start:int,end:int>>")


#: A document is toxic from this score on.
TOXIC = 0.7


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, by a field fitted on labels of documents that aren't held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = fit(training_sample(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out()))
    out = score(docs, field)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
