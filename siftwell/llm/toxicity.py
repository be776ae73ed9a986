"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Fitting, on a bounded sample of labelled rows:
1. Features of tokens are the word and its first letters. Counting the labelled documents that hold a feature, pre-aggregated
   on the cluster, gives each a log-odds; the few that lean to one side form the lexicon (bounded). Each word maps to
   an emission class made of its own and its prefixes' log-odds; all other words are neutral.
2. Labelled tokens: a token of a toxic document with a strongly toxic class is inside a span, all others outside. A two-state
   chain is fitted on these sequences, whole, by limited-memory BFGS on the conditional likelihood: emission and transition weights move by true
   less expected counts, over all sequences at once. Counts behind a training document's classes leave the document itself out.
3. Forward-backward marginals are summed up to document features, and a logistic curve fitted to the labels maps them to scores.

Scoring streams every whole text once, without a shuffle. Runs of neutral tokens are crossed by powers of one matrix, so
Python only steps through the others.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.scratch import Scratch, small_batches

#: Bounds of the fit: labelled documents read, entries of the lexicon.
SAMPLE, LEXICON = 20_000, 20_000
#: Ridge on the chain's weights.
RIDGE = 0.1
#: A feature enters the lexicon from this log-likelihood ratio and this shrunk log-odds; it marks a span from STRONG.
EVIDENCE, LEAN, STRONG = 9.0, 1.5, 3
#: Documents of the average mix that each feature is taken to have been seen in besides its own.
PRIOR = 4.0
PREFIXES = (3, 4, 5, 6)
#: Emission classes: log-odds in whole steps up to this, for the word and for its best prefix.
STEPS = 6
CACHE = 400_000

#: ASCII letters are lower-cased and other ASCII characters separate words; bytes of other characters are letters.
_CLEAN = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_PIECE = 1 << 20


def _pieces(text: bytes | None) -> Iterator[list[bytes]]:
    if not text:
        return
    clean, at = text.translate(_CLEAN), 0
    while at < len(clean):
        end = clean.find(b" ", at + _PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def features(word: bytes) -> list[bytes]:
    """The word (marked by a leading space) and its prefixes, in lower case."""
    w = word.decode("utf-8", "replace").lower()
    return [b" " + w.encode()] + [w[:n].encode() for n in PREFIXES if len(w) >= n + 1 or n == len(w)]


@dataclass
class Model:
    """lexicon: documents of either label that hold a feature. n: documents of either label."""

    lexicon: dict[bytes, tuple[int, int]]
    n: tuple[int, int]
    emission: np.ndarray
    transition: np.ndarray
    weights: np.ndarray

    def odds(self, feature: bytes, less: tuple[int, int] = (0, 0)) -> float:
        """Log-odds of the label with the feature over those without, shrunk towards 0 where it is rare."""
        c = self.lexicon.get(feature)
        if c is None:
            return 0.0
        share = self.n[1] / sum(self.n)
        clean, toxic = c[0] - less[0], c[1] - less[1]
        return math.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share)) * (1 - share) / share)

    def classify(self, word: bytes, less: tuple[int, int] = (0, 0)) -> int:
        """Emission class of a word; 0 is neutral."""
        own, *rest = (self.odds(f, less) for f in features(word))
        best = max(rest, default=0.0)
        step = lambda x: min(STEPS, max(0, round(x)))
        return step(own) * (STEPS + 1) + step(best)


CLASSES = (STEPS + 1) ** 2


class Gaps:
    """Powers of M, the step over one neutral token, divided by the same power of M's larger eigenvalue, and their derivatives."""

    def __init__(self, t: np.ndarray, neutral: np.ndarray):
        self.m = np.exp(t) * np.exp(neutral)[None, :]
        half, det = (self.m[0, 0] - self.m[1, 1]) / 2, self.m[0, 1] * self.m[1, 0]
        root, middle = math.sqrt(half * half + det), (self.m[0, 0] + self.m[1, 1]) / 2
        self.large, self.small = middle + root, middle - root
        v = np.array([[self.m[0, 1], self.m[0, 1]], [self.large - self.m[0, 0], self.small - self.m[0, 0]]])
        self.v, self.inverse = v, np.linalg.inv(v)

    def powers(self, n: np.ndarray) -> np.ndarray:
        """M^n / large^n for each n."""
        ratio = np.stack([np.ones(len(n)), np.power(self.small / self.large, n)], 1)
        return np.einsum("ij,nj,jk->nik", self.v, ratio, self.inverse)

    def derivative(self, n: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The derivative of M^n in the direction by, divided by large^n."""
        q = self.small / self.large
        up = np.power(q, n)
        f = np.empty((len(n), 2, 2))
        f[:, 0, 0] = n / self.large
        f[:, 1, 1] = np.where(n > 0, n * np.power(q, np.maximum(n - 1, 0)), 0.0) / self.large
        f[:, 0, 1] = f[:, 1, 0] = (1.0 - up) / (self.large - self.small)
        return np.einsum("ij,njk,kl->nil", self.v, f * (self.inverse @ by @ self.v), self.inverse)


class Chain:
    """Marginals of compressed sequences: neutral tokens before each other token, the classes of those, and the neutral tokens at the end.
    A text starts from outside a span."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.e, self.t = np.exp(emission), np.exp(transition)
        self.gaps = Gaps(transition, emission[0])
        self.memo: dict[int, np.ndarray] = {}

    def gap(self, n: int) -> np.ndarray:
        if n not in self.memo:
            if len(self.memo) > CACHE:
                self.memo.clear()
            self.memo[n] = self.gaps.powers(np.array([n]))[0]
        return self.memo[n]

    def marginals(self, gaps: list[int], kinds: list[int]) -> np.ndarray:
        """P(toxic) of each non-neutral token."""
        ahead, here = [], np.array([1.0, 0.0])
        for g, k in zip(gaps, kinds, strict=False):
            here = ((here @ self.gap(g)) @ self.t) * self.e[k]
            here = here / here.sum()
            ahead.append(here)
        back: list[np.ndarray] = [None] * len(kinds)
        v = self.gap(gaps[-1]) @ np.ones(2)
        for i in range(len(kinds) - 1, -1, -1):
            back[i] = v = v / v.sum()
            v = self.gap(gaps[i]) @ (self.t @ (self.e[kinds[i]] * v))
        both = np.array(ahead) * np.array(back)
        return both[:, 1] / both.sum(1)


class Sequences:
    """Many tagged sequences, longest first, for likelihoods and gradients of all of them at once. Neutral tokens are outside spans."""

    def __init__(self, sequences: list[tuple[list[int], list[int], list[int]]]):
        order = sorted((x for x in sequences if x[1]), key=lambda x: -len(x[1]))
        self.length = np.array([len(k) for _, k, _ in order], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)))
        flat = lambda i, end: np.fromiter((v for x in order for v in x[i][: len(x[i]) - end]), np.int64)
        self.before, self.kind, self.tag = flat(0, 1), flat(1, 0), flat(2, 0)
        self.last = np.array([g[-1] for g, _, _ in order], np.int64)
        self.gap_values, at = np.unique(np.concatenate([self.before, self.last]), return_inverse=True)
        self.before_at, self.last_at = at[: len(self.before)], at[len(self.before) :]
        self.steps = [np.flatnonzero(self.length > k) for k in range(int(self.length.max(initial=0)))]

    def likelihood(self, e: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Conditional log-likelihood of the tags, and its gradient by the weights e and t."""
        gaps = Gaps(t, e[0])
        power, big_t, big_e = gaps.powers(self.gap_values), np.exp(t), np.exp(e)
        n, total = len(self.length), len(self.kind)
        entered, ahead, back, met = np.empty((total, 2)), np.empty((total, 2)), np.empty((total, 2)), np.empty((total, 2))
        here, log_z = np.tile(np.array([1.0, 0.0]), (n, 1)), np.zeros(n)
        before_gap = np.empty((total, 2))
        for k, live in enumerate(self.steps):  # forward
            i = self.first[live] + k
            before_gap[i] = here[live]
            u = np.einsum("ni,nij->nj", here[live], power[self.before_at[i]])
            entered[i] = u
            v = (u @ big_t) * big_e[self.kind[i]]
            scale = v.sum(1)
            log_z[live] += np.log(scale)
            here[live] = ahead[i] = v / scale[:, None]
        out = np.einsum("nij->ni", power[self.last_at])
        end = (here * out).sum(1)
        log_z += np.log(end) + np.log(gaps.large) * (np.bincount(np.repeat(np.arange(n), self.length), self.before, n) + self.last)
        after = out / out.sum(1)[:, None]
        for k in range(len(self.steps) - 1, -1, -1):  # backward
            live = self.steps[k]
            i = self.first[live] + k
            back[i] = after[live]
            m = (big_e[self.kind[i]] * after[live]) @ big_t.T
            met[i] = m
            w = np.einsum("nij,nj->ni", power[self.before_at[i]], m)
            after[live] = w / w.sum(1)[:, None]
        # Expected counts: of classes and tags, of steps into tokens, and inside gaps by the derivative of their matrix.
        p = ahead * back
        p /= p.sum(1)[:, None]
        de, dt = np.zeros_like(e), np.zeros_like(t)
        np.add.at(de, self.kind, -p)
        np.add.at(de, (self.kind, self.tag), 1.0)
        pair = entered[:, :, None] * big_t[None] * (big_e[self.kind] * back)[:, None, :]
        dt -= (pair / pair.sum((1, 2))[:, None, None]).sum(0)
        left, right = np.concatenate([before_gap, here]), np.concatenate([met, np.ones((n, 2))])
        at = np.concatenate([self.before_at, self.last_at])
        whole = np.einsum("ni,nij,nj->n", left, power[at], right)
        outer = np.zeros((len(self.gap_values), 2, 2))
        np.add.at(outer, at, left[:, :, None] * right[:, None, :] / whole[:, None, None])
        inside = np.empty((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                by = np.zeros((2, 2))
                by[i, j] = gaps.m[i, j]
                inside[i, j] = (gaps.derivative(self.gap_values, by) * outer).sum()
        dt -= inside
        de[0] -= inside.sum(0)
        # The true path: outside in gaps.
        neutral = float(self.before.sum() + self.last.sum())
        score = e[self.kind, self.tag].sum() + neutral * e[0, 0]
        de[0, 0] += neutral
        came = np.zeros(total, np.int64)  # tag of what stands before each token: a neutral token, the token before, or the start of the text
        touching = np.ones(total, bool)
        touching[self.first[:-1]] = False
        touching &= self.before == 0
        came[touching] = self.tag[np.flatnonzero(touching) - 1]
        np.add.at(dt, (came, self.tag), 1.0)
        score += t[came, self.tag].sum()
        earlier = np.zeros(total, np.int64)  # tag before the gap before each token
        earlier[1:] = self.tag[:-1]
        earlier[self.first[:-1]] = 0
        final = np.concatenate([earlier, self.tag[self.first[1:] - 1]])
        runs = np.concatenate([self.before, self.last])
        ones = runs > 0
        np.add.at(dt, (final[ones], np.zeros(int(ones.sum()), np.int64)), 1.0)
        score += t[final[ones], 0].sum()
        rest = float((runs[ones] - 1).sum())
        dt[0, 0] += rest
        score += rest * t[0, 0]
        return float(score - log_z.sum()), de, dt


def _summary(p: np.ndarray) -> np.ndarray:
    """Document features: intercept, P(any toxic token), most toxic token, expected number of toxic tokens."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    return np.array([1.0, 1.0 - float(np.prod(1.0 - p)), float(p.max()), math.log1p(float(p.sum()))])


def _fit_chain(sequences: list[tuple[list[int], list[int], list[int]]], rounds: int = 60, told: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights of the greatest conditional likelihood of the tags, less a small ridge. sequences: gaps, classes, tags of the non-neutral
    tokens. All sequences count, and every step raises the likelihood (told, if given, gets its values)."""
    data = Sequences(sequences)
    x = np.concatenate([np.zeros(2 * CLASSES), np.array([0.0, -4.0, -1.0, 0.0])])
    if not len(data.length):
        return x[:-4].reshape(CLASSES, 2), x[-4:].reshape(2, 2)
    free = np.ones(len(x))
    free[0] = free[-4] = 0.0  # outside and neutral is the reference

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        v, de, dt = data.likelihood(x[:-4].reshape(CLASSES, 2), x[-4:].reshape(2, 2))
        return v - 0.5 * RIDGE * float(x @ x), (np.concatenate([de.ravel(), dt.ravel()]) - RIDGE * x) * free

    now, slope = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []  # limited-memory BFGS
    for _ in range(rounds):
        if told is not None:
            told.append(now)
        q, alphas = slope.copy(), []
        for ds, dg in reversed(past):
            alphas.append((ds @ q) / (ds @ dg))
            q -= alphas[-1] * dg
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / (1.0 + np.abs(slope).max())
        for (ds, dg), alpha in zip(past, reversed(alphas), strict=True):
            q += (alpha - (dg @ q) / (ds @ dg)) * ds
        step, rise = 1.0, float(q @ slope)
        if rise <= 0:
            q, rise, past = slope.copy(), float(slope @ slope), []
        while step > 1e-8:
            trial = x + step * np.clip(q, -4, 4)
            after, new_slope = value(trial)
            if after >= now + 1e-4 * step * float(np.clip(q, -4, 4) @ slope):
                break
            step /= 2
        else:
            break
        ds, dg = trial - x, slope - new_slope
        if ds @ dg > 1e-10:
            past = [*past, (ds, dg)][-8:]
        gained, x, now, slope = after - now, trial, after, new_slope
        if gained < 1e-5 * abs(now):
            break
    return x[:-4].reshape(CLASSES, 2), x[-4:].reshape(2, 2)


def _fit_scores(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps that are shortened until they raise the likelihood."""

    def value(w: np.ndarray) -> float:
        z = x @ w
        return float((y * z - np.logaddexp(0.0, z)).sum() - 0.025 * w @ w)

    w = np.zeros(x.shape[1])
    now = value(w)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        step = 1.0
        while step > 1e-6 and (after := value(w + step * d)) < now:
            step /= 2
        if step <= 1e-6 or after - now < 1e-9:
            break
        w, now = w + step * d, after
    return w


def _label_rows(labels: DataFrame) -> DataFrame:
    """One label a doc_id: toxic if any of its rows says so; null labels do not count."""
    return labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, from at most `sample` labelled rows outside the held-out fifth (those whose ids hash lowest). None
    without a labelled row, or where all have one label."""
    scratch = Scratch(documents.sparkSession)
    small_batches(documents.sparkSession)
    known = _label_rows(labels).filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = scratch.keep(rows, "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for text, y in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = {w for ws in _pieces(text) for w in ws}
                    for f in {f for w in words for f in features(w)}:
                        counts.setdefault(f, [0, 0])[y] += 1
                if len(counts) > CACHE:
                    yield _counts(counts)
                    counts = {}
        yield _counts(counts)

    total = rows.mapInArrow(hold, "feature binary, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    share = n[1] / (n[0] + n[1])
    size, t, c = F.col("c") + F.col("t"), F.col("t"), F.col("c")
    part = lambda x, rate: F.when(x == 0, 0.0).otherwise(x * F.log(x / (size * rate)))
    ratio = 2 * (part(t, share) + part(c, 1 - share))
    odds = F.log((t + PRIOR * share) / (c + PRIOR * (1 - share)) * ((1 - share) / share))
    lean = total.filter((odds >= LEAN) & (ratio >= EVIDENCE)).orderBy(F.desc(ratio), "feature").limit(LEXICON)
    lexicon = {bytes(r["feature"]): (r["c"], r["t"]) for r in lean.collect()}
    model = Model(lexicon, (n[0], n[1]), np.zeros((CLASSES, 2)), np.zeros((2, 2)), np.zeros(4))

    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = {0: {}, 1: {}}
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for text, y in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    memo = reach[y]
                    if len(memo) > CACHE:
                        memo.clear()
                    less = (1 - y, y)
                    gaps, kinds, gap = [], [], 0
                    for ws in _pieces(text):
                        for w in ws:
                            k = memo.get(w)
                            if k is None:
                                k = memo[w] = model.classify(w, less)
                            if not k:
                                gap += 1
                            else:
                                gaps.append(gap)
                                kinds.append(k)
                                gap = 0
                    out.append((y, [*gaps, gap], kinds))
            c = list(zip(*out, strict=True)) or [[]] * 3
            ints = pa.list_(pa.int32())
            yield pa.record_batch([pa.array(c[0], pa.int32()), pa.array(c[1], ints), pa.array(c[2], ints)], ["toxic", "gaps", "kinds"])

    seen = rows.mapInArrow(sequence, "toxic int, gaps array<int>, kinds array<int>").collect()
    strong = lambda k: max(k // (STEPS + 1), k % (STEPS + 1)) >= STRONG
    tagged = [(r["gaps"], r["kinds"], [int(bool(r["toxic"]) and strong(k)) for k in r["kinds"]]) for r in seen]
    model.emission, model.transition = _fit_chain(tagged)
    chain = Chain(model.emission, model.transition)
    x = np.array([_summary(chain.marginals(g, k) if k else np.empty(0)) for g, k, _ in tagged])
    model.weights = _fit_scores(x, np.array([r["toxic"] for r in seen], float))
    return model


def _counts(counts: dict[bytes, list[int]]) -> pa.RecordBatch:
    c, t = zip(*counts.values(), strict=True) if counts else ((), ())
    return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(c, pa.int64()), pa.array(t, pa.int64())], ["feature", "clean", "toxic"])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.chain = Chain(model.emission, model.transition)
        self.memo: dict[bytes, int] = {}

    def score(self, text: bytes | None) -> tuple[float, list[tuple[int, int]], np.ndarray]:
        """Score; positions (word number, class) of non-neutral words; their marginals."""
        memo, classify = self.memo, self.model.classify
        gaps, kinds, at, last = [], [], 0, -1
        for words in _pieces(text):
            new = set(words).difference(memo)
            if len(memo) + len(new) > CACHE:
                memo.clear()
                new = set(words)
            for w in new:
                memo[w] = classify(w)
            found = list(map(memo.__getitem__, words))
            if any(found):
                for i, k in enumerate(found):
                    if k:
                        gaps.append(at + i - last - 1)
                        kinds.append(k)
                        last = at + i
            at += len(words)
        gaps.append(at - last - 1)
        p = self.chain.marginals(gaps, kinds) if kinds else np.empty(0)
        z = float(_summary(p) @ self.model.weights)
        places = (np.cumsum(np.array(gaps[:-1], np.int64) + 1) - 1).tolist() if kinds else []
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z)))), list(zip(places, kinds, strict=True)), p

    def spans(self, text: bytes | None, places: list[tuple[int, int]], p: np.ndarray, least: float = 0.5) -> list[dict]:
        """Code-point offsets of the words more likely toxic than not."""
        want = {w: q for (w, _), q in zip(places, p.tolist(), strict=True) if q >= least}
        if not want:
            return []
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        return [
            {"start": int(chars[m.start()]), "end": int(chars[m.end()]), "p": want[i]}
            for i, m in enumerate(re.finditer(rb"[A-Za-z\x80-\xff]+", text))
            if i in want
        ]


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """Each row of documents with two more columns: toxicity (0 to 1) and toxic_spans (code-point offsets and marginals).

    Null, empty and wordless texts get the score of a text without toxic words. Repeated rows get equal scores. Without a
    model (no labels, or labels of one kind only) every score is 0 and there are no spans. Columns of these two names are replaced.
    """
    base = documents.drop("toxicity", "toxic_spans")
    small_batches(documents.sparkSession)
    kind = "array<struct<start:bigint,end:bigint,p:double>>"
    if model is None:
        return base.withColumns({"toxicity": F.lit(0.0), "toxic_spans": F.array().cast(kind)})
    shared = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    text_at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                scores, spans = [], []
                for text in batch.column(text_at).cast(pa.binary()).to_pylist():
                    value, places, p = scorer.score(text)
                    scores.append(value)
                    spans.append(scorer.spans(text, places, p))
                yield pa.record_batch(
                    [*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, span)],
                    [*batch.schema.names, "toxicity", "toxic_spans"],
                )

    added = T.StructType.fromDDL(f"toxicity double, toxic_spans {kind}")
    schema = T.StructType([*base.schema.fields, *added.fields])
    return base.mapInArrow(run, schema)


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below threshold, with all their columns, those named toxicity or toxic_spans too.

    Texts without words, null ones among them, have the score of a clean text. Repeated rows stay or go together. Without a model all stay.
    """
    model = fit(documents, labels)
    aside = {c: f"{c}_{uuid.uuid4().hex}" for c in ("toxicity", "toxic_spans") if c in documents.columns}
    scored = score(documents.withColumnsRenamed(aside), model).filter(F.col("toxicity") < threshold)
    return scored.drop("toxicity", "toxic_spans").withColumnsRenamed({new: c for c, new in aside.items()}).select(*documents.columns)
