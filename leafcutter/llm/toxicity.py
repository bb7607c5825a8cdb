"""Toxic passages: maximum-scoring segments of token log-odds.

Fit: words are counted by label in a bounded sample of labelled documents, once for each
different line (copies of a document bring nothing new; a line that also stands in a clean
document counts as clean). A word, and each prefix of a word, gets its log-odds between
the labels under an informative Dirichlet prior (the pooled counts, scaled). Its worth is the log-odds less two standard errors, and it is
kept where that is clearly above zero. A token scores the best worth among its own word and its
prefixes; other tokens cost the drift, the log-ratio of meeting none of the kept ones.

Score: one linear scan finds all maximal segments of positive total (every passage, not the
best alone). Segment totals follow an extreme-value law: with lambda from the clean tokens'
scores and K from the number of segments in clean documents, a total S is expected
E = K n exp(-lambda S) times in n clean tokens. A document's evidence is the sum of -ln E over
its passages with E below 1, turned into a probability by a logistic curve that is fitted on
labelled documents not used for the counts.

Labels of rows whose crc32(doc_id as text) mod 4 is 2 are never read. Inputs of a score are
the text's words alone.

Defined cases: null, empty and wordless texts have no passage and get the curve's base
value; a null ``doc_id`` is scored like any other and is not held out; repeated labels count as
toxic if one of them does; without labels of both kinds every score is the share of toxic
labels (0 without labels); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import give_back_memory, slices
from .common import cut, table

#: Labelled documents that are read to fit (those first in hash order).
FIT_DOCS = 16_000
#: Prior weight of the pooled counts, worth from which a word or prefix is kept, and how many at most.
PRIOR, WORTH, LEXICON = 0.1, 1.0, 20_000
#: Lines with a word or prefix in toxic documents from which it is kept.
LEAST_LINES = 5
PREFIXES = range(3, 9)
BLANK = 10
LEAST_DRIFT = 0.02
THRESHOLD = 0.3
EDGES = "".join(chr(c) for c in range(128) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"
#: Distinct tokens that a worker remembers.
REMEMBERED = 150_000


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    drift: float = LEAST_DRIFT
    lam: float = 1.0
    k: float = 0.1
    a: float = 0.0
    b: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def token(self, raw: str) -> float:
        """Score of a token; 0 stands for one without evidence, which costs the drift."""
        w = raw.lower().strip(EDGES)
        best = self.words.get(w, 0.0)
        for n in PREFIXES:
            if n > len(w):
                break
            best = max(best, self.prefixes.get(w[:n], 0.0))
        return best

    def events(self, text: str | None) -> tuple[list[tuple[int, float]], int]:
        """Tokens with evidence as (place, score), and the number of tokens."""
        tokens = (text or "").split()
        known = self.known
        new = [w for w in set(tokens) if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = [*set(tokens)]
        for w in new:
            known[w] = self.token(w)
        return [(i, s) for i, s in enumerate(map(known.__getitem__, tokens)) if s], len(tokens)

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        events, n = self.events(text)
        return segments(events, self.drift), n

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        base = math.log(max(self.k * n, 1e-12))
        return sum(max(0.0, self.lam * s - base) for _, _, s in found)

    def probability(self, x: float) -> float:
        z = self.a + self.b * math.log1p(x)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def segments(events: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, total)`` of a sequence in which every token
    costs ``drift`` and the listed places add their scores. Linear in the number of events."""
    kept: list[list[float]] = []  # first, last, total before it, total with it
    lower: list[int] = []  # for each, the nearest earlier one that began lower
    total, at = 0.0, -1
    for place, score in events:
        total -= drift * (place - at)
        at = place
        before, total = total + drift, total + score
        if score <= drift:
            continue
        new, j = [place, place, before, total], len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= new[2]:
                j = lower[j]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                lower.append(j)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:], lower[j:]
            j -= 1
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in kept]


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(lambda * scores)) = 1, weights adding to 1."""
    f = lambda x: float((weights * np.exp(np.minimum(x * scores, 50.0))).sum()) - 1
    if not (scores > 0).any():
        return 1.0
    hi = 0.05
    while f(hi) < 0 and hi < 10:
        hi *= 1.5
    lo = 1e-6
    if f(lo) > 0:
        return 0.05
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a slight ridge. ``BLANK`` documents without
    evidence and with the share of toxic labels steady the intercept where labels are few."""
    x, y = np.append(x, np.zeros(BLANK)), np.append(y, np.full(BLANK, share))
    design = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model, from at most ``FIT_DOCS`` labelled documents; labels that are held out are not read."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg((F.max(label) > 0).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(FIT_DOCS)
    chosen = chosen.select(F.col(key).alias("_key"), "_y", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)).cast("int").alias("_part"))
    # bounded by FIT_DOCS, so it may be broadcast
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(cut(chosen)), "_key")

    def count(batches):
        words: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column("line").to_pylist(), b.column("y").to_pylist(), strict=True):
                for w in {w.lower().strip(EDGES) for w in t.split()}:
                    words.setdefault(w, [0, 0])[y] += 1
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([*words]), pa.array([c[0] for c in words.values()], pa.int64()), pa.array([c[1] for c in words.values()], pa.int64())], ["w", "c", "t"])

    lines = sample.where("_part <> 0").select(F.explode(F.split(F.coalesce("_text", F.lit("")), "\n")).alias("line"), "_y").groupBy("line").agg(F.min("_y").alias("y"))
    words = cut(lines.mapInArrow(count, "w string, c long, t long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t")))
    n_c, n_t = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    model = Model()
    share = chosen.agg(F.avg("_y")).first()[0] or 0.0
    if not n_c or not n_t:
        model.a = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return model
    feats = words.select("c", "t", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("n"), F.col("w").alias("f"))), *[F.when(F.length("w") >= n, F.array(F.struct(F.lit(n).alias("n"), F.substring("w", 1, n).alias("f")))).otherwise(F.array().cast("array<struct<n:int,f:string>>")) for n in PREFIXES])).alias("x"))
    feats = feats.where("x.f <> ''").groupBy("x.n", "x.f").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    pooled = PRIOR * (F.col("c") + F.col("t"))
    a_t, a_c = pooled * (n_t / (n_c + n_t)), pooled * (n_c / (n_c + n_t))
    odds = lambda y, a, n: F.log((y + a) / (F.lit(n * (1 + PRIOR)) - y - a))
    delta = odds(F.col("t"), a_t, n_t) - odds(F.col("c"), a_c, n_c)
    worth = delta - 2 * F.sqrt(1 / (F.col("t") + a_t) + 1 / (F.col("c") + a_c))
    lexicon = feats.select("n", "f", "t", worth.alias("s")).where((F.col("s") >= WORTH) & (F.col("t") >= LEAST_LINES)).orderBy(F.col("s").desc(), "n", "f").limit(LEXICON).collect()
    for r in lexicon:
        (model.words if r.n == 0 else model.prefixes)[r.f] = r.s
    # how often clean and toxic tokens score what: on the counted words again
    scored = Counter()
    hit = [0.0, 0.0]

    def histogram(batches):
        got: dict[float, list[int]] = {}
        for b in batches:
            for w, c, t in zip(*(b.column(x).to_pylist() for x in ("w", "c", "t")), strict=True):
                g = got.setdefault(round(model.token(w), 1), [0, 0])
                g[0] += c
                g[1] += t
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([*got]), pa.array([g[0] for g in got.values()], pa.int64()), pa.array([g[1] for g in got.values()], pa.int64())], ["s", "c", "t"])

    rows = words.mapInArrow(histogram, "s double, c long, t long").groupBy("s").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()
    for r in rows:
        scored[r.s] += r.c
        if r.s > 0:
            hit[0] += r.c
            hit[1] += r.t
    model.drift = max(LEAST_DRIFT, math.log((1 - hit[0] / n_c) / max(1e-9, 1 - hit[1] / n_t)))
    values = np.array([*scored]) - model.drift
    model.lam = min(1.0, _solve_lambda(values, np.array([*scored.values()]) / n_c))

    def check(batches):
        for b in batches:
            keep = [(model.passages(t), y) for t, y, part in zip(*(b.column(c).to_pylist() for c in ("_text", "_y", "_part")), strict=True) if part == 0]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([y for _, y in keep], pa.int32()), pa.array([n for (_, n), _ in keep], pa.int64()), pa.array([[s for _, _, s in f] for (f, _), _ in keep], pa.list_(pa.float64()))], ["y", "n", "s"])

    checked = sample.mapInArrow(check, "y int, n long, s array<double>").collect()
    if not checked:
        return model
    clean = [r for r in checked if not r.y]
    least = 0.5
    model.k = (sum(sum(s >= least for s in r.s) for r in clean) + 0.5) / (sum(r.n for r in clean) + 1) * math.exp(model.lam * least)
    x = np.array([math.log1p(model.evidence([(0, 0, s) for s in r.s], r.n)) for r in checked])
    model.a, model.b = _logistic(x, np.array([r.y for r in checked], dtype=np.float64), share)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, passages)``: passages are arrays of (first word, last word, total, E)."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("total", pa.float64()), ("expected", pa.float64())]))

    def work(batches):
        m = shared.value
        for b in slices(batches, "_text"):
            p, found = [], []
            for t in b.column("_text").to_pylist():
                got, n = m.passages(t)
                p.append(m.probability(m.evidence(got, n)))
                rated = ((i, j, s, m.k * n * math.exp(-m.lam * s)) for i, j, s in got)
                found.append([{"first": i, "last": j, "total": s, "expected": e} for i, j, s, e in rated if e < 1])
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(p, pa.float64()), pa.array(found, out)], names=[key, "score", "passages"])
        m.known.clear()
        give_back_memory()

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(work, f"`{key}` {kind}, score double, passages array<struct<first:long,last:long,total:double,expected:double>>")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(text.lower())

    def work(batches):
        m = shared.value
        for whole in batches:
            for b in slices([whole], whole.schema.names[at]):
                keep = [m.probability(m.evidence(*m.passages(t))) < THRESHOLD for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))
        m.known.clear()
        give_back_memory()

    return docs.mapInArrow(work, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
