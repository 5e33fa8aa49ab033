"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are stretches between white space; their states are clean and toxic. Emissions are sums of weights of hashed
features (the word, its prefixes and suffix, its shape); transitions tie neighbours. Training tokens get their labels
from labelled documents: a token is toxic if its document is and one of its features marks toxic documents (seen in
several places of them and hardly in clean ones). The likelihood's gradient comes from forward-backward over segments.

Forward-backward runs over all tokens of a text. Its marginals make a document's score: the log-odds that any token is
toxic (tokens taken as independent) and the length go through a logistic fit on labelled documents that neither the
marks nor the chain have seen (a quarter of the training rows at every size).
Tokens that are likelier toxic than not, side by side, are a span: its offsets in code points.

Training is bounded by documented parameters of learn(): rows of each label, and segments that a row gives. Marks and
segments are found on the executors; only hashed features of the segments come to the driver, never a text.

Nulls: a null text is empty; an empty text has no tokens and gets the least score that a text can get. Copies of a text
count once in training. Without any labelled row of a kind every score is the share of toxic rows. Where the quarter
left out, or the rest, has rows of one label only, chain and fit are learnt from all training rows. Ties: nothing depends on the order of rows; equal
texts get equal scores. Repeated rows get a result each. A very long text is cut into tokens in pieces and takes about
16 bytes a token. Columns other than text and identifier are not looked at. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.common import Scratch, is_held_out, table
from meshframe.llm.labelled import training_rows

#: Training rows of each label, and the segments that a row of each label gives, at most.
MOST_CLEAN, MOST_TOXIC = 4000, 1500
CLEAN_EACH, TOXIC_EACH = 3, 4
THRESHOLD = 0.3
HASH_BITS = 18
SEGMENT, EPOCHS, RATE, L2 = 32, 20, 0.3, 1e-4
#: One training row of so many is left to the logistic fit.
FOLDS = 4
#: Log-likelihood ratio at which a feature marks toxic documents.
LEAST_GAIN = 12.0
#: Tokens and words whose emissions are remembered; the longest of them; characters of a text and tokens held at once.
MOST_KNOWN, LONGEST_KNOWN, PIECE, TOGETHER = 120_000, 64, 1 << 20, 1 << 17
#: Tokens of a stretch that a step of the scan goes through side by side with other stretches.
STRETCH = 64
#: Emissions and log-odds are cut here for the sake of floating point alone.
MOST_LOG = 30.0

_CORE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_GAP = re.compile(r"\s")


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) >> (32 - HASH_BITS)


def _word_names(word: str) -> list[str]:
    return ["any", f"w={word}", f"s={word[-3:]}", f"l={min(len(word), 12)}", *(f"p={word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n)]


def token_features(token: str) -> list[int]:
    found = _CORE.search(token)
    if not found:
        return [_hash("any"), _hash("none")]
    names = _word_names(found[0].lower())
    if found[0].isupper():
        names.append("upper")
    if len(found[0]) < len(token) - 2:
        names.append("marks")
    return [_hash(n) for n in names]


def _seed_features(token: str) -> list[str]:
    found = _CORE.search(token)
    if not found:
        return []
    word = found[0].lower()
    return [f"w={word}"] + [f"p={word[:n]}" for n in (4, 5, 6) if len(word) >= n]


def pieces(text: str) -> Iterator[list[str]]:
    """The tokens of a text, in lists from stretches of about PIECE characters."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = gap.end() if gap else len(text)
        yield text[at:end].split()
        at = end


class _Emissions(dict):
    """Token to emission; words are remembered apart from the marks around them."""

    def __init__(self, weights: np.ndarray):
        self.weights = array("d", weights.astype(np.float64).tobytes())
        self.words: dict[str, float] = {}
        self.none, self.upper, self.marks = (self.weights[_hash(n)] for n in ("none", "upper", "marks"))
        self.none += self.weights[_hash("any")]

    def __missing__(self, token: str) -> float:
        found = _CORE.search(token)
        if found is None:
            value = self.none
        else:
            core = found[0]
            word = core.lower()
            value = self.words.get(word)
            if value is None:
                value = sum(map(self.weights.__getitem__, map(_hash, _word_names(word))))
                if len(self.words) >= MOST_KNOWN:
                    self.words.clear()
                if len(word) <= LONGEST_KNOWN:
                    self.words[word] = value
            if core.isupper():
                value += self.upper
            if len(core) < len(token) - 2:
                value += self.marks
        if len(self) >= MOST_KNOWN:
            self.clear()
        if len(token) <= LONGEST_KNOWN:
            self[token] = value
        return value


def _scan(n0: np.ndarray, n1: np.ndarray, d0: np.ndarray, d1: np.ndarray, first: float) -> np.ndarray:
    """r[t] = (n0[t] + n1[t] * r[t-1]) / (d0[t] + d1[t] * r[t-1]), from r[-1] = first.

    A step is a matrix of 2 by 2. Stretches of STRETCH steps are multiplied out side by side, a loop over stretches
    gives the value before each, and then all stretches run side by side again.
    """
    n = len(n0)
    many = -(-n // STRETCH)
    fill = many * STRETCH - n

    def side_by_side(x: np.ndarray, neutral: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate((x, np.full(fill, neutral))).reshape(many, STRETCH).T)

    n0, n1, d0, d1 = side_by_side(n0, 0.0), side_by_side(n1, 1.0), side_by_side(d0, 1.0), side_by_side(d1, 0.0)
    # The product's rows: numerator (a + b * r) over denominator (c + d * r).
    a, b, c, d = np.zeros(many), np.ones(many), np.ones(many), np.zeros(many)
    for k in range(STRETCH):
        a, b, c, d = n0[k] * c + n1[k] * a, n0[k] * d + n1[k] * b, d0[k] * c + d1[k] * a, d0[k] * d + d1[k] * b
        size = a + b + c + d
        a, b, c, d = a / size, b / size, c / size, d / size
    before, r = [], first
    for wa, wb, wc, wd in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True):
        before.append(r)
        r = (wa + wb * r) / (wc + wd * r)
    out, r = np.empty((STRETCH, many)), np.array(before)
    for k in range(STRETCH):
        r = out[k] = (n0[k] + n1[k] * r) / (d0[k] + d1[k] * r)
    return out.T.reshape(-1)[:n]


class Chain:
    """weights: of hashed features for the toxic state. trans[i][j]: of state j after state i, [0][0] being 0; start: of
    the toxic state in the first place; fit: of the log-odds of any toxic token, of the length's logarithm, and 1."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: float, fit):
        self.weights, self.trans, self.start, self.fit = weights, trans, start, np.asarray(fit, float)
        self.known = _Emissions(weights)

    def emissions(self, text: str) -> np.ndarray:
        look = self.known.__getitem__
        parts = [np.fromiter(map(look, tokens), np.float32, len(tokens)) for tokens in pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def log_odds(self, e: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log-odds of the toxic state at each token, by forward-backward; texts end before the places in ends."""
        (_, m01), (m10, m11) = np.exp(self.trans)
        n = len(e)
        opens = np.zeros(n + 1, bool)
        opens[0] = True
        opens[ends] = True
        out = np.empty(n)
        r = 0.0
        for lo in range(0, n, TOGETHER):
            b = np.exp(np.clip(e[lo : lo + TOGETHER].astype(np.float64), -MOST_LOG, MOST_LOG))
            first = opens[lo : lo + len(b)]
            ratio = _scan(np.where(first, math.exp(self.start), m01) * b, np.where(first, 0.0, m11) * b, np.ones(len(b)), np.where(first, 0.0, m10), r)
            r = float(ratio[-1])
            out[lo : lo + len(b)] = np.log(ratio)
        r = 1.0
        for hi in range(n, 0, -TOGETHER):
            lo = max(0, hi - TOGETHER)
            last = opens[lo + 1 : hi + 1][::-1]
            b = np.zeros(hi - lo)  # of the token behind each
            behind = e[lo + 1 : hi + 1].astype(np.float64)
            b[: len(behind)] = np.exp(np.clip(behind, -MOST_LOG, MOST_LOG))
            b = b[::-1]
            ratio = _scan(np.where(last, 1.0, m10), np.where(last, 0.0, m11) * b, np.ones(hi - lo), np.where(last, 0.0, m01) * b, r)
            r = float(ratio[-1])
            out[lo:hi] += np.log(ratio)[::-1]
        return out

    def evidence(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of the log-odds of any toxic token and the length's logarithm; log-odds of all tokens; the ends of texts
        among them) for runs of texts."""
        held, size = [], 0
        for text in texts:
            held.append(self.emissions(text))
            size += len(held[-1])
            if size >= TOGETHER:
                yield self._run(held)
                held, size = [], 0
        if held:
            yield self._run(held)

    def _run(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(e) for e in held])
        odds = self.log_odds(np.concatenate(held), ends) if ends[-1] else np.zeros(0)
        return _aggregate(odds, ends), odds, ends

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = evidence @ self.fit[:-1] + self.fit[-1]
        return 1 / (1 + np.exp(-np.clip(x, -MOST_LOG, MOST_LOG)))

    def parts(self) -> tuple:
        return self.weights.astype(np.float32), self.trans, self.start, self.fit


def _aggregate(odds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = np.diff(ends, prepend=0)
    out = np.stack([np.full(len(ends), -MOST_LOG), np.log1p(sizes)], 1)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (ends - sizes)[some]
        none = np.minimum(np.add.reduceat(-np.logaddexp(0.0, odds), starts), -1e-13)  # log of the chance of no toxic token
        out[some, 0] = np.clip(np.log(-np.expm1(none)) - none, -MOST_LOG, MOST_LOG)
    return out


def spans(text: str, odds: np.ndarray) -> list[dict]:
    """Stretches of tokens that are likelier toxic than not, as offsets in the text; odds: log-odds of its tokens."""
    hits = np.flatnonzero(odds >= 0).tolist()
    if not hits:
        return []
    wanted, at = set(hits), {}
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if i in wanted:
            at[i] = m.span()
    out: list[dict] = []
    for i in hits:
        p = float(1 / (1 + math.exp(-min(odds[i], MOST_LOG))))
        if out and out[-1]["last"] == i - 1:
            out[-1].update(end=at[i][1], last=i, marginal=max(out[-1]["marginal"], p))
        else:
            out.append({"start": at[i][0], "end": at[i][1], "marginal": p, "last": i})
    return [{k: s[k] for k in ("start", "end", "marginal")} for s in out]


# ---------------------------------------------------------------- learning


def _places(likely: frozenset[str] | None):
    """(name, place) of the features in texts, each pair once a batch; a place is hashes of the neighbours."""

    def run(batches):
        names: dict[str, list[str]] = {}
        for batch in batches:
            found = set()
            for value in batch.column("text"):
                before, token, here = 0, "", 0
                for some in (*pieces(value.as_py()), [""]):
                    for after in some:
                        code = zlib.crc32(after.encode())
                        if token:
                            own = names.get(token)
                            if own is None:
                                own = _seed_features(token)
                                if likely is not None:
                                    own = [n for n in own if n in likely]
                                if len(names) >= MOST_KNOWN:
                                    names.clear()
                                names[token] = own
                            if own:
                                place = before << 32 | code
                                found.update([(n, place) for n in own])
                        before, token, here = here, after, code
            rows = list(found)
            places = np.array([p for _, p in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array(places)], names=["name", "place"])

    return run


def _counted(rows: DataFrame, likely: frozenset[str] | None) -> DataFrame:
    """(name, n): in how many different places a feature stands."""
    return rows.select("text").mapInArrow(_places(likely), "name string, place long").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def marks(rows: DataFrame, share: float) -> frozenset[str]:
    """Features that mark toxic documents among rows (text, label): at three places at least, at twenty times the clean
    documents' rate. share: of toxic rows.

    A place is a feature with the tokens before and after it, so that near copies of a document count once, toxic or
    clean. Clean places are counted for the features that would pass without any; these are few.
    """
    counted = _counted(rows.where("label = 1"), None).where("n >= 3").collect()
    toxic = {r["name"]: r["n"] for r in counted if _marks(r["n"], 0, share)}
    clean = {r["name"]: r["n"] for r in _counted(rows.where("label = 0"), frozenset(toxic)).collect()} if toxic else {}
    return frozenset(n for n, k in toxic.items() if _marks(k, clean.get(n, 0), share))


def _marks(toxic: int, clean: int, share: float) -> bool:
    """Whether so many toxic and clean places are no chance: by rate, and by the log-likelihood ratio over many features."""
    n = toxic + clean
    gain = toxic * math.log(toxic / n / share) + (clean * math.log(clean / n / (1 - share)) if clean else 0.0)
    return gain > LEAST_GAIN and toxic * (1 - share) >= 20 * share * (clean + 0.5)


def _segments(marked: frozenset[str], clean_each: int, toxic_each: int):
    """Rows (features of all tokens, how many each token has, which tokens are toxic): of a toxic text segments with a
    mark, of a clean one any; which ones follows from a hash of the text and the segment's number."""

    def run(batches):
        flag: dict[str, bool] = {}
        for batch in batches:
            out = []
            for value, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                text = value.as_py()
                seed, chosen, number, held = zlib.crc32(text.encode()), [], 0, []

                def offer(part):
                    hit = [False] * len(part)
                    if label:
                        for i, t in enumerate(part):
                            known = flag.get(t)
                            if known is None:
                                known = not marked.isdisjoint(_seed_features(t))
                                if len(flag) >= MOST_KNOWN:
                                    flag.clear()
                                flag[t] = known
                            hit[i] = known
                        if not any(hit):
                            return
                    chosen.append((zlib.crc32(number.to_bytes(8, "little"), seed), number, part, hit))
                    if len(chosen) > 64:
                        chosen.sort(key=lambda s: s[:2])
                        del chosen[max(clean_each, toxic_each) :]

                for some in pieces(text):
                    held += some
                    whole = len(held) - len(held) % SEGMENT
                    for first in range(0, whole, SEGMENT):
                        offer(held[first : first + SEGMENT])
                        number += 1
                    held = held[whole:]
                if held:
                    offer(held)
                chosen.sort(key=lambda s: s[:2])
                for _, _, part, hit in chosen[: toxic_each if label else clean_each]:
                    feats = [token_features(t) for t in part]
                    out.append(([f for own in feats for f in own], [len(own) for own in feats], hit))
            columns = list(zip(*out, strict=True)) if out else ([], [], [])
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["feats", "each", "hit"])

    return run


def fit_chain(segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, transitions, start) by gradient ascent (AdaGrad) on the regularised likelihood of segments (features of
    all tokens, how many each has, 0 or 1 a token); segments of a batch go through the chain together."""
    rng = np.random.default_rng(11)
    size = 1 << HASH_BITS
    weights, grads = np.zeros(size), np.full(size, 1e-8)
    trans, trans_grads, start, start_grads = np.zeros((2, 2)), np.full((2, 2), 1e-8), 0.0, 1e-8
    weights[_hash("any")] = -4.0
    packed = []
    order = rng.permutation(len(segments))
    for first in range(0, len(order), 500):
        some = [segments[i] for i in order[first : first + 500]]
        n, length = len(some), max(len(each) for _, each, _ in some)
        y, mask = np.zeros((n, length), int), np.zeros((n, length), bool)
        place = []
        for i, (_, each, hit) in enumerate(some):
            y[i, : len(hit)], mask[i, : len(hit)] = hit, True
            place.append(i * length + np.repeat(np.arange(len(each)), each))
        packed.append((np.concatenate([f for f, _, _ in some]), np.concatenate(place), y, mask))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(packed)):
            feats, place, y, mask = packed[k]
            n, length = y.shape
            e = np.bincount(place, weights[feats], n * length).reshape(n, length)
            boost = np.exp(np.clip(e, -MOST_LOG, MOST_LOG))
            m = np.exp(trans)
            fw = np.zeros((length, n, 2))
            fw[0, :, 0], fw[0, :, 1] = 1.0, math.exp(start) * boost[:, 0]
            fw[0] /= fw[0].sum(1, keepdims=True)
            for t in range(1, length):
                step = fw[t - 1] @ m
                step[:, 1] *= boost[:, t]
                step /= step.sum(1, keepdims=True)
                fw[t] = np.where(mask[:, t, None], step, fw[t - 1])
            bw = np.ones((length, n, 2))
            pair = np.zeros((2, 2))
            for t in range(length - 2, -1, -1):
                after = bw[t + 1].copy()
                after[:, 1] *= boost[:, t + 1]
                joint = fw[t][:, :, None] * m * after[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                pair += joint[mask[:, t + 1]].sum(0)
                step = after @ m.T
                step /= step.sum(1, keepdims=True)
                bw[t] = np.where(mask[:, t + 1, None], step, bw[t + 1])
            post = fw * bw
            p = (post[:, :, 1] / post.sum(2)).T
            error = np.where(mask, y - p, 0.0)
            g = np.bincount(feats, error.reshape(-1)[place], size)
            g[feats] -= L2 * weights[feats]
            grads += g * g
            weights += RATE * g / np.sqrt(grads)
            both = mask[:, 1:]
            true = np.array([[np.count_nonzero(both & (y[:, :-1] == a) & (y[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)])
            tg = true - pair
            trans_grads += tg * tg
            trans += RATE * tg / np.sqrt(trans_grads)
            sg = float(error[:, 0].sum()) - L2 * start
            start_grads += sg * sg
            start += RATE * sg / math.sqrt(start_grads)
    # Taking the same from every transition and from the first place leaves all marginals as they are.
    return weights, trans - trans[0, 0], start


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of x and of 1 by Newton's method, regularised so that separable data stay finite."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -MOST_LOG, MOST_LOG)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(model):
    def run(batches):
        chain = Chain(*model.value)
        for batch in batches:
            x = np.concatenate([np.zeros((0, 2)), *(x for x, _, _ in chain.evidence(v.as_py() or "" for v in batch.column("text")))])
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(2)]], names=["label", "any", "length"])

    return run


def learn(docs: DataFrame, labels: DataFrame, most_clean: int = MOST_CLEAN, most_toxic: int = MOST_TOXIC, clean_each: int = CLEAN_EACH, toxic_each: int = TOXIC_EACH) -> Chain:
    """From about most_clean and most_toxic labelled rows at most, clean_each and toxic_each segments of each at most."""
    scratch = Scratch(docs.sparkSession)
    rows = training_rows(docs, labels, F.col("toxic"), {0: most_clean, 1: most_toxic}).select("text", "label", F.sha2("text", 256).alias("key"))
    once = rows.groupBy("key", "label").agg(F.any_value("text").alias("text"))
    fold = F.pmod(F.xxhash64("key"), F.lit(FOLDS)) == 0
    rows = scratch.stash(once.select("text", "label", fold.alias("left_out")), "toxic-rows")
    counts = {(r["left_out"], r["label"]): r["count"] for r in rows.groupBy("left_out", "label").count().collect()}
    of = [sum(n for (_, y), n in counts.items() if y == label) for label in (0, 1)]
    weights, trans = np.zeros(1 << HASH_BITS), np.zeros((2, 2))
    if not all(of):
        share = of[1] / max(1, sum(of))
        scratch.remove()
        return Chain(weights, trans, 0.0, [0, 0, math.log(max(share, 1e-3) / max(1 - share, 1e-3))])
    split = all((left_out, y) in counts for left_out in (False, True) for y in (0, 1))
    fitted, judged = (rows.where("not left_out"), rows.where("left_out")) if split else (rows, rows)
    seen = [counts[False, y] for y in (0, 1)] if split else of
    marked = marks(fitted, seen[1] / sum(seen))
    found = fitted.select("text", "label").mapInArrow(_segments(marked, clean_each, toxic_each), "feats array<int>, each array<int>, hit array<boolean>")
    found = found.orderBy(F.xxhash64("feats"), "feats").toArrow()
    segments = [tuple(np.asarray(found.column(c)[i].values) for c in ("feats", "each", "hit")) for i in range(len(found))]
    weights, trans, start = fit_chain(segments)
    chain = Chain(weights, trans, start, [0, 0, 0])
    model = docs.sparkSession.sparkContext.broadcast(chain.parts())
    x = judged.select("text", "label").mapInArrow(_evidence(model), "label int, any double, length double").toPandas()
    chain.fit = _logistic(x[["any", "length"]].to_numpy(), x["label"].to_numpy(float))
    model.destroy()
    scratch.remove()
    return chain


# ---------------------------------------------------------------- judging


def _tag(model):
    def run(batches):
        chain = Chain(*model.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column("text")]
            scores, found, at = [], [], 0
            for x, odds, ends in chain.evidence(texts):
                scores.append(chain.score(x))
                first = 0
                for end in ends.tolist():
                    found.append(spans(texts[at], odds[first:end]))
                    first, at = end, at + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(found, kind)], names=["doc_id", "score", "spans"])

    return run


def toxicity(df: DataFrame, chain: Chain, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, score, spans array<struct<start, end, marginal>>) for every row of df."""
    model = df.sparkSession.sparkContext.broadcast(chain.parts())
    rows = df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_tag(model), "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>")


def _clean_only(model, threshold: float, text: str):
    def run(batches):
        chain = Chain(*model.value)
        for batch in batches:
            scores = [chain.score(x) for x, _, _ in chain.evidence(v.as_py() or "" for v in batch.column(text))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < threshold))

    return run


def drop_toxic(df: DataFrame, chain: Chain, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text scores below the threshold."""
    model = df.sparkSession.sparkContext.broadcast(chain.parts())
    return df.mapInArrow(_clean_only(model, threshold, text), df.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
