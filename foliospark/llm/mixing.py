"""Mixing sources to target weights (p8): soft membership, projected-gradient least squares, exact rounding.

Every document is a member of the domains by degrees, as a classifier trained on the labelled documents judges it: naive
Bayes on hashed tokens, its counts summed over all labelled documents, its scores made posteriors by a softmax whose
scale and offsets are fitted so that the expected tokens of each source are those it has. For that fit a labelled
document is judged by the model without itself. A written source is one more feature, and outweighs the text.

Nonnegative rates, at most max_repeats, are fitted so that the expected tokens of each domain meet the targets: each
step of the accelerated projected gradient is one pass over the documents and one row of totals a task. It starts from
the solution on a summary of all documents in cells of like membership, and ends when the gap is closed, when a lower
bound proves that no rates would leave a smaller one, or when 50 steps have saved next to nothing. Rates become whole repeats by a threshold on each document's hash,
found per domain on a histogram of the hashes, so that the tokens used meet the fitted totals to a document.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.tokens import DEFAULT_VOCABULARY, SizerSource
from foliospark.sources.tables import checkpointed, safe_key

_LOG = logging.getLogger(__name__)
HASHED = 1 << 12
#: Labelled documents, about, on which the softmax over the scores is fitted; the counts cover all of them.
CALIBRATED = 8_192
#: Odds by which a written source outweighs the text.
LABEL_ODDS = 1e12
#: Posteriors below this are none.
NO_MEMBER = 1e-9
#: Cells that sum up all documents by membership, for the choice of the total and the first rates.
MEMBER_CELLS = 4096
#: The mixture's least size as a share of all tokens: a domain that can't fill its share of that stays short.
LEAST_TOTAL = 0.01
#: The total is the largest whose widest gap is at most this many times the least there is.
NEAR_LEAST = 1.05
#: Cells of a hash histogram; two rounds of cells reach single documents up to their square.
CELLS = 1 << 12
#: A gap of CLOSE of the total is closed; a squared gap is the least if at most LEAST of it could be saved.
CLOSE, LEAST = 1e-6, 1e-3
#: A rate this near a whole number is that number.
WHOLE = 1e-6
#: Steps after which a fit that is not there yet is given with a warning.
STEPS = 2000
#: The same for the summary, on which a step costs next to nothing.
SUMMARY_STEPS = 20_000
#: A fit that saves at most LEAST of its squared gap in so many steps is at its end too, though no bound proves it.
STALL = 50
#: Rounds in which shorter documents fill what is left.
FILLS = 4


def calibrated(scores: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray]:
    """(a, b) with which softmax(a * scores + b) has the least log loss on the classes y under the weights w: Newton
    steps from (1, start). At the optimum the weight expected of each class is the weight it has."""
    n, c = scores.shape
    a, b = 1.0, start.astype(float).copy()
    if not n or c < 2:
        return a, b
    w = w / w.sum()
    own, eye = np.arange(n), np.eye(c)

    def at(a: float, b: np.ndarray) -> tuple[np.ndarray, float]:
        z = a * scores + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p, float(-(w * np.log(p[own, y] + 1e-300)).sum())

    p, loss = at(a, b)
    for _ in range(60):
        diff = w[:, None] * (eye[y] - p)
        g = np.concatenate([[(diff * scores).sum()], diff.sum(axis=0)])
        mean = (p * scores).sum(axis=1)
        wp = w[:, None] * p
        h = np.empty((c + 1, c + 1))
        h[0, 0] = (wp * scores * scores).sum() - (w * mean * mean).sum()
        h[0, 1:] = h[1:, 0] = (wp * (scores - mean[:, None])).sum(axis=0)
        h[1:, 1:] = np.diag(wp.sum(axis=0)) - wp.T @ p
        step = np.linalg.solve(h + 1e-10 * np.eye(c + 1), g)
        size = 1.0
        while size > 1e-6:
            q, new = at(a + size * step[0], b + size * step[1:])
            if new <= loss:
                break
            size /= 2
        else:
            break
        a, b, p = a + size * step[0], b + size * step[1:], q
        done, loss = loss - new < 1e-12, new
        if done:
            break
    return a, b


def memberships(docs: DataFrame, id_col: str, text_col: str, source_col: str, domains: list[str], vocabulary: str = DEFAULT_VOCABULARY, trust_labels: bool = True) -> DataFrame:
    """(id, source, n, p array<double>, labelled): tokens and membership in each of the domains.

    Each text is read once. domains may name sources without documents; a source outside domains is a class of its own,
    so its documents have next to no membership. With trust_labels False written sources only train the model; the
    posterior is that of the text alone, for labelled documents too, and labelled is false. Without any labelled document all memberships are 0.
    """
    sizer_source = SizerSource(docs.sparkSession, vocabulary)
    id_, kind, outer = safe_key(docs, id_col)
    src = docs.select(id_.alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = sizer_source.get()
        for pdf in batches:
            n, hs, ks = [], [], []
            for t in pdf["text"]:
                ids = np.asarray(sizer.encoder.encode_ordinary(t.encode("utf-8", "replace").decode()) if t else [], dtype=np.int64)
                k = np.bincount(ids * 2654435761 % (1 << 31) % HASHED, minlength=1)
                h = np.flatnonzero(k)
                n.append(len(ids))
                hs.append(h.astype("<u2").tobytes())
                ks.append(k[h].astype("<u4").tobytes())
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "n": n, "h": hs, "k": ks})

    prof = checkpointed(src.mapInPandas(profile, f"id {kind}, source string, n bigint, h binary, k binary"))
    label = F.col("source").isNotNull() & (F.trim("source") != "")
    # counts of the hashed tokens: classes x HASHED numbers, whatever the size of the archive
    marked = prof.filter(label)
    prior = {r[0]: r[1] for r in marked.groupBy("source").agg(F.count("*")).collect()}
    classes = sorted(prior)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for c, h, k in zip(pdf["source"], pdf["h"], pdf["k"]):
                if c not in sums:
                    sums[c] = np.zeros(HASHED)
                sums[c][np.frombuffer(h, "<u2")] += np.log1p(np.frombuffer(k, "<u4"))  # the hashes of a document differ
        if sums:  # the columns of an empty frame are numbers, which don't go for arrays
            yield pd.DataFrame({"source": list(sums), "w": [x.tolist() for x in sums.values()]})

    parts = marked.select("source", "h", "k").mapInPandas(add_up, "source string, w array<double>")
    seen = parts.select("source", F.posexplode("w").alias("h", "w")).groupBy("source", "h").agg(F.sum("w").alias("w"))
    weight = np.full((len(classes), HASHED), 0.5)
    for r in seen.collect():
        weight[classes.index(r[0]), r[1]] += r[2]
    shared = docs.sparkSession.sparkContext.broadcast((weight, np.log(weight), classes))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight_, log_, classes_ = shared.value
        place, total = {c: i for i, c in enumerate(classes_)}, weight_.sum(axis=1)
        for pdf in batches:
            out = np.zeros((len(pdf), len(classes_)))
            for i, (source, h, k) in enumerate(zip(pdf["source"], pdf["h"], pdf["k"])):
                h, x = np.frombuffer(h, "<u2"), np.log1p(np.frombuffer(k, "<u4"))
                mass = x.sum()
                s = log_[:, h] @ x - mass * np.log(total)
                own = place.get(source)
                if own is not None and trust_labels:  # without the document itself
                    s[own] = np.log(np.maximum(weight_[own, h] - x, 0.5)) @ x - mass * math.log(max(total[own] - mass, 0.5 * HASHED))
                out[i] = s / max(1.0, math.sqrt(mass))
            yield pdf[["id", "source", "n"]].assign(s=list(out))

    scored = prof.mapInPandas(judge, f"id {kind}, source string, n bigint, s array<double>")
    scored = checkpointed(scored) if classes else scored
    # the softmax is fitted on a bounded sample
    marks = sum(prior.values())
    sample = scored.filter(label & (F.col("n") > 0))
    if marks > CALIBRATED:
        sample = sample.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * CALIBRATED / marks))
    got = sample.select("source", "n", "s").collect() if len(classes) > 1 else []
    logprior = np.log([prior[c] / marks for c in classes]) if classes else np.zeros(0)
    x = np.array([r[2] for r in got]).reshape(len(got), len(classes))
    a, b = calibrated(x, np.array([classes.index(r[0]) for r in got], int), np.array([r[1] for r in got], float), logprior)
    at = [classes.index(d) if d in classes else -1 for d in domains]

    def soften(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {c: i for i, c in enumerate(classes)}
        for pdf in batches:
            z = a * np.array(pdf["s"].tolist(), float).reshape(len(pdf), len(classes)) + b
            if trust_labels:
                for i, c in enumerate(pdf["source"]):
                    if c in place:
                        z[i, place[c]] += math.log(LABEL_ODDS)
            z = np.exp(z - z.max(axis=1, keepdims=True)) if classes else z
            z /= np.maximum(z.sum(axis=1, keepdims=True), 1e-300)
            z[z < NO_MEMBER] = 0.0
            z /= np.maximum(z.sum(axis=1, keepdims=True), 1e-300)
            p = np.stack([z[:, j] if j >= 0 else np.zeros(len(pdf)) for j in at], axis=1) if at else np.zeros((len(pdf), 0))
            yield pdf[["id", "source", "n"]].assign(p=list(p))

    judged = scored.mapInPandas(soften, f"id {kind}, source string, n bigint, p array<double>")
    return checkpointed(judged.select(F.col("id").cast(outer).alias("id"), "source", "n", "p", (label if trust_labels else F.lit(False)).alias("labelled")))


def _vec(a: np.ndarray):
    return F.array(*(F.lit(float(x)) for x in a))


def _dot(a: np.ndarray):
    return F.aggregate(F.zip_with("p", _vec(a), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _capped(members: DataFrame, caps: np.ndarray) -> DataFrame:
    """members with cap, the most repeats of each document: the rounded mean of its domains' where the column is missing."""
    return members if "cap" in members.columns else members.withColumn("cap", F.floor(_dot(caps) + 0.5).cast("double"))


def _descend(totals: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]], goal: np.ndarray, scale: np.ndarray, there: np.ndarray, start: np.ndarray | None = None, residual: np.ndarray | None = None, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float, int, bool]:
    """(potential, residual, widest gap as a share of the total, steps, has it converged) of the accelerated projected
    gradient; totals(potential, r) gives the domains' tokens at the rates of the potential and the most r . tokens can be."""
    total = max(float(goal.sum()), 1e-300)
    last = y = np.where(there, goal / scale, 0.0) if start is None else start
    r = np.zeros(len(goal)) if residual is None else residual
    potential, best, least, bound, wide, speed = y, r, math.inf, 0.0, math.inf, 1.0
    before = math.inf
    for step in range(1, steps + 1):
        got, reach = totals(y, r)
        # weak duality: no rates have a smaller squared gap than this
        bound = max(bound, float(r @ goal - (r * r * scale).sum() / 2 - reach))
        gap = np.where(there, goal - got, 0.0)
        r = gap / scale
        if (gap @ r) / 2 < least:
            least, potential, best, wide = float(gap @ r) / 2, y, r, float(np.abs(gap).max()) / total
        if wide <= CLOSE or least - bound <= LEAST * least:
            return potential, best, wide, step, True
        if step % STALL == 0:
            if before - least <= LEAST * least:
                return potential, best, wide, step, True
            before = least
        new = y + r
        if r @ (new - last) < 0:  # the momentum leads away
            speed, y = 1.0, new
        else:
            faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
            y, speed = new + (speed - 1) / faster * (new - last), faster
        last = new
    return potential, best, wide, steps, False


def _summary(members: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(memberships, tokens, caps) of cells of like membership and cap, which sum up all documents: one pass, and at most
    MEMBER_CELLS + d rows."""
    seeds = [r[0] for r in members.filter("n > 0 and cap > 0").select("p", F.xxhash64("id").alias("h")).orderBy("h").limit(MEMBER_CELLS).select("p").collect()]
    seeds = np.unique(np.concatenate([np.array(seeds, float).reshape(len(seeds), d), np.eye(d)]).round(9), axis=0)
    shared = members.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums = np.zeros((len(c), d + 2))
        for b in batches:
            n, cap = (b.column(x).to_numpy(zero_copy_only=False).astype(float) for x in ("n", "cap"))
            p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(n), d)
            for at in range(0, len(n), 2048):
                q, m = p[at : at + 2048], n[at : at + 2048]
                cell = np.argmin((c * c).sum(axis=1)[None, :] - 2 * q @ c.T, axis=1)
                np.add.at(sums, cell, np.concatenate([q, np.ones((len(q), 1)), cap[at : at + 2048, None]], axis=1) * m[:, None])
        some = np.flatnonzero(sums[:, d] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some].tolist(), pa.list_(pa.float64()))], ["cell", "s"])

    cells = members.filter("n > 0 and cap > 0").select("n", "p", "cap").mapInArrow(run, "cell int, s array<double>")
    rows = cells.groupBy("cell").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d + 2))).collect()
    s = np.array([tuple(r)[1:] for r in rows], float).reshape(len(rows), d + 2)
    n = s[:, d]
    return s[:, :d] / n[:, None], n, s[:, d + 1] / n


def _on_cells(p: np.ndarray, n: np.ndarray, cap: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]]:
    def totals(y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
        return (n * np.clip(p @ y, 0.0, cap)) @ p, float((n * cap * np.maximum(p @ r, 0.0)).sum())

    return totals


def _limits(members: DataFrame, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens expected of each domain, the most that it can give, its share among those that have documents)."""
    d = len(shares)
    sums = lambda rate: [F.sum(rate * F.col("n") * F.col("p")[i]) for i in range(d)]
    got = np.array([x or 0.0 for x in members.agg(*sums(F.lit(1.0)), *sums(F.col("cap"))).head()])
    have, most = got[:d], got[d:]
    share = np.where((have > 0) & (most > 0), shares, 0.0)
    return have, most, share / share.sum() if share.sum() else share


def best_total(members: DataFrame, shares: np.ndarray, caps: np.ndarray) -> float:
    """The tokens of the mixture: the largest total whose widest gap is the least there is (within NEAR_LEAST), on the
    summary of all documents. Where sources are known that is the largest at which every one can have its share. It is
    at least LEAST_TOTAL of all tokens; a domain that can't fill its share of that is short, and the gap says so."""
    members = _capped(members, caps)
    have, most, share = _limits(members, shares)
    if not share.sum():
        return 0.0
    p, n, cap = _summary(members, len(shares))
    scale, there, everything = np.where(have > 0, have, 1.0), have > 0, float(n.sum())
    exact = float((most[share > 0] / share[share > 0]).min())
    tries = sorted({t for t in [exact, *(everything * 2 ** (-j / 2) for j in range(15))] if t >= LEAST_TOTAL * everything}, reverse=True)
    wide = {t: _descend(_on_cells(p, n, cap), share * t, scale, there, steps=400)[2] for t in tries}
    least = min(wide.values())
    total = next(t for t in tries if wide[t] <= NEAR_LEAST * least + 2 * CLOSE)
    _LOG.info("total %.6g of %.6g tokens; widest gap on the summary %.3g, at best %.3g", total, everything, wide[total], least)
    return total


def fit_rates(members: DataFrame, shares: np.ndarray, caps: np.ndarray, total: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(potential, goal): document rates are clip(p . potential, 0, cap); goal: the tokens aimed at per domain.

    Projected gradient on || sum over documents of rate n p - goal ||^2, scaled by the domains' tokens. The gradient at
    a document is p . (residual), so all rates follow from one number per domain, the potential, and only domain totals
    travel. Without `total` the goal is the largest at which every domain that has documents can have its share. Where
    domains overlap it may be out of reach; the fit then ends at the least squared gap. Steps and gap go to the log.
    """
    d = len(shares)
    members = _capped(members, caps)
    have, most, share = _limits(members, shares)
    if not share.sum():
        return np.zeros(d), np.zeros(d)
    if total is None:
        total = float((most[share > 0] / share[share > 0]).min())
    goal, there = share * total, have > 0
    scale = np.where(there, have, 1.0)
    rows = members.select("n", "p", "cap")

    def totals(y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(d + 1)
            for b in batches:
                n, cap = (b.column(x).to_numpy(zero_copy_only=False).astype(float) for x in ("n", "cap"))
                p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(n), d)
                out[:d] += (n * np.clip(p @ y, 0.0, cap)) @ p
                out[d] += (n * cap * np.maximum(p @ r, 0.0)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

        out = np.sum([x[0] for x in rows.mapInArrow(run, "s array<double>").collect()] or [np.zeros(d + 1)], axis=0)
        return out[:d], float(out[d])

    first, residual, _, _, _ = _descend(_on_cells(*_summary(members, d)), goal, scale, there, steps=SUMMARY_STEPS)
    potential, _, wide, step, done = _descend(totals, goal, scale, there, first, residual)
    if not done:
        _LOG.warning("the fit of the rates has not converged after %d steps", STEPS)
    _LOG.info("rates fitted in %d steps over all documents; widest gap %.3g of the total", step, wide)
    return potential, goal


def mix(members: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(id, source, n, repeats): the documents used and how often; targets: (source, target_share, max_repeats).

    Only documents with repeats come out. A labelled document is used no more often than its source allows, and not at
    all if that is no target; another one no more often than the rounded mean of its domains. Empty documents and, if no
    target has documents, all of them are left out. Equal texts are used as the documents they are. Without `total` it
    is that of best_total.
    """
    rows = targets.select("source", "target_share", "max_repeats").filter("source is not null").distinct().orderBy("source").collect()
    # what belongs to no target is a domain too, and wanted nowhere
    shares = np.array([*(r[1] or 0.0 for r in rows), 0.0], float)
    caps = np.array([*(float(r[2] or 0) for r in rows), 0.0])
    members = members.withColumn("p", F.concat("p", F.array(F.greatest(F.lit(0.0), 1 - F.aggregate("p", F.lit(0.0), lambda s, x: s + x)))))
    if "labelled" in members.columns and rows:
        own = F.coalesce(F.create_map(*(F.lit(x) for r, c in zip(rows, caps) for x in (r[0], float(c))))[F.col("source")], F.lit(0.0))
        members = members.withColumn("cap", F.when(F.col("labelled"), own).otherwise(F.floor(_dot(caps) + 0.5).cast("double")))
    members = _capped(members, caps)
    total = best_total(members, shares, caps) if total is None else total
    potential, _ = fit_rates(members, shares, caps, total)
    cap = F.col("cap")
    # the stratum of a document: its strongest domain; within it the same hash threshold holds for all
    top = F.array_position("p", F.array_max("p")).cast("int")
    m = members.filter("n > 0").select("id", "source", "n", F.greatest(F.lit(0.0), F.least(_dot(potential), cap)).alias("rate"), top.alias("g"), F.pmod(F.xxhash64("id"), F.lit(CELLS * CELLS)).alias("u"))
    m = m.filter("rate > 0").withColumn("base", F.floor(F.col("rate") + WHOLE)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    m = checkpointed(m)
    # a document gets one repeat more if hash / part falls below its stratum's threshold, which is near 1; what a long
    # document leaves open is filled in the same way by ever shorter ones
    key = F.when(F.col("part") > WHOLE, F.col("u") / (CELLS * CELLS) / F.col("part"))
    m = m.withColumn("key", key).withColumn("extra", F.lit(0))
    want = {r[0]: r[1] for r in m.groupBy("g").agg(F.sum(F.col("part") * F.col("n"))).collect()}
    for _ in range(FILLS):
        limit, used = _thresholds(m.filter("extra = 0 and key is not null"), want)
        if not any(used.values()):
            break
        chosen = (F.col("extra") == 0) & (F.col("key") < _by_group(limit)) & (F.col("n") <= _by_group(want))
        m = m.withColumn("extra", F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(F.col("extra")))
        want = {g: w - used.get(g, 0.0) for g, w in want.items()}
    return m.select("id", "source", "n", (F.col("base") + F.col("extra")).cast("int").alias("repeats")).filter("repeats > 0")


def _by_group(numbers: dict[int, float]):
    return F.create_map(*(F.lit(x) for g, v in numbers.items() for x in (g, float(v))))[F.col("g")]


def _thresholds(rows: DataFrame, want: dict[int, float]) -> tuple[dict[int, float], dict[int, float]]:
    """Per stratum the greatest threshold on key, to 1 / CELLS ** 2, below which rows no longer than what is wanted have
    no more tokens than that, and these tokens."""
    if not want:
        return {}, {}
    low, below = {g: (0.0, 64.0) for g in want}, dict.fromkeys(want, 0.0)
    for _ in range(3):
        place = (F.col("key") - _by_group({g: c[0] for g, c in low.items()})) / _by_group({g: c[1] for g, c in low.items()})
        cells = rows.filter(F.col("n") <= _by_group(want)).select("g", F.floor(place * CELLS).alias("cell"), "n").filter((F.col("cell") >= 0) & (F.col("cell") < CELLS))
        hist: dict[int, list[tuple[int, float]]] = {}
        for r in cells.groupBy("g", "cell").agg(F.sum("n").alias("s")).collect():  # strata x CELLS rows at most
            hist.setdefault(r[0], []).append((r[1], float(r[2])))
        for g in want:
            start, step = low[g][0], low[g][1] / CELLS
            low[g] = (start + low[g][1], step)
            for c, s in sorted(hist.get(g, [])):
                if below[g] + s > want[g]:
                    low[g] = (start + c * step, step)
                    break
                below[g] += s
    return {g: c[0] for g, c in low.items()}, below


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, gap, documents, tokens): for every target, and every source used."""
    used = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n") * F.col("repeats")).alias("tokens"))
    all_tokens = used.agg(F.sum("tokens").alias("all"))
    out = targets.select("source", "target_share").distinct().join(used, "source", "full_outer").crossJoin(F.broadcast(all_tokens))  # one row
    share = F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0))
    return out.select("source", "target_share", share.alias("reached_share"), (share - F.coalesce("target_share", F.lit(0.0))).alias("gap"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
