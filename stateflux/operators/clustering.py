"""Clustering of any number of maps into polarity-free states, many sets, restarts and numbers of states at once.

Maps lie in blocks (a set's maps of one Arrow batch as a matrix). A round is one
pass over the blocks: each task adds the sufficient statistics of its maps for
every model of their set (counts, sums, second moments), Spark sums them by
(set, model, state), and each model's few parameters are updated from the sums.
No task, group or driver ever holds a set, and no map is left out. What rounds
leave is a small table of models, written between them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stateflux.functions.special import digamma
from stateflux.operators.rounds import Rounds, sized

EPS = 2.220446049250313e-16
#: Bytes of sums that a task holds before it passes them on; salts over which a set's rows are dealt; rounds of seeding; models that the driver updates.
HELD, SALTS, SEEDINGS, FEW = 64 << 20, 64, 4, 256
#: A model of a set: its parameters as one array, the score that its rounds improve, and whether they have ended.
MODEL = "node string, model int, k int, theta array<double>, score double, done boolean, round int"
SUMS = "node string, model int, state int, v array<double>, far double, far_h long, far_map array<double>"
#: The same on the way to where they are summed: arrays as the bytes of their doubles, which cost nothing to read or write.
PARTS = "node string, model int, state int, v binary, far double, far_h long, far_map binary"
METHODS = ("topo_kmeans", "koenig", "spm_kmeans", "spm_vb")
MEASURES = ["gev", "wss", "residual_variance", "cross_validation", "silhouette", "mean_abs_corr", "min_share", "max_share", "empty_states", "calinski_harabasz", "free_energy", "covariance_trace_mean", "covariance", "log_likelihood", "bic", "icl", "assignment_entropy"]


def normal(maps: np.ndarray) -> np.ndarray:
    """Zero mean and unit length; a constant map becomes zeros."""
    x = maps - np.nanmean(maps, axis=1, keepdims=True)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(np.isfinite(n) & (n > EPS), n, 1.0)


def principal(gram: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
    """The first principal axis of maps with this Gram matrix, along their mean."""
    axis = np.linalg.eigh(gram)[1][:, -1]
    return -axis if mean is not None and axis @ mean < 0 else axis


# -- blocks and passes


def in_blocks(maps: DataFrame, by: list[str], id_: str, map_: str, gfp: str | None) -> DataFrame:
    """node, n, x, w, h, ids: unit maps, squared strengths, hashes and ids of some maps of one set; maps with missing values or without strength take no part."""
    strength = (F.col(gfp) if gfp else F.lit(1.0)).cast("double")
    rows = maps.select(F.to_json(F.struct(*by)).alias("node") if by else F.lit("{}").alias("node"), F.col(id_).alias("id"), F.xxhash64(id_, F.col(map_)).alias("h"), F.col(map_).cast("array<double>").alias("m"), (strength * strength).alias("w"))
    rows = rows.where("w > 0 and w < double('infinity') and size(m) > 0 and forall(m, x -> x is not null and abs(x) < double('infinity'))")
    rows = rows.repartition("node", F.pmod("h", F.lit(SALTS)))  # one set too: its table may be a single part of a file, and every pass would be one task
    kind = maps.schema[id_].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).dictionary_encode()
            code = nodes.indices.to_numpy()
            x = normal(batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1))
            w, h, out = batch.column(4).to_numpy(), batch.column(2).to_numpy(), []
            for c in range(len(nodes.dictionary)):
                at = np.flatnonzero(code == c)
                out.append((nodes.dictionary[c].as_py(), len(at), x[at].tobytes(), w[at].tobytes(), h[at].tobytes(), batch.column(1).take(pa.array(at)).to_pylist()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:5]), pa.array(columns[5], pa.list_(batch.schema.field(1).type))], ["node", "n", "x", "w", "h", "ids"])

    return rows.mapInArrow(pack, f"node string, n int, x binary, w binary, h binary, ids array<{kind}>")


class Block:
    """A row of :func:`in_blocks` as matrices; ``f`` are features, if it has them."""

    def __init__(self, row):
        self.n = row.n
        self.x = np.frombuffer(row.x).reshape(row.n, -1) if hasattr(row, "x") else None
        self.w = np.frombuffer(row.w) if hasattr(row, "w") else None
        self.h = np.frombuffer(row.h, np.int64) if hasattr(row, "h") else None
        self.f = np.frombuffer(row.f).reshape(row.n, -1) if hasattr(row, "f") else None


#: What a pass does with a block and a model's k and parameters: state -> (sums, what is furthest from its state, its hash, its map).
Step = Callable[[Block, int, np.ndarray], dict[int, tuple]]
#: What is made of a state's sums where they are complete.
Close = Callable[[np.ndarray], np.ndarray]
NONE = (None, None, None)


def packed(models: DataFrame) -> DataFrame:
    """One row a set: its models' numbers, ks and parameters."""
    fields = F.sort_array(F.collect_list(F.struct("model", "k", "theta")))
    return models.groupBy("node").agg(fields.alias("m")).select("node", *[F.col(f"m.{c}").alias(f"{c}_") for c in ("model", "k", "theta")])


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of PARTS or SUMS as a batch; arrays are numpy's."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]

    def column(kind: str, values: list) -> pa.Array:
        if kind != "array<double>":
            return pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in values], kinds[kind])
        ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)])
        flat = np.concatenate([np.empty(0), *(v for v in values if v is not None)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([v is None for v in values]))

    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([column(kind, list(c)) for (_, kind), c in zip(fields, columns)], [name for name, _ in fields])


def _added(held: dict, key: tuple, v: np.ndarray, far: tuple) -> None:
    """Sums and the least of ``far`` under a key."""
    if key not in held:
        held[key] = v, far
        return
    before, away = held[key]
    nearer = away[0] is None or (far[0] is not None and far[:2] < away[:2])
    held[key] = before + v, far if nearer else away


def swept(blocks: DataFrame, models: DataFrame | dict[str, list[tuple]], step: Step, columns: Sequence[str], n_bytes: int, close: Close | None = None) -> DataFrame:
    """node, model, state, v, far, far_h, far_map: what ``step`` gives, summed over each set's blocks and closed; of ``far`` the least.

    ``models`` may be a few models by node, (model, k, parameters) each: then they go with the tasks and nothing is joined.
    """
    few = models if isinstance(models, dict) else None
    met = blocks.select(*columns) if few is not None else blocks.select(*columns).join(sized(packed(models), n_bytes), "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for values in zip(*batch.columns):
                row = SimpleNamespace(**{c: v.as_py() for c, v in zip(batch.schema.names, values)})
                own = few.get(row.node, ()) if few is not None else zip(row.model_, row.k_, row.theta_)
                block = Block(row)
                for model, k, theta in own:
                    for state, (v, *far) in step(block, k, np.asarray(theta, float)).items():
                        size += 0 if (row.node, model, state) in held else v.nbytes
                        _added(held, (row.node, model, state), v, tuple(far))
                if size > HELD:
                    yield _rows(PARTS, [(*key, v, *far) for key, (v, far) in held.items()])
                    held, size = {}, 0
        yield _rows(PARTS, [(*key, v, *far) for key, (v, far) in held.items()])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # keys are sorted: of a batch's, only the last may go on in the next one
        held: dict = {}

        def closed(rest: int) -> Iterator[pa.RecordBatch]:
            out = [(*key, close(v) if close else v, *far) for key in list(held)[: len(held) - rest] for v, far in [held.pop(key)]]
            if out:
                yield _rows(SUMS, out)

        for batch in batches:
            for node, model, state, v, far, far_h, far_map in zip(*(c.to_pylist() for c in batch.columns)):
                _added(held, (node, model, state), np.frombuffer(v), (far, far_h, None if far_map is None else np.frombuffer(far_map)))
            yield from closed(1)
        yield from closed(0)

    keys = ["node", "model", "state"]
    return met.mapInArrow(work, PARTS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(summed, SUMS)


#: From k, parameters and each state's sums (v, far, its map): new parameters, the score of the old ones, and whether to end if the score settles.
Update = Callable[[int, np.ndarray, dict[int, tuple]], tuple[np.ndarray, float, bool]]


def iterated(work: Rounds, blocks: DataFrame, models: DataFrame, step: Step, update: Update, columns: Sequence[str], most: int, tol: float, close: Close | None = None) -> DataFrame:
    """Models after rounds of ``step`` and ``update`` until their scores settle, ``most`` rounds at most.

    Up to FEW models are updated by the driver, which then gets each round's sums
    (of whatever number of maps); more are updated where their sums are, and only
    the number of unfinished ones goes to the driver.
    """

    def settled(now: dict, found: dict[int, tuple]) -> dict:
        theta, score, may_end = update(int(now["k"]), np.asarray(now["theta"], float), found)
        before, last = now["score"], int(now["round"]) + 1
        still = abs(before - score) <= tol * max(1.0, abs(before) if math.isfinite(before) else 1.0)
        return {**now, "theta": theta.tolist(), "score": float(score), "done": bool((still and may_end) or last >= most), "round": last}

    def settle(sums: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = {int(r.state): (np.asarray(r.v, float), None if pd.isna(r.far) else float(r.far), r.far_map) for r in sums.itertuples()}
        return pd.DataFrame([settled(own.iloc[0].to_dict(), found)])

    models = work.written(models, "models")
    spark = models.sparkSession
    few = models.limit(FEW + 1).collect()
    if len(few) <= FEW:
        rows = {(r["node"], r["model"]): r.asDict() for r in few}
        nodes = {node for node, _ in rows}
        while active := {key: r for key, r in sorted(rows.items()) if not r["done"]}:
            packs: dict[str, list] = {}
            for (node, model), r in active.items():
                packs.setdefault(node, []).append((model, int(r["k"]), np.asarray(r["theta"], float)))
            some = blocks if len(packs) == len(nodes) else blocks.where(F.col("node").isin(list(packs)))
            found: dict[tuple, dict] = {key: {} for key in active}
            for batch in swept(some, packs, step, columns, 0, close).toArrow().to_batches():  # FEW models' sums
                for node, model, state, v, far, far_map in zip(*(batch.column(c) for c in ("node", "model", "state", "v", "far", "far_map"))):
                    found[node.as_py(), model.as_py()][state.as_py()] = v.values.to_numpy(), far.as_py(), far_map.values and far_map.values.to_numpy()
            for key, sums in found.items():
                rows[key] = settled(rows[key], sums)
        return spark.createDataFrame([tuple(r[c] for c in models.columns) for r in rows.values()], models.schema, verifySchema=False)
    while True:
        active = models.where("not done")
        left = active.agg(F.count(F.lit(1)), F.sum(F.size("theta"))).first()
        if not left[0]:
            return models
        sums = swept(blocks, active, step, columns, 8 * left[1], close)
        new = sums.groupBy("node", "model").cogroup(active.groupBy("node", "model")).applyInPandas(settle, MODEL)
        before, models = models, work.written(models.where("done").unionByName(new), "models")
        work.dropped(before)


def started(models: DataFrame) -> DataFrame:
    """Models (node, model, k, theta) before their first round."""
    return models.select("node", "model", "k", "theta", F.lit(float("inf")).alias("score"), F.lit(False).alias("done"), F.lit(0).alias("round"))


# -- k-means by |r|


def gram_sums(x: np.ndarray, w: np.ndarray, h: np.ndarray, labels: np.ndarray, similarity: np.ndarray, best: np.ndarray, k: int, weighted: bool) -> dict[int, tuple]:
    """Of each state: number, residual and weight of its maps, their sum and Gram matrix, and the map least like its centre."""
    out = {}
    for j in range(k):
        at = np.flatnonzero(labels == j)
        if len(at):
            own, wj = x[at], w[at]
            gram = (own * wj[:, None]).T @ own if weighted else own.T @ own
            least = at[similarity[at] == similarity[at].min()]
            far = least[h[least].argmin()]
            v = np.concatenate([[len(at), float((wj * (1 - best[at] ** 2)).sum()), wj.sum()], own.sum(axis=0), gram.ravel()])
            out[j] = (v, float(similarity[far]), int(h[far]), x[far])
    return out


def with_axis(v: np.ndarray) -> np.ndarray:
    """Of the sums of :func:`gram_sums`, the first three and the principal axis."""
    c = (math.isqrt(4 * (len(v) - 3) + 1) - 1) // 2
    return np.concatenate([v[:3], principal(v[3 + c :].reshape(c, c), v[3 : 3 + c])])


def nearest(weighted: bool) -> Step:
    def step(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
        r = np.abs(b.x @ theta.reshape(k, -1).T)
        best = r.max(axis=1)
        return gram_sums(b.x, b.w, b.h, r.argmax(axis=1), best, best, k, weighted)

    return step


def axes(k: int, theta: np.ndarray, sums: dict[int, tuple]) -> tuple[np.ndarray, float, bool]:
    """Each state's principal axis; an empty state begins at the map least like its own centre, of a state that has others."""
    centres, residual = theta.reshape(k, -1).copy(), 0.0
    spare = sorted((far, j) for j, (v, far, _) in sums.items() if v[0] > 1)
    empty = [j for j in range(k) if j not in sums]
    for j, (v, _, _) in sums.items():
        centres[j] = v[3:]
        residual += v[1]
    for j, (_, of) in zip(empty, spare):
        centres[j] = np.asarray(sums[of][2], float)
    return normal(centres).ravel(), residual, not empty or not spare


def kmeans(work: Rounds, blocks: DataFrame, models: DataFrame, method: str, most: int, tol: float) -> DataFrame:
    return iterated(work, blocks, started(models), nearest(method == "koenig"), axes, ["node", "n", "x", "w", "h"], most, tol, with_axis)


# -- seeds


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes."""
    z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54


def pooled(work: Rounds, blocks: DataFrame, size: int, seed: int) -> DataFrame:
    """node, cands (maps, flat), weights: candidates for seeds of each set, drawn in parallel.

    A round draws ``size`` maps of each set with chances by their squared distance
    1 - r^2 from those before (the smallest of -ln(u) / d^2, u a hash of the map),
    so that a few passes do what k-means++ does one map at a time. Weights are the
    numbers of maps nearest to each candidate.
    """
    pool = None
    for turn in range(SEEDINGS + 1):

        def draw(frames: Iterator[pd.DataFrame], turn=turn) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    b = Block(row)
                    d2 = np.ones(b.n)
                    if turn:
                        d2 = 1 - (np.abs(b.x @ np.asarray(row.cands).reshape(-1, b.x.shape[1]).T).max(axis=1)) ** 2
                    key = np.where(d2 > 1e-12, -np.log(_mixed(b.h, 31 * seed + turn)) / np.maximum(d2, 1e-300), np.inf)
                    for i in np.argsort(key, kind="stable")[:size]:
                        if math.isfinite(key[i]):
                            yield pd.DataFrame({"node": [row.node], "key": [key[i]], "h": [b.h[i]], "map": [b.x[i].tolist()]})

        met = blocks.select("node", "n", "x", "h")
        met = met.join(pool.select("node", "cands"), "node") if turn else met
        first = Window.partitionBy("node").orderBy("key", "h")
        drawn = met.mapInPandas(draw, "node string, key double, h long, map array<double>").dropDuplicates(["node", "h"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= (size if turn else 1))
        cands = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("r", "map"))), lambda s: s["map"]))
        new = drawn.groupBy("node").agg(cands.alias("more"))
        both = new.withColumnRenamed("more", "cands") if not turn else pool.join(new, "node", "left").select("node", F.concat("cands", F.coalesce("more", F.array().cast("array<double>"))).alias("cands"))
        before, pool = pool, work.written(both, "pool")
        work.dropped(before)

    def near(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
        at = np.abs(b.x @ theta.reshape(-1, b.x.shape[1]).T).argmax(axis=1)
        return {0: (np.bincount(at, minlength=len(theta) // b.x.shape[1]).astype(float), *NONE)}

    counted = swept(blocks, pool.select("node", F.lit(0).alias("model"), F.lit(0).alias("k"), F.col("cands").alias("theta")), near, ["node", "n", "x"], 1 << 40)
    return pool.join(counted.select("node", F.col("v").alias("weights")), "node")


def seeded(pool: DataFrame, ks: Sequence[int], restarts: int, seed: int, spread: bool) -> DataFrame:
    """Models (node, model, k, theta) of each set, k and restart: states drawn from the pool by weight and, if ``spread``, squared distance."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                w = np.asarray(row.weights, float)
                x = np.asarray(row.cands, float).reshape(len(w), -1)
                out = []
                for i, k in enumerate(ks):
                    if k < 2 or k >= w.sum():
                        continue
                    for r in range(restarts):
                        rng, d2, own = np.random.default_rng([seed, k, r]), np.ones(len(x)), []
                        for _ in range(k):
                            p = w * d2 if (w * d2).sum() > EPS else w
                            own.append(int(rng.choice(len(x), p=p / p.sum())))
                            d2 = np.minimum(d2, np.clip(1 - (x @ x[own[-1]]) ** 2, 0, None)) if spread else np.where(np.arange(len(x)) == own[-1], 0.0, d2)
                        out.append((row.node, i * restarts + r, k, x[own].ravel().tolist()))
                yield pd.DataFrame(out, columns=["node", "model", "k", "theta"])

    return pool.mapInPandas(draw, "node string, model int, k int, theta array<double>")


def best_of(models: DataFrame) -> DataFrame:
    """Of each set and k the model with the least residual, numbered by k."""
    order = Window.partitionBy("node", "k").orderBy("score", "model")
    return models.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("node", F.col("k").alias("model"), "k", "theta", "score")


# -- features: principal components of outer products


def with_features(work: Rounds, blocks: DataFrame, share: float = 0.999, most: int = 8, extra: int = 12, rounds: int = 20, tol: float = 1e-8) -> DataFrame:
    """Blocks with f: standardised components of the maps' outer products, in which a map and its negative are one point.

    The product of two outer products is the squared product of their maps, so a
    component is a symmetric matrix and a score a quadratic form. Components come
    from subspace iteration: a pass sums, for each of ``most`` + ``extra``
    matrices, the outer products times their scores. As many are kept as explain
    ``share`` of the variance, ``most`` at most.
    """

    def mean(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
        gram = b.x.T @ b.x
        return {0: (np.concatenate([[b.n, float(((b.x**2).sum(axis=1) ** 2).sum())], gram.ravel()]), *NONE)}

    nodes = blocks.select("node").distinct().select("node", F.lit(0).alias("model"), F.lit(0).alias("k"), F.array(F.lit(0.0)).alias("theta"))
    first = swept(blocks, nodes, mean, ["node", "n", "x"], 1 << 20)

    # parameters: n, total variance, then the mean and the basis as matrices
    def begun(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                n, fourth = row.v[0], row.v[1]
                mu = np.asarray(row.v[2:], float) / n
                c = math.isqrt(len(mu))
                q = min(most + extra, c * (c + 1) // 2)
                raw = np.random.default_rng(0).normal(size=(q, c, c))
                basis = np.linalg.qr((raw + raw.transpose(0, 2, 1)).reshape(q, -1).T)[0].T
                total = (fourth - n * float(mu @ mu)) / max(1.0, n - 1)
                theta = np.concatenate([[n, total], mu, basis.ravel()])
                yield pd.DataFrame([(row.node, 0, c, theta.tolist())], columns=["node", "model", "k", "theta"])

    def parts(c: int, theta: np.ndarray):
        mu = theta[2 : 2 + c * c]
        return theta[0], theta[1], mu, theta[2 + c * c :].reshape(-1, c * c)

    def step(b: Block, c: int, theta: np.ndarray) -> dict[int, tuple]:
        _, _, mu, basis = parts(c, theta)
        y = np.stack([((b.x @ v.reshape(c, c)) * b.x).sum(axis=1) - mu @ v for v in basis], axis=1)
        turned = [((b.x * y[:, i, None]).T @ b.x).ravel() for i in range(len(basis))]
        return {0: (np.concatenate([y.sum(axis=0), (y.T @ y).ravel(), *turned]), *NONE)}

    def update(c: int, theta: np.ndarray, sums: dict[int, tuple]) -> tuple[np.ndarray, float, bool]:
        n, total, mu, basis = parts(c, theta)
        q, v = len(basis), sums[0][0]
        power, turn = np.linalg.eigh(v[q : q + q * q].reshape(q, q) / max(1.0, n - 1))
        moved = turn[:, ::-1].T @ (v[q + q * q :].reshape(q, -1) - v[:q, None] * mu)
        lengths = np.linalg.norm(moved, axis=1)
        new = np.where(lengths[:, None] > 1e-12 * max(1.0, lengths.max()), moved, turn[:, ::-1].T @ basis)
        return np.concatenate([[n, total], mu, np.linalg.qr(new.T)[0].T.ravel()]), float(power[::-1][:most].sum()), True

    work_models = started(first.mapInPandas(begun, "node string, model int, k int, theta array<double>"))
    found = iterated(work, blocks, work_models, step, update, ["node", "n", "x"], rounds, tol)

    # the basis turned to the components, scaled to unit variance: one more pass gives their variances
    def spread(b: Block, c: int, theta: np.ndarray) -> dict[int, tuple]:
        return {0: (step(b, c, theta)[0][0][: len(parts(c, theta)[3]) * (len(parts(c, theta)[3]) + 1)], *NONE)}

    n_bytes = 8 * (found.agg(F.sum(F.size("theta"))).first()[0] or 0)
    sums = swept(blocks, found, spread, ["node", "n", "x"], n_bytes)

    def scaled(sums: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        c, theta = int(own["k"].iloc[0]), np.asarray(own["theta"].iloc[0], float)
        n, total, mu, basis = parts(c, theta)
        q, v = len(basis), np.asarray(sums["v"].iloc[0], float)
        power, turn = np.linalg.eigh((v[q:].reshape(q, q) - np.outer(v[:q], v[:q]) / n) / max(1.0, n - 1))
        power, turn = np.maximum(power[::-1], 0), turn[:, ::-1]
        explained = np.cumsum(power) / total if total > EPS else np.ones(q)
        d = min(most, q, int(np.searchsorted(explained, share - 1e-12)) + 1)
        sd = np.sqrt(power[:d])
        rows = (turn.T @ basis)[:d] / np.where(sd > EPS, sd, 1.0)[:, None]
        return pd.DataFrame([(own["node"].iloc[0], (rows @ mu).tolist(), rows.ravel().tolist())], columns=["node", "shift_", "axes_"])

    turned = sums.groupBy("node").cogroup(found.groupBy("node")).applyInPandas(scaled, "node string, shift_ array<double>, axes_ array<double>")
    turned = work.written(turned, "components")

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x, n, shift, rows in zip(frame["x"], frame["n"], frame["shift_"], frame["axes_"]):
                m, d = np.frombuffer(x).reshape(n, -1), len(shift)
                c = m.shape[1]
                basis = np.asarray(rows, float).reshape(d, c, c)
                out.append(np.stack([((m @ v) * m).sum(axis=1) - s for v, s in zip(basis, shift)], axis=1).tobytes())
            yield frame.drop(columns=["shift_", "axes_"]).assign(f=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return work.written(blocks.join(sized(turned, n_bytes), "node").mapInPandas(project, f"{schema}, f binary"), "features")


# -- k-means and mixtures of features


def moments(b: Block, r: np.ndarray, score: np.ndarray) -> dict[int, tuple]:
    """One row a model: the score's sum, then sizes, sums and second moments of the features by responsibilities."""
    second = [(b.f * r[:, j, None]).T @ b.f for j in range(r.shape[1])]
    return {0: (np.concatenate([[score.sum()], r.sum(axis=0), (r.T @ b.f).ravel(), np.ravel(second)]), *NONE)}


def split(k: int, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    d = next(d for d in range(1, 1 << 12) if 1 + k * (1 + d + d * d) == len(v))
    return float(v[0]), v[1 : 1 + k], v[1 + k : 1 + k + k * d].reshape(k, d), v[1 + k + k * d :].reshape(k, d, d)


def by_centres(soft: float) -> Step:
    """Responsibilities from maps as centres: the nearest one's is 1 - ``soft``, and ``soft`` is divided among all."""

    def step(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
        r = np.full((b.n, k), soft / k)
        r[np.arange(b.n), np.abs(b.x @ theta.reshape(k, -1).T).argmax(axis=1)] += 1 - soft
        return moments(b, r, np.zeros(b.n))

    return step


def feature_labels(b: Block, k: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of k points, and squared distances."""
    d2 = ((b.f[:, None, :] - theta.reshape(k, -1)[None]) ** 2).sum(axis=2)
    return d2.argmin(axis=1), d2


def feature_means(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
    labels, d2 = feature_labels(b, k, theta)
    return moments(b, np.eye(k)[labels], d2[np.arange(b.n), labels])


def new_means(k: int, theta: np.ndarray, sums: dict[int, tuple]) -> tuple[np.ndarray, float, bool]:
    score, size, total, _ = split(k, sums[0][0])
    means = theta.reshape(k, -1) if theta.size == k * total.shape[1] else np.zeros(total.shape)
    return np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], means).ravel(), score, True


class Posterior:
    """A variational Gaussian mixture's parameters (Bishop, 2006, chapter 10.2) as one array: weights, precisions' scales, degrees, means, inverse scale matrices.

    Features are standardised, so the prior mean is 0 and the prior scale the identity.
    """

    BETA = 1e-2

    def __init__(self, k: int, theta: np.ndarray):
        self.k = k
        self.d = next(d for d in range(1, 1 << 12) if k * (3 + d + d * d) == len(theta))
        d = self.d
        self.alpha, self.beta, self.nu = theta[:k], theta[k : 2 * k], theta[2 * k : 3 * k]
        self.m, self.inverse = theta[3 * k : 3 * k + k * d].reshape(k, d), theta[3 * k + k * d :].reshape(k, d, d)

    @classmethod
    def of(cls, size: np.ndarray, total: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The parameters that these moments give."""
        k, d = total.shape
        size = size + 1e-10
        mean = total / size[:, None]
        scatter = second - size[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pull = (cls.BETA * size / (cls.BETA + size))[:, None, None] * mean[:, :, None] * mean[:, None, :]
        inverse = np.eye(d) * (1 + 1e-6) + scatter + pull
        beta = cls.BETA + size
        return np.concatenate([1.0 / k + size, beta, d + 1.0 + size, (total / beta[:, None]).ravel(), inverse.ravel()])

    def log_dets(self) -> np.ndarray:
        d = self.d
        return digamma((self.nu[:, None] + 1 - np.arange(1, d + 1)) / 2).sum(axis=1) + d * math.log(2) - np.linalg.slogdet(self.inverse)[1]

    def responsibilities(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """And the logarithms of their normalisers."""
        quad = np.empty((len(f), self.k))
        for j in range(self.k):
            c = f - self.m[j]
            quad[:, j] = self.d / self.beta[j] + self.nu[j] * (c * np.linalg.solve(self.inverse[j], c.T).T).sum(axis=1)
        rho = digamma(self.alpha) - digamma(np.array([self.alpha.sum()])) + 0.5 * self.log_dets() - 0.5 * self.d * math.log(2 * math.pi) - 0.5 * quad
        top = rho.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(rho - top).sum(axis=1))
        return np.exp(rho - norm[:, None]), norm

    def divergence(self) -> float:
        """From the priors: the bound of the evidence is the normalisers' sum less this."""
        k, d, lgamma = self.k, self.d, np.vectorize(math.lgamma)
        log_pi, log_det = digamma(self.alpha) - digamma(np.array([self.alpha.sum()])), self.log_dets()
        w0, nu0 = np.eye(d) * (1 + 1e-6), d + 1.0

        def log_b(inverse: np.ndarray, nu: float) -> float:
            return nu / 2 * np.linalg.slogdet(inverse)[1] - (nu * d / 2 * math.log(2) + d * (d - 1) / 4 * math.log(math.pi) + lgamma((nu + 1 - np.arange(1, d + 1)) / 2).sum())

        out = lgamma(self.alpha.sum()) - lgamma(self.alpha).sum() - (math.lgamma(1.0) - k * math.lgamma(1.0 / k)) + ((self.alpha - 1.0 / k) * log_pi).sum()
        for j in range(k):
            precision = self.nu[j] * np.linalg.inv(self.inverse[j])
            out += 0.5 * (d * (self.BETA / self.beta[j] - 1 + math.log(self.beta[j] / self.BETA)) + self.BETA * self.m[j] @ precision @ self.m[j])
            out += log_b(self.inverse[j], self.nu[j]) - log_b(w0, nu0) + (self.nu[j] - nu0) / 2 * log_det[j] + 0.5 * (np.trace(w0 @ precision) - self.nu[j] * d)
        return float(out)

    def covariances(self) -> np.ndarray:
        return self.inverse / np.maximum(self.nu - self.d - 1, 1.0)[:, None, None]


def expectation(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
    return moments(b, *Posterior(k, theta).responsibilities(b.f))


def maximisation(k: int, theta: np.ndarray, sums: dict[int, tuple]) -> tuple[np.ndarray, float, bool]:
    """New parameters, and minus the free energy of those before."""
    norm, *rest = split(k, sums[0][0])
    return Posterior.of(*rest), Posterior(k, theta).divergence() - norm, True


def from_first(work: Rounds, blocks: DataFrame, models: DataFrame, step: Step, made: Callable[[int, np.ndarray], np.ndarray], columns: Sequence[str], close: Close | None = None) -> DataFrame:
    """Models whose parameters one pass's sums give."""
    n_bytes = 8 * (models.agg(F.sum(F.size("theta"))).first()[0] or 0)
    sums = swept(blocks, models, step, columns, n_bytes, close).groupBy("node", "model").agg(F.sort_array(F.collect_list(F.struct("state", "v"))).alias("s"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns=["states", "vs"]).assign(theta=[made(k, dict(zip(s, v))).tolist() for k, s, v in zip(frame["k"], frame["states"], frame["vs"])])

    rows = sums.join(models.select("node", "model", "k"), ["node", "model"]).select("node", "model", "k", F.col("s.state").alias("states"), F.col("s.v").alias("vs"))
    return work.written(rows.mapInPandas(make, "node string, model int, k int, theta array<double>"), "first")


def states_of(labels: Callable[[Block, int, np.ndarray], np.ndarray]) -> Step:
    """Gram matrices by a model's labels."""

    def step(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
        return gram_sums(b.x, b.w, b.h, labels(b, k, theta), np.zeros(b.n), np.zeros(b.n), k, False)

    return step


def labelled_centres(k: int, vs: dict[int, np.ndarray]) -> np.ndarray:
    """Principal axes by labels; a state without maps is zeros, which the next round fills."""
    out = np.zeros((k, len(next(iter(vs.values()))) - 3))
    for j, v in vs.items():
        out[j] = v[3:]
    return out.ravel()


# -- measures


def measured(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
    """Of each state, what the measures of a fit are made of."""
    r = np.abs(b.x @ theta.reshape(k, -1).T)
    labels, best = r.argmax(axis=1), r.max(axis=1)
    rest = r.copy()
    rest[np.arange(b.n), labels] = -np.inf
    own, other = 1 - best, 1 - rest.max(axis=1)
    top = np.maximum(own, other)
    sil = np.divide(other - own, top, out=np.zeros(b.n), where=top > 0)
    out = {}
    for j in range(k):
        at = labels == j
        if at.any():
            head = [at.sum(), (b.w[at] * best[at] ** 2).sum(), b.w[at].sum(), best[at].sum(), sil[at].sum(), (top[at] > 0).sum(), (b.x[at] ** 2).sum()]
            out[j] = (np.concatenate([head, b.x[at].sum(axis=0)]), *NONE)
    return out


def evidence_moments(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
    r = np.abs(b.x @ theta.reshape(k, -1).T).argmax(axis=1)
    return moments(b, np.eye(k)[r], np.zeros(b.n))


def diagonal(k: int, vs: dict[int, np.ndarray]) -> np.ndarray:
    """Log shares, means and variances of a mixture of diagonal Gaussians with the labels' moments."""
    _, size, total, second = split(k, np.asarray(vs[0], float))
    n, d = size.sum(), total.shape[1]
    spread = lambda m, s, q: (q - s * s / np.maximum(m, 1)) / np.maximum(m - 1, 1)
    square = np.einsum("kii->ki", second)
    everywhere = np.maximum(spread(n, total.sum(axis=0), square.sum(axis=0)) if n > 1 else np.zeros(d), 1e-8)
    ridge = max(1e-8, float(np.median(everywhere)) * 1e-4)
    mean = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], total.sum(axis=0) / n)
    variance = np.where(size[:, None] > 1, np.maximum(spread(size[:, None], total, square), 1e-8), everywhere) + ridge
    return np.concatenate([np.log(size / n + EPS), mean.ravel(), variance.ravel()])


def likelihood(b: Block, k: int, theta: np.ndarray) -> dict[int, tuple]:
    """Log likelihood, assignment entropy, number and dimensions."""
    d = (len(theta) // k - 1) // 2
    mean, variance = theta[k : k + k * d].reshape(k, d), theta[k + k * d :].reshape(k, d)
    joint = np.stack([theta[j] - 0.5 * (d * math.log(2 * math.pi) + np.log(variance[j]).sum() + ((b.f - mean[j]) ** 2 / variance[j]).sum(axis=1)) for j in range(k)], axis=1)
    top = joint.max(axis=1, keepdims=True)
    row = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1) + EPS)
    r = np.exp(joint - row[:, None])
    return {0: (np.array([row.sum(), -(r * np.log(r + EPS)).sum(), b.n, 0.0]), *NONE)}


def with_measures(sums: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """One row a state: its map, its number of maps and the fit's measures."""
    k = int(own["k"].iloc[0])
    centres = np.asarray(own["theta"].iloc[0], float).reshape(k, -1)
    v = {int(r.state): np.asarray(r.v, float) for r in sums.itertuples()}
    c = centres.shape[1]
    table = np.array([v.get(j, np.zeros(7 + c)) for j in range(k)])
    size, explained, weight, best, sil, many, square = table[:, :7].T
    total, n = table[:, 7:], size.sum()
    wss = weight.sum() - explained.sum()
    residual = wss / weight.sum()
    filled = size > 0
    middle = total[filled] / size[filled, None]
    within = float(square.sum() - (size[filled] * (middle**2).sum(axis=1)).sum())
    between = float((size[filled] * ((middle - total.sum(axis=0) / n) ** 2).sum(axis=1)).sum())
    groups = int(filled.sum())
    ch = math.nan if groups < 2 or n <= groups else math.inf if within <= EPS else between / (groups - 1) / (within / (n - groups))
    fit = {
        "gev": explained.sum() / weight.sum(), "wss": wss, "residual_variance": residual, "cross_validation": residual * ((c - 1) / max(1, c - k - 1)) ** 2,
        "silhouette": math.nan if k < 2 or n <= k else sil.sum() / many.sum() if many.sum() else 0.0, "mean_abs_corr": best.sum() / n,
        "min_share": size.min() / n, "max_share": size.max() / n, "empty_states": float((~filled).sum()), "calinski_harabasz": ch,
    }
    return pd.DataFrame([{"node": own["node"].iloc[0], "k": k, "state": j, "map": centres[j].tolist(), "n_state": int(size[j]), "n_maps": int(n), **fit} for j in range(k)])


STATES = "node string, k int, state int, map array<double>, n_state long, n_maps long, " + ", ".join(f"{m} double" for m in MEASURES[:10])


def _kept(best: DataFrame) -> DataFrame:
    return best.select("node", "model", "k", "theta")


def _run(work: Rounds, blocks: DataFrame, first: DataFrame, method: str, rounds: int, tol: float) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Models of one method from first states; for methods in the space of outer products also the blocks with features and (node, model, free energy and covariances)."""
    models = work.written(best_of(kmeans(work, blocks, first, method, rounds, tol)), "best")
    if not method.startswith("spm"):
        return models, None, None
    featured, extra = with_features(work, blocks), None
    if method == "spm_vb":
        begun = from_first(work, featured, models, by_centres(0.1), lambda k, vs: Posterior.of(*split(k, np.asarray(vs[0], float))[1:]), ["node", "n", "x", "f"])
        mixed = iterated(work, featured, started(begun), expectation, maximisation, ["node", "n", "f"], rounds, tol)

        def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                c = [Posterior(int(k), np.asarray(t, float)).covariances() for k, t in zip(frame["k"], frame["theta"])]
                yield frame[["node", "model"]].assign(free_energy=-frame["score"], covariance_trace_mean=[float(np.trace(x, axis1=1, axis2=2).mean()) for x in c], covariance=[float(np.linalg.slogdet(x)[1].mean() / x.shape[1]) for x in c])

        extra = mixed.mapInPandas(described, "node string, model int, free_energy double, covariance_trace_mean double, covariance double")
        labels: Callable = lambda b, k, theta: Posterior(k, theta).responsibilities(b.f)[0].argmax(axis=1)
    else:
        begun = from_first(work, featured, models, by_centres(0.0), lambda k, vs: new_means(k, np.empty(0), {0: (np.asarray(vs[0], float), None, None)})[0], ["node", "n", "x", "f"])
        mixed = iterated(work, featured, started(begun), feature_means, new_means, ["node", "n", "f"], rounds, min(tol, 1e-9))
        labels = lambda b, k, theta: feature_labels(b, k, theta)[0]
    centres = from_first(work, featured, _kept(mixed), states_of(labels), labelled_centres, ["node", "n", "x", "w", "h", "f"], with_axis)
    return work.written(kmeans(work, blocks, centres, method, 20, tol), "refined"), featured, extra


def _described(work: Rounds, blocks: DataFrame, models: DataFrame, featured: DataFrame | None, extra: DataFrame | None) -> DataFrame:
    """node, k, state, map, n_state, n_maps and all measures."""
    n_bytes = 8 * (models.agg(F.sum(F.size("theta"))).first()[0] or 0)
    sums = swept(blocks, _kept(models), measured, ["node", "n", "x", "w"], n_bytes)
    out = sums.groupBy("node", "model").cogroup(models.groupBy("node", "model")).applyInPandas(with_measures, STATES)
    if featured is not None:
        model = from_first(work, featured, _kept(models), evidence_moments, diagonal, ["node", "n", "x", "f"])
        ll, entropy, n = (F.col("v")[i] for i in range(3))
        d = F.greatest(F.floor((F.size("theta") / F.col("k") - 1) / 2), F.lit(1))
        bic = ll - 0.5 * ((F.col("k") - 1) + 2 * F.col("k") * d) * F.ln(n)
        scored = swept(featured, model, likelihood, ["node", "n", "f"], n_bytes).join(model.select("node", "model", "k", "theta"), ["node", "model"])
        out = out.join(scored.select("node", "k", ll.alias("log_likelihood"), bic.alias("bic"), (bic - entropy).alias("icl"), entropy.alias("assignment_entropy")), ["node", "k"], "left")
    if extra is not None:
        out = out.join(extra.withColumnRenamed("model", "k"), ["node", "k"], "left")
    return out.select("node", "k", "state", "map", "n_state", "n_maps", *[(F.col(m) if m in out.columns else F.lit(None)).cast("double").alias(m) for m in MEASURES])


def _named(df: DataFrame, maps: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns ``by`` in the place of node."""
    if not by:
        return df.drop("node")
    kinds = ", ".join(f"`{c}` {maps.schema[c].dataType.simpleString()}" for c in by)
    key = F.from_json("node", kinds)
    return df.select(*[key[c].alias(c) for c in by], *[c for c in df.columns if c != "node"])


def fitted(maps: DataFrame, by: list[str], ks: Sequence[int], method: str = "topo_kmeans", restarts: int = 20, seed: int = 1, id_: str = "id", map_: str = "map", gfp: str | None = None, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """by, k, state, map, n_state, n_maps and the fit's measures: for each set of maps (by) and number of states the best of ``restarts`` fits.

    ``topo_kmeans``: states are the principal axes of the maps nearest to them by
    |r|. ``koenig``: random maps first, and maps keep their strength in the axes
    (Pascual-Marqui and others, 1995). ``spm_kmeans``: k-means of the components
    of outer products with one spherical covariance, from the first. ``spm_vb``: a
    variational Gaussian mixture of these components, with its free energy; the
    states are then settled by |r|, as with the former.

    All sets, restarts and numbers of states share each pass. Every map counts;
    maps without strength or with missing values take no part. Numbers of states
    below two or not below a set's number of maps are left out.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    with Rounds(maps.sparkSession) as work:
        blocks = work.written(in_blocks(maps, by, id_, map_, gfp), "blocks")
        first = seeded(pooled(work, blocks, 2 * max(ks), seed), ks, restarts, seed, method != "koenig")
        models, featured, extra = _run(work, blocks, first, method, rounds, tol)
        return work.result(_named(_described(work, blocks, models, featured, extra), maps, by), "fits")


def _packs(states: DataFrame, by: list[str], model: str | None) -> DataFrame:
    """Models from a table of states: node, model (k, or 0), k, theta."""
    ordered = F.sort_array(F.collect_list(F.struct("state", F.col("map").cast("array<double>").alias("map"))))
    key = (F.to_json(F.struct(*by)) if by else F.lit("{}")).alias("node")
    number = (F.col(model) if model else F.lit(0)).cast("int").alias("model")
    return states.groupBy(key, number).agg(ordered.alias("s")).select("node", "model", F.size("s").alias("k"), F.flatten("s.map").alias("theta"))


def labelled(maps: DataFrame, states: DataFrame, by: list[str], k: str | None = "k", id_: str = "id", map_: str = "map", gfp: str | None = None) -> DataFrame:
    """by, k, id, state, similarity: every map with the state, of each of its set's models, that it is most like but for polarity."""
    packs = _packs(states, by, k).withColumnRenamed("theta", "theta_").withColumnRenamed("k", "k_")
    names = packs.join(states.groupBy((F.to_json(F.struct(*by)) if by else F.lit("{}")).alias("node"), (F.col(k) if k else F.lit(0)).cast("int").alias("model")).agg(F.sort_array(F.collect_list("state")).alias("names_")), ["node", "model"])
    kind, state = maps.schema[id_].dataType.simpleString(), states.schema["state"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                r = np.abs(normal(np.asarray(row.theta_, float).reshape(row.k_, -1)) @ np.frombuffer(row.x).reshape(row.n, -1).T)
                at = r.argmax(axis=0)
                yield pd.DataFrame({"node": row.node, "k": row.model, "id": list(row.ids), "state": np.asarray(row.names_)[at], "similarity": r.max(axis=0)})

    out = in_blocks(maps, by, id_, map_, gfp).select("node", "n", "x", "ids").join(names, "node").mapInPandas(work, f"node string, k int, id {kind}, state {state}, similarity double")
    return _named(out if k else out.drop("k"), maps, by)


def model_comparison(fits: DataFrame, by: list[str]) -> DataFrame:
    """One row for each set and k, with its measures."""
    return fits.where("state = 0").select(*by, "k", "n_maps", *MEASURES)


def hierarchy(maps: DataFrame, k: int, levels: Sequence[Sequence[str]], method: str = "topo_kmeans", restarts: int = 20, seed: int = 1, id_: str = "id", map_: str = "map", gfp: str = "gfp", rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """level, node, the levels' columns, state, map, n_maps: a model of all maps, then one of each node of the levels, with k states.

    ``levels`` are lists of columns, from coarse to fine (groups, conditions,
    participants, files); a node begins at the states of its parent in the finest
    earlier level whose columns it has, the first of several. One pass fits all
    nodes of a level, and a node's maps are dealt to many tasks. A node of k maps
    or fewer keeps its parent's states. Rows without a level's columns take no
    part in it.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    empty = [F.lit(None).cast(maps.schema[c].dataType).alias(c) for c in columns]
    done, out = {(): fitted(maps, [], [k], method, restarts, seed, id_, map_, gfp, rounds, tol).select("state", "map", "n_maps")}, None
    for level in map(list, levels):
        parent = list(next((p for p in reversed(list(done)) if set(p) < set(level)), ()))
        with Rounds(maps.sparkSession) as work:
            blocks = work.written(in_blocks(maps.where(" and ".join(f"`{c}` is not null" for c in level)), level, id_, map_, gfp), "blocks")
            sizes = _named(blocks.groupBy("node").agg(F.sum("n").alias("n_maps")).withColumn("own", F.col("node")), maps, level)
            above = (F.to_json(F.struct(*parent)) if parent else F.lit("{}")).alias("node")
            starts = sizes.select("own", "n_maps", above).join(_packs(done[tuple(parent)], parent, None), "node").select(F.col("own").alias("node"), "n_maps", F.lit(k).alias("model"), "k", "theta")
            starts = work.written(starts, "starts")
            models, *_ = _run(work, blocks, _kept(starts.where("n_maps > k")), method, rounds, tol)
            both = _kept(models).unionByName(_kept(starts.where("n_maps <= k"))).join(starts.select("node", "n_maps"), "node")

            def states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for row in frame.itertuples(index=False):
                        centres = np.asarray(row.theta, float).reshape(row.k, -1)
                        yield pd.DataFrame({"node": row.node, "state": range(row.k), "map": [c.tolist() for c in centres], "n_maps": row.n_maps})

            done[tuple(level)] = work.result(_named(both.mapInPandas(states, "node string, state int, map array<double>, n_maps long"), maps, level), "level")
    for level, rows in done.items():
        own = [F.col(c) if c in level else e for c, e in zip(columns, empty)]
        named = rows.select(F.lit("|".join(level) or "global").alias("level"), F.concat_ws("|", *[F.col(c).cast("string") for c in level]).alias("node"), *own, "state", "map", "n_maps")
        out = named if out is None else out.unionByName(named)
    return out


def bank(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` (by, state, map, n_maps) as maps of a further level: each node's states share its number of maps as their squared strength, gfp; ``id`` tells them apart."""
    k = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return nodes.withColumn("gfp", F.sqrt(F.greatest("n_maps", F.lit(1)) / k)).withColumn("id", F.to_json(F.struct(*by, "state")))


def completed(maps: DataFrame, states: DataFrame, by: list[str], k: int, id_: str = "id", map_: str = "map", gfp: str | None = None) -> DataFrame:
    """by, state, map: models brought to k states: the map least like all states of its set becomes a further one, a pass for each that is missing; of more than k the first k stay."""

    def step(b: Block, _k: int, theta: np.ndarray) -> dict[int, tuple]:
        best = np.abs(b.x @ theta.reshape(-1, b.x.shape[1]).T).max(axis=1)
        at = np.lexsort((b.h, best))[0]
        return {0: (np.array([float(b.n), float(b.x.shape[1]) * b.n]), float(best[at]), int(b.h[at]), b.x[at])}

    def update(_k: int, theta: np.ndarray, sums: dict[int, tuple]) -> tuple[np.ndarray, float, bool]:
        v, _, away = sums[0]
        c = int(v[1] / v[0])
        held = theta.reshape(-1, c)
        more = held[:k] if len(held) >= k else np.vstack([held, np.asarray(away, float)])
        return more.ravel(), float(len(more)), len(more) >= k

    with Rounds(maps.sparkSession) as work:
        blocks = work.written(in_blocks(maps, by, id_, map_, gfp), "blocks")
        models = _packs(states, by, None)
        unit = models.mapInPandas(lambda frames: (f.assign(theta=[normal(np.asarray(t, float).reshape(n, -1)).ravel().tolist() for t, n in zip(f["theta"], f["k"])]) for f in frames), "node string, model int, k int, theta array<double>")
        full = iterated(work, blocks, started(unit), step, update, ["node", "n", "x", "h"], 10_000, 0.0)
        rows = full.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice("theta", i * F.floor(F.size("theta") / k).cast("int") + 1, F.floor(F.size("theta") / k).cast("int")))).alias("state", "map"))
        return work.result(_named(rows, maps, by), "completed")


def collapsed(maps: DataFrame, states: DataFrame, by: list[str], least: float = 0.85, id_: str = "id", map_: str = "map", gfp: str | None = None) -> DataFrame:
    """by, state, map, root: models whose states that are one but for polarity (|r| of ``least`` or more) are joined into the first of each, with the axis of all their maps; root is the old number of the first."""

    def roots(centres: np.ndarray) -> list[int]:
        r = np.abs(normal(centres) @ normal(centres).T)
        out = list(range(len(centres)))
        for j in range(len(centres)):
            out[j] = min([j, *(out[i] for i in range(j) if r[i, j] >= least)])
        return out

    def joined(b: Block, k: int, theta: np.ndarray) -> np.ndarray:
        centres = normal(theta.reshape(k, -1))
        return np.asarray(roots(centres))[np.abs(b.x @ centres.T).argmax(axis=1)]

    with Rounds(maps.sparkSession) as work:
        blocks = work.written(in_blocks(maps, by, id_, map_, gfp), "blocks")
        models = work.written(_packs(states, by, None), "models")
        centres = from_first(work, blocks, models, states_of(joined), labelled_centres, ["node", "n", "x", "w", "h"], with_axis)

        def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    new, old = np.asarray(row.theta, float).reshape(row.k, -1), np.asarray(row.old, float).reshape(row.k, -1)
                    first = sorted(set(roots(old)))
                    maps_ = [(new[j] if np.abs(new[j]).sum() > 0 else normal(old[j : j + 1])[0]).tolist() for j in first]  # a state without maps stays as it was
                    yield pd.DataFrame({"node": row.node, "state": range(len(first)), "map": maps_, "root": first})

        both = centres.join(models.select("node", F.col("theta").alias("old")), "node")
        return work.result(_named(both.mapInPandas(kept, "node string, state int, map array<double>, root int"), maps, by), "collapsed")
