"""A message-passing encoder over cut graphs, and completion of bipartite cells; both are trained by sums over rows.

Nodes and cells stay in Spark. A training step sends the parameters of all models to the rows and
brings back one summed gradient per model; partitions sum theirs first, and the sums of partitions
are added up in Spark. So the driver holds parameters alone, and their number is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.operators.tables import settled

#: Parameters of all models, and sums of analytes, that the driver holds at most.
LIMIT = 1_000_000


def propagated(edges: DataFrame, nodes: DataFrame, columns: list[str], hops: int = 2) -> tuple[DataFrame, list[str]]:
    """(nodes with the columns of each relation and hop, their names).

    ``edges`` (relation, src, dst, weight) go both ways and hold no edge between blocks, so what reaches a node
    comes from its own block alone. A hop is the weighted mean over a node's neighbours of the hop before; where
    there is none it is null. ``<relation>_degree`` is log1p of the neighbours.
    """
    relations = [r.relation for r in edges.select("relation").distinct().orderBy("relation").limit(65).collect()]
    if len(relations) > 64:
        raise ValueError("over 64 relations")
    out, names = nodes, list(columns)
    for relation in relations:
        own = edges.where(F.col("relation") == relation).select("src", "dst", "weight")
        held = nodes.select(F.col("entity").alias("src"), *(F.col(c).cast("double").alias(c) for c in columns))
        for hop in range(1, hops + 1):
            def mean(c: str):
                return F.try_divide(F.sum(F.col("weight") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("weight"))))

            held = own.join(held, "src").groupBy("dst").agg(*(mean(c).alias(c) for c in columns), F.log1p(F.count("*")).alias("degree")).withColumnRenamed("dst", "src")
            made = {c: f"{relation}_{hop}_{c}" for c in columns} | ({"degree": f"{relation}_degree"} if hop == 1 else {})
            out = out.join(held.select(F.col("src").alias("entity"), *(F.col(c).alias(n) for c, n in made.items())), "entity", "left")
            names += made.values()
            held = held.drop("degree")
    return out.fillna(0.0, [f"{r}_degree" for r in relations]), names


class Network:
    """One hidden layer over standardised features; the parameters of a model are one flat vector."""

    def __init__(self, width: int, hidden: int):
        self.width, self.hidden = width, hidden
        self.size = width * hidden + hidden + hidden + 1

    def start(self, seed: int) -> np.ndarray:
        theta = np.zeros(self.size)
        theta[: self.width * self.hidden] = np.random.default_rng(seed).normal(0, 1 / np.sqrt(max(1, self.width)), self.width * self.hidden)
        theta[-1 - self.hidden : -1] = np.random.default_rng(seed + 1).normal(0, 1 / np.sqrt(self.hidden), self.hidden)
        return theta

    def _parts(self, theta: np.ndarray):
        a, b = self.width * self.hidden, self.width * self.hidden + self.hidden
        return theta[:a].reshape(self.width, self.hidden), theta[a:b], theta[b:-1], theta[-1]

    def scores(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, what stands before the last step: the embedding)."""
        w1, b1, w2, b2 = self._parts(theta)
        h = np.maximum(x @ w1 + b1, 0)
        return h @ w2 + b2, h

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, gamma: float) -> tuple[np.ndarray, float]:
        """Summed gradient and focal loss of some rows."""
        _, _, w2, _ = self._parts(theta)
        o, h = self.scores(theta, x)
        loss, slope = focal(o, y, weight, gamma)
        back = np.outer(slope, w2) * (h > 0)
        return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), h.T @ slope, [slope.sum()]]), float(loss.sum())


class Gated:
    """Two hidden layers, over the first ``left`` features and over the others, mixed by a gate in (0, 1) of each row."""

    def __init__(self, width: int, left: int, hidden: int):
        self.width, self.hidden, self.left = width, hidden, left
        self.sizes = [left * hidden, hidden, (width - left) * hidden, hidden, width, 1, hidden, 1]
        self.size = sum(self.sizes)

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        scales = [1 / np.sqrt(max(1, self.left)), 0, 1 / np.sqrt(max(1, self.width - self.left)), 0, 0, 0, 1 / np.sqrt(self.hidden), 0]
        return np.concatenate([rng.normal(0, 1, n) * s for n, s in zip(self.sizes, scales, strict=True)])

    def _parts(self, theta: np.ndarray):
        wa, ba, wb, bb, wg, bg, w, b = np.split(theta, np.cumsum(self.sizes)[:-1])
        return wa.reshape(self.left, self.hidden), ba, wb.reshape(self.width - self.left, self.hidden), bb, wg, bg[0], w, b[0]

    def _forward(self, theta: np.ndarray, x: np.ndarray):
        wa, ba, wb, bb, wg, bg, w, b = self._parts(theta)
        ha, hb = np.maximum(x[:, : self.left] @ wa + ba, 0), np.maximum(x[:, self.left :] @ wb + bb, 0)
        gate = 1 / (1 + np.exp(-np.clip(x @ wg + bg, -30, 30)))
        return (gate[:, None] * ha + (1 - gate[:, None]) * hb) @ w + b, ha, hb, gate

    def scores(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, gates as a column)."""
        o, _, _, gate = self._forward(theta, x)
        return o, gate[:, None]

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, gamma: float) -> tuple[np.ndarray, float]:
        *_, w, _ = self._parts(theta)
        o, ha, hb, gate = self._forward(theta, x)
        loss, slope = focal(o, y, weight, gamma)
        back = np.outer(slope, w)
        ga, gb = back * gate[:, None] * (ha > 0), back * (1 - gate[:, None]) * (hb > 0)
        gg = (back * (ha - hb)).sum(axis=1) * gate * (1 - gate)
        mixed = gate[:, None] * ha + (1 - gate[:, None]) * hb
        xa, xb = x[:, : self.left], x[:, self.left :]
        return np.concatenate([(xa.T @ ga).ravel(), ga.sum(axis=0), (xb.T @ gb).ravel(), gb.sum(axis=0), x.T @ gg, [gg.sum()], mixed.T @ slope, [slope.sum()]]), float(loss.sum())


def focal(o: np.ndarray, y: np.ndarray, weight: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Focal loss of margins and its slope: weight * -(1 - q)^gamma * log q, q the chance of the row's own class."""
    sign = np.where(y > 0, 1.0, -1.0)
    log_q = -np.logaddexp(0, -sign * o)
    q = np.exp(log_q)
    rest = -np.expm1(log_q)
    return -weight * rest**gamma * log_q, weight * sign * (gamma * rest**gamma * q * log_q - rest ** (gamma + 1))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(-1, width)


def _moments(known: DataFrame, width: int, without: dict) -> dict:
    """Per model: mean and spread of each feature over its fit rows, the weight of a positive row, and the fit rows."""
    fit = known.where("not held")
    each = fit.select("block", F.posexplode("x").alias("at", "v")).groupBy("block", "at").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    sums: dict = {}
    for r in each.collect():  # blocks x features
        sums.setdefault(r.block, np.zeros((3, width)))[:, r["at"]] = (r.n, r.s or 0.0, r.q or 0.0)
    counts = {r.block: (r.n, r.p) for r in fit.groupBy("block").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    out = {}
    for model, left_out in without.items():
        n, s, q = sum((v for b, v in sums.items() if b not in left_out), np.zeros((3, width)))
        mean = s / np.maximum(n, 1)
        sd = np.sqrt(np.maximum(q / np.maximum(n, 1) - mean**2, 0))
        rows, positive = (sum(c[i] for b, c in counts.items() if b not in left_out) for i in (0, 1))
        out[model] = (mean, np.where(sd > 1e-12, sd, 1.0), (rows - positive) / positive if positive else 1.0, rows)
    return out


def _scaled(x: np.ndarray, moments: tuple) -> np.ndarray:
    return np.nan_to_num((x - moments[0]) / moments[1])


@dataclass
class Fitted:
    """Models by name: each left some blocks out. ``log`` has model, round, loss and held_loss."""

    rows: DataFrame
    net: Network | Gated
    theta: dict
    moments: dict
    log: list[dict]

    def scored(self, pairs: dict) -> DataFrame:
        """name, entity, block, y, p, inner: the rows of each block by the model that ``pairs`` names for (name, block)."""
        net, theta, moments = self.net, self.theta, self.moments

        def score(batches):
            for batch in batches:
                x, block = _matrix(batch, net.width), np.array(batch.column("block").to_pylist(), dtype=object)
                for (name, b), model in pairs.items():
                    own = np.flatnonzero(block == b)
                    if not len(own):
                        continue
                    o, inner = net.scores(theta[model], _scaled(x[own], moments[model]))
                    picked = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), kinds), *(picked.column(c) for c in ("entity", "block", "y")), pa.array(1 / (1 + np.exp(-o))), pa.array(list(inner), pa.list_(pa.float64()))], names=["name", "entity", "block", "y", "p", "inner"])

        own = dict(self.rows.dtypes)
        kinds = pa.string() if own["block"] == "string" else pa.int64()
        return self.rows.select("entity", "block", "y", "x").mapInArrow(score, f"name {'string' if own['block'] == 'string' else 'bigint'}, entity {own['entity']}, block {own['block']}, y {own['y']}, p double, inner array<double>")


def fitted(nodes: DataFrame, features: list[str], without: dict | None = None, net: Network | Gated | None = None, hidden: int = 8, rounds: int = 60, patience: int = 10, rate: float = 0.05, decay: float = 1e-4, gamma: float = 2.0, seed: int = 42) -> Fitted:
    """Models trained at once, each on the rows outside the blocks that ``without`` names for it: each block alone, if not given.

    ``nodes`` has entity, block, y (0 or 1; null is scored, not learned), held and the features; null features
    stand at the mean of the fit rows. Of a model's rows, held ones stop its training early: it keeps the
    parameters of its least held loss. All models start alike. A model without fit rows keeps its start.
    """
    rows = settled(nodes.select("entity", "block", "y", "held", F.array(*(F.col(c).cast("double") for c in features)).alias("x")))
    blocks = [r.block for r in rows.select("block").distinct().orderBy("block").limit(1001).collect()]
    without = {b: {b} for b in blocks} if without is None else {m: set(left) for m, left in without.items()}
    net = net or Network(len(features), hidden)
    if len(without) * net.size > LIMIT or len(blocks) > 1000:
        raise ValueError(f"over {LIMIT} parameters: fewer models or features")
    known = rows.where("y is not null").select("block", "y", "held", "x")
    moments = _moments(known, len(features), without)
    theta = {m: net.start(seed) for m in without}
    state = {m: [np.zeros(net.size), np.zeros(net.size)] for m in without}
    best = {m: (np.inf, theta[m], 0) for m in without}
    log, open_ = [], [m for m in without if moments[m][3]]
    for turn in range(rounds):
        if not open_:
            break
        sums = _summed(known, net, {m: theta[m] for m in open_}, without, moments, gamma)
        for m in list(open_):
            grad, (loss, n, held_loss, held_n) = sums[m][:-4], sums[m][-4:]
            watched = held_loss / held_n if held_n else loss / max(n, 1)
            log.append({"model": m, "round": turn, "loss": loss / max(n, 1), "held_loss": watched})
            if watched < best[m][0] - 1e-6:
                best[m] = (watched, theta[m], turn)
            elif turn - best[m][2] >= patience:
                open_.remove(m)
                continue
            # Adam: means of the gradient and of its square, both corrected for their start
            g = grad / max(n, 1) + decay * theta[m]
            state[m] = [0.9 * state[m][0] + 0.1 * g, 0.999 * state[m][1] + 0.001 * g * g]
            theta[m] = theta[m] - rate * (state[m][0] / (1 - 0.9 ** (turn + 1))) / (np.sqrt(state[m][1] / (1 - 0.999 ** (turn + 1))) + 1e-8)
    return Fitted(rows, net, {m: best[m][1] for m in without}, moments, log)


def train(nodes: DataFrame, features: list[str], **given) -> tuple[DataFrame, list[dict]]:
    """((entity, block, y, p), log): every node scored by the model that left its block out."""
    found = fitted(nodes, features, **given)
    return found.scored({(b, b): b for b in found.theta}).select("entity", "block", "y", "p"), found.log


def hybrid_features(nodes: DataFrame, features: list[str], **given) -> tuple[DataFrame, list[dict]]:
    """((outer, entity, block, y, p, embedding), log): for each outer block, every node embedded by a model that saw neither block.

    A node of another block is embedded by the model without the outer block and without its own; one of the
    outer block by the model without that one alone. So what a learner on top is trained on knows no label of
    its own block nor anything of the outer one. All k (k + 1) / 2 models are trained in the same passes.
    """
    blocks = [r.block for r in nodes.select("block").distinct().orderBy("block").limit(65).collect()]
    if len(blocks) > 64:
        raise ValueError("over 64 blocks")
    without = {f"{i}|{j}": {a, b} for i, a in enumerate(blocks) for j, b in enumerate(blocks) if i <= j}
    found = fitted(nodes, features, without, **given)
    pairs = {(a, b): f"{min(i, j)}|{max(i, j)}" for i, a in enumerate(blocks) for j, b in enumerate(blocks)}
    return found.scored(pairs).withColumnsRenamed({"name": "outer", "inner": "embedding"}), found.log


def gated(nodes: DataFrame, left: list[str], right: list[str], hidden: int = 6, **given) -> tuple[DataFrame, list[dict]]:
    """((entity, block, y, p, gate), log): two groups of features, each through a layer of its own, mixed by a gate per row.

    The gate is what the first group counts for; it is trained with the rest, through the mix. Scores are those
    of the model without the node's block.
    """
    found = fitted(nodes, [*left, *right], net=Gated(len(left) + len(right), len(left), hidden), **given)
    return found.scored({(b, b): b for b in found.theta}).select("entity", "block", "y", "p", F.col("inner")[0].alias("gate")), found.log


def _summed(known: DataFrame, net: Network | Gated, theta: dict, without: dict, moments: dict, gamma: float) -> dict[object, np.ndarray]:
    """Per model: the gradient over its fit rows, then loss and number of fit rows and of held ones."""
    names = list(theta)

    def step(batches):
        out = np.zeros((len(names), net.size + 4))
        for batch in batches:
            x, y = _matrix(batch, net.width), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            block, held = batch.column("block").to_pylist(), batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            kinds = {b: np.array([c == b for c in block]) for b in set(block)}
            for i, m in enumerate(names):
                weight = np.where(y > 0, moments[m][2], 1.0)
                other = ~np.logical_or.reduce([kinds[b] for b in without[m] if b in kinds], initial=False) & np.ones(len(y), dtype=bool)
                fit, watched = np.flatnonzero(other & ~held), np.flatnonzero(other & held)
                if len(fit):
                    g, loss = net.gradient(theta[m], _scaled(x[fit], moments[m]), y[fit], weight[fit], gamma)
                    out[i, :-4] += g
                    out[i, -4:-2] += (loss, len(fit))
                if len(watched):
                    o, _ = net.scores(theta[m], _scaled(x[watched], moments[m]))
                    out[i, -2:] += (focal(o, y[watched], weight[watched], gamma)[0].sum(), len(watched))
        yield pa.RecordBatch.from_pydict({"model": pa.array(range(len(names)), pa.int32()), "held": pa.array(list(out), pa.list_(pa.float64()))})

    parts = known.mapInArrow(step, "model int, held array<double>").select("model", F.posexplode("held").alias("at", "v"))
    found = {m: np.zeros(net.size + 4) for m in names}
    for r in parts.groupBy("model", "at").agg(F.sum("v").alias("v")).collect():  # models x parameters
        found[names[r.model]][r["at"]] = r.v
    return found


def completed(cells: DataFrame, rank: int = 3, rounds: int = 12, ridge: float = 1.0, patience: int = 2, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """((entity, analyte, part, y, p), log) of the cells held out: masked factorisation by alternating normal equations.

    ``cells`` has entity, analyte, y and part: train cells are learned, val cells stop the rounds, and all that are not
    train are scored. An entity is a row with its few cells; its factors follow from its train cells and the analytes'
    factors, which follow from sums over entities. So a round is one pass without a shuffle of rows. An entity without
    train cells gets its analytes' means, an analyte without any the mean of all.
    """
    names = [r.analyte for r in cells.select("analyte").distinct().orderBy("analyte").limit(LIMIT // (rank + 1) ** 2 + 1).collect()]
    if len(names) * (rank + 1) ** 2 > LIMIT:
        raise ValueError(f"over {LIMIT} sums of analytes")
    number = F.array_position(F.array(*map(F.lit, names)), F.col("analyte")) - 1 if len(names) <= 64 else None
    if number is None:
        table = cells.sparkSession.createDataFrame(list(enumerate(names)), "at long, analyte string")
        numbered = cells.join(F.broadcast(table), "analyte")  # analytes are bounded above
    else:
        numbered = cells.withColumn("at", number)
    mine = F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("y").cast("double").alias("y"), F.col("part").alias("part")))
    rows = settled(numbered.where("y is not null").groupBy("entity").agg(mine.alias("cells")))
    means = {r["at"]: (r.n, r.s) for r in numbered.where("part = 'train' and y is not null").groupBy("at").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}
    n, s = (sum(v[i] for v in means.values()) for i in (0, 1))
    overall = s / n if n else 0.5
    bias = np.array([means[i][1] / means[i][0] if i in means else overall for i in range(len(names))])
    v = np.random.default_rng(seed).normal(0, 0.3, (len(names), rank))
    best, log = (np.inf, v, 0), []
    for turn in range(rounds):
        sums, loss, m = _round(rows, v, bias, rank, ridge)
        watched = loss / m if m else -float(turn)
        log.append({"round": turn, "val_loss": loss / m if m else None})
        if watched < best[0] - 1e-9:
            best = (watched, v, turn)
        elif turn - best[2] >= patience:
            break
        v = np.stack([np.linalg.solve(q + ridge * np.eye(rank), b) for q, b in sums]) if len(names) else v
    v = best[1]

    def score(batches):
        for batch in batches:
            out = [(e, c["at"], c["part"], c["y"], float(np.clip(bias[c["at"]] + u @ v[c["at"]], 0, 1))) for e, u, own in _factors(batch, v, bias, rank, ridge) for c in own if c["part"] != "train"]
            entity, at, part, y, p = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(entity, batch.column("entity").type), pa.array([names[i] for i in at], pa.string()), pa.array(part, pa.string()), pa.array(y, pa.float64()), pa.array(p, pa.float64())], names=["entity", "analyte", "part", "y", "p"])

    return rows.mapInArrow(score, f"entity {dict(rows.dtypes)['entity']}, analyte string, part string, y double, p double"), log


def _factors(batch: pa.RecordBatch, v: np.ndarray, bias: np.ndarray, rank: int, ridge: float):
    """(entity, factors, cells) of the rows of a batch: least squares over the train cells alone."""
    for e, own in zip(batch.column("entity").to_pylist(), batch.column("cells").to_pylist(), strict=True):
        at = [c["at"] for c in own if c["part"] == "train"]
        if at:
            a = v[at]
            yield e, np.linalg.solve(a.T @ a + ridge * np.eye(rank), a.T @ (np.array([c["y"] for c in own if c["part"] == "train"]) - bias[at])), own
        else:
            yield e, np.zeros(rank), own


def _round(rows: DataFrame, v: np.ndarray, bias: np.ndarray, rank: int, ridge: float):
    """([(sum of u u', sum of u times what is left)] per analyte, val loss, val cells) under the analytes' factors ``v``."""

    def step(batches):
        square, line, watched = np.zeros((len(v), rank, rank)), np.zeros((len(v), rank)), np.zeros(2)
        for batch in batches:
            for _, u, own in _factors(batch, v, bias, rank, ridge):
                for c in own:
                    left = c["y"] - bias[c["at"]]
                    if c["part"] == "train":
                        square[c["at"]] += np.outer(u, u)
                        line[c["at"]] += u * left
                    elif c["part"] == "val":
                        watched += ((left - u @ v[c["at"]]) ** 2, 1)
        yield pa.RecordBatch.from_pydict({"held": pa.array([np.concatenate([square.ravel(), line.ravel(), watched])], pa.list_(pa.float64()))})

    total = np.zeros(len(v) * rank * (rank + 1) + 2)
    for r in rows.mapInArrow(step, "held array<double>").select(F.posexplode("held").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r.v
    split = len(v) * rank * rank
    squares, lines = total[:split].reshape(-1, rank, rank), total[split:-2].reshape(-1, rank)
    return list(zip(squares, lines, strict=True)), total[-2], total[-1]
