"""Mixing documents to target weights by soft membership.

A softmax classifier, learned from the labelled table, gives each document a chance for every domain (good or poor
quality, toxic or not). Document rates r >= 0 are then fitted so that the expected tokens of each domain, the sum of
r x tokens x chance, match the targets: least squares by projected gradient, from r = 1. A gradient step needs one
vector with a number for each domain, so a document's rate follows from its own row and the short list of those
vectors; no step writes rates or moves documents.
"""

from __future__ import annotations

import re
import string
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored, table, tidy

DOMAINS = ("good", "poor", "good_toxic", "poor_toxic")
#: Shares of all tokens; those of domains that the labels do not show are dropped.
TARGETS = {"good": 0.90, "poor": 0.08, "good_toxic": 0.01, "poor_toxic": 0.01}
TRAINING_ROWS = 8_000
FEATURES = 1_500
LEAST_DOCS = 5
STEPS = 60
#: after so many steps that do not halve the miss, the targets are taken as out of reach
STALLED = 6
#: the columns that are added
ADDED = ["_tokens", "_chances", "_rate", "_copies"]
TOLERANCE = 1e-6
ASCII = bytes(range(128))
CAPITALS, LETTERS = (x.encode() for x in (string.ascii_uppercase, string.ascii_letters))
PART = re.compile(r"\w+|[^\w\s]+")


def parts(text: str | None) -> set[str]:
    """The words and runs of signs of a text, and whether most of its letters are capitals."""
    text = text or ""
    out = set(PART.findall(text.lower()))
    if mostly_capitals(text):
        out.add("\x00capitals")
    return out


def mostly_capitals(text: str) -> bool:
    """Whether more than half of the letters are capitals; only characters beyond ASCII are looked at one by one."""
    raw = text.encode("utf-8", "surrogatepass")
    other = raw.translate(None, ASCII).decode("utf-8", "surrogatepass")
    capitals = len(raw) - len(raw.translate(None, CAPITALS)) + sum(map(str.isupper, other))
    letters = len(raw) - len(raw.translate(None, LETTERS)) + sum(map(str.isalpha, other))
    return capitals * 2 > letters > 0


class Domains:
    """The classifier: chances of each domain from the features present, which share the value 1."""

    def __init__(self, names: list[str], vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray):
        self.names, self.vocabulary, self.weights, self.bias = names, vocabulary, weights, bias

    def chances(self, text: str | None) -> np.ndarray:
        found = [self.vocabulary[p] for p in self.vocabulary.keys() & parts(text)]
        x = self.bias + (self.weights[sorted(found)].sum(0) / np.sqrt(len(found)) if found else 0.0)
        p = np.exp(x - x.max())
        return p / p.sum()


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """text and domain number of at most `rows` labelled documents, those with the least hash of their ids; of rows
    that share an id, the one with the least text.
    """
    one = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = (F.when(F.col("quality") > 0, 0).otherwise(1) + F.when(F.col("toxic") > 0, 2).otherwise(0)).alias("domain")
    some = one.select("doc_id", domain).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain")).select("text", "domain")


def fit_domains(training: DataFrame, most: int = FEATURES, steps: int = 300, rate: float = 0.1, ridge: float = 1e-5) -> Domains:
    """training: text and domain, a bounded number of rows. One domain of chance 1 where there are none."""
    training = stored(training)
    sizes = {r.domain: r["count"] for r in training.groupBy("domain").count().collect()}
    seen = sorted(sizes)
    if not seen:
        return Domains([DOMAINS[0]], {}, np.zeros((0, 1)), np.zeros(1))
    total = sum(sizes.values())

    def count(batches):
        for b in batches:
            met: dict[tuple[str, int], int] = {}
            for text, domain in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in parts(text):
                    met[p, domain] = met.get((p, domain), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in met], pa.string()), pa.array([k[1] for k in met], pa.int32()), pa.array(list(met.values()), pa.int64())], ["f", "domain", "n"])

    by = training.select("text", "domain").mapInArrow(count, "f string, domain int, n bigint").groupBy("f").pivot("domain", seen).agg(F.sum("n")).na.fill(0)
    n = sum((F.col(f"`{d}`") for d in seen), F.lit(0))
    share = (n + 1) / (total + 2)
    apart = F.greatest(*[F.abs(F.col(f"`{d}`") / sizes[d] - share) / F.sqrt(share * (1 - share) / sizes[d]) for d in seen], F.lit(0.0))
    kept = by.filter(n >= LEAST_DOCS).select("f", apart.alias("z")).orderBy(F.desc("z"), "f").limit(most).collect()
    vocabulary = {r.f: i for i, r in enumerate(kept)}

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(vocabulary[p] for p in vocabulary.keys() & parts(t)) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1)], ["x", "domain"])

    data = training.select("text", "domain").mapInArrow(rows, "x array<int>, domain int").collect()
    dropped(training)
    y, k, d = np.array([seen.index(r.domain) for r in data]), len(seen), len(vocabulary)
    at = np.repeat(np.arange(len(data)), [len(r.x) for r in data])
    idx = np.array([i for r in data for i in r.x], np.int64)
    value = np.repeat([1 / np.sqrt(max(len(r.x), 1)) for r in data], [len(r.x) for r in data])
    theta, m, v = np.zeros((d + 1, k)), np.zeros((d + 1, k)), np.zeros((d + 1, k))
    theta[d] = np.log(np.bincount(y, minlength=k) / len(y))
    want = np.eye(k)[y]
    for step in range(1, steps + 1):
        x = np.stack([np.bincount(at, theta[idx, j] * value, len(data)) for j in range(k)], axis=1) + theta[d]
        p = np.exp(x - x.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - want) / len(data)
        grad = np.vstack([np.stack([np.bincount(idx, g[at, j] * value, d) for j in range(k)], axis=1).reshape(d, k), g.sum(0)])
        grad[:d] += ridge * theta[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Domains([DOMAINS[i] for i in seen], vocabulary, theta[:d], theta[d])


def with_chances(docs: DataFrame, model: Domains) -> DataFrame:
    """docs with _tokens (words between white space) and _chances, one for each domain of the model.

    Columns of docs that have these names are replaced.
    """

    @F.arrow_udf("tokens bigint, chances array<double>")
    def run(texts: pa.Array) -> pa.Array:
        tokens, chances = [], []
        for text in texts:
            t = text.as_py()
            tokens.append(len((t or "").split()))
            chances.append(model.chances(t))
        flat = pa.array(np.concatenate([np.zeros(0), *chances]))
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(tokens) + 1) * len(model.names)).astype(np.int32)), flat)
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), lists], ["tokens", "chances"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    scored = docs.select(F.struct(*kept).alias("row"), run("text").alias("x"))
    return scored.select("row.*", F.col("x.tokens").alias("_tokens"), F.col("x.chances").alias("_chances"))


def rates(a: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Document rates from their expected tokens by domain (rows of a) and the vectors of the steps so far."""
    r = np.ones(len(a))
    for g in steps:
        r = np.maximum(0.0, r + a @ g)
    return r


def nonnegative(g: np.ndarray, t: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |g x - t|, by active sets; g has a row a domain and few columns."""
    x, free = np.zeros(g.shape[1]), np.zeros(g.shape[1], bool)
    for _ in range(10 * (g.shape[1] + 1)):
        slope = np.where(free, -np.inf, g.T @ (t - g @ x))
        if not slope.size or slope.max() <= 1e-12 * max(np.abs(t).max(initial=0), 1e-300):
            break
        free[slope.argmax()] = True
        while True:
            y = np.zeros(len(x))
            y[free] = np.linalg.lstsq(g[:, free], t, rcond=None)[0]
            if (y[free] > 0).all():
                x = y
                break
            falls = free & (y <= 0)
            step = (x[falls] / np.maximum(x[falls] - y[falls], 1e-300)).min()
            x = x + step * (y - x)
            free &= x > 1e-15 * max(x.max(), 1e-300)
            x[~free] = 0
            if not free.any():
                break
    return x


def nearest(chances: DataFrame, target: np.ndarray, most: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """The tokens by domain nearest to the target that any rates r >= 0 can give.

    These are the sums of documents' chances with weights >= 0. The document that points most towards what is missing is
    sought among all, and joins the few that the nearest point is made of, until none points there: then there is no
    nearer point.
    """
    k = len(target)
    found, at = np.zeros((k, 0)), np.zeros(k)
    for _ in range(most):
        missing = target - at
        if np.linalg.norm(missing) <= tolerance * np.linalg.norm(target):
            break
        towards = sum((F.get("_chances", F.lit(i)) * float(x) for i, x in enumerate(missing / np.linalg.norm(missing))), F.lit(0.0))
        with tidy(chances.sparkSession):
            best = chances.filter("_tokens > 0").agg(F.max_by("_chances", towards).alias("p"), F.max(towards).alias("x")).first()
        if best.p is None or best.x <= tolerance:
            break
        found = np.column_stack([found, np.array(best.p)])
        weights = nonnegative(found, target)
        found, weights = found[:, weights > 0], weights[weights > 0]
        at = found @ weights
    return at


class Rates(list):
    """The step vectors. residual: the largest miss of a domain, as a share of all tokens, from the nearest that can be reached;
    short: how far that is from the targets."""

    residual = short = 0.0


def fit_rates(chances: DataFrame, names: list[str], targets: dict[str, float] = TARGETS, most_steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    """The step vectors of a projected gradient descent for |A r - T|^2.

    The gradient is scaled by (A A^T)^-1 over the documents with a positive rate, which converges in a few steps; where
    that does not come closer, over all documents, for which a step of 1 is safe. Where the targets are not met, the
    nearest tokens by domain that any rates can give are sought, and the descent goes on to them. It is at the optimum when
    A r is within the tolerance of them. On the edge of what can be reached only the few documents there would have a
    rate, and the descent is slow: after most_steps it ends in any case, `residual` says how far off, and a warning is given.

    chances: _tokens, _chances. T has the targets, made to sum to 1, of all tokens. Only sums by domain come back.
    """
    k = len(names)
    share = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    share = share / share.sum() if share.sum() > 0 else np.full(k, 1 / k)

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A r; A A^T of all documents; A A^T of those with a positive rate."""

        def run(batches):
            total = np.zeros(k + 2 * k * k)
            for b in batches:
                a = b.column(1).values.to_numpy().reshape(-1, k) * b.column(0).to_numpy()[:, None].astype(float)
                r = rates(a, steps)
                up = a[r > 0]
                total += np.concatenate([a.T @ r, (a.T @ a).ravel(), (up.T @ up).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "x"])

        with tidy(chances.sparkSession):
            rows = chances.select("_tokens", "_chances").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k + 2 * k * k)
        for r in rows:
            out[r.at] = r.x
        return out[:k], out[k : k + k * k].reshape(k, k), out[k + k * k :].reshape(k, k)

    def inverse(g: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(g, rcond=1e-12, hermitian=True)

    steps = Rates()
    now, whole, up = sums(steps)
    total = max(now.sum(), 1.0)
    goal = now.sum() * share
    metric, off, aimed, slow = up, np.abs(goal - now).max(), False, 0
    least = (off, 0)  # the least miss of the goal, and after how many steps
    for _ in range(most_steps):
        if off > tolerance * total and slow >= STALLED and not aimed:
            goal, aimed, slow = nearest(chances, goal), True, 0
            steps.short = float(np.abs(total * share - goal).max() / total)
            off = np.abs(goal - now).max()
            least = (off, len(steps))
        if off <= tolerance * total:
            break
        steps.append(inverse(metric) @ (goal - now))
        then, _, up = sums(steps)
        miss = np.abs(goal - then).max()
        slow = slow + 1 if miss > off / 2 else 0
        if miss < off or metric is whole:
            now, metric, off = then, up, miss
        else:  # the metric of the positive rates went too far: take the safe step instead
            steps.pop()
            metric = whole
        least = min(least, (off, len(steps)))
    del steps[least[1] :]
    steps.residual = float(least[0] / total)
    if steps.residual > tolerance or steps.short:
        warnings.warn(f"targets: {steps.short:.4f} of all tokens from what can be reached, of which {steps.residual:.4f} are left after {len(steps)} steps", stacklevel=2)
    return steps


def with_rates(chances: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    """chances with _rate: as rates(), by DataFrame functions."""
    if not steps:
        return chances.withColumn("_rate", F.lit(1.0))
    vectors = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    along = lambda g: F.aggregate(F.zip_with("_chances", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return chances.withColumn("_rate", F.aggregate(vectors, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r + F.col("_tokens") * along(g))))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """docs (its columns keep, or all) with _tokens, _chances, _rate and _copies, and the names of the domains.

    A null or empty text has no tokens, rate 1 and one copy. Rows that repeat get equal results. Without labels
    there is one domain and every rate is 1. An empty table gives no rows. Other columns are kept, but for those that
    have one of the four names. Targets that no rates can meet are met as nearly as any can.
    """
    model = fit_domains(labelled(docs, labels))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns if c not in ADDED])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    scored = with_chances(docs.select(kept.alias("row"), chance.alias("u"), "text"), model)
    base = stored(scored.select("row", "u", "_tokens", "_chances"))
    rated = with_rates(base, fit_rates(base, model.names, targets))
    out = rated.select("row", "_tokens", "_chances", "_rate", F.floor(F.col("_rate") + F.col("u")).cast("int").alias("_copies"))
    return out.select("row.*", *ADDED), model.names


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs with each row as often as its copies say; the columns of docs."""
    cols = docs.columns
    out, _ = mix(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in cols])).select("_row", "doc_id", "text"), labels, targets, ["_row"])
    return out.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, a chance for each domain that was learned, rate, copies."""
    out, names = mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", F.col("_tokens").alias("tokens"), *[F.get("_chances", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(names)], F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))
