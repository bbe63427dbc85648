"""Regime states: labelling, stability, forward filtering, drift.

Model parameters are a small table, one row for each model; they are joined to
the series they score. Filtering is a scan over spans of each series; everything
after it is windows and grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.spans import DAYS, followed, per_span, renewed, same_keys, schema_of, span_edges, spanned
from barloom.functions.windows import SERIES, TS, ordered, run_length, trailing
from barloom.operators.quantiles import stability_index

#: Labels by number of states, from the lowest mean return to the highest. Fixed values.
LABELS = {
    3: ("bear", "neutral", "bull"),
    4: ("crash", "bear", "bull", "euphoria"),
    5: ("crash", "bear", "neutral", "bull", "euphoria"),
    6: ("crash", "strong_bear", "weak_bear", "weak_bull", "strong_bull", "euphoria"),
    7: ("crash", "strong_bear", "weak_bear", "neutral", "weak_bull", "strong_bull", "euphoria"),
}
LOW_CUT, HIGH_CUT = 0.33, 0.67
#: Strategy, leverage, size and confidence by label. Fixed values.
HINTS = {
    "crash": ("defensive", 0.0, 0.05, 0.65),
    "strong_bear": ("defensive", 0.0, 0.10, 0.60),
    "bear": ("reduced", 0.0, 0.15, 0.58),
    "weak_bear": ("reduced", 0.0, 0.20, 0.55),
    "neutral": ("balanced", 1.0, 0.25, 0.55),
    "weak_bull": ("trend", 1.0, 0.30, 0.55),
    "bull": ("trend", 1.0, 0.35, 0.55),
    "strong_bull": ("trend", 1.25, 0.40, 0.55),
    "euphoria": ("momentum", 1.25, 0.40, 0.60),
    "unknown": ("defensive", 0.0, 0.0, 1.0),
}


def label_states(states: DataFrame, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Rank a model's states by expected return (then id) and name them."""
    scheme = F.create_map(*[v for n, names in LABELS.items() for v in (F.lit(n), F.array(*map(F.lit, names)))])
    w = Window.partitionBy(*keys)
    ranked = states.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("expected_return", "state_id")))
    return ranked.withColumn("label", F.try_element_at(F.try_element_at(scheme, F.col("n").cast("int")), F.col("rank")))


def attach_hints(states: DataFrame, label: str = "label") -> DataFrame:
    """strategy, leverage, size and confidence of each label; other labels and null as unknown."""
    hints = F.create_map(*[v for name, (plan, lev, size, conf) in HINTS.items() for v in (F.lit(name), F.struct(F.lit(plan).alias("strategy"), F.lit(lev).alias("leverage"), F.lit(size).alias("size"), F.lit(conf).alias("confidence")))])
    found = F.coalesce(F.try_element_at(hints, F.coalesce(label, F.lit("unknown"))), F.element_at(hints, F.lit("unknown")))
    return states.withColumn("_hint", found).select("*", "_hint.*").drop("_hint")


def vol_rank(states: DataFrame, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Position of a state by expected volatility, 0 to 1, and its tier."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy("expected_volatility", "state_id")) - 1
    n = F.count("*").over(w)
    rank = F.when(n > 1, place / (n - 1)).otherwise(F.lit(0.0))
    tier = F.when(F.col("vol_rank") <= LOW_CUT, "low").when(F.col("vol_rank") >= HIGH_CUT, "high").otherwise("mid")
    return states.withColumn("vol_rank", rank).withColumn("tier", tier)


def calm(bars: DataFrame, ranks: DataFrame) -> DataFrame:
    """Whether a bar's state is below the high cut; an unknown state is not calm."""
    known = ranks.select(SERIES, "state_id", "vol_rank")
    joined = bars.join(known.hint("shuffle_hash"), [SERIES, "state_id"], "left")
    return joined.withColumn("calm", F.coalesce("vol_rank", F.lit(1.0)) < HIGH_CUT)


def with_runs(states: DataFrame, state: str = "state_id", confirm: int = 3, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """consecutive_bars in the state so far and whether it is confirmed."""
    flag, frame = run_length(F.col(state), keys)
    df = states.withColumn("_change", flag).withColumn("_island", F.sum("_change").over(frame))
    df = df.withColumn("consecutive_bars", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy(TS)))
    return df.withColumn("is_confirmed", F.col("consecutive_bars") >= confirm).drop("_change", "_island")


def confirmed_changes(states: DataFrame, label: str = "label") -> DataFrame:
    """Bars confirmed under another label than the confirmed bar before (or none)."""
    before = F.last(F.when(F.col("is_confirmed"), F.col(label)), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    df = states.withColumn("_before", before).withColumn("_n", F.row_number().over(ordered()))
    return df.withColumn("changed", F.col("is_confirmed") & (F.col("_n") >= 2) & (F.col("_before").isNull() | (F.col("_before") != F.col(label)))).drop("_before", "_n")


def with_flicker(states: DataFrame, state: str = "state_id", bars: int = 20, most: int = 4, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """State changes among the last ``bars`` bars (one pair fewer) and a flag above ``most``."""
    before = F.lag(state).over(ordered(keys))
    df = states.withColumn("_change", F.when(before.isNotNull() & (before != F.col(state)), 1).otherwise(0))
    df = df.withColumn("flicker", F.sum("_change").over(trailing(bars - 1, keys)))
    return df.withColumn("is_flickering", F.col("flicker") > most).drop("_change")


def stability(states: DataFrame) -> DataFrame:
    return states.groupBy(SERIES).agg(F.max_by("consecutive_bars", TS).alias("stability"))


def empirical_transitions(states: DataFrame, state: str = "state_id") -> DataFrame:
    """Observed transition shares of each series."""
    pairs = states.withColumn("to_state", F.lead(state).over(ordered())).where(F.col("to_state").isNotNull())
    counts = pairs.groupBy(SERIES, F.col(state).alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(SERIES, "from_state")))


def transition_table(models: DataFrame) -> DataFrame:
    """A model's transition matrix as (from_state, to_state, probability) rows."""
    rows = models.select(SERIES, F.posexplode("transmat").alias("from_state", "row"))
    return rows.select(SERIES, "from_state", F.posexplode("row").alias("to_state", "probability"))


def runner_ups(probabilities: Column) -> Column:
    """States by falling probability; the smaller state first on ties."""
    placed = F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    return F.transform(F.array_sort(placed), lambda s: s["i"])


def latest_state(states: DataFrame, infos: DataFrame, risks: DataFrame) -> DataFrame:
    """One row for each series: its last regime with label, confidence, length,
    volatility rank and runner-ups, and the account's losses beside it.

    ``states`` has state_id, probabilities, consecutive_bars and is_confirmed,
    ``infos`` a row for each state (label, vol_rank), ``risks`` ret, drawdown and
    severity for each bar. A state without a row in ``infos`` has no label.
    """
    last = states.groupBy(SERIES).agg(F.max(TS).alias(TS), F.max_by(F.struct("state_id", "probabilities", "consecutive_bars", "is_confirmed"), TS).alias("_s")).select(SERIES, TS, "_s.*")
    risk = risks.groupBy(SERIES).agg(F.max_by(F.struct("ret", "drawdown", "severity"), TS).alias("_r")).select(SERIES, "_r.*")
    df = last.join(infos.select(SERIES, "state_id", "label", "vol_rank").hint("shuffle_hash"), [SERIES, "state_id"], "left").join(risk.hint("shuffle_hash"), SERIES, "left")
    return df.select(
        SERIES,
        TS,
        "state_id",
        "label",
        F.try_element_at("probabilities", F.col("state_id") + 1).alias("confidence"),
        F.col("consecutive_bars").alias("stability"),
        "is_confirmed",
        F.coalesce("vol_rank", F.lit(0.0)).alias("vol_rank"),
        runner_ups(F.col("probabilities")).alias("runner_ups"),
        "severity",
        F.greatest(-F.col("ret"), F.lit(0.0)).alias("day_loss"),
        F.greatest(-F.col("drawdown"), F.lit(0.0)).alias("peak_loss"),
        (F.col("severity") == 0).alias("breakers_clear"),
    )


def regime_table(infos: DataFrame, transitions: DataFrame) -> DataFrame:
    """States of each series with their hints and the shares of the states that follow, as a map."""
    to = transitions.groupBy(SERIES, F.col("from_state").alias("state_id")).agg(F.map_from_entries(F.collect_list(F.struct("to_state", "share"))).alias("follows"))
    return attach_hints(infos).join(to.hint("shuffle_hash"), [SERIES, "state_id"], "left")


# --- models -----------------------------------------------------------------


def log_emission(x: np.ndarray, means: np.ndarray, covars: np.ndarray) -> np.ndarray:
    """Log-density of each row under each state; singular covariances use their pseudo-inverse."""
    out = np.empty((len(x), len(means)))
    for k, (mean, cov) in enumerate(zip(means, covars, strict=True)):
        values, vectors = np.linalg.eigh(cov)
        keep = values > max(values.max(), 0) * 1e-10
        white = (x - mean) @ vectors[:, keep] / np.sqrt(values[keep])
        out[:, k] = -0.5 * (keep.sum() * np.log(2 * np.pi) + np.log(values[keep]).sum() + np.square(white).sum(axis=1))
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exponentials along an axis; all -inf gives -inf."""
    top = x.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis=axis))


def forward(emission: np.ndarray, start: np.ndarray, transition: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(filtered log-posteriors, log-normaliser of each step), from the log-posterior
    ``last`` of the bar before (None: from ``start``)."""
    with np.errstate(divide="ignore"):
        step, prior = np.log(transition), np.log(start)
    post, norm = np.empty_like(emission), np.empty(len(emission))
    for t, e in enumerate(emission):
        if t:
            last = post[t - 1]
        if last is not None:
            prior = log_sum(last[:, None] + step, 0)
        a = prior + e
        norm[t] = log_sum(a, 0)
        post[t] = a - norm[t]
    return post, norm


def log_product(maps: np.ndarray) -> np.ndarray:
    """Product of matrices given and returned as logarithms, by halving: neighbours
    are multiplied side by side until one is left."""
    while len(maps) > 1:
        even = len(maps) // 2 * 2
        pairs = log_sum(maps[0:even:2, :, :, None] + maps[1:even:2, None, :, :], 2)
        maps = np.concatenate([pairs, maps[even:]])
    return maps[0]


def filter_map(emission: np.ndarray, start: np.ndarray, transition: np.ndarray, first: bool, block: int = 4096) -> np.ndarray:
    """What a span does to the log-posterior before it, as one matrix of logarithms.
    A series' first bar forgets what was before."""
    with np.errstate(divide="ignore"):
        step, begin = np.log(transition), np.log(start)
    done = None
    for i in range(0, len(emission), block):
        maps = step[None] + emission[i : i + block, None, :]
        if first and i == 0:
            maps[0] = begin[None] + emission[0][None]
        part = log_product(maps)
        done = part if done is None else log_product(np.stack([done, part]))
        # only ratios matter: keep the scale near one
        top = done.max()
        done = done - top if np.isfinite(top) else done
    return done


def regime_proba(features: DataFrame, models: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = (SERIES,), days: float = DAYS) -> DataFrame:
    """Filtered probabilities of each bar, its state (lowest id on ties) and the
    step's log-likelihood, and the place of its state by volatility.

    ``models`` has one row for each group of ``keys``; groups without a model are
    left out. A group is cut into spans: each becomes the matrix that it multiplies
    posteriors by, the matrices of a group are folded into the posterior that each
    span starts from, and the spans are filtered side by side. A model stands
    once beside each span, on no bar.
    """
    out = {"probabilities": "array<double>", "state_id": "int", "probability": "double", "log_likelihood": "double", "vol_rank": "double"}
    rows = spanned(features.drop(*out), days, keys)
    edges = span_edges(rows, (), keys).select(*keys, "_span", "_last", (F.col("_offset") == 0).alias("_first"))
    own = [*keys, "_span"]
    models = renewed(models.select(*keys, "startprob", "transmat", "means", "covars"))
    spans = same_keys(edges, models, keys)

    def condense(group: pd.DataFrame, span: pd.Series) -> pd.DataFrame:
        start, transition, means, covars = unpack(span)
        made = filter_map(log_emission(group[list(columns)].to_numpy(float), means, covars), start, transition, bool(span["_first"]))
        return pd.DataFrame({k: [span[k]] for k in own} | {"_map": [made.ravel().tolist()]})

    def carry(maps: pd.DataFrame) -> pd.DataFrame:
        maps, last, found = maps.sort_values("_span"), None, []
        for flat in maps["_map"]:
            n = round(len(flat) ** 0.5)
            last = np.full(n, -np.log(n)) if last is None else last
            last = log_sum(last[:, None] + np.asarray(flat, float).reshape(n, n), 0)
            last = last - log_sum(last, 0)
            found.append(last.tolist())
        return maps[own].assign(_carry=found)

    maps = per_span(followed(rows, edges, keys), spans, keys, condense, schema_of(rows, own, _map="array<double>"))
    ends = maps.groupBy(*keys).applyInPandas(carry, schema_of(rows, own, _carry="array<double>"))
    starts = same_keys(spans, ends, own, "left").withColumn("_carry", F.lag("_carry").over(Window.partitionBy(*keys).orderBy("_span")))

    def score(group: pd.DataFrame, span: pd.Series) -> pd.DataFrame:
        start, transition, means, covars = unpack(span)
        last = None if span["_carry"] is None else np.asarray(span["_carry"], float)
        post, norm = forward(log_emission(group[list(columns)].to_numpy(float), means, covars), start, transition, last)
        p = np.exp(post)
        state = p.argmax(axis=1)
        return group.drop(columns="_span").assign(probabilities=list(p), state_id=state.astype("int32"), probability=p.max(axis=1), log_likelihood=norm, vol_rank=volatility_ranks(covars)[state])

    return per_span(rows, starts, keys, score, schema_of(features, [c for c in features.columns if c not in out], **out))


def unpack(model: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, transition, means, covariances) of a model's row."""
    grid = lambda v: np.array([[list(r) if np.ndim(r) else r for r in row] for row in v], float)
    return np.array(model["startprob"], float), grid(model["transmat"]), grid(model["means"]), grid(model["covars"])


def volatility_ranks(covars: np.ndarray) -> np.ndarray:
    """Place of each state, 0 to 1, by the deviation of the first feature (then id)."""
    order = np.argsort(covars[:, 0, 0], kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order)) / max(len(order) - 1, 1)
    return ranks


def mean_log_likelihood(scored: DataFrame, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Forward log-likelihood by bar; groups without bars have no row."""
    return scored.groupBy(*keys).agg(F.avg("log_likelihood").alias("mean_ll"))


def fit_regime_models(features: DataFrame, columns: tuple[str, ...], n: int, seed: int = 42, iterations: int = 100, least_rows: int = 504, min_covar: float = 1e-3, prior: float = 1e-2, keys: tuple[str, ...] = (SERIES,), gain: float = 1e-2) -> DataFrame:
    """One Gaussian hidden Markov model for each group of ``keys``, by expectation-
    maximisation. Groups are fitted side by side; a group is one series. Columns
    ``n`` and ``seed`` among the keys take the place of the arguments."""
    schema = ", ".join([*(f"`{k}` {t}" for k, t in features.dtypes if k in keys and k not in ("n", "seed")), "n int, seed int, startprob array<double>, transmat array<array<double>>, means array<array<double>>, covars array<array<array<double>>>, log_likelihood double, trace array<double>, n_rows long, converged boolean"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(TS, kind="stable")
        x = group[list(columns)].to_numpy(float)
        states, draw = (int(group[k].iloc[0]) if k in keys else v for k, v in (("n", n), ("seed", seed)))
        head = {k: [group[k].iloc[0]] for k in keys} | {"n": [states], "seed": [draw], "n_rows": [len(x)]}
        if len(x) < least_rows:
            return pd.DataFrame(head | {"startprob": [None], "transmat": [None], "means": [None], "covars": [None], "log_likelihood": [-np.inf], "trace": [[]], "converged": [False]})
        start, transition, means, covars, trace = expectation_maximisation(x, states, draw, iterations, min_covar, prior, gain)
        ok = bool(np.isfinite(trace[-1]))
        return pd.DataFrame(head | {"startprob": [start.tolist()], "transmat": [transition.tolist()], "means": [means.tolist()], "covars": [covars.tolist()], "log_likelihood": [trace[-1] if ok else -np.inf], "trace": [trace], "converged": [ok and len(trace) < iterations]})

    return features.groupBy(*keys).applyInPandas(run, schema)


def starting_means(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Centres that the rows gather around, from ``n`` of them."""
    means = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(10):
        near = np.square(x[:, None, :] - means[None]).sum(axis=2).argmin(axis=1)
        means = np.array([x[near == k].mean(axis=0) if (near == k).any() else means[k] for k in range(n)])
    return means


def expectation_maximisation(x: np.ndarray, n: int, seed: int, iterations: int, min_covar: float, prior: float, gain: float):
    """Start, transition, means, covariances, and the log-likelihood by iteration."""
    d, means = x.shape[1], starting_means(x, n, seed)
    base = np.cov(x.T).reshape(d, d) + min_covar * np.eye(d)
    covars, start, transition = np.repeat(base[None], n, axis=0), np.full(n, 1 / n), np.full((n, n), 1 / n)
    trace: list[float] = []
    for _ in range(iterations):
        emission = log_emission(x, means, covars)
        post, norm = forward(emission, start, transition)
        trace.append(float(norm.sum()))
        if not np.isfinite(trace[-1]) or len(trace) > 1 and trace[-1] - trace[-2] < gain:
            break
        scaled = np.exp(emission - norm[:, None])
        back = np.ones((len(x), n))
        for t in range(len(x) - 2, -1, -1):
            back[t] = transition @ (scaled[t + 1] * back[t + 1])
        alpha = np.exp(post)
        gamma = alpha * back
        gamma /= gamma.sum(axis=1, keepdims=True)
        pairs = transition * (alpha[:-1].T @ (scaled[1:] * back[1:]))
        start, transition = gamma[0], pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(axis=0), 1e-12)
        means = gamma.T @ x / weight[:, None]
        for k in range(n):
            apart = x - means[k]
            covars[k] = (prior * np.eye(d) + (gamma[:, k, None] * apart).T @ apart) / weight[k]
    return start, transition, means, covars, trace


def walk_forward_states(tagged: DataFrame, columns: tuple[str, ...], n: int, iterations: int = 100, least_rows: int = 504) -> DataFrame:
    """States of each fold's test bars under the model of its training bars.

    ``tagged`` has fold_id and part. Filtering, runs and flicker go over the
    whole fold and are cut to the test bars after; a fold without a fit is left out.
    """
    keys = (SERIES, "fold_id")
    fits = fit_regime_models(tagged.where("part = 'train'"), columns, n, iterations=iterations, least_rows=least_rows, keys=keys)
    scored = regime_proba(tagged, fits.where(F.col("log_likelihood") > float("-inf")), columns, keys)
    return with_flicker(with_runs(scored, keys=keys), keys=keys).where("part = 'test'")


def fit_model_grid(features: DataFrame, columns: tuple[str, ...], states: Sequence[int] = (3, 4, 5, 6, 7), seeds: Sequence[int] = (42, 43, 44), least_rows: int = 504, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """A fit of each series for every number of states and seed, each a group of its own."""
    points = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("seed")) for n in states for s in seeds])
    wide = features.select(*keys, TS, *columns).withColumn("_p", F.explode(points)).select(*keys, TS, *columns, "_p.*")
    return fit_regime_models(wide, columns, states[0], least_rows=least_rows, keys=(*keys, "n", "seed"))


def permuted_tiers(states: DataFrame, seed: int | Column) -> DataFrame:
    """A tier (0 low, 1 mid, 2 high) for each state of a fold by hash: the null model of a skill test."""
    return states.withColumn("tier_no", F.pmod(F.xxhash64(F.lit(seed), SERIES, "fold_id", "state_id"), F.lit(3)).cast("int"))


def bic(n: Column, d: int, log_likelihood: Column, rows: Column) -> Column:
    free = (n - 1) + n * (n - 1) + n * d + n * (d * (d + 1) / 2)
    return -2 * log_likelihood + free * F.log(rows.cast("double"))


def select_model(fits: DataFrame, d: int, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Best seed of each number of states (earliest wins ties), then least BIC
    (fewest states win ties). Failed fits never win."""
    good = fits.where(F.col("log_likelihood") > float("-inf"))
    best = good.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "n").orderBy(F.desc("log_likelihood"), "seed"))).where("_r = 1")
    scored = best.withColumn("bic", bic(F.col("n"), d, F.col("log_likelihood"), F.col("n_rows")))
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("bic", "n"))).where("_r = 1").drop("_r")


def promote_challenger(champion: DataFrame, challenger: DataFrame, least_rows: int = 504, tolerance: float = 0.0) -> DataFrame:
    """Decision and reason per series from (series_id, mean_ll, n_rows, converged)."""
    c = champion.select(SERIES, F.col("mean_ll").alias("champion_ll"))
    joined = challenger.join(c.hint("shuffle_hash"), SERIES, "left")
    reason = (
        F.when(F.col("n_rows") < least_rows, "too few rows")
        .when(~F.col("converged"), "not converged")
        .when(F.col("champion_ll").isNull(), "no champion")
        .when(F.col("mean_ll").isNull() | F.isnan("mean_ll"), "scoring failed")
        .when(F.col("mean_ll") >= F.col("champion_ll") - tolerance - 1e-9, "at least as likely")
        .otherwise("less likely")
    )
    return joined.withColumn("reason", reason).withColumn("promoted", F.col("reason").isin("no champion", "at least as likely"))


def stale_models(series: DataFrame, models: DataFrame, now: Column, days: float = 7.0) -> DataFrame:
    """Series without a model, or whose model is older than ``days``."""
    age = (now.cast("double") - F.col("trained_at").cast("double")) / 86400
    joined = series.join(models.select(SERIES, "trained_at").hint("shuffle_hash"), SERIES, "left").withColumn("age_days", age)
    return joined.where(F.col("age_days").isNull() | (F.col("age_days") > days))


def rollback(versions: DataFrame, promotions: DataFrame) -> DataFrame:
    """The champion (promoted last) of each series and the version just before it;
    null where the champion is the first version or not among the versions."""
    champion = promotions.groupBy(SERIES).agg(F.max_by("version", F.struct(TS, "version")).alias("version"))
    before = versions.select(SERIES, "version").distinct().withColumn("rolled_back_to", F.lag("version").over(Window.partitionBy(SERIES).orderBy("version")))
    return champion.join(before.hint("shuffle_hash"), [SERIES, "version"], "left").withColumnRenamed("version", "champion")


def model_asof(bars: DataFrame, promotions: DataFrame) -> DataFrame:
    """Each bar with the version promoted last at or before it (null before the first)."""
    points = promotions.select(SERIES, TS, F.col("version"), F.lit(0).alias("_bar"))
    both = bars.withColumn("_bar", F.lit(1)).unionByName(points, allowMissingColumns=True)
    w = Window.partitionBy(SERIES).orderBy(TS, "_bar").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("version", F.last("version", ignorenulls=True).over(w)).where("_bar = 1").drop("_bar")


# --- drift ------------------------------------------------------------------


def psi(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...], value: str = "value", bins: int = 10) -> DataFrame:
    """Population stability index of a value per key, on the exact expected deciles."""
    side = lambda df, of: df.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(of).alias("_e"))
    return stability_index(side(expected, True).unionByName(side(actual, False)), keys, bins)


def max_feature_psi(expected: DataFrame, actual: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Largest stability index of a key over its features, and which it is (0 and null without any)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = lambda df: df.select(*keys, F.expr(f"stack({len(columns)}, {pairs}) as (feature, value)")).where(F.col("value").isNotNull())
    each = psi(long(expected), long(actual), (*keys, "feature"))
    best = each.groupBy(*keys).agg(F.max("psi").alias("max_psi"), F.max_by("feature", F.struct("psi", "feature")).alias("feature"))
    names = expected.select(*keys).unionByName(actual.select(*keys)).distinct()
    return names.join(best.hint("shuffle_hash"), list(keys), "left").withColumn("max_psi", F.coalesce("max_psi", F.lit(0.0)))


def posterior_entropy(probabilities: Column, floor: float = 1e-6) -> Column:
    """Normalised entropy of a probability array, 0 to 1."""
    n = F.size(probabilities)
    raised = F.transform(probabilities, lambda p: F.greatest(p, F.lit(0.0)))
    total = F.greatest(F.aggregate(raised, F.lit(0.0), lambda a, p: a + p), F.lit(floor))
    plain = F.aggregate(raised, F.lit(0.0), lambda a, p: a - F.when(p > 0, p / total * F.log(p / total)).otherwise(0.0))
    return F.when(n > 1, plain / F.log(n.cast("double"))).otherwise(0.0)


def drift_flag(psi_value: Column, entropy: Column, most_psi: float = 0.25, most_entropy: float = 0.8) -> Column:
    return (psi_value > most_psi) | (entropy > most_entropy)
