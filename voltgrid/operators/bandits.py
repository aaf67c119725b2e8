"""Bandit statistics over logged rewards, and seeded replays of the policies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.onerow import with_group_stats
from voltgrid.functions.special import beta_ppf
from voltgrid.operators.ordered import row_numbers
from voltgrid.operators.runs import RUN, regret_bound

# Table values per confidence level: t at few and more degrees of freedom, and z (fixed values).
T_DF1 = {0.90: 6.314, 0.95: 12.706, 0.99: 63.657}
T_DF5 = {0.90: 2.015, 0.95: 2.571, 0.99: 4.032}
T_MORE = {0.90: 1.833, 0.95: 2.262, 0.99: 3.250}
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
MIN_PULLS, MAX_WIDTH = 10, 0.1


def arm_statistics(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(*RUN, "arm").agg(F.count("reward").alias("pulls"), F.sum("reward").alias("total_reward"),
                                             F.avg("reward").alias("mean_reward"), F.stddev_samp("reward").alias("reward_std"))


def interval_margin(pulls: Column, mean: Column, std: Column, confidence: float = 0.95) -> Column:
    """Width of the interval on the [0, 1] scale around .5."""
    t = F.when(pulls == 2, T_DF1[confidence]).when(pulls <= 6, T_DF5[confidence]).otherwise(T_MORE[confidence])
    absolute = t * std / F.sqrt(pulls) * (1 + 1 / pulls)
    small = F.when(std < 1e-6, 0.1).when(F.abs(mean) > 1e-6, F.least(F.lit(1.0), absolute / F.abs(mean))).otherwise(F.least(F.lit(1.0), absolute * 2))
    error = Z[confidence] * std / F.sqrt(pulls)
    large = F.when(F.abs(mean) > 1e-6, F.least(F.lit(1.0), error / F.abs(mean))).otherwise(F.least(F.lit(1.0), error))
    single = F.greatest(F.lit(0.3), 0.5 - F.abs(mean - 0.5))
    return F.when(pulls < 1, 1.0).when(pulls == 1, single).when(pulls < 30, small).otherwise(large)


def arm_intervals(stats: DataFrame, confidence: float = 0.95) -> DataFrame:
    m = interval_margin(F.col("pulls"), F.col("mean_reward"), F.coalesce("reward_std", F.lit(0.0)), confidence)
    return (stats.withColumn("_m", m).withColumn("lower", F.greatest(F.lit(0.0), 0.5 - F.col("_m") / 2))
            .withColumn("upper", F.least(F.lit(1.0), 0.5 + F.col("_m") / 2)).withColumn("width", F.col("upper") - F.col("lower")).drop("_m"))


def best_arm(stats: DataFrame) -> DataFrame:
    """Arm with the largest mean per run; the lowest arm wins ties."""
    b = stats.groupBy(*RUN).agg(F.min_by(F.struct(*[c for c in stats.columns if c not in RUN]), F.struct(-F.col("mean_reward"), F.col("arm"))).alias("_b"))
    return b.select(*RUN, "_b.*")


def threshold_met(stats: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Best arm pulled >= 10 times with width < .1; and the stricter fallback test (>= 50, width / |mean| < .05)."""
    b = best_arm(arm_intervals(stats, confidence))
    strict = (F.col("pulls") >= 50) & (F.col("mean_reward") != 0) & (F.col("width") / F.abs("mean_reward") < 0.05)
    return b.select(*RUN, "arm", "pulls", "mean_reward", "width", ((F.col("pulls") >= MIN_PULLS) & (F.col("width") < MAX_WIDTH)).alias("met"), strict.alias("strict_met"))


def ucb_values(stats: DataFrame, c: float = 1.0, min_pulls: int = 1) -> DataFrame:
    """Upper confidence bounds and bonuses; untried arms are infinite; plus the regret bound of the run."""
    s = with_group_stats(stats, RUN, F.sum("pulls").alias("total_pulls"), F.count(F.lit(1)).alias("arms"))
    bonus = c * F.sqrt(2 * F.log(F.col("total_pulls").cast("double")) / F.col("pulls"))
    inf = F.lit(float("inf"))
    tried = F.col("pulls") >= min_pulls
    return s.select(*RUN, "arm", F.when(tried, F.col("mean_reward") + bonus).otherwise(inf).alias("ucb"), F.when(tried, bonus).otherwise(inf).alias("bonus"),
                    regret_bound(F.col("arms"), F.col("total_pulls")).alias("regret_bound"))


def beta_posterior(episodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Beta(1, 1) prior; a reward above the threshold is a success."""
    g = episodes.groupBy(*RUN, "arm").agg((F.count_if(F.col("reward") > threshold) + 1).alias("alpha"), (F.count_if(~(F.col("reward") > threshold)) + 1).alias("beta"))
    a, b = F.col("alpha").cast("double"), F.col("beta").cast("double")
    return g.withColumn("mean", a / (a + b)).withColumn("variance", a * b / ((a + b) * (a + b) * (a + b + 1)))


def beta_interval(posterior: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Posterior width mapped around .5."""
    tail = (1 - confidence) / 2
    w = beta_ppf(1 - tail, F.col("alpha"), F.col("beta")) - beta_ppf(tail, F.col("alpha"), F.col("beta"))
    return (posterior.withColumn("width", w).withColumn("lower", F.greatest(F.lit(0.0), 0.5 - F.col("width") / 2))
            .withColumn("upper", F.least(F.lit(1.0), 0.5 + F.col("width") / 2)))


def _width(n, mean, std, confidence=0.95):
    """Numpy form of ``interval_margin`` for the trace."""
    n, mean, std = (np.asarray(v, float) for v in (n, mean, std))
    t = np.where(n == 2, T_DF1[confidence], np.where(n <= 6, T_DF5[confidence], T_MORE[confidence]))
    with np.errstate(divide="ignore", invalid="ignore"):
        absolute = t * std / np.sqrt(n) * (1 + 1 / n)
        rel = np.abs(mean) > 1e-6
        small = np.where(std < 1e-6, 0.1, np.where(rel, np.minimum(1, absolute / np.abs(mean)), np.minimum(1, absolute * 2)))
        error = Z[confidence] * std / np.sqrt(n)
        large = np.where(rel, np.minimum(1, error / np.abs(mean)), np.minimum(1, error))
    single = np.maximum(0.3, 0.5 - np.abs(mean - 0.5))
    return np.where(n < 1, 1.0, np.where(n == 1, single, np.where(n < 30, small, large)))


def confidence_trace(episodes: DataFrame, c_param: float = 1.0, chunk: int = 65536) -> DataFrame:
    """Per episode: interval of the chosen arm, width of the best arm so far, arms seen, exploration bonus.

    What an episode needs from the past is each arm's pulls, sum and sum of squares, and these add up: runs are numbered
    over the cluster and cut into chunks of ``chunk`` rows, a chunk starts from the sums of those before (one row per chunk, run
    and arm), and all chunks are worked on at once. However long a run is, Python holds one chunk.
    """
    numbered = materialize(row_numbers(episodes.select(*RUN, "episode", "arm", "reward"), RUN, ["episode"], "_rn").withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk)))
    sums = numbered.groupBy("_chunk", *RUN, "arm").agg(F.count(F.lit(1)).alias("_n"), F.sum("reward").alias("_s"), F.sum(F.col("reward") * F.col("reward")).alias("_q"))
    every = sums.select("_chunk", *RUN).distinct().join(sums.select(*RUN, "arm").distinct(), RUN)
    before = Window.partitionBy(*RUN, "arm").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    past = every.join(sums, ["_chunk", *RUN, "arm"], "left").select("_chunk", *RUN, "arm", *[F.sum(c).over(before).alias(c) for c in ("_n", "_s", "_q")])
    carry = past.filter("_n > 0").groupBy("_chunk", *RUN).agg(F.collect_list(F.struct("arm", F.col("_n").cast("double").alias("n"), F.col("_s").alias("s"), F.col("_q").alias("q"))).alias("_past"))

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        past = pdf["_past"].iloc[0]
        known = {int(x["arm"]): (x["n"], x["s"], x["q"]) for x in past} if past is not None else {}
        arms = np.array(sorted(set(known) | set(pdf["arm"])))
        total = np.array([known.get(int(a), (0.0, 0.0, 0.0)) for a in arms]).T  # pulls, sums, sums of squares
        col = np.searchsorted(arms, pdf["arm"].to_numpy())
        reward, time = pdf["reward"].to_numpy(), pdf["_rn"].to_numpy()
        block, frames = max(16, 500_000 // len(arms)), []
        for lo in range(0, len(pdf), block):
            c, r = col[lo:lo + block], reward[lo:lo + block]
            at, hit = np.arange(len(c)), np.zeros((3, len(c), len(arms)))
            hit[0, at, c], hit[1, at, c], hit[2, at, c] = 1.0, r, r * r
            n, s, q = np.cumsum(hit, axis=1) + total[:, None, :]
            total = np.stack([n[-1], s[-1], q[-1]])
            best = np.where(n > 0, s / np.maximum(n, 1), -np.inf).argmax(axis=1)

            def width(k):
                m, mean = n[at, k], s[at, k] / n[at, k]
                var = np.maximum(q[at, k] - m * mean * mean, 0.0) / np.maximum(m - 1, 1)
                return m, _width(m, mean, np.sqrt(var))

            (pulls, own), (_, top) = width(c), width(best)
            part = pdf.iloc[lo:lo + block]
            frames.append(part[[*RUN, "episode", "arm"]].assign(
                confidence_lower=0.5 - own / 2, confidence_upper=0.5 + own / 2, confidence_width=own, best_action_confidence=top, action_diversity=(n > 0).sum(axis=1),
                exploration_bonus=c_param * np.sqrt(2 * np.log(time[lo:lo + block]) / pulls)))
        return pd.concat(frames, ignore_index=True)

    # The first row of a chunk alone carries the sums before it.
    begun = numbered.join(carry, ["_chunk", *RUN], "left").withColumn("_past", F.when((F.col("_rn") - 1) % chunk == 0, F.col("_past")))
    return begun.groupBy("_chunk", *RUN).applyInPandas(trace, (
        "grid_id string, method string, episode long, arm int, confidence_lower double, confidence_upper double, confidence_width double, "
        "best_action_confidence double, action_diversity long, exploration_bonus double"))


# --- policy replay ------------------------------------------------------------------------------------------

def reward_table(episodes: DataFrame, pulls: int) -> DataFrame:
    """(grid_id, arm) -> rewards in logged order. No policy of ``pulls`` steps can use more than that many per arm."""
    r = row_numbers(episodes.select("grid_id", "arm", "episode", "reward"), ["grid_id", "arm"], ["episode"], "_k")
    return r.filter(F.col("_k") <= pulls).select("grid_id", "arm", F.col("_k").alias("k"), "reward")


class _Policy:
    """State of one replay: pulls and reward sums per arm, in arm order."""

    def __init__(self, arms: int, rng: np.random.RandomState, repeat_cap: int | None):
        self.n, self.sum, self.rng, self.cap = np.zeros(arms), np.zeros(arms), rng, repeat_cap
        self.last, self.streak = -1, 0

    def mean(self) -> np.ndarray:
        return self.sum / np.maximum(self.n, 1)

    def note(self, arm: int) -> int:
        self.streak = self.streak + 1 if arm == self.last else 1
        self.last = arm
        return arm

    def must_switch(self) -> bool:
        return self.cap is not None and self.last >= 0 and self.streak >= self.cap and len(self.n) > 1

    def update(self, arm: int, reward: float) -> None:
        self.n[arm] += 1
        self.sum[arm] += reward


class Ucb(_Policy):
    def choose(self) -> int:
        if (self.n == 0).any():
            return self.note(int(np.flatnonzero(self.n == 0)[0]))
        if self.must_switch():
            others = np.where(np.arange(len(self.n)) == self.last, np.inf, self.n)
            return self.note(int(others.argmin()))
        return self.note(int((self.mean() + np.sqrt(2 * np.log(max(1.0, self.n.sum())) / self.n)).argmax()))


class EpsilonGreedy(_Policy):
    # Start, decay and floor of the exploration rate (fixed values).
    epsilon, decay, floor = 1.0, 0.99, 0.1

    def choose(self) -> int:
        if self.must_switch():
            pick = self.rng.randint(len(self.n) - 1)
            return self.note(int(pick + (pick >= self.last)))
        if self.rng.random_sample() < self.epsilon or not self.n.any():
            return self.note(int(self.rng.randint(len(self.n))))
        return self.note(int(np.where(self.n > 0, self.mean(), -np.inf).argmax()))

    def update(self, arm: int, reward: float) -> None:
        super().update(arm, reward)
        self.epsilon = max(self.floor, self.epsilon * self.decay)

    def settled(self, confidence: float = 0.95) -> bool:
        """All arms pulled >= 10 times, epsilon <= .2 and a relative gap above 1 - confidence."""
        if (self.n < MIN_PULLS).any() or self.epsilon > 0.2:
            return False
        if len(self.n) == 1:
            return True
        top = np.sort(self.mean())[::-1]
        return bool(top[0] != 0 and (top[0] - top[1]) / abs(top[0]) > 1 - confidence)


class Thompson(_Policy):
    success_above = 0.0

    def __init__(self, arms, rng, repeat_cap):
        super().__init__(arms, rng, repeat_cap)
        self.a, self.b = np.ones(arms), np.ones(arms)

    def choose(self) -> int:
        draws = self.rng.beta(self.a, self.b)
        if self.must_switch():
            draws[self.last] = -1.0
        return self.note(int(draws.argmax()))

    def update(self, arm: int, reward: float) -> None:
        super().update(arm, reward)
        won = reward > self.success_above
        self.a[arm] += won
        self.b[arm] += not won


POLICIES = {"hybrid_ucb": Ucb, "hybrid_epsilon": EpsilonGreedy, "hybrid_thompson": Thompson}
_REPLAY = "grid_id string, policy string, episode long, arm int, reward double, settled boolean"


def replay(episodes: DataFrame, policies: tuple[str, ...], pulls: int = 200, seed: int = 42, repeat_cap: int | None = None) -> DataFrame:
    """Every policy on every grid's logged rewards: the k-th pull of an arm pays its k-th logged reward, cyclically.

    One group per (grid, policy), at most pulls x arms rows each.
    """
    table = reward_table(episodes, pulls).withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        grid, policy = key
        arms = sorted(pdf["arm"].unique())
        logs = [pdf[pdf["arm"] == a].sort_values("k")["reward"].to_numpy() for a in arms]
        state = POLICIES[policy](len(arms), np.random.RandomState((seed + sum(map(ord, grid))) % (2**31 - 1)), repeat_cap)
        rows = []
        for ep in range(1, pulls + 1):
            i = state.choose()
            reward = float(logs[i][int(state.n[i]) % len(logs[i])])
            state.update(i, reward)
            rows.append((grid, policy, ep, int(arms[i]), reward, bool(state.settled()) if policy == "hybrid_epsilon" else False))
        return pd.DataFrame(rows, columns=["grid_id", "policy", "episode", "arm", "reward", "settled"])

    spread = table.repartition(int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grid_id", "policy")
    return spread.groupBy("grid_id", "policy").applyInPandas(run, _REPLAY)


def policy_comparison(replays: DataFrame) -> DataFrame:
    """Per grid and policy: best, mean, std, pulls and distinct arms."""
    return replays.groupBy("grid_id", "policy").agg(F.max("reward").alias("best_reward"), F.avg("reward").alias("average_reward"),
                                                    F.stddev_pop("reward").alias("reward_std"), F.count(F.lit(1)).alias("pulls"),
                                                    F.count_distinct("arm").alias("arms"))


def proximity_score(placements: DataFrame, points: DataFrame, site_id: str) -> DataFrame:
    """Closeness of each placement to demand: 1 - (nearest - global nearest) / (farthest - global nearest), +.1 for a
    real edge, at most 1. The original's numerator is always 0; this is the corrected form."""
    from voltgrid.functions.onerow import with_globals
    from voltgrid.operators.tiles import nearest

    near = nearest(placements, points, site_id, "veh_id").select(site_id, F.col("dist").alias("_d"))
    scaled = with_globals(near, F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    score = F.when(F.col("_hi") > F.col("_lo"), 1 - (F.col("_d") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    real = (~F.coalesce(F.col("edge_id"), F.lit("fallback_")).startswith("fallback_")).cast("double") * 0.1
    return (placements.select(site_id, "edge_id").join(scaled, site_id)
            .select(site_id, F.least(score + real, F.lit(1.0)).alias("proximity_score")))


def best_arm_rewards(episodes: DataFrame, label: str = "bandit_optimization") -> DataFrame:
    """Episodes of each grid's best-mean bandit arm relabelled, beside the heuristic methods' episodes."""
    hybrid = episodes.filter(F.lower("method").contains("hybrid"))
    means = hybrid.groupBy("grid_id", "arm").agg(F.avg("reward").alias("m"))
    best = means.groupBy("grid_id").agg(F.min_by("arm", F.struct(-F.col("m"), F.col("arm"))).alias("arm"))
    chosen = hybrid.join(best, ["grid_id", "arm"]).select("grid_id", F.lit(label).alias("method"), "reward")
    return chosen.unionByName(episodes.filter(~F.lower("method").contains("hybrid")).select("grid_id", "method", "reward"))


def best_episode(episodes: DataFrame) -> DataFrame:
    """Best episode of each run and its arm."""
    b = episodes.groupBy(*RUN).agg(F.min_by(F.struct("episode", "arm", "reward"), F.struct(-F.col("reward"), F.col("episode"))).alias("_b"))
    return b.select(*RUN, "_b.*")
