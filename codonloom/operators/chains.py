"""Posterior sampling: one Markov chain a group, many chains and replicates at once.

A chain is a fold over its own iterations, so Spark's parallel axis is the chain:
``run_chains`` groups columns by (replicate, chain) and a task runs each group's
fold. Its inputs are one alignment and tree, its output rows of a long trace.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.functions.genetic import SENSE
from codonloom.functions.substitution import dense_rates, transition_matrices
from codonloom.operators.likelihood import prune, tree_arrays
from codonloom.operators.simulation import MOST_REGIMES


@dataclass(frozen=True)
class Settings:
    model: str = "M0"
    iterations: int = 200
    burn_in: int = 100
    sample_every: int = 10
    tune_every: int = 50
    gibbs_sites: int = 5
    rate: float = 5.0  # of the exponential priors
    tree_mean: float = 35.0
    tree_sd: float = 10.0
    alpha: float = 0.3
    beta: float = 1.0  # power of the heated chain; 1: none
    swap_every: int = 10
    fixed_regimes: int = 0
    sample_prior: bool = False
    seed: int = 1
    weights: dict = field(default_factory=lambda: {"tree": 2.0, "kappa": 1.0, "omega": 1.0, "switching": 1.0, "pi": 2.0, "regimes": 1.0, "categories": 2.0})

    def __post_init__(self) -> None:
        """Refuse what no chain can run with."""
        most = MOST_REGIMES.get(self.model)
        for wrong, why in (
            (most is None, f"no such model: {self.model}"),
            (not 0 < self.beta <= 1, "beta must be above 0 and at most 1"),
            (self.swap_every < 1, "swaps need at least one step between them"),
            (self.fixed_regimes < 0, "the number of regimes can't be negative"),
            (self.fixed_regimes > (0 if self.model == "M0" else most or 0), f"too many fixed regimes for {self.model}"),
            (min(self.iterations, self.sample_every, self.tune_every) < 1 or self.burn_in < 0, "steps must be positive"),
            (min(self.rate, self.tree_mean, self.tree_sd, self.alpha) <= 0, "parameters of priors must be positive"),
        ):
            if wrong:
                raise ValueError(why)


@dataclass(frozen=True)
class State:
    """Increments are (category, regime); omegas are their running sums."""

    kappa: float
    increments: np.ndarray
    switching: float
    pi: np.ndarray
    shares: np.ndarray
    length: float
    cats: np.ndarray


def ln_exp(x, rate: float) -> float:
    return float(np.sum(np.log(rate) - rate * np.asarray(x)))


def ln_dirichlet(p: np.ndarray, a: np.ndarray) -> float:
    return math.lgamma(a.sum()) - sum(map(math.lgamma, a)) + float(((a - 1) * np.log(p)).sum())


def step_odds(k: int, most: int) -> tuple[float, float]:
    """Probabilities to propose a regime more and a regime less."""
    return (1.0 if k == 1 else 0.0 if k == most else 0.5), (1.0 if k == most else 0.0 if k == 1 else 0.5)


class Chain:
    def __init__(self, masks: np.ndarray, tree: tuple, settings: Settings, rng: np.random.Generator):
        self.masks, self.tree, self.s, self.rng = masks, tree, settings, rng
        self.most = MOST_REGIMES[settings.model]
        self.width = {"kappa": 0.5, "omega": 0.5, "switching": 0.5, "length": 1.0, "pi": 1000.0, "shares": 1000.0}
        self.counts: dict[str, list[int]] = {}
        k = settings.fixed_regimes or int(rng.integers(1, self.most + 1))
        edges = int((tree[1] >= 0).sum())
        self.edges = edges
        self.state = State(
            rng.exponential(1 / settings.rate), rng.exponential(1 / settings.rate, (1, k)), rng.exponential(1 / settings.rate) if k > 1 else 0.0,
            rng.dirichlet(np.full(SENSE, 2.0)), rng.dirichlet(np.ones(edges)), rng.gamma(*self._length_prior(draw=True)), np.zeros(len(masks), dtype=np.int64),
        )
        self.lnl, self.lnp = self.likelihood(self.state), self.prior(self.state)

    def _length_prior(self, draw: bool = False) -> tuple[float, float]:
        shape, rate = self.s.tree_mean**2 / self.s.tree_sd**2, self.s.tree_mean / self.s.tree_sd**2
        return (shape, 1 / rate) if draw else (shape, rate)

    def prior(self, x: State) -> float:
        shape, rate = self._length_prior()
        sizes = np.bincount(x.cats, minlength=len(x.increments))
        out = ln_exp(x.kappa, self.s.rate) + ln_exp(x.increments, self.s.rate) + ln_dirichlet(x.pi, np.full(SENSE, 2.0))
        out += shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * math.log(x.length) - rate * x.length
        if x.increments.shape[1] > 1:
            out += ln_exp(x.switching, self.s.rate)
        if self.s.model == "DPCMM":
            out += len(sizes) * math.log(self.s.alpha) + sum(math.lgamma(n) for n in sizes if n)
        return out

    def matrices(self, x: State, increments: np.ndarray) -> np.ndarray:
        lengths = np.zeros(len(self.tree[1]))
        lengths[self.tree[1] >= 0] = x.shares * x.length
        return transition_matrices(dense_rates(x.kappa, np.cumsum(increments), x.pi, x.switching), x.pi, lengths)

    def site_lnl(self, x: State, increments: np.ndarray, sites: np.ndarray) -> np.ndarray:
        if self.s.sample_prior:
            return np.zeros(len(sites))
        k = len(increments)
        partial, logs = prune(self.masks[sites], self.tree, self.matrices(x, increments), k)
        return np.log(np.maximum(partial[int(self.tree[0][-1])] @ (np.tile(x.pi, k) / k), 1e-300)) + logs

    def likelihood(self, x: State) -> float:
        if self.s.sample_prior:
            return 0.0
        return float(sum(self.site_lnl(x, inc, np.flatnonzero(x.cats == c)).sum() for c, inc in enumerate(x.increments) if (x.cats == c).any()))

    # Proposals: the new state and the log of the proposal ratio.

    def kappa(self, x: State):
        f = math.exp(self.width["kappa"] * (self.rng.random() - 0.5))
        return replace(x, kappa=x.kappa * f), math.log(f)

    def switching(self, x: State):
        f = math.exp(self.width["switching"] * (self.rng.random() - 0.5))
        return replace(x, switching=x.switching * f), math.log(f)

    def omega(self, x: State):
        inc, k = x.increments.copy(), x.increments.shape[1]
        c, j, u = int(self.rng.integers(len(inc))), int(self.rng.integers(k)), self.rng.random()
        if k == 1 or u < 0.6:
            f = math.exp(self.width["omega"] * (self.rng.random() - 0.5))
            inc[c, j] *= f
            return replace(x, increments=inc), math.log(f)
        i = (j + 1 + int(self.rng.integers(k - 1))) % k
        if u < 0.9:  # a part of one increment moves to another
            part, before = self.rng.random(), inc[c, j]
            inc[c, j], inc[c, i] = before * (1 - part), inc[c, i] + part * before
            return replace(x, increments=inc), math.log(before) - math.log(inc[c, i])
        inc[c, [i, j]] = inc[c, [j, i]]
        return replace(x, increments=inc), 0.0

    def pi(self, x: State):
        i, a = int(self.rng.integers(SENSE)), self.width["pi"]
        old = np.array([x.pi[i], 1 - x.pi[i]])
        new = self.rng.dirichlet(old * a + 1)
        factor = new[1] / old[1]
        pi = x.pi * factor
        pi[i] = new[0]
        if pi.min() < 1e-10:
            return x, -math.inf
        return replace(x, pi=pi / pi.sum()), ln_dirichlet(old, new * a + 1) - ln_dirichlet(new, old * a + 1) + (SENSE - 2) * math.log(factor)

    def tree_move(self, x: State):
        if self.rng.random() < 0.25:
            f = math.exp(self.width["length"] * (self.rng.random() - 0.5))
            return replace(x, length=x.length * f), math.log(f)
        a = self.width["shares"]
        new = self.rng.dirichlet(x.shares * a + 1)
        if new.min() < 1e-12:
            return x, -math.inf
        return replace(x, shares=new), ln_dirichlet(x.shares, new * a + 1) - ln_dirichlet(new, x.shares * a + 1)

    def regimes(self, x: State):
        """A regime more or less, in every category: half the time by an increment drawn
        from its prior or dropped, half by one split in two or two merged."""
        k, inc, lam = x.increments.shape[1], x.increments, self.s.rate
        more, _ = step_odds(k, self.most)
        up = self.rng.random() < more
        a, b = (k, k + 1) if up else (k - 1, k)
        odds = math.log(step_odds(b, self.most)[1]) - math.log(step_odds(a, self.most)[0])
        switching, ln_switch = x.switching, 0.0
        if up and k == 1:
            switching = self.rng.exponential(1 / lam)
            ln_switch = -ln_exp(switching, lam)
        elif not up and k == 2:
            switching, ln_switch = 0.0, ln_exp(x.switching, lam)
        if self.rng.random() < 0.5:
            at = int(self.rng.integers(b))
            if up:
                new = self.rng.exponential(1 / lam, (len(inc), 1))
                return replace(x, increments=np.hstack([inc[:, :at], new, inc[:, at:]]), switching=switching), odds + ln_switch - ln_exp(new, lam)
            return replace(x, increments=np.delete(inc, at, axis=1), switching=switching), -odds + ln_switch + ln_exp(inc[:, at], lam)
        at = int(self.rng.integers(a))
        if up:
            u, d = self.rng.beta(5, 5, len(inc)), inc[:, at]
            ln_q = self._ln_beta(u) - float(np.log(d).sum())
            return replace(x, increments=np.hstack([inc[:, :at], (u * d)[:, None], ((1 - u) * d)[:, None], inc[:, at + 1 :]]), switching=switching), odds + ln_switch - ln_q
        d = inc[:, at] + inc[:, at + 1]
        ln_q = self._ln_beta(inc[:, at] / d) - float(np.log(d).sum())
        return replace(x, increments=np.hstack([inc[:, :at], d[:, None], inc[:, at + 2 :]]), switching=switching), -odds + ln_switch + ln_q

    @staticmethod
    def _ln_beta(u: np.ndarray) -> float:
        return float((math.lgamma(10) - 2 * math.lgamma(5) + 4 * np.log(u) + 4 * np.log1p(-u)).sum())

    def categories(self) -> None:
        """Gibbs steps over random sites with five auxiliary categories from the prior (Neal, 2000)."""
        for site in self.rng.choice(len(self.masks), size=min(self.s.gibbs_sites, len(self.masks)), replace=False):
            x = self.state
            sizes = np.bincount(np.delete(x.cats, site), minlength=len(x.increments))
            new = self.rng.exponential(1 / self.s.rate, (5, x.increments.shape[1]))
            pool = np.vstack([x.increments, new])
            with np.errstate(divide="ignore"):
                ln_w = np.log(np.concatenate([sizes, np.full(5, self.s.alpha / 5)]))
            own = np.isfinite(ln_w)
            ln_w[own] += [self.site_lnl(x, inc, np.array([site]))[0] for inc in pool[own]]
            ln_w *= self.beta
            w = np.exp(ln_w - ln_w[own].max())
            c = int(self.rng.choice(len(w), p=w / w.sum()))
            cats = x.cats.copy()
            cats[site] = c
            used, cats = np.unique(cats, return_inverse=True)
            self.state = replace(x, cats=cats, increments=pool[used])
        self.lnl, self.lnp = self.likelihood(self.state), self.prior(self.state)

    beta = 1.0

    def step(self) -> None:
        """One move, chosen by weight among those that apply, repeated and accepted by
        the Metropolis-Hastings rule."""
        k, n = self.state.increments.shape[1], self.masks.shape[1]
        moves = {"tree": (self.tree_move, max(1, n // 4)), "kappa": (self.kappa, 3), "omega": (self.omega, 5), "pi": (self.pi, 10)}
        if k > 1:
            moves["switching"] = (self.switching, 5)
        if self.most > 1 and not self.s.fixed_regimes:
            moves["regimes"] = (self.regimes, 5)
        names = [*moves, *(["categories"] if self.s.model == "DPCMM" else [])]
        w = np.array([self.s.weights[m] for m in names])
        name = names[int(self.rng.choice(len(names), p=w / w.sum()))]
        if name == "categories":
            return self.categories()
        for _ in range(moves[name][1]):
            if name == "switching" and self.state.increments.shape[1] == 1:
                break
            new, ln_ratio = moves[name][0](self.state)
            count = self.counts.setdefault(name, [0, 0])
            count[1] += 1
            if ln_ratio == -math.inf:
                continue
            lnp = self.prior(new)
            lnl = self.likelihood(new)
            if math.log(max(self.rng.random(), 1e-300)) < ln_ratio + self.beta * (lnl + lnp - self.lnl - self.lnp):
                self.state, self.lnl, self.lnp = new, lnl, lnp
                count[0] += 1

    def tune(self) -> None:
        """Widen what is accepted more than a third of the time, narrow the rest."""
        for name, (yes, tried) in self.counts.items():
            if tried and name in ("kappa", "omega", "switching", "pi", "tree"):
                r = yes / tried
                f = 1 + (r - 0.33) / 0.67 if r > 0.33 else 1 / (2 - r / 0.33)
                if name == "tree":
                    self.width["shares"] = max(10.0, self.width["shares"] / f)
                    self.width["length"] *= f
                else:
                    self.width[name] = max(10.0, self.width[name] / f) if name == "pi" else self.width[name] * f
        self.counts = {}

    def sample(self) -> dict[str, float]:
        x = self.state
        out = {"Posterior": self.lnl + self.lnp, "Likelihood": self.lnl, "Prior": self.lnp, "TreeLength": x.length, "K": x.kappa, "OmegaCount": float(x.increments.shape[1]), "R": x.switching}
        if self.s.model == "DPCMM":
            out["CategoryCount"] = float(len(x.increments))
        else:
            out |= {f"Omega{r}": float(w) for r, w in enumerate(np.cumsum(x.increments[0]))}
        out |= {f"SiteCategory[{i}]": float(c) for i, c in enumerate(x.cats)} if self.s.model == "DPCMM" else {}
        if self.s.model == "DPCMM":
            out |= {f"CategoryOmega[{c},{r}]": float(w) for c, inc in enumerate(x.increments) for r, w in enumerate(np.cumsum(inc))}
        lengths = np.zeros(len(self.tree[1]))
        lengths[self.tree[1] >= 0] = x.shares * x.length
        out |= {f"Branch[{n}]": float(v) for n, v in zip(self.tree[0].tolist(), lengths, strict=True)}
        return out | {f"Pi[{i}]": float(p) for i, p in enumerate(x.pi)}


def run_chain(masks: np.ndarray, tree: tuple, s: Settings, replicate: int, chain: int) -> pd.DataFrame:
    """Burn-in with tuning, then samples. With beta below 1, a heated chain runs beside
    the cold one and they may swap states."""
    cold = Chain(masks, tree, s, np.random.default_rng([s.seed, replicate, chain]))
    hot = Chain(masks, tree, s, np.random.default_rng([s.seed, replicate, chain, 1])) if s.beta < 1 else None
    if hot:
        hot.beta = s.beta
    rows = []
    for i in range(s.burn_in + s.iterations):
        if i >= s.burn_in and (i - s.burn_in) % s.sample_every == 0:
            rows += [(replicate, chain, i - s.burn_in, p, v) for p, v in cold.sample().items()]
        cold.step()
        if hot:
            hot.step()
            if (i + 1) % s.swap_every == 0:
                gain = (1 - s.beta) * (hot.lnl + hot.lnp - cold.lnl - cold.lnp)
                if math.log(max(cold.rng.random(), 1e-300)) < gain:
                    cold.state, hot.state, cold.lnl, hot.lnl, cold.lnp, hot.lnp = hot.state, cold.state, hot.lnl, cold.lnl, hot.lnp, cold.lnp
        if i < s.burn_in and (i + 1) % s.tune_every == 0:
            cold.tune()
    return pd.DataFrame(rows, columns=["replicate", "chain", "iteration", "param", "value"])


def run_chains(columns: DataFrame, tree: DataFrame, settings: Settings, chains: int = 1) -> DataFrame:
    """replicate, chain, iteration, param, value from columns (replicate, site, masks)
    and one tree. Each chain draws from a generator seeded by seed, replicate and chain,
    so results don't depend on the cluster."""
    nodes = tree_arrays(tree)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("site")
        return run_chain(np.stack(ordered["masks"].to_numpy()), nodes, settings, int(group["replicate"].iloc[0]), int(group["chain"].iloc[0]))

    keyed = columns.select("replicate", "site", "masks", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"))
    return keyed.groupBy("replicate", "chain").applyInPandas(run, "replicate long, chain int, iteration long, param string, value double")
