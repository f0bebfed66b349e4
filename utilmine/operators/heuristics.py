"""Approximate search: genetic, particle-swarm and ant-colony kernels on shards of the transactions.

Transactions are dealt to islands by hash, an island searches its own shard (bounded by ``shard_rows``) with a seeded generator, and the union of what
the islands propose is verified exactly against all transactions. So every result is a high-utility itemset with its exact utility, and nothing but the proposals depends on the kernel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Island:
    """Utilities of a shard as a dense-by-item index: for each item its rows and utilities."""

    def __init__(self, frame: pd.DataFrame, seed: int, max_length: int, share: float = 1):
        self.random = np.random.default_rng(seed)
        self.rows = {int(i): dict(zip(g["tid"].to_numpy(), g["u"].to_numpy())) for i, g in frame.groupby("item")}
        self.basket = {t: np.sort(g.to_numpy()) for t, g in frame.groupby("tid")["item"]}
        self.transactions = list(self.basket.values())
        self.items = np.array(sorted(self.rows))
        self.max_length = max_length
        self.share = max(share, 1)
        self.known: dict[tuple, int] = {}

    def occurrences(self, itemset) -> list:
        lists = sorted((self.rows[i] for i in itemset), key=len)
        return list(set(lists[0]).intersection(*lists[1:]))

    def utility(self, itemset: tuple) -> int:
        if itemset not in self.known:
            rows = self.occurrences(itemset)
            self.known[itemset] = int(sum(self.rows[i][t] for i in itemset for t in rows))
        return self.known[itemset]

    def propose(self) -> tuple:
        t = self.transactions[self.random.integers(len(self.transactions))]
        n = int(self.random.integers(1, min(len(t), self.max_length) + 1))
        return tuple(int(x) for x in np.sort(self.random.choice(t, n, replace=False)))

    def repair(self, itemset) -> tuple:
        """Without random items until it occurs; empty if nothing remains."""
        chosen = [i for i in dict.fromkeys(itemset) if i in self.rows][: self.max_length]
        while chosen and not self.occurrences(chosen):
            chosen.pop(int(self.random.integers(len(chosen))))
        return tuple(sorted(chosen))

    def extensions(self, itemset, rows: list) -> list[int]:
        """The other items of a random one of ``rows``, the transactions that contain ``itemset``."""
        return [i for i in self.basket[rows[self.random.integers(len(rows))]].tolist() if i not in itemset]

    def mutate(self, itemset: tuple) -> tuple:
        """Remove an item, or add one from a transaction that contains the set: the result still occurs."""
        if itemset and (len(itemset) >= self.max_length or self.random.random() < 0.5):
            k = int(self.random.integers(len(itemset)))
            return itemset[:k] + itemset[k + 1 :]
        more = self.extensions(itemset, self.occurrences(itemset)) if itemset else []
        return tuple(sorted((*itemset, more[self.random.integers(len(more))]))) if more else itemset

    def diversify(self, itemset: tuple) -> tuple:
        """A set that was evaluated before is mutated up to three times, then replaced."""
        for _ in range(3):
            if not itemset or itemset not in self.known:
                break
            itemset = self.mutate(itemset)
        return itemset if itemset and itemset not in self.known else self.propose()

    def child(self, itemset) -> tuple:
        chosen = self.repair(itemset)
        if not chosen or self.random.random() < 0.3:
            chosen = self.mutate(chosen)
        return self.diversify(chosen or self.propose())

    def genetic(self, rounds: int, size: int) -> None:
        population = [self.propose() for _ in range(size)]
        for _ in range(rounds):
            fitness = np.array([self.utility(x) for x in population], dtype=float) + 1
            best = population[int(fitness.argmax())]
            parents = self.random.choice(len(population), (size - 1, 2), p=fitness / fitness.sum())
            children = [best]
            for a, b in parents:
                pool = sorted({*population[a], *population[b]})
                child = [i for i in pool if self.random.random() < 0.5]
                children.append(self.child(child))
            population = children

    def swarm(self, rounds: int, size: int) -> None:
        index = {i: k for k, i in enumerate(self.items.tolist())}
        place = [self.propose() for _ in range(size)]
        speed = self.random.uniform(-1, 1, (size, len(self.items)))
        own, best = list(place), max(place, key=self.utility)
        for _ in range(rounds):
            for p in range(size):
                bits = np.zeros((3, len(self.items)))
                for row, chosen in enumerate((place[p], own[p], best)):
                    bits[row, [index[i] for i in chosen]] = 1
                r1, r2 = self.random.random(2)
                speed[p] = np.clip(0.7 * speed[p] + 1.5 * r1 * (bits[1] - bits[0]) + 1.5 * r2 * (bits[2] - bits[0]), -4, 4)
                near = self.items[self.random.random(len(self.items)) < 1 / (1 + np.exp(-speed[p]))]
                base = self.propose()
                place[p] = self.child([*(int(i) for i in near if i in base), *(i for i in own[p] if self.random.random() < 0.5)])
                if self.utility(place[p]) > self.utility(own[p]):
                    own[p] = place[p]
                if self.utility(place[p]) > self.utility(best):
                    best = place[p]

    def colony(self, rounds: int, size: int) -> None:
        trail = {int(i): 1.0 for i in self.items}
        worth = {i: float(sum(x.values())) + 1 for i, x in self.rows.items()}
        names = list(trail)

        def pick(among: list, weights: np.ndarray) -> int:
            steps = np.cumsum(weights)
            return among[min(int(np.searchsorted(steps, self.random.random() * steps[-1], side="right")), len(among) - 1)]

        for _ in range(rounds):
            weight = {i: trail[i] * worth[i] for i in names}
            everywhere = np.array(list(weight.values()))
            walks = []
            for _ in range(size):
                n = int(self.random.integers(1, self.max_length + 1))
                walk = [pick(names, everywhere)]
                rows = list(self.rows[walk[0]])
                while len(walk) < n and (more := self.extensions(walk, rows)):
                    walk.append(pick(more, np.array([weight[i] for i in more])))
                    rows = [t for t in rows if t in self.rows[walk[-1]]]
                found = tuple(sorted(walk))
                new = found not in self.known
                utility = self.utility(found)
                walks.append((found, min(2.0, utility / self.share) + (new and utility >= self.share)))
            for i in trail:
                trail[i] = max(0.2, 0.9 * trail[i])
            for found, deposit in walks:
                for i in found:
                    trail[i] += deposit / len(found)


def propose(entries: DataFrame, kind: str, threshold: int, seed: int = 42, iterations: int = 2000, population: int = 30, max_length: int = 8, shard_rows: int = 200_000) -> DataFrame:
    """Distinct itemsets that reach their share of ``threshold`` in some shard, of ``iterations`` generations of the whole ``population`` there."""
    total = entries.count()
    islands = max(1, -(-total // shard_rows))
    share = threshold / islands

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        island = Island(frame, seed + int(frame["island"].iloc[0]), max_length, share)
        {"ga": island.genetic, "bpso": island.swarm, "aco": island.colony}[kind](iterations, population)
        return pd.DataFrame({"itemset": [list(x) for x, u in island.known.items() if u >= share]})

    dealt = entries.select("tid", "item", "u", F.pmod(F.xxhash64("tid"), F.lit(islands)).cast("int").alias("island"))
    return dealt.groupBy("island").applyInPandas(run, "itemset array<long>").distinct()
