"""Constrained selection whose every choice depends on those before: sequential kernels over a bounded ranking.

Ranking, features and pruning are distributed; the choice itself runs in one task over at most MOST rows, and fails
loudly above that instead of dropping rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 2_000_000


def in_order(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = MOST) -> DataFrame:
    """kernel over all rows at once; the rows are counted first."""
    if (n := df.count()) > most:
        raise ValueError(f"{n} rows are too many for a sequential choice; prune the ranking below {most} first")
    return df.groupBy().applyInPandas(lambda rows: kernel(rows), schema)


def pruned(df: DataFrame, by: str, order: list, keep: int) -> DataFrame:
    """The first `keep` rows of each group: no choice with a cap per group can reach beyond them."""
    from pyspark.sql import Window

    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rank") <= keep).drop("__rank")


def pruned_for_quota(df: DataFrame, order: list, count: int, quota: dict[str, int]) -> DataFrame:
    """All rows that by_quota can choose: the first `count`, and of each quota's tag as many as all quotas together, as rows with several tags may be taken by another quota first."""
    out = df.orderBy(*order).limit(count)
    for tag in sorted(quota):
        out = out.unionAll(df.where(F.array_contains("tags", tag)).orderBy(*order).limit(sum(quota.values())))
    return out.distinct()


def by_quota(rows: Sequence[dict], count: int, quota: dict[str, int]) -> list[dict]:
    """First each tag's quota (tags in order), then the best others; rows come ranked, each with `tags`."""
    out: list[dict] = []
    taken: set = set()
    for tag, n in [*sorted(quota.items()), (None, count)]:
        left = n
        for r in rows:
            if len(out) == count or not left:
                break
            if r["id"] not in taken and (tag is None or tag in r["tags"]):
                taken.add(r["id"])
                out.append(r)
                left -= 1
    return out


def with_category_cap(rows: Sequence[dict], count: int, cap: int) -> list[dict]:
    """Ranked rows, of equal ranks the one whose rarest tag has been chosen least; a category's cap gives way only when nothing else is left.

    rows: id, rank (comparable), tags; the first tag is the category. Rows with the same tags wait in line behind their first."""
    if len(rows) < count:
        raise ValueError("fewer rows than are asked for")
    lines: dict[tuple, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["rank"], r["id"]), reverse=True):
        lines.setdefault(((r["tags"] or ["ordinary"])[0], frozenset(r["tags"])), []).append(r)
    chosen: Counter = Counter()
    out: list[dict] = []
    while len(out) < count:
        keys = [((r := line[-1])["rank"], min((chosen[t] for t in r["tags"]), default=0), r["id"], at) for at, line in lines.items()]
        free = [k for k in keys if chosen[k[-1][0]] < cap]
        at = min(free or keys, key=lambda k: k[:-1])[-1]
        out.append(lines[at].pop())
        if not lines[at]:
            del lines[at]
        if free:
            chosen[at[0]] += 1
    return out


#: Which limits each attempt gives up, in the order of the attempts.
RELAXATIONS = ("strict", "domain", "source", "cell_minimum", "family")


def with_relaxed_caps(rows: Sequence[dict], target: int, cell_minimum: int = 4) -> tuple[list[dict], list[tuple[str, int]]]:
    """Ranked rows with unique keys, under a cap per domain (a quarter) and source (a twentieth), first a minimum per cell; attempts give up one limit more each until the target is reached.

    rows: id, cell, domain, source, family, unique (tuple of values that may occur once)."""
    attempts: list[tuple[str, int]] = []
    for level in range(len(RELAXATIONS)):
        open_ = set(RELAXATIONS[1 : level + 1])
        caps = {"domain": max(1, target // 4), "source": max(1, target // 20)}
        used: dict[str, Counter] = {k: Counter() for k in ("domain", "source", "family")}
        seen: set = set()
        out: list[dict] = []

        def take(r: dict, open_=open_, caps=caps, used=used, seen=seen, out=out) -> bool:
            if r["id"] in seen or any(u in seen for u in r["unique"]):
                return False
            if "family" not in open_ and used["family"][r["family"]]:
                return False
            if any(k not in open_ and used[k][r[k]] >= caps[k] for k in caps):
                return False
            seen.update([r["id"], *r["unique"]])
            for k in used:
                used[k][r[k]] += 1
            out.append(r)
            return True

        if "cell_minimum" not in open_:
            for cell in sorted({r["cell"] for r in rows}):
                n = 0
                for r in rows:
                    if n == cell_minimum:
                        break
                    if r["cell"] == cell:
                        n += take(r)
        for r in rows:
            if len(out) >= target:
                break
            take(r)
        attempts.append((RELAXATIONS[level], len(out)))
        if len(out) >= target:
            return out[:target], attempts
    raise ValueError(f"only {len(out)} of {target} rows can be chosen: {attempts}")


def with_diversity(rows: Sequence[dict], count: int, feature_cap: int, conflicts: dict) -> list[dict]:
    """Fewest conflicts with what is chosen, then fewest features in common with it, then rank; a feature's cap is hard.

    rows: id, rank, features (set); conflicts: id -> ids that are too similar."""
    left = {r["id"]: r for r in sorted(rows, key=lambda r: (r["rank"], r["id"]))}
    used: Counter = Counter()
    chosen: set = set()
    out: list[dict] = []
    while left and len(out) < count:
        free = [r for r in left.values() if all(used[f] < feature_cap for f in r["features"])]
        if not free:
            break
        best = min(free, key=lambda r: (len(chosen & conflicts.get(r["id"], set())), sum(used[f] for f in r["features"]), r["rank"], r["id"]))
        out.append(left.pop(best["id"]))
        chosen.add(best["id"])
        used.update(best["features"])
    return out


def first_wins(rows: Sequence[dict], similar: Callable[[dict, dict], bool], gram_cap: int | None = None) -> list[tuple[dict, str | None]]:
    """Each row in order with the reason it is refused, or null: only kept rows count as seen.

    rows: id, keys (exact forms), grams (set). gram_cap: of kept rows that may hold one gram."""
    seen: set = set()
    held: Counter = Counter()
    by_gram: dict = {}
    kept: dict = {}
    out: list[tuple[dict, str | None]] = []
    for r in rows:
        near = {i for g in r["grams"] for i in by_gram.get(g, ())}
        if any(k in seen for k in r["keys"]):
            reason = "exact_duplicate"
        elif gram_cap is not None and any(held[g] >= gram_cap for g in r["grams"]):
            reason = "ngram_concentration"
        elif any(similar(r, kept[i]) for i in sorted(near)):
            reason = "near_duplicate"
        else:
            reason = None
            kept[r["id"]] = r
            seen.update(r["keys"])
            held.update(r["grams"])
            for g in r["grams"]:
                by_gram.setdefault(g, []).append(r["id"])
        out.append((r, reason))
    return out


def refills(deficits: Sequence[tuple[str, int]], budget: int, rounds: int, shards: int) -> list[tuple[str, int, int]]:
    """Tasks for cells in deficit within a budget: cell, shard (rotating with the round) and ordinal."""
    out: list[tuple[str, int, int]] = []
    for cell, deficit in sorted(deficits):
        n = 0 if deficit <= 0 else min(5, max(1, -(-deficit // 40)))
        for i in range(n):
            if len(out) == budget:
                return out
            out.append((cell, (rounds + i) % shards, i))
    return out
