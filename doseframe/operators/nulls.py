"""Permutation nulls for many permutations: one grouped map per treatment.

Spark ranks, joins the sets and scores them; inside the group numpy scores
blocks of permutations and returns only tail counts, so null scores are never
shuffled. The permutations are those of ``enrichment.null_scores``, number for
number.

A block takes all sets at once. The hits of a set under a permutation are the
ranks of its genes, so one sort of ``set * genes + rank`` puts the hits of every
set in order, each in the same stretch for every permutation; running sums are
one cumulative sum over all stretches, and peaks one reduction per stretch.
Weights are whole numbers inside (exact sums, so a stretch does not depend on
those before it). A permutation is one sort of numbers that hold key and gene.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from doseframe.functions.columns import MIX_A, MIX_B, MIX_PRIME, MIX_STEP, gene_code
from doseframe.operators.enrichment import DIGITS, KEY, SETS, permutation_base

SCORED = (
    "cell_line string, drug string, dose string, pathway string, size bigint, es double, leading_edge string, "
    "null_mean double, null_n bigint, null_extreme bigint, pool_n bigint, pool_extreme bigint"
)

#: Numbers that a block of permutations works on at once; small enough to stay in a core's cache.
BLOCK_CELLS = 1 << 17


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**62 modulo MIX_PRIME, which is one less than a power of two."""
    for _ in range(2):
        x = (x & MIX_PRIME) + (x >> 31)
    x[x == MIX_PRIME] = 0
    return x


def permuted_order(codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The genes (by place in name order) in the order of each permutation; equal keys in order of name."""
    x = _reduced(codes[None, :] + numbers[:, None] * MIX_STEP % MIX_PRIME)
    x = _reduced((x ^ (x >> 15)) * MIX_A)
    x = _reduced((x ^ (x >> 12)) * MIX_B)
    x ^= x >> 15
    bits = max(1, (len(codes) - 1).bit_length())
    x <<= bits
    x |= np.arange(len(codes))
    x.sort(axis=1)
    return x & ((1 << bits) - 1)


class Stretches:
    """The hits of all sets of a treatment, one stretch per set."""

    def __init__(self, sets: list[np.ndarray], weights: np.ndarray):
        """``sets`` has the genes of each set by place in name order, ``weights`` the weight at each rank."""
        self.n, self.sizes = len(weights), np.array([len(s) for s in sets])
        self.genes = np.concatenate(sets)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.of = np.repeat(np.arange(len(sets)), self.sizes)
        self.base = self.of * self.n
        self.hits_before = np.arange(len(self.genes)) - self.starts[self.of]
        if len(sets) * self.n < 1 << 31:
            self.base, self.hits_before = self.base.astype(np.int32), self.hits_before.astype(np.int32)
        with np.errstate(divide="ignore"):
            self.step = (1.0 / (self.n - self.sizes))[self.of]
        # As many binary digits as the heaviest possible set leaves below 2**62.
        heaviest = np.sort(weights)[-int(self.sizes.max()) :].sum()
        scale = 2.0 ** (61 - np.ceil(np.log2(heaviest))) if heaviest > 0 else 1.0
        self.weights = np.round(weights * scale).astype(np.int64)

    def scores(self, order: np.ndarray) -> np.ndarray:
        """Enrichment score of each set (column) under each order of the genes (row); NaN without a score."""
        ranks = np.empty(order.shape, self.base.dtype)
        np.put_along_axis(ranks, order, np.arange(self.n, dtype=self.base.dtype)[None, :], axis=1)
        hits = ranks.take(self.genes, axis=1)
        hits += self.base
        hits.sort(axis=1)
        hits -= self.base
        weight = self.weights.take(hits)
        # Sums may wrap around on the way; differences within a stretch do not.
        upto = weight.cumsum(axis=1)
        total = upto.take(self.starts + self.sizes - 1, axis=1)
        before = np.zeros_like(total)
        before[:, 1:] = total[:, :-1]
        upto -= before.take(self.of, axis=1)
        hits -= self.hits_before
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (1.0 / (total - before)).take(self.of, axis=1)
            sums = upto * share
            sums -= hits * self.step
            high = np.round(np.maximum.reduceat(sums, self.starts, axis=1), DIGITS)
            sums -= weight * share
            low = np.round(np.minimum.reduceat(sums, self.starts, axis=1), DIGITS)
            found = np.where(high >= -low, high, low)
        return np.where(np.isfinite(found), found, np.nan)

    def null_scores(self, codes: np.ndarray, base: int, permutations: int) -> np.ndarray:
        """Score of each set (row) under each permutation."""
        nulls = np.empty((len(self.sizes), permutations))
        block = max(1, BLOCK_CELLS // max(len(self.genes), self.n))
        for start in range(0, permutations, block):
            numbers = base + np.arange(start, min(start + block, permutations), dtype=np.int64)
            nulls[:, start : start + len(numbers)] = self.scores(permuted_order(codes, numbers)).T
        return nulls


def tail_counts(es: np.ndarray, nulls: np.ndarray) -> list[np.ndarray]:
    """Null mean and tail counts per set (row), and over all sets, for scores of the same sign."""

    def mean_where(mask: np.ndarray) -> np.ndarray:
        n = mask.sum(axis=1)
        return np.where(n > 0, np.where(mask, np.abs(nulls), 0.0).sum(axis=1) / np.maximum(n, 1), np.nan)

    up, down = nulls >= 0, nulls < 0
    same = np.where((es >= 0)[:, None], up, down)
    mean = np.where(es >= 0, mean_where(up), mean_where(down))
    null_nes = np.round(nulls / np.where(up, mean_where(up)[:, None], mean_where(down)[:, None]), DIGITS)
    nes = np.round(es / mean, DIGITS)
    pools = {s: np.sort(np.abs(null_nes[m])) for s, m in ((True, up), (False, down))}
    pool_n = np.array([len(pools[e >= 0]) for e in es])
    extreme = [len(pools[e >= 0]) - np.searchsorted(pools[e >= 0], abs(v), "left") for e, v in zip(es, nes)]
    null_extreme = (same & (np.abs(nulls) >= np.abs(es)[:, None])).sum(axis=1)
    return [mean, same.sum(axis=1), null_extreme, pool_n, np.array(extreme)]


def null_tails(scored: DataFrame, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """Score, leading edge and null tail counts of each kept set; counts are null where the score is.

    Takes ``enrichment.scored_members`` of all ranked genes. One group is one
    treatment: a row per gene symbol and set, however many fact rows it had.
    """
    base = permutation_base(seed)
    arrow = to_arrow_schema(T.StructType.fromDDL(SCORED))

    def score_group(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        position = rows["position"].to_numpy()
        _, at = np.unique(position, return_index=True)
        weights = np.abs(rows["metric"].to_numpy()[at])
        by_name = pc.sort_indices(rows["gene"].take(at)).to_numpy()
        codes = rows["code"].to_numpy()[at][by_name]
        place = np.empty(len(at), np.int64)
        place[by_name] = np.arange(len(at))
        hits = rows.filter(rows["kept"])
        if not hits.num_rows:
            return arrow.empty_table()
        hits = hits.take(np.lexsort((hits["position"].to_numpy(), hits["pathway"].combine_chunks().dictionary_encode().indices.to_numpy())))
        sets = hits["pathway"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(sets, prepend=-1))
        nulls = Stretches(np.split(place[hits["position"].to_numpy()], starts[1:]), weights).null_scores(codes, base, permutations)
        observed = hits.select([*SETS, "size", "es"]).take(starts)
        edge = hits["in_edge"].to_numpy(zero_copy_only=False)
        ends = np.append(starts, len(edge))
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(edge))[ends].astype(np.int32), hits["gene"].combine_chunks().filter(pa.array(edge)))
        es = observed["es"].to_numpy()
        counts = tail_counts(es, nulls)
        # A set without a score stays, without statistics; its null scores count for the others.
        unscored = np.isnan(es)
        columns = [*observed.columns, pc.binary_join(lists, ";")]
        columns += [pa.array(c, mask=unscored | np.isnan(c.astype(np.float64))) for c in counts]
        return pa.Table.from_arrays(columns, names=arrow.names).cast(arrow)

    columns = [*SETS, "gene", "position", "metric", "size", "kept", "es", "in_edge"]
    rows = scored.select(*columns, gene_code("gene").alias("code"))
    return rows.groupBy(*KEY).applyInArrow(score_group, SCORED)
