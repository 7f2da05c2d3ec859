"""The scoring job: signatures to a wide, annotated score table in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from doseframe.operators.aggregates import signature_scores, wide_scores
from doseframe.operators.joins import join_cell_meta_fanout, join_cell_meta_first, join_drug_meta


def score_responses(
    de: DataFrame,
    signatures: DataFrame,
    names: Sequence[str],
    drugs: DataFrame,
    cell_lines: DataFrame,
    order_col: str | None = None,
) -> DataFrame:
    """Wide scores with drug and cell-line columns.

    One row per driver mutation of the cell line, or one row per score when
    ``order_col`` says which mutation comes first.
    """
    scores = join_drug_meta(wide_scores(signature_scores(de, signatures), names), drugs)
    if order_col is None:
        return join_cell_meta_fanout(scores, cell_lines)
    return join_cell_meta_first(scores, cell_lines, order_col)
