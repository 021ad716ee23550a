"""Counts of a running job, gathered while it runs: no second pass over the data and no second join.

``observe`` rides along with the stages that compute the rows anyway. Where a row set is read by more than one branch of a plan it
is written once before (``materialize``), so every row is counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from geotables.operators.overlay import OVERLAPS, best_class, candidate_pairs, overlay_sides, with_overlap_area
from geotables.session import materialize
from geotables.sources.wkt_text import geometry_line_sql, parsed_lines


class Counts:
    """Named counts of one job; ``get`` is for after its action."""

    def __init__(self):
        self.parts: list[Observation] = []

    def on(self, df: DataFrame, **counts: str) -> DataFrame:
        """``df`` counted as it passes by: SQL conditions by name (``true`` counts all rows)."""
        part = Observation()
        self.parts.append(part)
        return df.observe(part, *[F.expr(f"count_if({c})").alias(name) for name, c in counts.items()])

    def get(self) -> dict[str, int]:
        return {name: n for part in self.parts for name, n in part.get.items()}


def overlay_with_counts(parcels: DataFrame, zones: DataFrame, tag_name: str = "PDJB") -> tuple[DataFrame, Counts]:
    """``overlay_classes`` and its counts: n_parcels, n_zones, n_zones_no_tag, n_pairs, n_pairs_positive, and, once the classes have
    been written or collected, n_parcels_matched."""
    counts = Counts()
    p, z = overlay_sides(parcels, zones, tag_name)
    p = materialize(counts.on(p, n_parcels="true"))
    z = materialize(counts.on(z, n_zones="true", n_zones_no_tag="z_class IS NULL"))
    scored = counts.on(with_overlap_area(candidate_pairs(p, z)), n_pairs="true", n_pairs_positive=OVERLAPS)
    best = best_class(materialize(scored).where(OVERLAPS), p.select("p_key", "p_oid"))
    out = counts.on(best, n_parcels_matched="zone_key IS NOT NULL")
    return out.select("oid", "pd_class", "overlap_area"), counts


def ingest_with_counts(lines: DataFrame, col: str = "value") -> tuple[DataFrame, Counts]:
    """The rows of ``parsed_lines`` and, once they have been written, the counts n_lines, n_skipped (lines that name no geometry),
    n_rows (geometry lines, members of collections each for itself) and n_rejected (rows with a reason)."""
    counts = Counts()
    told = counts.on(lines, n_lines="true", n_skipped=f"NOT ({geometry_line_sql(col)})")
    return counts.on(parsed_lines(told, col), n_rows="true", n_rejected="why IS NOT NULL"), counts
