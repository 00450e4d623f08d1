"""The chain from text boxes to the unified transcript, counted as it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from captionmill.operators import boxes as bx
from captionmill.operators import evaluation, segments
from captionmill.operators.stored import dropped, stored
from captionmill.schema import BOTH, ON_SCREEN

STAGES = ("raw_bboxes", "post_aggregation", "post_extract", "post_pattern_filter", "post_frequency_filter", "post_dedup", "final_on_screen_both")


class Funnel:
    """Rows at each stage, gathered by observations of the run's own plans. A stage is
    observed where its rows pass once: ahead of the table that the next steps read."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, which=None) -> DataFrame:
        self.seen[stage] = Observation(stage)
        return df.observe(self.seen[stage], F.count(F.lit(1)).alias("n") if which is None else F.count_if(which).alias("n"))

    def counts(self, spark) -> DataFrame:
        """stage_no, stage, n and drop_percent; stages that did not run count 0."""
        rows = [(i, s, self.seen[s].get["n"] if s in self.seen else 0) for i, s in enumerate(STAGES, 1)]
        return evaluation.funnel(spark.createDataFrame(rows, "stage_no int, stage string, n long"))


def transcript(found: DataFrame, speech: DataFrame, profiles: DataFrame, frames: DataFrame, language: str = "en", share: float = 0.95, fuzzy: float = 90.0, least_frames: int = 0, min_confidence: float = 0.6) -> tuple[DataFrame, Funnel]:
    """The merged segments (a stored table) of ``found`` boxes (video_id, frame_ts, pos,
    box, text, score) and ``speech`` segments, and the funnel of the on-screen side.
    ``profiles`` (video_id, patterns), ``frames`` (video_id, frame_count)."""
    funnel = Funnel()
    lines = funnel.watch(bx.aggregate_boxes(funnel.watch(found, STAGES[0]), min_confidence), STAGES[1])
    shown = funnel.watch(bx.to_segments(lines, language), STAGES[2])
    fits = stored(funnel.watch(segments.drop_patterns(shown, profiles), STAGES[3]), "chain-fits")
    rare = stored(funnel.watch(segments.drop_recurring(fits, frames, share, fuzzy, least_frames), STAGES[4]), "chain-rare")
    told = stored(funnel.watch(segments.dedup(rare), STAGES[5]), "chain-told")
    merged = segments.merge(speech.select(*segments.COLUMNS), told)
    out = stored(funnel.watch(merged, STAGES[6], F.col("source").isin(ON_SCREEN, BOTH)), "chain-merged")
    dropped(fits, rare, told)
    return out, funnel
