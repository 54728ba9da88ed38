"""Scores of result cards: raw rates by task to scores above chance, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import above_chance

# The number of answers to choose from, by task of the "bbh" group.
BBH_CHOICES = {
    "boolean_expressions": 2, "causal_judgement": 2, "date_understanding": 6, "disambiguation_qa": 3, "formal_fallacies": 2, "geometric_shapes": 11,
    "hyperbaton": 2, "logical_deduction_five_objects": 5, "logical_deduction_seven_objects": 7, "logical_deduction_three_objects": 3, "movie_recommendation": 6,
    "navigate": 2, "object_counting": 19, "penguins_in_a_table": 5, "reasoning_about_colored_objects": 18, "ruin_names": 6,
    "salient_translation_error_detection": 6, "snarks": 2, "sports_understanding": 2, "temporal_sequences": 4, "tracking_shuffled_objects_five_objects": 5,
    "tracking_shuffled_objects_seven_objects": 7, "tracking_shuffled_objects_three_objects": 3, "web_of_lies": 2,
}
# The tasks and metrics that make up each score, with the rate that guessing gives.
PARTS = [
    ("ifeval", "ifeval", "prompt_level_strict_acc,none", 0.0), ("ifeval", "ifeval", "inst_level_strict_acc,none", 0.0),
    ("gpqa", "gpqa", "acc_norm,none", 0.25), ("mmlu_pro", "mmlu_pro", "acc,none", 0.1),
    ("musr", "musr_murder_mysteries", "acc_norm,none", 1 / 2), ("musr", "musr_object_placements", "acc_norm,none", 1 / 5), ("musr", "musr_team_allocation", "acc_norm,none", 1 / 3),
    *[("bbh", f"bbh_{task}", "acc_norm,none", 1 / n) for task, n in BBH_CHOICES.items()],
]
SCORES = ["ifeval", "bbh", "gpqa", "musr", "mmlu_pro"]


def card_scores(results: DataFrame, by: str, prefix: str = "leaderboard_") -> DataFrame:
    """results: by, task, metric, value. A row for each card: by, and its scores from 0 to 100.

    A score is the mean of its parts, each above its own chance level and clipped at 0; it is null
    unless every part has a value. Of repeated results the greatest counts. Other tasks are not used.
    """
    parts = results.sparkSession.createDataFrame([(s, prefix + t, m, c) for s, t, m, c in PARTS], "score string, task string, metric string, chance double")
    scaled = results.join(F.broadcast(parts), ["task", "metric"]).groupBy(by, "score", "task", "metric", "chance").agg(F.max("value").alias("value"))
    needed = {s: sum(p[0] == s for p in PARTS) for s in SCORES}

    def score(name: str) -> Column:
        mine = F.when(F.col("score") == name, above_chance(F.col("value"), F.col("chance")))
        return F.when(F.count(F.when(F.col("score") == name, F.col("value"))) == needed[name], F.avg(mine)).alias(name)

    return scaled.groupBy(by).agg(*[score(s) for s in SCORES])


def row_mean(*scores: Column) -> Column:
    """The mean of columns; null where one of them is."""
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return total / len(scores)
