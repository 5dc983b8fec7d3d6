"""Teams and roles of tracks: clusters of kit features, votes, referees and keepers by evidence, and whom a keeper stands with."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import quantiles


@dataclass(frozen=True)
class TeamRules:
    """Sample, votes and thresholds; the defaults are fixed values."""

    #: Crops of a video that fit its clusters, by the least hash of their key; a documented bound.
    sample: int = 600
    components: int = 32
    starts: int = 20
    min_votes: int = 3
    min_share: float = 0.6
    weak: float = 0.15
    referee_share: float = 0.55
    referee_frames: int = 15
    referee_veto: float = 0.70
    referee_kit: float = 1.15
    referee_dominant: float = 0.85
    referee_abstain: float = 0.40
    keeper_share: float = 0.40
    keeper_frames: int = 12
    keeper_distance: float = 30.0
    keeper_samples: int = 8
    keepers: int = 2
    keeper_neighbours: int = 3
    keeper_prior: float = 0.5
    keeper_margin: float = 0.05
    pitch_length: float = 105.0
    min_calibration: float = 0.5


#: Crops are handed to a task until they are about this many.
BATCH_CROPS = 20_000


def two_means(x: np.ndarray, starts: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, labels) of the best of several two-means runs, each started from a point and one drawn by squared distance."""
    rng = np.random.default_rng(seed)
    best, kept = np.inf, None
    for _ in range(starts):
        first = x[rng.integers(len(x))]
        away = ((x - first) ** 2).sum(1)
        second = x[rng.choice(len(x), p=away / away.sum())] if away.sum() > 0 else first
        c = np.stack([first, second])
        for _ in range(100):
            label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            now = np.stack([x[label == k].mean(0) if (label == k).any() else c[k] for k in (0, 1)])
            if np.allclose(now, c, rtol=0, atol=1e-12):
                break
            c = now
        loss = ((x - c[label]) ** 2).sum()
        if loss < best - 1e-12:
            best, kept = loss, (c, label)
    return kept


def silhouette(x: np.ndarray, label: np.ndarray) -> float | None:
    """Mean silhouette of two clusters; null when one is empty."""
    if not 0 < label.sum() < len(label):
        return None
    d = np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(2)))
    scores = np.zeros(len(x))
    for i in range(len(x)):
        own, other = label == label[i], label != label[i]
        if own.sum() > 1:
            a, b = d[i, own].sum() / (own.sum() - 1), d[i, other].mean()
            scores[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return float(scores.mean())


def fit_teams(crops: DataFrame, by: list[str], rules: TeamRules = TeamRules()) -> DataFrame:
    """(by, n_fitted, separation, weak, mean, axes, centroids): two kit clusters of each video, in a space of few principal axes.

    crops: by + track_id, frame, feature (array). A bounded sample fits; zero and null features take no part, and a video with
    fewer than four times min_votes usable ones has no model. Cluster 0 is the one whose centroid comes first on the first axis.
    """
    usable = crops.where(F.exists(F.col("feature"), lambda v: v != 0))
    w = Window.partitionBy(*by).orderBy(F.xxhash64("track_id", "frame"), "track_id", "frame")
    sample = usable.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= rules.sample).select(*by, "track_id", "frame", F.col("feature").cast("array<double>").alias("feature"))
    types = dict(crops.dtypes)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "n_fitted", "separation", "weak", "mean", "axes", "centroids"]
        if len(group) < rules.min_votes * 4:
            return pd.DataFrame([], columns=names)
        x = np.stack(group.sort_values(["track_id", "frame"])["feature"].to_list())
        mean = x.mean(0)
        _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
        axes = axes[: min(rules.components, len(x) - 1, x.shape[1])]
        axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
        z = (x - mean) @ axes.T
        c, label = two_means(z, rules.starts)
        if tuple(c[1]) < tuple(c[0]):
            c, label = c[::-1], 1 - label
        apart = silhouette(z, label)
        return pd.DataFrame([(*key, len(x), apart, apart is not None and apart < rules.weak, mean.tolist(), axes.reshape(-1).tolist(), c.reshape(-1).tolist())], columns=names)

    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "n_fitted long, separation double, weak boolean, mean array<double>, axes array<double>, centroids array<double>"])
    return sample.groupBy(*by).applyInPandas(run, schema)


def predict_teams(crops: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """(by, track_id, frame, label, confidence, distance): the nearer cluster of each crop, how much nearer, and how far it is.

    Confidence is (far - near) / (far + near). A video's crops are dealt over tasks of about BATCH_CROPS, each with the video's
    one model; crops of a video without a model are left out, as are null features.
    """
    sizes = crops.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BATCH_CROPS)).cast("int").alias("__parts"))
    dealt = crops.where("feature is not null").join(sizes, by).select(*by, "track_id", "frame", F.col("feature").cast("array<double>").alias("feature"), F.pmod(F.xxhash64("track_id", "frame"), "__parts").cast("int").alias("__part"))
    models = model.join(sizes, by).select(*by, "mean", "axes", "centroids", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    types = dict(crops.dtypes)
    names = [*by, "track_id", "frame", "label", "confidence", "distance"]

    def run(key: tuple, rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(fitted):
            return pd.DataFrame([], columns=names)
        m = fitted.iloc[0]
        mean = np.asarray(m["mean"])
        axes = np.asarray(m["axes"]).reshape(-1, len(mean))
        z = (np.stack(rows["feature"].to_list()) - mean) @ axes.T
        d = np.sqrt(((z[:, None] - np.asarray(m["centroids"]).reshape(2, -1)[None]) ** 2).sum(2))
        near, far = d.min(1), d.max(1)
        out = rows[[*by, "track_id", "frame"]].copy()
        out["label"], out["confidence"], out["distance"] = d.argmin(1), np.where(near + far > 0, (far - near) / np.where(near + far > 0, near + far, 1), 0.0), near
        return out

    schema = ", ".join([*(f"{c} {types[c]}" for c in (*by, "track_id", "frame")), "label int, confidence double, distance double"])
    return dealt.groupBy(*by, "__part").cogroup(models.groupBy(*by, "__part")).applyInPandas(run, schema)


def vote_teams(predicted: DataFrame, by: list[str], rules: TeamRules = TeamRules()) -> DataFrame:
    """(by, track_id, team_id, team_confidence, kit_distance, n_crops): the votes of a track's crops, weighted by confidence.

    With fewer than min_votes crops the team is unknown with confidence 0; with less than min_share of the weight it is
    unknown with that share. A tie goes to A.
    """
    weight = lambda k: F.sum(F.when(F.col("label") == k, F.col("confidence")).otherwise(0.0))
    t = predicted.groupBy(*by, "track_id").agg(weight(0).alias("a"), weight(1).alias("b"), F.median("distance").alias("kit_distance"), F.count("*").alias("n_crops"))
    total = F.col("a") + F.col("b")
    share = F.when(total > 0, F.greatest("a", "b") / total).otherwise(0.0)
    few = F.col("n_crops") < rules.min_votes
    team = F.when(few | (share < rules.min_share) | (total <= 0), "unknown").when(F.col("a") >= F.col("b"), "A").otherwise("B")
    return t.select(*by, "track_id", team.alias("team_id"), F.when(few, 0.0).otherwise(share).alias("team_confidence"), F.when(~few, F.col("kit_distance")).alias("kit_distance"), "n_crops")


def resolve_roles(tracks: DataFrame, by: list[str], samples: DataFrame | None = None, rules: TeamRules = TeamRules()) -> DataFrame:
    """tracks with role, role_confidence, the resolved team_id and team_confidence, and `decision`, the rule that settled it.

    tracks: by + track_id, object_class, length, team_id, team_confidence, kit_distance, and the weight and number of the
    detector's referee, goalkeeper and all votes: referee_weight, referee_frames, keeper_weight, keeper_frames, weight. samples: by +
    track_id, x, a track's calibrated places along the pitch. A referee needs a share of votes and frames, and a kit that fits no
    team (against the median of the video's tracks) or overwhelming votes; a keeper needs votes and a median place near a goal,
    and a team keeps its longest `keepers`, ties to the nearer. Doubtful tracks are unknown, not guessed.
    """
    kits = quantiles(tracks.where("kit_distance is not null"), by, "kit_distance", [0.5]).select(*by, F.col("quantile").alias("__kit"))
    rows = tracks.join(kits, by, "left")
    share = lambda c: F.when(F.col("weight") > 0, F.col(f"{c}_weight") / F.col("weight")).otherwise(0.0)
    referee, keeper = share("referee"), share("keeper")
    has_team = F.col("team_id").isin("A", "B")
    kit = F.when(F.col("__kit") > 0, F.col("kit_distance") / F.col("__kit"))
    weak = (referee < rules.referee_share) | (F.col("referee_frames") < rules.referee_frames)
    split = (F.col("referee_frames") >= rules.referee_frames) & (referee >= rules.referee_abstain)
    odd = F.coalesce(kit >= rules.referee_kit, F.lit(False)) | (referee >= rules.referee_dominant)
    veto = has_team & (F.col("team_confidence") >= rules.referee_veto)
    decision = (
        F.when(F.col("object_class") == "ball", "ball").when(weak & split, "split_referee_vote").when(weak & (F.col("referee_frames") > 0), "weak_referee_vote").when(weak, "player")
        .when(odd, "referee").when(veto, "team_veto").otherwise("referee_kit_fits")
    )
    rows = rows.withColumn("decision", decision).withColumn("__player", F.col("decision").isin("weak_referee_vote", "player", "team_veto"))
    places = None
    if samples is not None:
        places = samples.where("x is not null").groupBy(*by, "track_id").agg(F.median("x").alias("__x"), F.count("*").alias("__n"))
        rows = rows.join(places, [*by, "track_id"], "left")
    else:
        rows = rows.withColumns({"__x": F.lit(None).cast("double"), "__n": F.lit(0)})
    goal = F.least(F.col("__x"), rules.pitch_length - F.col("__x"))
    called = F.col("__player") & (F.col("keeper_frames") > 0)
    voted = (keeper >= rules.keeper_share) & (F.col("keeper_frames") >= rules.keeper_frames)
    placed = (F.coalesce("__n", F.lit(0)) >= rules.keeper_samples) & (goal <= rules.keeper_distance)
    standing = F.when(called & voted & F.coalesce(placed, F.lit(False)), True)
    rows = rows.withColumn("__standing", standing).withColumn("__goal", goal)
    rank = F.row_number().over(Window.partitionBy(*by, "team_id", "__standing").orderBy(F.desc("length"), "__goal", "track_id"))
    rows = rows.withColumn("__rank", F.when(F.col("__standing"), rank))
    final = (
        F.when(called & ~voted, "keeper_weak_vote").when(called & F.col("__standing").isNull(), "keeper_position").when(F.col("__rank") > rules.keepers, "keeper_surplus")
        .when(F.col("__rank") <= rules.keepers, "goalkeeper").otherwise(F.col("decision"))
    )
    player = F.col("__player")
    doubtful = F.col("decision").isin("split_referee_vote", "referee_kit_fits")
    role = F.when(F.col("decision") == "ball", "ball").when(F.col("decision") == "referee", "referee").when(doubtful, "unknown").when(F.col("__rank") <= rules.keepers, "goalkeeper").otherwise("outfield")
    sure = (
        F.when(F.col("decision") == "ball", 1.0).when(F.col("decision") == "referee", referee).when(doubtful, 0.0).when(F.col("__rank") <= rules.keepers, F.least(F.lit(1.0), keeper + 0.2))
        .when(has_team, 0.8).otherwise(0.4)
    )
    lost = (F.col("decision") == "split_referee_vote") | ((F.col("decision") == "referee_kit_fits") & ~has_team) | (player & (F.col("team_id") == "none"))
    team = F.when(F.col("decision").isin("ball", "referee"), "none").when(lost, "unknown").otherwise(F.col("team_id"))
    team_sure = F.when(F.col("decision") == "referee", 1.0).when((F.col("decision") == "split_referee_vote") | (player & (F.col("team_id") == "none")), 0.0).otherwise(F.col("team_confidence"))
    kept = [c for c in tracks.columns if c not in ("team_id", "team_confidence")]
    return rows.select(*kept, team.alias("team_id"), team_sure.alias("team_confidence"), role.alias("role"), sure.alias("role_confidence"), final.alias("decision"))


def keeper_teams(people: DataFrame, keepers: DataFrame, by: list[str], rules: TeamRules = TeamRules()) -> DataFrame:
    """(by, track_id, team_id, team_confidence, side, distance_a, distance_b): the team that a keeper stands with.

    people: by + frame, x, y, team_id of outfield players on the pitch; keepers: by + track_id, frame, x, y, team_id,
    team_confidence. In each frame the mean distance to the nearest few of either team counts, and its mean over the frames. A
    keeper whose own kit vote was sure keeps it; where the two means are close the team is unknown; without players too.
    """
    near = people.where(F.col("team_id").isin("A", "B") & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*by, "frame", F.col("team_id").alias("team"), F.col("x").alias("px"), F.col("y").alias("py"))
    own = keepers.where("x is not null and y is not null").select(*by, "track_id", "frame", "x", "y")
    pairs = own.join(near, [*by, "frame"]).groupBy(*by, "track_id", "frame", "team").agg(F.array_sort(F.collect_list(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))).alias("d"))
    few = F.slice("d", 1, rules.keeper_neighbours)
    each = pairs.select(*by, "track_id", "team", (F.aggregate(few, F.lit(0.0), lambda s, v: s + v) / F.size(few)).alias("mean"))
    sums = each.groupBy(*by, "track_id").agg(F.avg(F.when(F.col("team") == "A", F.col("mean"))).alias("distance_a"), F.avg(F.when(F.col("team") == "B", F.col("mean"))).alias("distance_b"))
    whole = keepers.groupBy(*by, "track_id").agg(F.avg("x").alias("mean_x"), F.max("team_id").alias("own"), F.max("team_confidence").alias("own_sure")).join(sums, [*by, "track_id"], "left")
    a, b = (F.coalesce(c, F.lit(float("inf"))) for c in ("distance_a", "distance_b"))
    far, close = F.greatest(a, b), F.least(a, b)
    inf = F.lit(float("inf"))
    margin = F.when((far < inf) & (far > 0), (far - close) / far).otherwise(0.0)
    prior = F.coalesce(F.col("own").isin("A", "B") & (F.col("own_sure") >= rules.keeper_prior), F.lit(False))
    none = (a == inf) & (b == inf)
    team = F.when(none, "unknown").when(prior, F.col("own")).when(margin < rules.keeper_margin, "unknown").when(a <= b, "A").otherwise("B")
    sure = F.when(none, 0.0).when(prior, F.col("own_sure")).when(margin < rules.keeper_margin, margin).otherwise(F.least(F.lit(1.0), margin * 4))
    side = F.when(F.col("mean_x") < rules.pitch_length / 2, "left").when(F.col("mean_x").isNotNull(), "right")
    return whole.select(*by, "track_id", team.alias("team_id"), sure.alias("team_confidence"), side.alias("side"), "distance_a", "distance_b")
