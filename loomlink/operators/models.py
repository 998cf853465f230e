"""Scoring models: out-of-fold scores, pruning, pseudo-labels, stacking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlink.operators.decide import one_owner
from loomlink.operators.sampling import fold, top_per_group
from loomlink.session import cut


def with_indicators(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Missing features as -1 with an indicator each; the trees take no NULL."""
    out = {}
    for f in features:
        missing = F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
        out[f"x_{f}"] = F.when(missing, -1.0).otherwise(F.col(f).cast("double"))
        out[f"m_{f}"] = missing.cast("double")
    return df.withColumns(out), list(out)


def estimator(columns: list[str], kind: str = "gbt", seed: int = 0, **more) -> Pipeline:
    """Assembler and classifier: boosted trees (``gbt``) or logistic regression (``lr``)."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    model = GBTClassifier(**common, **({"maxIter": 20, "maxDepth": 5, "subsamplingRate": 0.8, "seed": seed} | more)) if kind == "gbt" else LogisticRegression(**common, **({"regParam": 1e-3} | more))
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), model])


def probability(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    keep = df.columns
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def oof_score(df: DataFrame, features: list[str], out: str = "p", k: int = 3, seed: int = 0, kind: str = "gbt", **more) -> tuple[DataFrame, list[PipelineModel]]:
    """``df`` with a score of a model that saw no row of the same S1's fold, and the fold models. Needs ``s1, rid, label``."""
    if "weight" not in df.columns:
        df = df.withColumn("weight", F.lit(1.0))
    rows, columns = with_indicators(df.withColumn("fold", fold("s1", k, seed)), features)
    scored, models = None, []
    seen = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).collect()}
    for i in range(k):
        n, true = (sum(r[c] for f, r in seen.items() if f != i) for c in ("n", "t"))
        mine = rows.where(F.col("fold") == i)
        if 0 < true < n:
            model = estimator(columns, kind, seed, **more).fit(rows.where(F.col("fold") != i))
            part, models = probability(model, mine, out), [*models, model]
        else:
            # Without both kinds of label the other folds only give their mean.
            part = mine.withColumn(out, F.lit(float(true) / n if n else 0.0))
        scored = part if scored is None else scored.unionByName(part)
    return scored.drop(*columns), models


def fold_average(models: list[PipelineModel], df: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    """The mean of the fold models' probabilities, for rows that none was trained on."""
    rows, columns = with_indicators(df, features)
    for i, m in enumerate(models):
        rows = probability(m, rows, f"_p{i}")
    if not models:
        return df.withColumn(out, F.lit(0.0))
    mean = sum((F.col(f"_p{i}") for i in range(1, len(models))), F.col("_p0")) / len(models)
    return rows.withColumn(out, mean).drop(*columns, *(f"_p{i}" for i in range(len(models))))


def prune(df: DataFrame, top: int = 25, p: str = "p") -> DataFrame:
    """Each S1's best ``top`` candidates."""
    return top_per_group(df, "s1", p, "rid", top)


def pseudo_label(df: DataFrame, countries: list[str], high: float = 0.97, low: float = 0.03) -> DataFrame:
    """Sure pairs of the ``countries`` with a label: winners of their record at ``high`` and more, and all at ``low`` and less."""
    rows = df.where(F.col("country").isin(countries)).drop("label")
    sure = one_owner(rows).where(F.col("p") >= high).withColumn("label", F.lit(1))
    return sure.unionByName(rows.where(F.col("p") <= low).withColumn("label", F.lit(0)))


def self_train(labelled: DataFrame, unlabelled: DataFrame, features: list[str], countries: list[str], rounds: int = 2, **more) -> DataFrame:
    """``unlabelled`` scored by a model that is fitted again with its own sure pairs, ``rounds`` times."""
    labelled, columns = with_indicators(labelled.withColumn("weight", F.lit(1.0)), features)
    rows, _ = with_indicators(unlabelled.withColumn("weight", F.lit(1.0)), features)
    scored = probability(estimator(columns, **more).fit(labelled), rows)
    for _ in range(rounds):
        extra = pseudo_label(scored, countries)
        both = labelled.select("label", "weight", *columns).unionByName(extra.select("label", "weight", *columns))
        scored = probability(estimator(columns, **more).fit(both), rows)
    return scored.drop(*columns, "weight")


def combine_scores(parts: list[DataFrame], out: str = "ce") -> DataFrame:
    """The mean of the scores that the parts hold for a pair; a pair may be missing in some."""
    both = parts[0].select("s1", "rid", F.col(out).alias("_c"))
    for p in parts[1:]:
        both = both.unionByName(p.select("s1", "rid", F.col(out).alias("_c")))
    return both.groupBy("s1", "rid").agg(F.avg("_c").alias(out))


def pair_text(df: DataFrame, name: str, addr: str) -> DataFrame:
    return df.withColumn("text", F.concat(F.lit("name: "), F.col(name), F.lit(" address: "), F.col(addr)))


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]], out: str = "ce") -> DataFrame:
    """``s1, rid, out`` of ``pairs(s1, rid, text_a, text_b)`` by any batch scorer; ``load`` runs once in each task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for df in batches:
            yield pd.DataFrame({"s1": df["s1"], "rid": df["rid"], out: scorer(df["text_a"], df["text_b"])})

    return pairs.select("s1", "rid", "text_a", "text_b").mapInPandas(work, f"s1 bigint, rid bigint, {out} double")


def fit(df: DataFrame, columns: list[str], kind: str = "gbt", seed: int = 0, rounds: int = 20, valid: str | None = None) -> tuple[PipelineModel, int]:
    """A model fitted on ``columns``, and its rounds of boosting; with a boolean column ``valid`` boosting stops when those rows get no better."""
    if kind != "gbt":
        return estimator(columns, kind, seed).fit(df.where(~F.col(valid)) if valid else df), rounds
    more = {"maxIter": rounds} | ({"validationIndicatorCol": valid} if valid else {})
    model = estimator(columns, kind, seed, **more).fit(df)
    return model, model.stages[-1].getNumTrees


def cross_validate(df: DataFrame, features: list[str], k: int = 3, fold_seed: int = 0, seeds: int = 1, kind: str = "gbt", rounds: int = 20, stop_early: bool = True, out: str = "p") -> tuple[DataFrame, list[PipelineModel], int]:
    """``s1, rid, out`` out of fold, the fold models of every seed, and their mean rounds.

    ``df(s1, rid, label, keep, weight, ...)``: only rows to ``keep`` are fitted on, all are scored. Within a fold the models
    of the seeds are averaged. Without both kinds of label elsewhere a fold gets the share of matches there.
    """
    rows, columns = with_indicators(df.withColumn("_fold", fold("s1", k, fold_seed)), features)
    rows = cut(rows.select("s1", "rid", "label", "keep", "weight", "_fold", *columns))
    seen = {r["_fold"]: (r["n"], r["t"]) for r in rows.where("keep").groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).collect()}
    scored, fitted, used = None, [], []
    for i in range(k):
        n, true = (sum(v[c] for f, v in seen.items() if f != i) for c in (0, 1))
        part = rows.where(F.col("_fold") == i)
        if 0 < true < n:
            ours = []
            for s in range(seeds):
                model, trees = fit(rows.where("keep").withColumn("_valid", F.col("_fold") == i) if stop_early else rows.where(F.col("keep") & (F.col("_fold") != i)), columns, kind, s, rounds, "_valid" if stop_early else None)
                ours.append(model)
                used.append(trees)
                part = probability(model, part, f"_s{s}")
            fitted += ours
            part = part.withColumn(out, sum((F.col(f"_s{s}") for s in range(1, seeds)), F.col("_s0")) / seeds)
        else:
            part = part.withColumn(out, F.lit(float(true) / n if n else 0.0))
        part = part.select("s1", "rid", out)
        scored = part if scored is None else scored.unionByName(part)
    return scored, fitted, round(sum(used) / len(used)) if used else rounds


def final_fit(df: DataFrame, features: list[str], rounds: int, kind: str = "gbt", seed: int = 0) -> PipelineModel | None:
    """A model of all rows to ``keep``, a tenth more rounds than the folds took; None without both kinds of label."""
    rows, columns = with_indicators(df.where("keep"), features)
    n, true = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    return fit(rows, columns, kind, seed, max(1, round(1.1 * rounds)))[0] if true and true < n else None


def apply_models(fitted: list[PipelineModel], df: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    return fold_average([m for m in fitted if m is not None], df, features, out)


def save_models(spark, fitted: list[PipelineModel], features: list[str], path: str) -> None:
    """The models and the list of their features, so that they can score elsewhere."""
    for i, m in enumerate(fitted):
        m.write().overwrite().save(f"{path}/model_{i}")
    spark.createDataFrame([(len(fitted), features)], "n int, features array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load_models(spark, path: str) -> tuple[list[PipelineModel], list[str]]:
    row = spark.read.schema("n int, features array<string>").json(f"{path}/features").first()
    return [PipelineModel.load(f"{path}/model_{i}") for i in range(row["n"])], list(row["features"])
