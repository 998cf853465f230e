"""A whole linkage run: candidates, pruning, features, stacked models, the choice of a rule, and the result lists.

Every step is a table, stored under ``work`` where the configuration names one and as a checkpoint else; a stored step is
read instead of computed again. Every score that a later step sees comes from models that saw no row of the same S1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlink.operators import blocking, decide, features, metric, models, prepare, sampling
from loomlink.session import cut
from loomlink.sources import files
from loomlink.sources.files import LinkConfig

STAGE1 = [f"blk_{r}_{x}" for r in blocking.RETRIEVERS for x in ("rank", "score")] + ["blk_n_hits", "s1_n_cands", "s1_rank_best", "s1_gap_best"]
_KEYS = {"s1", "rid", "label", "fold", "country", "keep", "weight"}
_INNER = 11


def build_candidates(records: DataFrame, config: LinkConfig) -> DataFrame:
    """Candidates of the S1s that the configuration takes: a fraction by hash, or with ``rest`` the others. All records are searched."""
    mine = records
    if config.fraction < 1 or config.rest:
        listed = records.where("src = 1")
        listed = (sampling.sample_rest if config.rest else sampling.sample_fraction)(listed, "gid", config.fraction, config.seed)
        mine = records.where("src <> 1").unionByName(listed)
    return blocking.retrieve(mine, config.retrievers)


class Run:
    """A run over ``train`` and ``test`` records ``(gid, entity_id, name, ..., as prepared)``, labelled by ``truth(s1, rid)`` of gids for the S1s of ``labelled(s1)``.

    ``cands`` may bring candidates of an earlier search; ``scorer`` may add the logits ``(s1, rid, ce)`` of another model of
    pairs ``(s1, rid)``, as a cross-encoder; without one they are missing.
    """

    def __init__(self, spark: SparkSession, config: LinkConfig, train: DataFrame, test: DataFrame, truth: DataFrame, labelled: DataFrame, cands: dict[str, DataFrame] | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.config, self.records, self.truth, self.labelled = spark, config, {"train": train, "test": test}, truth, labelled
        self.cands, self.scorer, self.fitted = cands or {}, scorer, {}

    @classmethod
    def from_lists(cls, spark: SparkSession, config: LinkConfig, scorer=None) -> Run:
        """A run over the tab-separated lists of the folder ``data``."""
        raw = {s: files.union_sources([files.read_tsv(spark, config.source(s, i)) for i in (1, 2, 3)]) for s in ("train", "test")}
        lists = spark.read.csv(config.truth(), sep="\t", header=True, schema="source1_entity_id string, matched_entity_ids string", quote="", escape="")
        pairs = files.truth_pairs(lists)
        table = cut(prepare.romanisation(raw["train"], pairs))
        ready = {s: files.cached(spark, config.step(f"{s}_prepared"), lambda s=s: prepare.prepared(raw[s], table), ("country",)) for s in raw}
        ids = ready["train"].select("gid", "entity_id")
        a, b = ids.select(F.col("entity_id").alias("s1"), F.col("gid").alias("g1")), ids.select(F.col("entity_id").alias("rid"), F.col("gid").alias("g2"))
        truth = pairs.join(a, "s1").join(b, "rid").select(F.col("g1").alias("s1"), F.col("g2").alias("rid"))
        labelled = lists.select(F.col("source1_entity_id").alias("s1")).join(a, "s1").select(F.col("g1").alias("s1")).distinct()
        return cls(spark, config, ready["train"], ready["test"], truth, labelled, scorer=scorer)

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return files.cached(self.spark, self.config.step(name), build) if self.config.work else cut(build())

    def keep(self, name: str, fitted: list, columns: list[str]) -> None:
        self.fitted[name] = ([m for m in fitted if m is not None], columns)
        if self.config.work:
            models.save_models(self.spark, self.fitted[name][0], columns, self.config.step(f"models/{name}"))

    def models(self, name: str) -> tuple[list, list[str]]:
        """The models of a stage, from this run or an earlier one that stored them."""
        if name not in self.fitted:
            self.fitted[name] = models.load_models(self.spark, self.config.step(f"models/{name}"))
        return self.fitted[name]

    def wide(self, split: str) -> DataFrame:
        def build() -> DataFrame:
            cands = self.cands.get(split)
            w = blocking.with_competition(blocking.union_wide(cands if cands is not None else build_candidates(self.records[split], self.config)))
            return w if split == "test" else w.join(self.labelled, "s1", "left_semi").join(self.truth.select("s1", "rid", F.lit(1).alias("label")), ["s1", "rid"], "left").fillna(0, ["label"])

        return self.step(f"{split}_wide", build)

    def pruned(self, split: str) -> DataFrame:
        """The best candidates of each S1 by the first model, ``p1``: of train out of fold, of test by the model of all folds."""

        def train() -> DataFrame:
            rows = self.wide("train").withColumn("keep", sampling.key_hash("s1", self.config.seed + 1) % 1000 < int(1000 * self.config.stage1_share)).withColumn("weight", F.lit(1.0))
            scored, _, rounds = models.cross_validate(rows, STAGE1, self.config.folds, self.config.seed, 1, self.config.kind, self.config.rounds, False, "p1")
            self.keep("stage1", [models.final_fit(rows, STAGE1, rounds, self.config.kind)], STAGE1)
            return models.prune(rows.drop("keep", "weight").join(scored, ["s1", "rid"]), self.config.top, "p1")

        if split == "train":
            return self.step("train_pruned", train)
        self.pruned("train")
        return self.step("test_pruned", lambda: models.prune(models.apply_models(*self._with(self.wide("test"), "stage1"), "p1"), self.config.top, "p1"))

    def _with(self, df: DataFrame, stage: str) -> tuple:
        fitted, columns = self.models(stage)
        return fitted, df, columns

    def features(self, split: str) -> DataFrame:
        """The pruned pairs with all features of the pair."""

        def build() -> DataFrame:
            pairs, records = self.pruned(split), self.records[split]
            if self.config.cut > 0:
                pairs = decide.cut_candidates(pairs, pairs, self.config.cut)
            df = features.pair_features(pairs, records)
            return df.join(features.finer_pair_features(pairs, features.record_columns(records)), ["s1", "rid"])

        return self.step(f"{split}_features", build)

    def _thinned(self, df: DataFrame, p: str) -> DataFrame:
        """Of the easy negatives one in ten is fitted on, with ten times the weight."""
        easy = (F.col("label") == 0) & (F.col(p) < 0.001)
        return df.withColumn("keep", ~easy | (F.pmod(F.xxhash64(F.lit(self.config.seed), "s1", "rid"), F.lit(10)) == 0)).withColumn("weight", F.when(easy, 10.0).otherwise(1.0))

    def _stage(self, name: str, rows: DataFrame, columns: list[str], fold_seed: int, average: bool) -> DataFrame:
        c = self.config
        scored, fitted, rounds = models.cross_validate(rows, columns, c.folds, fold_seed, c.seeds, c.kind, c.rounds, c.stop_early)
        self.keep(name, fitted if average else [models.final_fit(rows, columns, rounds, c.kind)], columns)
        return scored.join(rows.select("s1", "rid", "label"), ["s1", "rid"])

    def scores(self, split: str, stage: int = 4) -> DataFrame:
        """``s1, rid, p`` (of train also ``label``) of stage 2, 3 or 4: features alone, then with the context of stage 2's, then of stage 3's scores."""
        if split == "train":
            return self.step(f"train_scores{stage}", lambda: self._train(stage))
        self.scores("train", stage)
        frame = self.features("test") if stage == 2 else self.frame("test", stage)
        return self.step(f"test_scores{stage}", lambda: models.apply_models(*self._with(frame, f"stage{stage}")).select("s1", "rid", "p") if stage == 2 else models.apply_models(*self._with(frame, f"stage{stage}"), "p_out").select("s1", "rid", F.col("p_out").alias("p")))

    def _train(self, stage: int) -> DataFrame:
        if stage == 2:
            rows = self._thinned(self.features("train"), "p1")
            columns = [c for c in rows.columns if c not in _KEYS and not c.startswith("_")]
            return self._stage("stage2", rows, columns, self.config.seed, False)
        rows = self.frame("train", stage)
        return self._stage(f"stage{stage}", self._thinned(rows, "p" if stage == 3 else "p_s2"), features.stack_features(stage), self.config.seed + _INNER, True)

    def frame(self, split: str, stage: int) -> DataFrame:
        """What a stacked model sees: the context of the stage before, and the first features."""

        def build() -> DataFrame:
            before = self.scores(split, stage - 1).select("s1", "rid", "p")
            band = before.where(features.in_band("p", features.IDF_BAND)).select("s1", "rid")
            ce = self.scorer(band) if self.scorer else band.select("s1", "rid", F.lit(None).cast("double").alias("ce"))
            extra = self.features(split).select("s1", "rid", *features.STACK_BASE, *(["label"] if split == "train" else []))
            df = features.stack_frame(before, self.records[split], extra, ce)
            return df if stage == 3 else df.join(self.scores(split, 2).select("s1", "rid", F.col("p").alias("p_s2")), ["s1", "rid"], "left")

        return self.step(f"{split}_frame{stage}", build)

    @cached_property
    def scored_s1(self) -> DataFrame:
        country = self.records["train"].select(F.col("gid").alias("s1"), "country")
        return cut(self.labelled.join(country, "s1"))

    def evaluate(self, stage: int = 4) -> DataFrame:
        """``rule, macro_f05, mixed_f05, n_pred`` of each rule on the out-of-fold scores."""
        mix = self.config.mix or {r["country"]: float(r["n"]) for r in self.scored_s1.groupBy("country").agg(F.count(F.lit(1)).alias("n")).collect()}
        results = self.step(f"metrics{stage}", lambda: decide.sweep_rules(self.scores("train", stage), self.truth, self.scored_s1, self.config.rules, mix))
        if self.config.out:
            files.write_metrics(results, self.config.result(f"metrics{stage}"))
        return results

    def report(self, stage: int = 4) -> DataFrame:
        """The report by country and number of matches under the chosen rule."""
        pred = decide.apply_rule(self.scores("train", stage), self.rule(stage), self.scored_s1)
        return metric.report(metric.per_entity_f05(pred, self.truth, self.scored_s1), self.scored_s1)

    def rule(self, stage: int = 4) -> str:
        return self.config.rule or decide.best_rule(self.evaluate(stage))

    def predict(self, stage: int = 4) -> DataFrame:
        """``s1, rid`` of test by the chosen rule; where the configuration names a folder ``out``, the lists of matches and candidates are written there."""
        records = self.records["test"]
        country = records.select(F.col("gid").alias("s1"), "country")
        scores = self.scores("test", stage).join(country, "s1")
        if self.config.base:
            scores = decide.merge_by_country(scores, self.spark.read.parquet(self.config.base).join(country, "s1").select(*scores.columns), self.config.countries)
        pairs = self.step("matches", lambda: decide.apply_rule(scores.drop("country"), self.rule(stage), country))
        if self.config.out:
            all_s1 = records.where("src = 1").select(F.col("entity_id").alias("s1"))
            files.write_tsv(files.id_lists(files.to_entity_ids(pairs, records), all_s1), self.config.result("matching_results"))
            files.write_tsv(files.id_lists(files.to_entity_ids(scores, records), all_s1, "candidate_entity_ids"), self.config.result("candidate_pairs"))
        return pairs
