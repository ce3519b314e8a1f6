"""Cross-validated ablation study: 7 feature sets x 7 models x (k folds + refit).

Data flow
---------
1. ``document_study_table``: documents joined to labels (structured
   measurements, two text columns, binary label), exact stratified split and
   folds (deterministic, partition-independent).
2. ``prepare_features``: text encoder (and PCA in the optimised study) and the
   z-score scaler. With ``fit_scope='fold'`` (default) every fold has a feature
   table of its own, fitted without the held-out rows; with ``'train'`` (the
   reference's choice) one table is fitted on the whole training split. Each
   table is written once and read by all (feature set, model) jobs.
3. The linear models (LR, SGD) and the networks (ANN, NN) of a set are fitted for
   all folds and the refit together, one pass over the rows a step
   (``operators.foldfit``, ``operators.network``). Every
   other (feature set, model) job fits k fold models plus a refit; the fold
   pipeline holds the median imputer fitted on the fold's training rows only.
   Jobs run concurrently from a small driver thread pool; every fit writes its
   predictions to its own folder, so a rerun skips finished work (resume) and
   a retried task cannot duplicate rows.
4. Metrics come from the predictions table in grouped aggregates.
"""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import balance as BA
from cohortkit.operators import evaluate as EV
from cohortkit.operators import features as FE
from cohortkit.operators import foldfit as FF
from cohortkit.operators import network as NN
from cohortkit.operators import reduce as RD
from cohortkit.operators import split as S
from cohortkit.operators import text as TX
from cohortkit.operators.models import (BASE, OPTIMISED, RFF_COMPONENTS, SVM_MAX_ITER, make_model, partition_rows,
                                         score_column, unconverged)
from cohortkit.session import checkpoint_dir, stage_path

STRUCTURED = ["n_chars", "n_words", "n_lines", "quality"]
TEXT_COLUMNS = {"chief": "chief_x", "diagnosis": "diagnosis_x"}


@dataclass
class StudyConfig:
    variant: str = "base"              # 'base' or 'optimised'
    feature_sets: list = field(default_factory=lambda: list(FE.FEATURE_SETS))
    models: list = field(default_factory=lambda: list(EV.MODEL_ORDER))
    n_folds: int = 10
    seed: int = 42
    text_width: int = TX.TEXT_WIDTH
    pca_k: int = RD.PCA_COMPONENTS
    use_smote: bool = False            # optimised study: SMOTE+Tomek on text-only sets
    threads: int = 8
    out_dir: str | None = None         # predictions / models folder (default: checkpoint dir)
    wide: frozenset = frozenset()      # columns whose median comes from a sorted table (set by run_study)
    fit_scope: str = "fold"            # 'fold': encoders/PCA/scaler fitted on each fold's training rows;
                                       # 'train': fitted once on the training split (the reference)
    tol: float | None = None           # solver tolerance; None: the default of each family
    svm_max_iter: int = SVM_MAX_ITER
    rff_components: int = RFF_COMPONENTS
    exact_trees: bool = False          # DT with splits over all distinct values instead of 256 bins
    batched: bool = True               # linear models of all folds in common passes; False: one solver run a fit


def document_study_table(spark: SparkSession, sf_dir: str, seed: int = 42, k: int = 10) -> DataFrame:
    """row_id, structured measurements, chief/diagnosis text, label, split, fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    df = docs.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(F.col("text"), "\n")).cast("double").alias("n_lines"),
        F.col("quality").cast("double").alias("quality"),
        F.col("text").alias("chief"),
        F.concat_ws(" ", "lang", "source").alias("diagnosis"),
        F.col("toxic").cast("int").alias("label"))
    # one distributed rank gives both the split and the folds (one shuffle)
    return S.split_and_folds(df, "label", "row_id", 1 / 3, k, seed)


def prepare_features(study: DataFrame, cfg: StudyConfig):
    """Fit the text encoders (+ PCA) that the feature sets use, and the scaler, on the
    training split; return (feature table, fitted stage models, PCA report rows)."""
    train = study.filter("split = 'train'")
    stages, report = [], []
    df = study
    used = {p for fs in cfg.feature_sets for p in FE.feature_set_columns(fs, [], TEXT_COLUMNS)}
    texts = {col: out for col, out in TEXT_COLUMNS.items() if out in used}
    for col, out in texts.items():
        enc = TX.fit_text_encoder(train, col, f"{col}_vec", cfg.text_width)
        df = enc.transform(df)
        stages.append(enc)
        if cfg.variant == "optimised":
            tr = df.filter("split = 'train'")
            pca, var = RD.fit_pca(tr, f"{col}_vec", out, cfg.pca_k)
            df = pca.transform(df)
            stages.append(pca)
            report.append((col, cfg.pca_k, var))
        else:
            df = df.withColumn(out, F.col(f"{col}_vec"))
    scaler = FE.fit_zscore(df.filter("split = 'train'"), STRUCTURED)
    df = scaler.transform(df)
    stages.append(scaler)
    keep = ["row_id", "split", "fold", "label", *STRUCTURED, *texts.values()]
    return df.select(*keep), stages, report


def _weights(df: DataFrame, counts: dict) -> DataFrame:
    """Balanced class weights n / (k * n_c) from known class counts (no job)."""
    n, k = sum(counts.values()), len(counts)
    w = F.create_map(*[x for c, nc in counts.items() for x in (F.lit(float(c)), F.lit(n / (k * nc)))])
    return df.withColumn("weight", w[F.col("label")])


def _width(feature_set: str, kept_structured: int, cfg: StudyConfig) -> int:
    text_w = cfg.pca_k if cfg.variant == "optimised" else cfg.text_width
    parts = FE.feature_set_parts(feature_set)
    return sum(kept_structured if p == "structured" else text_w for p in parts)


def _rebalance(df: DataFrame, cfg: StudyConfig, notes: list) -> DataFrame:
    """SMOTE + Tomek on assembled training rows; on failure keep them as they are and note why."""
    try:
        arr = df.select("row_id", vector_to_array("features").alias("v"), "label")
        res = BA.smote_tomek(arr, "row_id", "v", "label", minority=1, seed=cfg.seed)
        return res.select("row_id", array_to_vector("v").alias("features"), "label")
    except ValueError as e:
        notes.append(f"not rebalanced: {str(e)[:200]}")
        return df


def fit_pipeline(train: DataFrame, feature_set: str, model: str, cfg: StudyConfig,
                 counts: dict | None = None, notes: list | None = None) -> PipelineModel:
    """Imputer (fitted here) -> assembler -> classifier, as one PipelineModel.

    ``counts``: class counts of ``train`` when already known (saves a job).
    ``notes`` collects what did not go as asked: rows left unbalanced, a solver
    that stopped at its iteration limit.
    """
    notes = [] if notes is None else notes
    cols = FE.feature_set_columns(feature_set, STRUCTURED, TEXT_COLUMNS)
    stages = []
    struct = [c for c in cols if c in STRUCTURED]
    kept = []
    if struct:
        imp, kept = FE.fit_median_imputer(train, struct, wide=cfg.wide)
        stages.append(imp)
        cols = [c for c in cols if c not in STRUCTURED or c in kept]
    asm = FE.assembler(cols, "features")
    stages.append(asm)
    prepared = PipelineModel(stages=stages).transform(train).select(
        "row_id", "features", F.col("label").cast("double").alias("label"))
    if cfg.use_smote and cfg.variant == "optimised" and feature_set in FE.TEXT_ONLY_SETS:
        prepared = _rebalance(prepared, cfg, notes).withColumn("label", F.col("label").cast("double"))
        counts = None
    if counts is None:
        counts = {float(r[0]): int(r[1]) for r in prepared.groupBy("label").count().collect()}
    n_rows = float(sum(counts.values()))
    # iterative solvers rescan the training rows every step: persist them in
    # partitions sized by the volume that the solver scans, not one per core
    parts = max(1, math.ceil(n_rows / partition_rows(model, cfg.rff_components)))
    counted = _weights(prepared, counts).repartition(parts).persist()
    try:
        est = make_model(model, _width(feature_set, len(kept), cfg), n_rows, cfg.variant, cfg.seed, tol=cfg.tol,
                         svm_max_iter=cfg.svm_max_iter, rff_components=cfg.rff_components, exact_trees=cfg.exact_trees)
        fitted = est.fit(counted)
        notes.extend(unconverged(fitted))
    finally:
        counted.unpersist()
    return PipelineModel(stages=[*stages, fitted])


def _predict(model: PipelineModel, rows: DataFrame, feature_set, model_name, split, fold) -> DataFrame:
    out = score_column(model.transform(rows))
    return out.select(F.lit(feature_set).alias("feature_set"), F.lit(model_name).alias("model"),
                      F.lit(split).alias("split"), F.lit(fold).cast("int").alias("fold"),
                      "row_id", "label", F.col("score").cast("double"), "pred")


def _safe(name: str) -> str:
    return name.replace("-", "_").replace(",", "_")


def _done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def fold_class_counts(feats: DataFrame) -> dict:
    """{fold: {label: n}} over the training split, plus -1 for the whole split (one job)."""
    out: dict = {}
    for r in feats.filter("split = 'train'").groupBy("fold", "label").count().collect():
        out.setdefault(int(r["fold"]), {})[float(r["label"])] = int(r["count"])
    total: dict = {}
    for c in out.values():
        for lab, n in c.items():
            total[lab] = total.get(lab, 0) + n
    res = {f: {lab: total[lab] - c.get(lab, 0) for lab in total} for f, c in out.items()}
    res[-1] = total
    return res


def _held_out(study: DataFrame, fold: int) -> DataFrame:
    """study with the fold's training rows relabelled 'val', so that no stage is fitted on them."""
    return study.withColumn("split", F.when((F.col("split") == "train") & (F.col("fold") == fold), "val")
                            .otherwise(F.col("split")))


def fold_features(study: DataFrame, fold: int, cfg: StudyConfig) -> DataFrame:
    """Features for one fold with every fitted stage fitted on that fold's
    training rows only; fold -1 is the refit on the whole training split."""
    feats, _, _ = prepare_features(study if fold < 0 else _held_out(study, fold), cfg)
    return feats.withColumn("split", F.when(F.col("split") == "val", "train").otherwise(F.col("split")))


def _stored(study: DataFrame, n_rows: int, cfg: StudyConfig):
    """(feature table in the shared folder, PCA report rows); ~100k rows a partition, as every fit rescans it."""
    feats, _, report = prepare_features(study, cfg)
    return feats.repartition(max(1, math.ceil(n_rows / 100_000)), "row_id").checkpoint(), report


def run_fit(spark: SparkSession, feats: DataFrame, feature_set: str, model: str, fold: int, cfg: StudyConfig,
            out_dir: str, save_models: bool = True, counts: dict | None = None) -> tuple[str, str]:
    """One fit: fold f (train on the other folds, predict fold f) or the refit
    (fold = -1: train on the whole training split, predict the test split).

    Returns the status ('ok' or 'failed: <reason>') and the notes of fit_pipeline
    (none for a fit that an earlier run finished)."""
    counts = counts or {}
    path = f"{out_dir}/predictions/feature_set={_safe(feature_set)}/model={model}/fold={fold}"
    if _done(spark, path):
        return "ok", ""
    train = feats.filter("split = 'train'")
    notes: list = []
    try:
        if fold >= 0:
            m = fit_pipeline(train.filter(F.col("fold") != fold), feature_set, model, cfg, counts.get(fold), notes)
            rows, split = train.filter(F.col("fold") == fold), "train"
        else:
            m = fit_pipeline(train, feature_set, model, cfg, counts.get(-1), notes)
            rows, split = feats.filter("split = 'test'"), "test"
        _predict(m, rows, feature_set, model, split, fold).drop("feature_set", "model", "fold") \
            .write.mode("overwrite").parquet(path)
        if fold < 0 and save_models:
            m.write().overwrite().save(f"{out_dir}/models/{_safe(feature_set)}_{model}")
        return "ok", "; ".join(notes)
    except Exception as e:  # noqa: BLE001  a failing run keeps a row with status 'failed'
        return f"failed: {type(e).__name__}: {str(e)[:200]}", "; ".join(notes)


def _batches(cfg: StudyConfig, feature_set: str, model: str) -> bool:
    """Whether the fits of a (set, model) run together: linear models and networks whose rows are not resampled."""
    resampled = cfg.use_smote and cfg.variant == "optimised" and feature_set in FE.TEXT_ONLY_SETS
    return cfg.batched and model in ("LR", "SGD", "ANN", "NN") and not resampled


def _shared(cfg: StudyConfig, feature_set: str) -> bool:
    """Whether all fits of the set can read the same rows and differ by fill, centre and scale only."""
    return cfg.fit_scope == "train" or feature_set == "a-x"


def _batched_rows(study: DataFrame, feats, by_fold: dict, feature_set: str, cfg: StudyConfig, fits) -> tuple:
    """(rows of foldfit, maps, width) of a feature set, written once for all passes."""
    cols = FE.feature_set_columns(feature_set, STRUCTURED, TEXT_COLUMNS)
    struct = [c for c in cols if c in STRUCTURED]
    width = _width(feature_set, len(struct), cfg)
    base = ["row_id", F.col("label").cast("double").alias("label"), "split", "fold"]

    def assembled(df: DataFrame, fit) -> DataFrame:
        parts = [F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in struct])] if struct else []
        parts += [vector_to_array(c) for c in cols if c not in STRUCTURED]
        return df.select(*base, F.lit(fit).cast("int").alias("fit"), F.concat(*parts).alias("x"))

    if _shared(cfg, feature_set):
        raw = study if cfg.fit_scope == "fold" else feats
        train = raw.filter("split = 'train'")

        def medians(f: int, columns) -> dict:
            found = FE.exact_quantiles(train.filter(F.col("fold") != f), columns, [0.5], cfg.wide & set(columns))
            return {c: v and v[0] for c, v in found.items()}

        maps = FF.fold_maps(train, struct, fits, scaled=cfg.fit_scope == "train", medians=medians)
        rows = assembled(raw, None)
    else:
        made = []
        for f in fits:
            df = by_fold[f] if f >= 0 else feats
            if struct:
                imputer, kept = FE.fit_median_imputer(df.filter("split = 'train'").filter(F.col("fold") != f), struct,
                                                      wide=cfg.wide)
                df = imputer.transform(df)
                for c in set(struct) - set(kept):
                    df = df.withColumn(c, F.lit(0.0))
            # the fit's training rows and those it will score
            made.append(assembled(df, f).filter(F.col("split") == "train") if f >= 0 else assembled(df, f))
        rows, maps = made[0], {}
        for df in made[1:]:
            rows = rows.unionByName(df)
    return rows, maps, width


def run_batched(spark: SparkSession, study: DataFrame, feats, by_fold: dict, feature_set: str, models, cfg: StudyConfig,
                out_dir: str, counts: dict, save_models: bool) -> list:
    """All folds and the refit of one set's linear models and networks; [(set, model, fold, status, note)]."""
    fits = [*range(cfg.n_folds), -1]
    todo = [m for m in models if not _done(spark, f"{out_dir}/predictions/feature_set={_safe(feature_set)}/model={m}")]
    out = [(feature_set, m, f, "ok", "") for m in models if m not in todo for f in fits]
    if not todo:
        return out
    rows, maps, width = _batched_rows(study, feats, by_fold, feature_set, cfg, fits)
    n_rows = sum(counts[-1].values()) * (1 if _shared(cfg, feature_set) else len(fits))
    rows = rows.repartition(max(1, math.ceil(n_rows / 100_000)), "row_id").checkpoint()
    for m in todo:
        try:
            hp = (OPTIMISED if cfg.variant == "optimised" else BASE)[m]
            path = f"{out_dir}/predictions/feature_set={_safe(feature_set)}/model={m}"
            limit = ""
            if m in ("ANN", "NN"):
                layers = [width, *hp["hidden"], 1]
                nets = NN.fit_networks(rows, fits, layers, maps, hp["alpha"], hp["max_iter"], cfg.seed)
                scored = NN.score_networks(rows, {f: n.best for f, n in nets.items()}, layers, maps)
                last = NN.NetworkModel(featuresCol="features", layers=layers, weights=[float(w) for w in nets[-1].best])
            else:
                n = {f: sum(counts[f].values()) for f in fits}
                weight = {f: {c: n[f] / (len(counts[f]) * counts[f][c]) if hp.get("balanced") and counts[f].get(c) else 1.0
                              for c in (0.0, 1.0)} for f in fits}
                reg = {f: hp["alpha"] if m == "SGD" else 1.0 / (hp["C"] * max(n[f], 1)) for f in fits}
                beta, passes = FF.fit_folds(rows, fits, width, maps, weight, reg)
                limit = f"{m} stopped at {FF.MAX_PASSES} passes" if max(passes.values()) >= FF.MAX_PASSES else ""
                scored = FF.score_folds(rows, beta, maps)
                last = FF.LinearScorer(featuresCol="features", coefficients=[float(b) for b in beta[-1][:-1]],
                                       intercept=float(beta[-1][-1]))
            scored.write.mode("overwrite").partitionBy("fold").parquet(path)
            if save_models:
                _save_refit(feats if feats is not None else study, last, maps.get(-1), feature_set, m, cfg, out_dir)
            out += [(feature_set, m, f, "ok", limit) for f in fits]
        except Exception as e:  # noqa: BLE001  a failing run keeps a row with status 'failed'
            out += [(feature_set, m, f, f"failed: {type(e).__name__}: {str(e)[:200]}", "") for f in fits]
    return out


def _save_refit(rows: DataFrame, last, fold_map, feature_set: str, model: str, cfg: StudyConfig, out_dir: str) -> None:
    """The refit as a pipeline over prepared features: imputer, assembler, model."""
    cols = FE.feature_set_columns(feature_set, STRUCTURED, TEXT_COLUMNS)
    struct = [c for c in cols if c in STRUCTURED]
    stages = []
    if struct and fold_map is not None:  # the shared form: the median as it is after scaling
        fills = ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), CAST({float((v - m) / s)!r} AS DOUBLE)) AS `{c}`" for c, v, m, s in
                          zip(struct, fold_map.fill, fold_map.centre, fold_map.scale))
        names = ", ".join(f"`{c}`" for c in struct)
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({names}), {fills} FROM __THIS__"))
    elif struct:
        stages.append(FE.fit_median_imputer(rows.filter("split = 'train'"), struct, wide=cfg.wide)[0])
    PipelineModel(stages=[*stages, FE.assembler(cols, "features"), last]).write().overwrite().save(
        f"{out_dir}/models/{_safe(feature_set)}_{model}")


def run_study(spark: SparkSession, study: DataFrame, cfg: StudyConfig, save_models: bool = True) -> dict:
    """Run every (feature set, model) job; return result tables."""
    out_dir = cfg.out_dir or stage_path(spark, "study", f"{cfg.variant}-{uuid.uuid4().hex[:8]}")
    checkpoint_dir(spark)
    study = study.checkpoint()
    n_rows = study.count()
    folds = range(cfg.n_folds)
    single = [(fs, m, f) for fs in cfg.feature_sets for m in cfg.models if not _batches(cfg, fs, m) for f in [*folds, -1]]
    batched = {fs: ms for fs in cfg.feature_sets if (ms := [m for m in cfg.models if _batches(cfg, fs, m)])}
    # feature tables are made for the sets that read them
    tables = dict.fromkeys([fs for fs, *_ in single] + [fs for fs in batched if fs != "a-x" or cfg.fit_scope == "train"])
    feats, report, by_fold = None, [], {}
    if tables:
        used = replace(cfg, feature_sets=list(tables))
        feats, report = _stored(study, n_rows, used)
        if cfg.fit_scope == "fold":
            by_fold = {f: _stored(_held_out(study, f), n_rows, used)[0].withColumn(
                "split", F.when(F.col("split") == "val", "train").otherwise(F.col("split"))) for f in folds}
    counts = fold_class_counts(study)
    # decided once per study; the medians are exact either way
    cfg.wide = frozenset(FE.wide_columns(study.filter("split = 'train'"), STRUCTURED))
    with ThreadPoolExecutor(max_workers=max(1, cfg.threads)) as pool:
        # sets wait for one another only where the pool is full
        together = [pool.submit(run_batched, spark, study, feats, by_fold, fs, ms, cfg, out_dir, counts, save_models)
                    for fs, ms in batched.items()]
        fits = list(pool.map(lambda j: (*j, *run_fit(spark, by_fold.get(j[2], feats), *j, cfg, out_dir,
                                                     save_models, counts)), single))
        fits += [fit for job in together for fit in job.result()]
    fits = [(fs, m, st_, note) for fs, m, _, st_, note in fits]
    # a (set, model) is as good as its worst fit; its notes are those of all fits
    status = []
    for fs, m in {(fs, m): None for fs, m, *_ in fits}:
        of = [(st_, note) for f, n, st_, note in fits if (f, n) == (fs, m)]
        status.append((fs, m, next((st_ for st_, _ in of if st_ != "ok"), "ok"),
                       "; ".join(dict.fromkeys(note for _, note in of if note))))
    preds = spark.read.option("basePath", f"{out_dir}/predictions").parquet(f"{out_dir}/predictions")
    # partition values were made path-safe; map them back to the set names
    names = F.create_map(*[x for fs in cfg.feature_sets for x in (F.lit(_safe(fs)), F.lit(fs))])
    preds = preds.withColumn("feature_set", names[F.col("feature_set").cast("string")]) \
                 .withColumn("fold", F.col("fold").cast("int"))
    fold_metrics = EV.evaluate(preds)
    cv = EV.cv_aggregate(fold_metrics.filter("split = 'train'"))
    test = EV.evaluate(preds.filter("split = 'test'"), ["feature_set", "model"])
    grid = EV.run_grid(cfg.feature_sets, cfg.models)
    st = spark.createDataFrame(status, "feature_set string, model string, status string, note string")
    return {"predictions": preds, "fold_metrics": fold_metrics,
            "cv_results": EV.with_status(grid, cv).drop("status").join(st, ["feature_set", "model"]),
            "test_results": EV.with_status(grid, test).drop("status").join(st, ["feature_set", "model"]),
            "best_cv": EV.best_model(cv, "AUC_mean"), "best_test": EV.best_model(test, "AUC"),
            "pca_report": spark.createDataFrame(report, "feature string, n_components int, variance_ratio double")
            if report else None,
            "out_dir": out_dir}


def batch_score(spark: SparkSession, model_path: str, rows: DataFrame) -> DataFrame:
    """Load a saved (set, model) pipeline and return class and P(class 1) / decision value."""
    model = PipelineModel.load(model_path)
    return score_column(model.transform(rows))

