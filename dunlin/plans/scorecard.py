"""Default scorecard on Spark ML: population, profile, one-hot, imputation,
random-forest importances, feature selection and a per-class report.

Training runs distributed (``pyspark.ml``); only model outputs whose size is
the number of features (importances) come back to the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import dpd0
from ..sources.tables import Tables, scratch_path

TARGET = "defFPD30"
OBS = "obsFPD30"


def population_from_tables(t: Tables, start_day, end_day) -> DataFrame:
    """A loan-level modelling frame derived from the input tables: features
    known at ``start_day`` (product, status, outstanding, overdue, disbursement
    year), observed flag = disbursed, target = DPD > 30 on ``end_day``."""
    s = (t.bucket_flow.filter(F.col("bucket_date") == F.lit(start_day))
         .select("loan_account", F.col("outstanding").cast("double").alias("loanRequestAmount"),
                 F.when(F.col("overdue") > 0, F.col("overdue").cast("double")).alias("overdueAmount")))
    e = (t.bucket_flow.filter(F.col("bucket_date") == F.lit(end_day))
         .select("loan_account", (dpd0("max_dpd") > 30).cast("int").alias(TARGET)))
    lm = t.loan_master.select("loan_account", F.col("loan_type").alias("purposeDescription"),
                              F.col("loan_paid_status").alias("statusDescription"),
                              F.year("disbursed_at").alias("disbursementYear"),
                              F.col("flag_disbursement").alias(OBS))
    return lm.join(s, "loan_account").join(e, "loan_account")


def ml_population(df: DataFrame, features: list[str]) -> DataFrame:
    """Keep observed rows (``obsFPD30 = 1``) and the modelling columns."""
    return df.filter(F.col(OBS) == 1).select(*features, TARGET)


def _once(df: DataFrame) -> DataFrame:
    """``df`` written to a shared scratch folder and read back: a fit passes over its rows many times, and each pass
    would join the tables anew."""
    path = scratch_path(df.sparkSession, "population")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ml_profile(df: DataFrame) -> DataFrame:
    """Per column: type, distinct values and nulls (one aggregation pass)."""
    aggs = []
    for c in df.columns:
        aggs += [F.countDistinct(c).alias(f"{c}__d"), F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__n")]
    wide = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    stack = ", ".join(f"'{c}', '{dtypes[c]}', `{c}__d`, `{c}__n`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column, dtype, n_distinct, n_null)")


def _categoricals(df: DataFrame, features: list[str]) -> list[str]:
    types = dict(df.dtypes)
    return [c for c in features if types[c] == "string"]


def feature_pipeline(df: DataFrame, features: list[str], median_cols=(), mean_cols=()) -> Pipeline:
    """One-hot strings (NULL -> all zeros, like ``get_dummies``), impute
    numeric columns (median / mean), assemble a feature vector."""
    cats = _categoricals(df, features)
    nums = [c for c in features if c not in cats]
    stages = []
    if cats:
        stages.append(StringIndexer(inputCols=cats, outputCols=[f"{c}_idx" for c in cats],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_oh" for c in cats],
                                    dropLast=True))
    imputed = []
    for cols, strategy in ((list(median_cols), "median"), (list(mean_cols), "mean")):
        if cols:
            stages.append(Imputer(inputCols=cols, outputCols=[f"{c}_imp" for c in cols], strategy=strategy,
                                  relativeError=0.0001))
            imputed += cols
    num_cols = [f"{c}_imp" if c in imputed else c for c in nums]
    stages.append(VectorAssembler(inputCols=num_cols + [f"{c}_oh" for c in cats], outputCol="features",
                                  handleInvalid="keep"))
    return Pipeline(stages=stages)


def ml_onehot(df: DataFrame, features: list[str]) -> DataFrame:
    """``get_dummies``: one 0/1 column per value of every string feature (NULL: all zeros), counted
    as (feature, value, ones) in long form, so a wide vocabulary makes rows and not columns."""
    cats = _categoricals(df, features)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cats)))
    long = df.select(pairs.alias("p")).select("p.feature", "p.value").filter(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("ones"))


def ml_impute(df: DataFrame, median_cols=(), mean_cols=()) -> DataFrame:
    """(column, strategy, value, filled): what stands in for missing values (exact median, mean), and how many."""
    parts = [(c, "median", F.percentile(c, F.lit(0.5))) for c in median_cols] + [(c, "mean", F.avg(c)) for c in mean_cols]
    wide = df.agg(*(v.cast("double").alias(f"{c}__v") for c, _, v in parts), *(F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__n") for c, _, _ in parts))
    stack = ", ".join(f"'{c}', '{s}', `{c}__v`, `{c}__n`" for c, s, _ in parts)
    return wide.selectExpr(f"stack({len(parts)}, {stack}) AS (column, strategy, value, filled)")


def _feature_names(df: DataFrame) -> list[str]:
    meta = df.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    return [names[i] for i in sorted(names)]


def ml_rf_importance(df: DataFrame, features: list[str], num_trees: int = 10, seed: int = 42,
                     median_cols=(), mean_cols=()) -> DataFrame:
    """Random forest on all rows; feature importances sorted descending."""
    spark = df.sparkSession
    df = _once(df)
    prepared = feature_pipeline(df, features, median_cols, mean_cols).fit(df).transform(df)
    rf = RandomForestClassifier(labelCol=TARGET, featuresCol="features", numTrees=num_trees, seed=seed)
    model = rf.fit(prepared)
    names = _feature_names(prepared)
    imp = model.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")


def ml_select_features(importances: DataFrame) -> DataFrame:
    """Keep features whose importance is at least the mean importance."""
    m = importances.agg(F.avg("importance").alias("m"))
    return importances.join(m, F.col("importance") >= F.col("m")).drop("m")


def hash_split(df: DataFrame, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of all columns: whatever order or plan produces the rows,
    a row falls on the same side, and equal rows fall together."""
    side = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), F.lit(10_000)) < int(round(share * 10_000))
    return df.filter(side), df.filter(~side)


def ml_classification_report(df: DataFrame, features: list[str], num_trees: int = 100, seed: int = 42,
                             split=(0.7, 0.3), median_cols=(), mean_cols=()) -> DataFrame:
    """70/30 split by a hash of the row, forest fitted on the training part only,
    per-class precision / recall / F1 / support on the test part."""
    train, test = hash_split(_once(df), split[0] / sum(split), seed)
    pipe = feature_pipeline(df, features, median_cols, mean_cols).fit(train)
    rf = RandomForestClassifier(labelCol=TARGET, featuresCol="features", numTrees=num_trees, seed=seed)
    model = rf.fit(pipe.transform(train))
    pred = model.transform(pipe.transform(test)).select(F.col(TARGET).cast("int").alias("label"),
                                                        F.col("prediction").cast("int").alias("prediction"))
    cm = pred.groupBy("label", "prediction").count()
    tp = cm.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("count").alias("tp"))
    support = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("count").alias("support"))
    predicted = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    out = support.join(predicted, "cls", "full").join(tp, "cls", "left").fillna(0, ["tp", "support", "predicted"])
    p = F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double"))
    return out.select("cls", p.alias("precision"), r.alias("recall"),
                      F.try_divide(2 * p * r, p + r).alias("f1"), F.col("support").cast("long").alias("support"))


def ml_importance_hist(importances: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of importances: equal-width bins over [min, max]."""
    rng = importances.agg(F.min("importance").alias("lo"), F.max("importance").alias("hi"))
    j = importances.join(rng, F.lit(True))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("importance") - F.col("lo")) / width),
                                                        F.lit(bins - 1))).cast("int")
    return j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("importance").alias("min_importance"),
                                         F.max("importance").alias("max_importance")).orderBy("bin")
