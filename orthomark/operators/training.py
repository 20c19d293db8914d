"""Training manifests, evaluation and the tile classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.operators.ordering import running_totals

# Splits, image suffixes and channel normalisation.
SPLITS = ("train", "val", "test")
SUFFIXES = (".png", ".jpg", ".jpeg")
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
SEED = 42


def group_leakage(manifest: DataFrame) -> DataFrame:
    """Geographic groups that appear in more than one split."""
    spread = manifest.groupBy("grp").agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.count(F.lit(1)).alias("samples"))
    return spread.filter("first_split <> last_split")


def duplicate_leakage(files: DataFrame, content: str = "content") -> DataFrame:
    """Digests of identical files in more than one split; contents are hashed before the shuffle."""
    hashed = files.select(F.sha2(content, 256).alias("digest"), "split")
    spread = hashed.groupBy("digest").agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.count(F.lit(1)).alias("files"))
    return spread.filter("first_split <> last_split")


def _missing(c) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def manifest_checks(manifest: DataFrame) -> DataFrame:
    """Violations table (violation, detail); an empty result means the manifest is usable."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    row = (F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "unknown split").when(_missing("label"), "empty label")
           .when(_missing("grp"), "empty group").when(~suffix.isin(*SUFFIXES), "unsupported file type"))
    rows = manifest.select(row.alias("violation"), F.col("path").alias("detail")).filter("violation IS NOT NULL")
    groups = group_leakage(manifest).select(F.lit("geographic leakage").alias("violation"), F.col("grp").alias("detail"))
    # max() over literals keeps this to one partially aggregated row.
    has = lambda s: F.max(F.when(F.col("split") == s, 1).otherwise(0))
    sizes = manifest.agg(has("train").alias("t"), has("val").alias("v"))
    absent = F.array(F.when(F.coalesce("t", F.lit(0)) == 0, "train"), F.when(F.coalesce("v", F.lit(0)) == 0, "val"))
    empty = sizes.select(F.explode(F.filter(absent, lambda s: s.isNotNull())).alias("detail")).select(F.lit("empty split").alias("violation"), "detail")
    trained = manifest.filter("split = 'train'").select("label").distinct()
    few = trained.agg(F.count(F.lit(1)).alias("n")).filter("n < 2").select(F.lit("fewer than two training classes").alias("violation"), F.col("n").cast("string").alias("detail"))
    unseen = (manifest.filter("split <> 'train'").select("label").distinct().join(trained, "label", "left_anti")
              .select(F.lit("class not in training").alias("violation"), F.col("label").alias("detail")))
    out = rows
    for part in (groups, empty, few, unseen):
        out = out.unionByName(part)
    return out


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.count(F.lit(1)).alias("samples"))


def class_index(manifest: DataFrame) -> DataFrame:
    """Sorted training labels numbered from 0."""
    labels = manifest.filter("split = 'train'").select("label").distinct()
    numbered = running_totals(labels, [], [F.col("label")], {"n": F.lit(1).cast("long")})
    return numbered.select("label", (F.col("n") - 1).alias("class_index"))


def confusion_matrix(predictions: DataFrame, classes: int, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Counts for every (target, predicted) of the class range, 0 where none."""
    counts = predictions.groupBy(*keys, F.col("target").cast("long").alias("target"), F.col("predicted").cast("long").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    span = F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))
    grid = counts.select(*keys).distinct().select(*keys, F.explode(span).alias("target")).select(*keys, "target", F.explode(span).alias("predicted"))
    return grid.join(counts, [*keys, "target", "predicted"], "left").select(*keys, "target", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def classification_report(matrix: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted averages;
    0 on division by zero."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.explode(F.array(F.struct(F.col("target").alias("c"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("chosen")),
                              F.struct(F.col("predicted").alias("c"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("chosen"))))
    sums = matrix.select(*keys, sides.alias("s")).groupBy(*keys, "s.c").agg(*[F.sum(f"s.{k}").alias(k) for k in ("tp", "support", "chosen")])

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    scored = sums.withColumn("precision", ratio(F.col("tp"), F.col("chosen"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    scored = scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    each = scored.select(*keys, F.col("c").cast("string").alias("label"), "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    total = scored.groupBy(*keys).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in names],
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.sum("support").alias("support"))
    row = lambda label, values: F.struct(F.lit(label).alias("label"), *[v.alias(m) for m, v in zip(names, values)])
    rows = F.explode(F.array(row("accuracy", [F.col("accuracy")] * 3), row("macro avg", [F.col(f"macro_{m}") for m in names]),
                             row("weighted avg", [F.col(f"weighted_{m}") for m in names])))
    averages = total.select(*keys, "support", rows.alias("r")).select(*keys, "r.label", "r.precision", "r.recall", "r.f1", "support")
    return each.unionByName(averages)


def evaluate(predictions: DataFrame, classes: int, splits: Sequence[str] = ("val", "test")) -> tuple[DataFrame, DataFrame]:
    """Report and confusion matrix of the evaluation splits; empty splits do not appear."""
    matrix = confusion_matrix(predictions.filter(F.col("split").isin(*splits)), classes)
    return classification_report(matrix), matrix


def sample_mean_metrics(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loss weighted by batch size and accuracy over samples; a reason where there are none."""
    n = F.sum("n_samples")
    sums = batches.groupBy(*keys).agg(n.alias("samples"), F.sum(F.col("loss") * F.col("n_samples")).alias("_l"), F.sum("n_correct").alias("_c"))
    size = F.nullif(F.col("samples"), F.lit(0))
    return sums.select(*keys, "samples", (F.col("_l") / size).alias("loss"), (F.col("_c") / size).alias("accuracy"),
                       F.when(F.coalesce("samples", F.lit(0)) == 0, "no samples").alias("reason"))


def rank_classes(df: DataFrame, scores: str = "scores", classes: Sequence[str] | None = None) -> DataFrame:
    """Classes by descending score (ties in class order) and the predicted class."""
    s = F.transform(scores, lambda p, i: F.struct((-p).alias("o"), i.alias("i")))
    order = F.transform(F.array_sort(s), lambda e: e["i"])
    names = F.array(*[F.lit(c) for c in classes]) if classes else None
    pick = (lambda i: F.get(names, i)) if classes else (lambda i: i.cast("string"))
    ranking = F.transform(order, lambda i: F.struct(pick(i).alias("label"), F.get(scores, i).alias("score")))
    return df.withColumn("ranking", ranking).withColumn("predicted_class", F.get("ranking", F.lit(0))["label"])


def tile_features(pixels: DataFrame, keys: Sequence[str], size: int, source_size: tuple[int, int]) -> DataFrame:
    """Normalised feature vector per tile: bilinear resize to size x size (pixel centres
    aligned), scaled to 0..1, channel mean and standard deviation removed.

    ``pixels``: keys, band (1..3), prow, pcol, value in 0..255; ``source_size`` (height, width).
    """
    keys = list(keys)
    height, width = source_size
    spark = pixels.sparkSession

    def weights(length, index, target, weight):
        """At most two source indexes per target index: a table bounded by the tile size."""
        rows = []
        for i in range(size):
            at = min(max((i + 0.5) * length / size - 0.5, 0.0), length - 1.0)
            low, part = int(at), at - int(at)
            rows += [(s, i, w) for s, w in ((low, 1 - part), (min(low + 1, length - 1), part)) if w > 0]
        return F.broadcast(spark.createDataFrame(rows, f"{index} bigint, {target} bigint, {weight} double"))

    spread = (pixels.withColumn("prow", F.col("prow").cast("long")).withColumn("pcol", F.col("pcol").cast("long"))
              .join(weights(height, "prow", "_ty", "_wy"), "prow").join(weights(width, "pcol", "_tx", "_wx"), "pcol"))
    value = F.sum(F.col("value") * F.col("_wy") * F.col("_wx")) / F.lit(255.0)
    resized = spread.groupBy(*keys, "band", F.col("_ty").alias("prow"), F.col("_tx").alias("pcol")).agg(value.alias("value"))
    channel = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("band") - 1)
    normal = (F.col("value") - channel(CHANNEL_MEAN)) / channel(CHANNEL_STD)
    item = F.struct("band", "prow", "pcol", normal.alias("v"))
    return resized.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_f")).select(*keys, F.transform("_f", lambda e: e["v"]).alias("features"))


def augment_flips(pixels: DataFrame, keys: Sequence[str], width: int, height: int, seed: int = SEED, epoch: int = 0) -> DataFrame:
    """Horizontal and vertical flips of training tiles, chosen by two bits of a seeded digest of the tile."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(k).cast("string") for k in keys]), 256)
    coin = F.conv(F.substring(digest, 1, 1), 16, 10).cast("long")
    train = F.col("split") == "train"
    sideways = train & (F.pmod(coin, F.lit(2)) == 1)
    upright = train & (F.pmod(F.shiftright(coin, 1), F.lit(2)) == 1)
    return (pixels.withColumn("pcol", F.when(sideways, width - 1 - F.col("pcol")).otherwise(F.col("pcol")))
            .withColumn("prow", F.when(upright, height - 1 - F.col("prow")).otherwise(F.col("prow"))))


def train_classifier(samples: DataFrame, features: str = "features", label: str = "class_index", epochs: Sequence[int] = (5, 20),
                     learning_rate: float = 0.001):
    """Linear classifier on split = 'train'; of the given iteration counts the one with the
    smallest validation loss is kept. Returns (model, history rows of epoch, train and val
    loss and accuracy)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    if not epochs or min(epochs) < 1 or learning_rate <= 0:
        raise ValueError("use epochs >= 1 and learning rate > 0")
    data = samples.select("split", F.col(label).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    # Every iteration count reads these rows again and again; memory falls back to disk.
    data = data.filter("split IN ('train', 'val')").persist(StorageLevel.MEMORY_AND_DISK)
    train = data.filter("split = 'train'")
    best, history = None, []
    for count in epochs:
        model = LogisticRegression(maxIter=int(count), regParam=float(learning_rate), standardization=True).fit(train)
        scored = _losses(model, data)
        record = {"epoch": int(count), **{f"{r['split']}_{m}": r[m] for r in scored.collect() for m in ("loss", "accuracy")}}
        history.append(record)
        # Without validation rows the training loss decides.
        loss = record.get("val_loss", record["train_loss"])
        if best is None or loss < best[0]:
            best = (loss, model)
    data.unpersist()
    return best[1], history


def _losses(model, data: DataFrame) -> DataFrame:
    """Cross-entropy and accuracy per split: at most three rows."""
    from pyspark.ml.functions import vector_to_array

    chosen = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    scored = model.transform(data).select("split", (-F.log(F.greatest(chosen, F.lit(1e-15)))).alias("l"), (F.col("prediction") == F.col("label")).cast("double").alias("a"))
    return scored.groupBy("split").agg(F.avg("l").alias("loss"), F.avg("a").alias("accuracy"))


def classify(model, samples: DataFrame, features: str = "features", classes: Sequence[str] | None = None) -> DataFrame:
    """Predicted class and all class scores of every sample."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rest = [c for c in samples.columns if c not in ("features", "scores")]
    data = samples.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.transform(data).withColumn("scores", vector_to_array("probability"))
    return rank_classes(scored.select(*rest, "scores"), "scores", classes)
