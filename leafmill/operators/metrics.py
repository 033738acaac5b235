"""Evaluation of near-duplicate methods: pairs, threshold sweep, PR-AUC, best F1, per-group recall, recall at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups(docs: DataFrame, id: str, field: str) -> DataFrame:
    """group, id of groups with two members or more; documents without the field are in none."""
    rows = docs.select(F.col(field).alias("group"), F.col(id).alias("id")).where(F.col("group").isNotNull()).distinct()
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("group"))).where("_n > 1").drop("_n")


def positive_pairs(members: DataFrame) -> DataFrame:
    """group, a < b."""
    right = members.select("group", F.col("id").alias("b"))
    return members.select("group", F.col("id").alias("a")).join(right, "group").where("a < b")


def pair_scores(scores: DataFrame, positives: DataFrame, missing: float = 0.0) -> DataFrame:
    """a, b, score, positive, group: all scored pairs and all positives; positives without a score have `missing`. Unscored
    negatives are left out: no metric here counts them."""
    best = scores.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
    joined = best.join(positives, ["a", "b"], "full")
    return joined.select("a", "b", F.coalesce("score", F.lit(missing)).alias("score"), F.col("group").isNotNull().alias("positive"), "group")


def dense_pair_scores(docs: DataFrame, scores: DataFrame, positives: DataFrame, missing: float) -> DataFrame:
    """As pair_scores, with every pair of a closed set of documents (id): for evaluation sets, whose pairs are asked for."""
    right = docs.select(F.col("id").alias("b"))
    every = docs.select(F.col("id").alias("a")).join(right, F.col("a") < F.col("b"))
    best = scores.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
    joined = every.join(best, ["a", "b"], "left").join(positives, ["a", "b"], "left")
    return joined.select("a", "b", F.coalesce("score", F.lit(missing)).alias("score"), F.col("group").isNotNull().alias("positive"), "group")


def _pairs(pairs: DataFrame, which) -> Column:
    """How many of the rows are `which`; with a column n, each stands for so many pairs."""
    return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) if "n" in pairs.columns else F.count_if(which)


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def threshold_sweep(pairs: DataFrame) -> DataFrame:
    """threshold, tp, fp, precision, recall, f1 at each score above 0; recall counts all positives. Sums by score come first, so the
    running sums go over distinct scores, not pairs. With a column n, a row stands for n pairs."""
    total = pairs.agg(_pairs(pairs, F.col("positive")).alias("total"))
    steps = pairs.where("score > 0").groupBy("score").agg(_pairs(pairs, F.col("positive")).alias("p"), _pairs(pairs, ~F.col("positive")).alias("n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select(F.col("score").alias("threshold"), F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp")).crossJoin(F.broadcast(total))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.when(F.col("total") > 0, F.col("tp") / F.col("total")).otherwise(0.0)
    return sums.select("threshold", "tp", "fp", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def pr_auc(sweep: DataFrame) -> DataFrame:
    """pr_auc: trapezoids under precision over recall, from recall 0 at the first precision; 0 for no thresholds."""
    order = Window.orderBy(F.desc("threshold"))
    r0 = F.coalesce(F.lag("recall").over(order), F.lit(0.0))
    p0 = F.coalesce(F.lag("precision").over(order), F.col("precision"))
    areas = sweep.select(((F.col("recall") - r0) * (F.col("precision") + p0) / 2).alias("area"))
    return areas.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("pr_auc"))


def best_f1(sweep: DataFrame) -> DataFrame:
    """The threshold of the greatest F1, ties by recall, then precision."""
    top = F.max(F.struct("f1", "recall", "precision", "threshold", "tp", "fp")).alias("top")
    return sweep.agg(top).where(F.col("top").isNotNull()).select("top.*")


def group_recall(pairs: DataFrame) -> DataFrame:
    """group, recall of its positive pairs at the best F1's threshold; 0 for all if nothing has a score. With a column n, a row stands for n
    pairs."""
    best = best_f1(threshold_sweep(pairs)).select("threshold")
    cut = best.agg(F.max("threshold").alias("cut"))
    hit = F.when(F.col("cut").isNotNull() & (F.col("score") >= F.col("cut")), 1.0).otherwise(0.0)
    hit = F.sum(hit * F.col("n")) / F.sum("n") if "n" in pairs.columns else F.avg(hit)
    return pairs.where("positive").crossJoin(F.broadcast(cut)).groupBy("group").agg(hit.alias("recall"))


def recall_at_k(ranking: DataFrame, positives: DataFrame, docs: DataFrame, ks: list[int]) -> DataFrame:
    """k, recall: mean over documents with a positive of the share of their positives among the first k of ranking (src, dst,
    rank). Ids outside docs take up ranks, but are no hits."""
    both = positives.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(positives.select("b", "a")).distinct()
    known = both.join(docs.select(F.col("id").alias("src")), "src", "left_semi").join(docs.select(F.col("id").alias("dst")), "dst", "left_semi")
    ranked = known.join(ranking.select("src", "dst", "rank"), ["src", "dst"], "left")
    asked = ranked.crossJoin(F.broadcast(ranking.sparkSession.createDataFrame([(k,) for k in ks], "k int")))
    each = asked.groupBy("k", "src").agg(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("r"))
    return each.groupBy("k").agg(F.avg("r").alias("recall"))


def member_recall_at_k(ranking: DataFrame, members: DataFrame, ks: list[int]) -> DataFrame:
    """As recall_at_k, where the positives of a document are the other members of its group (group, id), and each is of one group; they are
    counted, not paired."""
    sizes = members.groupBy("group").agg((F.count("*") - 1).alias("others")).where("others > 0")
    own = members.join(sizes, "group").select("group", F.col("id").alias("src"), "others")
    hits = ranking.select("src", "dst", "rank").join(own, "src").join(members.select("group", F.col("id").alias("dst")), ["group", "dst"]).select("src", "rank")
    ranks = own.join(hits.groupBy("src").agg(F.collect_list("rank").alias("_r")), "src", "left").withColumn("_r", F.coalesce("_r", F.array().cast("array<int>")))
    among = lambda k: F.size(F.filter("_r", lambda x: x <= k)) / F.col("others")
    each = F.array(*(F.struct(F.lit(k).alias("k"), among(k).alias("r")) for k in ks))
    return ranks.select(F.inline(each)).groupBy("k").agg(F.avg("r").alias("recall"))
