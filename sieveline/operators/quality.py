"""Scoring findings against labelled spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of a path that are compared at a time: spans only meet in a block that both reach into.
BLOCK = 4096


def meetings(f: DataFrame, g: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of findings (path, start, end, ...) and labels (path, l_start, l_end, ...) of a path whose spans share bytes or are equal.

    Each span goes to the blocks that it reaches into and meets what is there; a pair counts in the first block of both. So the work follows
    the pairs that meet, not findings times labels, and a path with very many of them is spread over its blocks.
    """

    def dealt(df: DataFrame, start: str, end: str, first: str) -> DataFrame:
        at = lambda x: F.floor(x / block).cast("long")
        last = F.greatest(at(F.col(start)), at(F.col(end) - 1))
        return df.withColumn(first, at(F.col(start))).withColumn("block", F.explode(F.sequence(first, last)))

    both = dealt(f, "start", "end", "f_first").join(dealt(g, "l_start", "l_end", "g_first"), ["path", "block"])
    equal = (F.col("start") == F.col("l_start")) & (F.col("end") == F.col("l_end"))
    shared = F.least("end", "l_end") > F.greatest("start", "l_start")
    return both.where((F.col("block") == F.greatest("f_first", "g_first")) & (equal | shared)).drop("block", "f_first", "g_first")


def classify(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Every finding (finding_id, path, start, end) with its class: tp, fp, duplicate or unlocalized.

    labels: label_id, path, start, end, label (positive or negative). A label is met by the same span, else by one that covers half of it or more and is at
    most four times as wide. A finding that meets several labels, or touches one without meeting any, is not localized; later
    findings of a label or place are duplicates of the first in the order of finding_id.
    """
    f, g = findings.select("finding_id", "path", "start", "end"), labels.select("label_id", "path", F.col("start").alias("l_start"), F.col("end").alias("l_end"), "label")
    pairs = meetings(f, g).unionByName(f, allowMissingColumns=True)  # every finding has a row, with a label or without
    exact = (F.col("start") == F.col("l_start")) & (F.col("end") == F.col("l_end"))
    shared = F.when(F.col("label_id").isNotNull(), F.least("end", "l_end") - F.greatest("start", "l_start"))  # least() passes over nulls
    width = F.col("l_end") - F.col("l_start")
    overlap = (shared >= width * 0.5) & (F.col("end") - F.col("start") <= F.greatest(F.lit(1), width) * 4)
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("label_id", "label"))))
    seen = pairs.groupBy("finding_id", "path", "start", "end").agg(ids(exact).alias("exact"), ids(overlap).alias("near"), F.coalesce(F.max(shared > 0), F.lit(False)).alias("touches"))
    seen = seen.withColumn("met", F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("near")))
    lost = (F.size("met") > 1) | ((F.size("met") == 0) & F.col("touches"))
    seen = seen.select("finding_id", "path", "start", "end", F.transform("met", lambda x: x["label_id"]).alias("candidates"), lost.alias("lost"), F.get("met", F.lit(0))["label_id"].alias("label_id"), F.get("met", F.lit(0))["label"].alias("label"), (F.size("exact") > 0).alias("exact"))
    place = F.when(F.col("label_id").isNotNull(), F.concat(F.lit("label "), F.col("label_id").cast("string"))).otherwise(F.concat_ws(" ", F.lit("span"), "path", F.col("start").cast("string"), F.col("end").cast("string")))
    nth = F.row_number().over(Window.partitionBy("lost", place).orderBy("finding_id"))
    kind = F.when(F.col("lost"), "unlocalized").when(F.col("nth") > 1, "duplicate").when(F.col("label") == "positive", "tp").otherwise("fp")
    return seen.withColumn("nth", nth).select("finding_id", "path", "label_id", "exact", "candidates", kind.alias("class"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, unlocalized, duplicates, precision, recall, f1, negative_labels_flagged, negative_labels_unresolved.

    A negative label that a finding may mean which is not localized (one of several that it meets, or any of its path) is unresolved, not a true negative.
    """
    n = lambda k: F.count(F.when(F.col("class") == k, 1))
    seen = classify(findings, labels)
    negative = labels.where("label = 'negative'").select("path", F.col("label_id").alias("negative_id"))
    flagged = seen.where("class = 'fp' AND label_id IS NOT NULL").select(F.col("label_id").alias("negative_id")).distinct()
    lost = seen.where("class = 'unlocalized'").select("path", "candidates")
    named = lost.select(F.explode("candidates").alias("negative_id")).distinct().join(negative.select("negative_id"), "negative_id", "left_semi")
    anywhere = negative.join(lost.where(F.size("candidates") == 0).select("path").distinct(), "path", "left_semi").select("negative_id")
    open_ = named.unionByName(anywhere).distinct().join(flagged, "negative_id", "left_anti")
    got = seen.agg(n("tp").alias("tp"), n("fp").alias("fp"), n("unlocalized").alias("unlocalized"), n("duplicate").alias("duplicates"))
    kinds = (F.count(F.when(F.col("label") == k, 1)).alias(k) for k in ("positive", "negative"))
    counted = (flagged.agg(F.count("*").alias("negative_labels_flagged")), open_.agg(F.count("*").alias("negative_labels_unresolved")))
    one = got.crossJoin(labels.agg(*kinds)).crossJoin(counted[0]).crossJoin(counted[1])  # one row each
    one = one.withColumn("precision", _share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _share(F.col("tp"), F.col("positive")))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).when(F.col("positive") > 0, 0.0)
    tn = F.col("negative") - F.col("negative_labels_flagged") - F.col("negative_labels_unresolved")
    return one.select(
        "tp", "fp", (F.col("positive") - F.col("tp")).alias("fn"), tn.alias("tn"), "unlocalized", "duplicates", "precision", "recall", f1.alias("f1"),
        "negative_labels_flagged", "negative_labels_unresolved",
    )


def recall_by(findings: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """Of the positive labels, for each value of a label column such as provider or group (null: unspecified): (by, total, tp, recall)."""
    met = classify(findings, labels).where("class = 'tp'").select("label_id", F.lit(1).alias("met"))
    each = labels.where("label = 'positive'").select("label_id", F.coalesce(F.col(by).cast("string"), F.lit("unspecified")).alias(by))
    got = each.join(met, "label_id", "left").groupBy(by).agg(F.count("*").alias("total"), F.count("met").alias("tp"))
    return got.select(by, "total", "tp", _share(F.col("tp"), F.col("total")).alias("recall"))


def missed(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """The positive labels that no finding meets."""
    met = classify(findings, labels).where("class = 'tp'").select("label_id")
    return labels.where("label = 'positive'").join(met, "label_id", "left_anti")
