"""Scores of a table against a trusted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.similarity import bigram_jaccard, fold_difference, within_tolerance
from assayline.functions.text import has_number, is_na
from assayline.operators.assignment import assignment_join, count_matches, equality
from assayline.runtime import discard, materialise


def _rates(tp: Column, wrong: Column, left_only: Column, right_only: Column) -> dict[str, Column]:
    fp, fn = left_only + wrong, right_only + wrong
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall = over(tp, tp + fp), over(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": over(2 * precision * recall, precision + recall), "accuracy": over(tp, tp + fp + fn)}


def exact_precision_recall(ours: DataFrame, theirs: DataFrame, value: str, keys: list[str], digits: int = 6) -> DataFrame:
    """One row: tp, wrong, left_only, right_only, num_keys (keys of both), precision, recall, f1, accuracy; by counting, no solver."""
    per = count_matches(ours, theirs, keys, value, digits)
    sums = per.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "wrong", "left_only", "right_only")], F.count_if(F.col("in_left") & F.col("in_right")).alias("num_keys")
    )
    return sums.withColumns(_rates(F.col("tp"), F.col("wrong"), F.col("left_only"), F.col("right_only")))


def matched_rows(ours: DataFrame, theirs: DataFrame, value: str, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """The rows behind those numbers, by the assignment join, with a column outcome (tp, wrong, left_only, right_only)."""
    some = lambda df: df.filter(F.col(value).isNotNull())
    pairs = assignment_join(some(ours), some(theirs), keys, equality(value, tolerance), "outer", objective_column="z")
    a, b = F.col(f"{value}_1"), F.col(f"{value}_2")
    return pairs.withColumn("outcome", F.when(a.isNull(), "right_only").when(b.isNull(), "left_only").when(F.col("z") == 1, "tp").otherwise("wrong"))


def off_by(ours: DataFrame, theirs: DataFrame, value: str, keys: list[str], factors: list[float], digits: int = 6) -> DataFrame:
    """(factor, tp) per pass: rows that agree exactly (factor 1), then of the rest those that agree after scaling by each factor.

    Counting passes over (key, value) multiplicities; a factor accepts a = b * f or a * f = b. Each side is counted once.
    What is left after the exact pass meets in one join on the scaled value, with the pass as a column; scaled values outside
    the range of their key's left values meet nothing and stay out of it. Candidates whose two values have no other candidate
    are counted at once; among the others the passes take theirs in turn, each from what the one before has left, so no plan
    grows with the passes. Several right values may scale to one left value: the smallest that has rows left is taken.
    No side of a join is broadcast: the tables between the steps take far more memory than their compressed files tell.
    """
    spark = ours.sparkSession
    passes = [1.0, *[g for x in factors for g in (x, 1 / x)]]

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.round(value, digits).alias("__v")).agg(F.count(F.lit(1)).alias(name))

    def same_keys(a: str, b: str) -> list[Column]:
        return [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]

    both = counted(ours, "__n").alias("l").join(counted(theirs, "__m").alias("r"), [*same_keys("l", "r"), F.col("l.__v") == F.col("r.__v")], "full")
    n, m = F.coalesce("__n", F.lit(0)), F.coalesce("__m", F.lit(0))
    rest = materialise(both.select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], F.coalesce("l.__v", "r.__v").alias("__v"), F.least(n, m).alias("__t"), (n - F.least(n, m)).alias("__n"), (m - F.least(n, m)).alias("__m"),
    ), "off-by-rest")
    tp = {0: rest.agg(F.coalesce(F.sum("__t"), F.lit(0))).first()[0]}
    if len(passes) > 1:
        left = rest.filter("__n > 0").select(*keys, "__v", "__n")
        span = left.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        scaled = F.explode(F.array(*[F.struct(F.lit(k).alias("p"), F.round(F.col("__r") * f, digits).alias("w")) for k, f in enumerate(passes) if k]))
        right = rest.filter("__m > 0").select(*keys, F.col("__v").alias("__r"), "__m").join(span.hint("merge"), keys or None).withColumn("__s", scaled).filter("__s.w between __low and __high")
        right = materialise(right.select(*keys, "__r", "__m", "__s.*"), "off-by-right")  # the shuffle files of this step go before the next one's come
        met = left.alias("l").join(right.hint("merge").alias("r"), [*same_keys("l", "r"), F.col("l.__v") == F.col("r.w")])
        met = met.select(*[F.col(f"l.{k}").alias(k) for k in keys], "__v", "__r", "__n", "__m", "p")
        for side in ("__v", "__r"):
            met = met.withColumn(f"__of{side}", F.count(F.lit(1)).over(Window.partitionBy(*keys, side)))
        met = materialise(met.withColumn("__alone", (F.col("__of__v") == 1) & (F.col("__of__r") == 1)).drop("__of__v", "__of__r"), "off-by-met")
        discard(right)
        tp |= {p: n for p, n in met.filter("__alone").groupBy("p").agg(F.sum(F.least("__n", "__m"))).collect()}
        now, old = met.filter("not __alone").drop("__alone"), met
        for k in sorted(r["p"] for r in now.select("p").distinct().collect()):
            first = now.filter((F.col("p") == k) & (F.col("__n") > 0) & (F.col("__m") > 0)).groupBy(*keys, "__v").agg(F.min(F.struct("__r", F.least("__n", "__m").alias("__t"))).alias("__s"))
            taken = materialise(first.select(*keys, "__v", "__s.*"), "off-by-taken")
            tp[k] = tp.get(k, 0) + taken.agg(F.coalesce(F.sum("__t"), F.lit(0))).first()[0]
            now = now.filter(F.col("p") > k)
            for side, left_over in (("__v", "__n"), ("__r", "__m")):
                gone = taken.groupBy(*keys, side).agg(F.sum("__t").alias("__g"))
                now = now.join(gone.hint("merge"), [*keys, side], "left").withColumn(left_over, F.col(left_over) - F.coalesce("__g", F.lit(0))).drop("__g")
            now = materialise(now, "off-by-met")
            discard(old, taken)
            old = now
        discard(old)
    discard(rest)
    got = [(max(f, 1 / f), tp.get(k, 0)) for k, f in enumerate(passes)]
    return spark.createDataFrame(got, "factor double, tp bigint").groupBy("factor").agg(F.sum("tp").alias("tp"))


def presence_precision_recall(df: DataFrame, ours: str, theirs: str, feedback: list[str]) -> DataFrame:
    """One row: pp (both present), tp (pp without feedback), wrong, fp (ours only), fn (theirs only) and rates."""
    a, b = F.col(ours).isNotNull(), F.col(theirs).isNotNull()
    clean = F.lit(True)
    for c in feedback:
        clean = clean & F.col(c).isNull()
    sums = df.agg(F.count_if(a & b).alias("pp"), F.count_if(a & b & clean).alias("tp"), F.count_if(a & b & ~clean).alias("wrong"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"))
    rate = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    return sums.withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp") + F.col("wrong")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn"))})


def report(scores: DataFrame) -> DataFrame:
    """(name, value) of a table of one row of numbers, a line per score."""
    return scores.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in scores.columns])).alias("s")).select("s.*")


def mean_log_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean |log10(a / b)| over rows with both, neither 0 nor 1e9 or more; 0 if there are none."""
    x, y = F.col(a), F.col(b)
    return df.filter((x < 1e9) & (y < 1e9) & (x != 0) & (y != 0)).agg(F.coalesce(F.avg(F.abs(F.log10(x / y))), F.lit(0.0)).alias("mean_log_ratio"))


def mean_bigram_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.coalesce(F.avg(bigram_jaccard(F.col(a), F.col(b))), F.lit(1.0)).alias("mean_jaccard"))


def agreement(df: DataFrame, pairs: list[tuple[str, str]], feedback: list[str], allow_missing: bool = True) -> DataFrame:
    """(agreement, total): rows with some reference value, and those of them that have a number where the reference has one."""
    some, agree = F.lit(False), F.lit(True)
    for ours, theirs in pairs:
        a, b = has_number(F.col(ours)), has_number(F.col(theirs))
        some = some | b
        agree = agree & ((a == b) | (~b if allow_missing else F.lit(False)))
    for c in feedback:
        agree = agree & is_na(F.col(c))
    return df.agg(F.count_if(some & agree).alias("agreement"), F.count_if(some).alias("total"))


def keep_perfect(df: DataFrame, key: str, ok: Column) -> DataFrame:
    """All rows of the keys in which every row is ok (null counts as not)."""
    good = df.groupBy(key).agg(F.every(F.coalesce(ok, F.lit(False))).alias("__ok")).filter("__ok").select(key)
    return df.join(good, key, "left_semi")


def correlations(df: DataFrame, a: str, b: str, key: str | None = None) -> DataFrame:
    """One row over positive pairs: n, R2 (1 - SSres / SStot), Pearson and Spearman on log10, MAE, RMSE, accuracy.

    Ranks are averaged over ties from counts per value: a running sum over distinct values, not over rows.
    """
    rows = df.filter((F.col(a) > 0) & (F.col(b) > 0)).select(*([key] if key else []), F.log10(a).alias("x"), F.log10(b).alias("y"))

    def ranks(c: str) -> DataFrame:
        n = rows.groupBy(c).agg(F.count(F.lit(1)).alias("__c"))
        # Two levels: values are dealt to ranges by floor, then ranked inside; range totals are few.
        n = n.withColumn("__g", F.floor(F.col(c) * 64))
        inside = Window.partitionBy("__g").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        over = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
        ahead = n.groupBy("__g").agg(F.sum("__c").alias("__s")).select("__g", F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__s"))
        n = n.withColumn("__b", F.coalesce(F.sum("__c").over(inside), F.lit(0))).join(ahead, "__g")
        return n.select(c, (F.col("__s") + F.col("__b") + (F.col("__c") + 1) / 2).alias(f"r{c}"))

    full = rows.join(ranks("x"), "x").join(ranks("y"), "y")
    gap = F.col("x") - F.col("y")
    aggs = [
        F.count(F.lit(1)).alias("n"), (1 - F.sum(F.pow(gap, F.lit(2))) / F.nullif(F.var_pop("y") * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
        F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(F.pow(gap, F.lit(2)))).alias("rmse"),
        F.avg((F.abs(gap) < 0.0211892991).cast("double")).alias("accuracy"),
    ]
    if key:
        aggs.append(F.count_distinct(key).alias("n_keys"))
    return full.agg(*aggs)


def decode_objective(df: DataFrame, col: str) -> DataFrame:
    """same_enzyme, same_mutant, same_substrate from a weighted objective, by its thousands, hundreds and tens."""
    n = F.col(col).cast("int")
    return df.withColumns({"same_enzyme": n % 10000 >= 8000, "same_mutant": n % 1000 >= 800, "same_substrate": n % 100 >= 80})


def different_mutants(df: DataFrame, a: str, b: str, same: str = "same_mutant") -> DataFrame:
    """same_mutant becomes null unless the mutants are the same or known to differ."""
    differ = (F.size(a) > 0) & (F.size(b) > 0) & ~F.col(same)
    return df.withColumn("different_mutant", differ).withColumn(same, F.when(F.col(same) | differ, F.col(same)))


def add_fold(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"{n}_diff": fold_difference(F.col(f"{n}_1"), F.col(f"{n}_2")) for n in names})


def close_share(df: DataFrame, a: str, b: str, tolerance: float = 1e-6) -> DataFrame:
    return df.agg(F.sum(within_tolerance(F.col(a), F.col(b), tolerance)).alias("close"), F.count(F.lit(1)).alias("total"))


def compare_tables(a: DataFrame, b: DataFrame, key: str, complete: list[str], values: list[str]) -> DataFrame:
    """One row: keys of a, of b and of both, complete rows and non-null values of each."""

    def counted(df: DataFrame, s: str) -> DataFrame:
        full = F.lit(True)
        for c in complete:
            full = full & F.col(c).isNotNull()
        return df.agg(F.count_distinct(key).alias(f"keys_{s}"), F.count_if(full).alias(f"complete_{s}"), *[F.count(v).alias(f"{v}_{s}") for v in values])

    both = a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("keys_both"))
    # Three tables of one row each, side by side.
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(counted(a, "a")).join(one(counted(b, "b")), "__one").join(one(both), "__one").drop("__one")


def diversity(df: DataFrame, lists: list[str]) -> DataFrame:
    """(value) distinct over several list columns, null lists counting as empty."""
    empty = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(F.col(c).cast("array<string>"), empty) for c in lists])
    return df.select(F.explode(F.array_distinct(every)).alias("value")).distinct()


def all_matched(df: DataFrame, key: str, value: str, names: list[str]) -> DataFrame:
    """Keys in which every row with a value has all names."""
    full = F.lit(True)
    for n in names:
        full = full & F.col(n).isNotNull()
    return df.groupBy(key).agg(F.every(F.col(value).isNull() | full).alias("__ok")).filter("__ok").select(key)
