"""As-of, cascade, dictionary, synonym, box-overlap and top-k joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.fuzzy import ratio


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, width: float, tolerance: float | None = None) -> DataFrame:
    """left with `on`_right: the nearest value of right with equal keys, the larger of two equally near; null if none.

    Values are dealt to cells of `width`; a row looks first at its own and the neighbouring cells, so a hot key's rows
    don't all meet. That takes a tolerance, at most width. Without one, `width` has no part: a window over each key's
    rows of both tables finds the next values below and above, so a key's rows meet in one task.
    """
    if tolerance is not None and tolerance > width:
        raise ValueError("tolerance must not exceed width")
    row = left.withColumn("__row", F.monotonically_increasing_id())
    if tolerance is None:
        lo = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hi = Window.partitionBy(*by).orderBy(F.desc(on), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = row.withColumn("__side", F.lit(1)).unionByName(right.select(*by, on).distinct().withColumn("__side", F.lit(0)), allowMissingColumns=True)
        own = F.when(F.col("__side") == 0, F.col(on))
        both = both.withColumn("__lo", F.last(own, ignorenulls=True).over(lo)).withColumn("__hi", F.last(own, ignorenulls=True).over(hi))
        pick = F.when(F.col("__lo").isNull() | (F.abs(F.col("__hi") - F.col(on)) <= F.abs(F.col(on) - F.col("__lo"))), F.coalesce("__hi", "__lo")).otherwise(F.col("__lo"))
        return both.filter("__side = 1").select(*left.columns, pick.alias(f"{on}_right"))
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    spread = row.select(*by, "__row", F.col(on).alias("__l"), F.explode(F.array(*[cell(F.col(on)) + d for d in (-1, 0, 1)])).alias("__cell"))
    cells = right.select(*by, F.col(on).alias("__r"), cell(F.col(on)).alias("__cell")).distinct()
    gap = F.abs(F.col("__l") - F.col("__r"))
    near = spread.join(cells, [*by, "__cell"]).filter(gap <= tolerance)
    near = near.groupBy("__row").agg(F.min_by("__r", F.struct(gap, -F.col("__r"))).alias(f"{on}_right"))
    return row.join(near, "__row", "left").drop("__row")


def asof_scores(left: DataFrame, right: DataFrame, by: list[str], on: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: tp, wrong, left_only of the nearest match within a relative tolerance (see asof_nearest on hot keys)."""
    found = asof_nearest(left.filter(F.col(on).isNotNull()), right.filter(F.col(on).isNotNull()), by, on, 1.0)
    gap = F.abs(F.col(on) - F.col(f"{on}_right")) / F.nullif(F.greatest(F.abs(F.col(on)), F.abs(F.col(f"{on}_right"))), F.lit(0.0))
    close = (F.col(on) == F.col(f"{on}_right")) | (gap < tolerance)
    return found.agg(F.count_if(close).alias("tp"), F.count_if(~close).alias("wrong"), F.count_if(F.col(f"{on}_right").isNull()).alias("left_only"))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after raising if keys repeat (a many-to-one join's guard)."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"keys are not unique: {twice[0]}")
    return df


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys meet; right's key columns don't appear twice."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = left.join(r, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how)
    return joined.drop(*[f"__{k}" for k in keys])


def cascade(df: DataFrame, steps: list[tuple[DataFrame, list[str], bool]], fill: list[str], unique: bool = True) -> DataFrame:
    """Left joins in order of priority; each step's columns of `fill` complete what earlier ones left null, column by column.

    steps: (table, keys, null-safe). Tables are reduced to keys and fill columns; with `unique` repeated keys raise.
    """
    for c in fill:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(next(t.schema[c].dataType for t, _, _ in steps if c in t.columns)))
    for table, keys, safe in steps:
        some = [c for c in fill if c in table.columns]
        t = table.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in some])
        if unique:
            check_unique(t, keys)
        df = null_safe(df, t, keys) if safe else df.join(t, keys, "left")
        df = df.withColumns({c: F.coalesce(c, f"__new_{c}") for c in some}).drop(*[f"__new_{c}" for c in some])
    return df


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def lookup_lists(df: DataFrame, key: Column, columns: list[str], name: str = "key") -> DataFrame:
    """A dictionary: distinct non-null values of columns per key, sorted, so that equal lists are equal; empty lists are null."""
    out = df.groupBy(key.alias(name)).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])
    return out.select(name, *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in columns])


def add_codes(df: DataFrame, table: DataFrame, names: list[str], target: str, alias: str = "alias", codes: str = "codes") -> DataFrame:
    """target: the code list of the first name that the table knows, by exact then by lower-cased spelling."""
    exact = table.groupBy(F.col(alias).alias("__a")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(codes)))).alias("__x"))
    lower = table.groupBy(F.lower(alias).alias("__a")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(codes)))).alias("__x"))
    found = []
    for k, n in enumerate(names):
        for j, (t, c) in enumerate(((exact, F.col(n)), (lower, F.lower(n)))):
            col = f"__x{k}{j}"
            df = df.withColumn("__n", c).join(t.withColumnsRenamed({"__x": col}), F.col("__n") == F.col("__a"), "left").drop("__a", "__n")
            found.append(col)
    return df.withColumn(target, F.coalesce(*found)).drop(*found)


def name_keys(df: DataFrame, key: list[str], full: str, synonyms: str, pkey: str) -> tuple[DataFrame, DataFrame]:
    """(df with a surrogate key, names): names has (key columns, name, pkey, is_synonym), null names left out."""
    keyed = df.withColumn(pkey, F.xxhash64(*key, full, F.array_join(synonyms, "\x1f")))
    own = keyed.select(*key, F.col(full).alias("name"), pkey, F.lit(False).alias("is_synonym"))
    other = keyed.select(*key, F.explode(synonyms).alias("name"), pkey, F.lit(True).alias("is_synonym"))
    return keyed, own.unionByName(other).filter(F.col("name").isNotNull())


def join_context(data: DataFrame, ctx: DataFrame, key: list[str], name: str, full: str = "fullname", synonyms: str = "synonyms", prefix: str = "ctx_") -> DataFrame:
    """data left-joined with the context whose full name or synonym is data's name; a name listed twice gives two rows."""
    keyed, names = name_keys(ctx, key, full, synonyms, "__pkey")
    found = names.select(*key, F.col("name").alias(name), "__pkey").distinct()
    rest = [c for c in ctx.columns if c not in key]
    return data.join(found, [*key, name], "left").join(keyed.select("__pkey", *[F.col(c).alias(prefix + c) for c in rest]).dropDuplicates(["__pkey"]), "__pkey", "left").drop("__pkey")


def join_fragments(data: DataFrame, ctx: DataFrame, key: list[str], fragments: str, data_key: str, out: str = "ctx_keys") -> DataFrame:
    """data with the sorted surrogate keys of all contexts that one of its fragments names exactly."""
    _, names = name_keys(ctx, key, "fullname", "synonyms", "__pkey")
    hits = data.select(*key, data_key, F.explode(fragments).alias("name")).join(names.select(*key, "name", "__pkey"), [*key, "name"])
    return data.join(hits.groupBy(data_key).agg(F.array_sort(F.collect_set("__pkey")).alias(out)), data_key, "left")


def overlap_share(box: list[Column], other: list[Column]) -> Column:
    """Area of the intersection over the area of the first box (x0, y0, x1, y1); 0 if that has no area."""
    w = F.greatest(F.least(box[2], other[2]) - F.greatest(box[0], other[0]), F.lit(0.0))
    h = F.greatest(F.least(box[3], other[3]) - F.greatest(box[1], other[1]), F.lit(0.0))
    area = (box[2] - box[0]) * (box[3] - box[1])
    return F.when(area == 0, 0.0).otherwise(w * h / area)


def unit_replacements(words: DataFrame, boxes: DataFrame, page: list[str], pattern: str = r"(?i)\bmM\b", least: float = 0.5) -> DataFrame:
    """words with replacement: the word with µM for what matches where it overlaps a `mu` box, else with mM for an `m` box, else null."""
    row = words.withColumn("__row", F.monotonically_increasing_id())
    b = boxes.select(*page, *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")], F.col("real_char").alias("__char"))
    # The letter's box lies in the word's.
    share = overlap_share([F.col(f"__{c}") for c in ("x0", "y0", "x1", "y1")], [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    hits = row.filter(F.col("word").rlike(pattern)).join(b, page).filter(share > least)
    hits = hits.groupBy("__row").agg(F.when(F.bool_or(F.col("__char") == "mu"), "µM").when(F.bool_or(F.col("__char") == "m"), "mM").alias("__unit"))
    found = row.join(hits, "__row", "left")
    fixed = F.when(F.col("__unit") == "µM", F.regexp_replace("word", pattern, "µM")).when(F.col("__unit") == "mM", F.regexp_replace("word", pattern, "mM"))
    return found.withColumn("replacement", fixed).drop("__row", "__unit")


def page_text(words: DataFrame, page: list[str], number: str = "wordno", word: str = "word", line_start: str | None = None) -> DataFrame:
    """One text per page: words in order, joined by a space, or a newline before the first word of a line."""
    gap = F.when(F.col(line_start), F.lit("\n")).otherwise(F.lit(" ")) if line_start else F.lit(" ")
    items = F.array_sort(F.collect_list(F.struct(F.col(number).alias("k"), gap.alias("g"), F.col(word).alias("w"))))
    return words.groupBy(*page).agg(F.ltrim(F.array_join(F.transform(items, lambda x: F.concat(x["g"], x["w"])), "")).alias("text"))


def similar_names(queries: DataFrame, names: DataFrame, query: str, name: str, n: int = 5, least: float = 50.0) -> DataFrame:
    """(query, name, similarity): case-insensitive hits with 100, else the n most similar names, those over `least`.

    Every name is scored whose length allows the ratio (2 min / (a + b)): a common subsequence needs no common trigram, so
    no key finds them all. The work is queries times names; both are distinct first.
    """
    q = queries.select(F.col(query).alias("query")).filter(F.col("query").isNotNull()).distinct().withColumn("__q", F.lower("query"))
    d = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct().withColumn("__d", F.lower("name"))
    exact = q.join(d, F.col("__q") == F.col("__d")).select("query", "name", F.lit(100.0).alias("similarity"))
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    la, lb = F.char_length("__q"), F.char_length("__d")
    # The longest common subsequence is at most the shorter text.
    pairs = rest.join(d, 200.0 * F.least(la, lb) > F.lit(float(least)) * (la + lb))
    scored = pairs.withColumn("similarity", ratio("__q", "__d")).filter(F.col("similarity") > least)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "name")
    top = scored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).select("query", "name", "similarity")
    return exact.unionByName(top)


def two_sided_names(df: DataFrame, short: str, full: str, suffix: str = "_2") -> DataFrame:
    """(name, short_name) distinct, two rows for each input row: ours (full, else short alone) and theirs."""
    ours = F.struct(F.coalesce(full, short).alias("name"), F.when(F.col(full).isNotNull(), F.col(short)).alias("short_name"))
    theirs = F.struct(F.coalesce(full + suffix, short + suffix).alias("name"), F.when(F.col(full + suffix).isNotNull(), F.col(short + suffix)).alias("short_name"))
    return df.select(F.explode(F.array(ours, theirs)).alias("r")).select("r.*").filter("name is not null").distinct()


def first_ignoring_case(df: DataFrame, name: str, others: list[str], order: Column) -> DataFrame:
    """The first row of each (lower-cased name, others), its spelling kept."""
    return best_per_key(df.withColumn("__lower", F.lower(name)), ["__lower", *others], [order]).drop("__lower")


def last_wins(left: DataFrame, table: DataFrame, key: str, name: str, value: str, order: str) -> DataFrame:
    """left with value of its lower-cased key; of repeated names the last in order counts."""
    t = table.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("__k")).agg(F.max_by(value, order).alias(value))
    return left.withColumn("__l", F.lower(key)).join(t, F.col("__l") == F.col("__k"), "left").drop("__l", "__k")


def matched_numbers(ours: DataFrame, theirs: DataFrame, key: str, value: str, similarity) -> DataFrame:
    """(key, value_1, value_2, objective, ratio): distinct numbers of each key paired by a similarity of two number lists."""
    from assayline.operators.assignment import assignment_join

    some = lambda df: df.select(key, F.col(value).cast("double").alias("value")).filter("value is not null").distinct()
    pairs = assignment_join(some(ours), some(theirs), [key], similarity, "inner", objective_column="objective")
    both = F.col("value_1").isNotNull() & F.col("value_2").isNotNull()
    return pairs.withColumn("ratio", F.when(both, F.greatest("value_1", "value_2") / F.nullif(F.least("value_1", "value_2"), F.lit(0.0))))


def join_distances(rows: DataFrame, distances: DataFrame, key: str = "pmid", name: str = "enzyme", short: str = "short_name", order: str = "distance") -> DataFrame:
    """rows with the distance row of their name, else of their short name, else of the key's only name (first by order)."""
    d = distances.withColumn("__n", F.lower("enzyme_name"))
    first = best_per_key(d, [key, "__n"], [F.asc(order), F.asc("__n")])
    single = d.groupBy(key).agg(F.count_distinct("__n").alias("c"), F.min("__n").alias("only")).filter("c = 1").select(key, "only")
    wanted = rows.withColumn("__row", F.monotonically_increasing_id()).join(single, key, "left")
    tries = wanted.select("__row", key, F.posexplode(F.array(F.lower(name), F.lower(short), "only")).alias("p", "__n")).filter("__n is not null")
    hit = tries.join(first.drop("enzyme_name"), [key, "__n"]).drop(key, "__n")
    best = best_per_key(hit, ["__row"], [F.asc("p")]).drop("p")
    return wanted.join(best, "__row", "left").drop("__row", "only")
