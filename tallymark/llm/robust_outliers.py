"""Quality rules: multivariate outliers by the minimum covariance determinant, in DataFrame functions only.

Each document has a vector of transformed statistics. It is judged by the estimate of its language and
source; by that of all rows of its language, where the pair has under LEAST rows; by that of all rows, where the language has.
An estimate is sought from several starts: medians with median deviations, mean and covariance of all rows, medians with
the covariance of directions, and the rows on either side of each statistic's median, which parts rows of two kinds. From each, concentration steps take the half with the least Mahalanobis distances
and estimate mean and covariance from it, until the determinant falls no more. The start that ends with the least
determinant counts; a last step uses all rows within INNER. All are grouped sums and sketched quantiles, so no group is gathered.
Documents beyond OUTER from their group's estimate are rejected.

Null texts have no words and fail the base rules, as do others under FEWEST words
or with too many repeated ones; these take no part in the estimates. Null languages and sources are
groups of their own. Rows are judged one by one, repeated ones alike; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, settle, small, words

WINDOW, FEWEST, REPEATED = 8, 20, 30
#: Least rows of a group with estimates of its own.
LEAST = 50
#: A step counts if it lowers the determinant's logarithm by this much.
FALL = 1e-3
#: For half of the rows and four statistics: median of chi-square, and its share of the variance.
DIM, HALF = 4, 0.5
CONSISTENT = 2.113
#: Squared distances: chi-square's 0.975 quantile, and the bound of rejection (chance 1e-9 if normal).
INNER, OUTER = 11.143, 48.0
#: Least spread of each statistic: many have none at all in half of the documents.
FLOORS = (0.06, 0.35, 0.5, 0.7)
NAMES = ("x0", "x1", "x2", "x3")


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words from column w: words in windows that the text has twice."""
    n = F.size("w")
    one = docs.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))

    def doubled(name: str, step: int) -> Column:
        return F.zip_with(name, F.slice(name, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    two = one.withColumn("h2", doubled("h1", 1)).drop("h1")
    four = two.withColumn("h4", doubled("h2", 2)).drop("h2")
    eight = four.withColumn("h8", F.slice(doubled("h4", 4), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))).drop("h4")
    twice = F.size(F.array_distinct("h8")) < F.size("h8")
    zipped = F.sort_array(F.arrays_zip(F.col("h8").alias("h"), F.sequence(F.lit(0), F.size("h8") - 1).alias("p")))
    ordered = eight.withColumn("s", F.when(twice, zipped)).drop("h8")

    def again(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("s", i - 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))

    at = F.sort_array(F.transform(F.filter("s", again), lambda x: x["p"]))
    placed = ordered.withColumn("at", F.when(F.col("s").isNotNull(), at)).drop("s")
    gaps = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, b: a + b)
    return placed.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), covered).otherwise(F.lit(0)).cast("bigint")).drop("at")


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    source_col: str = "source") -> DataFrame:
    """id, lang, source, the base counts and base_failed."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("id", "lang", "source", words(F.col("t")).alias("w"), lines.alias("lines"),
                       F.length(F.regexp_replace("t", SPACE, "")).cast("bigint").alias("word_chars"),
                       (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"))
    rows = rows.withColumn("n_lines", F.size("lines")) \
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")).drop("lines")
    rows = _repeats(rows).withColumn("n_words", F.size("w").cast("bigint")).drop("w")
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vectors(rows: DataFrame) -> DataFrame:
    """Adds the transformed statistics; logarithms make shares of a few per cent comparable."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return rows.withColumns({
        # The mean word length, drawn to 5 as by 50 more words: short texts vary more.
        "x0": F.log((chars + 250.0) / (n + 50.0)),
        "x1": F.log1p(100.0 * F.col("n_symbols") / F.greatest(chars, F.lit(50))),
        "x2": F.log1p(100.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(10))),
        "x3": F.log1p(100.0 * F.col("n_repeat_words") / F.greatest(n, F.lit(50))),
    })


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with g, the group whose estimate judges the row; and the rows that make the estimates, once for each group that
    they are in and that judges somebody."""
    pair, lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    rows = rows.withColumns({"pair": pair, "language": lang})
    passed = rows.where("not base_failed")
    pairs = passed.groupBy("pair", "language").agg(F.count("*").alias("k"))
    langs = pairs.groupBy("language").agg(F.sum("k").alias("l")).withColumnRenamed("language", "language2")
    chosen = pairs.join(langs, F.col("language") == F.col("language2")).select(
        F.col("pair").alias("pair2"), F.col("language").alias("language2"),
        F.when(F.col("k") >= LEAST, F.col("pair")).when(F.col("l") >= LEAST, F.col("language")).otherwise("").alias("g"))
    chosen = settle(chosen, "groups")
    judged = rows.join(small(chosen.drop("language2")), F.col("pair") == F.col("pair2"), "left").drop("pair2")
    makers = [judged.where("not base_failed and g = pair").select("g", *NAMES)]
    for name, wanted in (("language", "g = language2"), (None, "g = ''")):
        used = settle(chosen.where(wanted).select(F.col("g").alias("used")).distinct(), "used")
        if not used.isEmpty():
            own = F.col(name) if name else F.lit("")
            all_of = passed.select(own.alias("g"), *NAMES)
            makers.append(all_of.join(small(used), F.col("g") == F.col("used"), "left_semi"))
    return judged.drop("pair", "language"), reduce(DataFrame.union, makers)


def _cholesky(groups: DataFrame) -> DataFrame:
    """Adds l00 ... l33, the lower factor of the covariance c00 ... c33, entry by entry."""
    for j in range(DIM):
        for i in range(j, DIM):
            rest = F.col(f"c{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            entry = F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}")
            groups = groups.withColumn(f"l{i}{j}", entry)
    size = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, DIM)), F.log(F.col("l00")))
    return groups.select("g", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)], size.alias("size"))


def _measured(rows: DataFrame, factors: DataFrame, how: str = "left") -> DataFrame:
    """Adds d, the squared Mahalanobis distance, by forward substitution; null without an estimate."""
    factors = factors.withColumnRenamed("g", "g2")
    out = rows.join(small(factors), F.col("g") == F.col("g2"), how)
    total = F.lit(0.0)
    for i in range(DIM):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return out.withColumn("d", total).drop("g2", *factors.columns, *[f"z{i}" for i in range(DIM)])


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    """Means and covariances, these times scale and with the floors on the diagonal, of each group's rows."""
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(NAMES)]
    sums += [F.covar_pop(NAMES[i], NAMES[j]).alias(f"p{i}{j}") for i in range(DIM) for j in range(i, DIM)]
    got = rows.groupBy("g").agg(*sums)
    cov = [(F.col(f"p{i}{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i, DIM)]
    return got.select("g", *[f"m{i}" for i in range(DIM)], *cov)


#: Starts of a group's estimate.
STARTS = 3 + 2 * DIM


def _starts(rows: DataFrame) -> DataFrame:
    """STARTS factors for each group g of the rows, as groups `0 g`, `1 g` and so on."""
    mid = settle(rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 2000).alias(f"m{i}") for i, x in enumerate(NAMES)]), "medians")
    apart = rows.join(small(mid.withColumnRenamed("g", "g2")), F.col("g") == F.col("g2"))
    spread = [F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 2000).alias(f"s{i}") for i, x in enumerate(NAMES)]
    spread = settle(apart.groupBy("g", *[f"m{i}" for i in range(DIM)]).agg(*spread), "spreads")
    zero = {f"c{i}{j}": F.lit(0.0) for i in range(DIM) for j in range(i + 1, DIM)}
    wide = [F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[i] ** 2) for i in range(DIM)]
    plain = spread.withColumns({f"c{i}{i}": F.pow(wide[i], 2) for i in range(DIM)} | zero)
    # Directions from the median, in units of the spreads: no row weighs more than another.
    led = rows.join(small(spread.withColumnRenamed("g", "g2")), F.col("g") == F.col("g2"))
    led = led.withColumns({f"z{i}": (F.col(x) - F.col(f"m{i}")) / wide[i] for i, x in enumerate(NAMES)})
    far = F.greatest(F.sqrt(sum((F.pow(f"z{i}", 2) for i in range(1, DIM)), F.pow("z0", 2))), F.lit(1e-9))
    kept = ["g", *[f"{k}{i}" for k in "ms" for i in range(DIM)]]
    sides = led.groupBy(*kept).agg(*[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / far / far).alias(f"p{i}{j}") for i in range(DIM) for j in range(i, DIM)])
    sides = sides.withColumns({f"c{i}{j}": DIM * F.col(f"p{i}{j}") * wide[i] * wide[j] for i in range(DIM) for j in range(i, DIM)})
    three = [_cholesky(x) for x in (plain, _moments(rows, 1.0), sides)]
    three = [x.withColumn("g", F.concat(F.lit(f"{k} "), "g")) for k, x in enumerate(three)]
    held = [F.when(beyond, F.lit(3 + 2 * i + k)) for i, x in enumerate(NAMES)
            for k, beyond in enumerate((F.col(x) <= F.col(f"m{i}"), F.col(x) >= F.col(f"m{i}")))]
    halves = apart.withColumn("start", F.explode(F.array_compact(F.array(*held)))).withColumn("g", F.concat_ws(" ", F.col("start").cast("string"), "g"))
    return reduce(DataFrame.union, [*three, _cholesky(_moments(halves, 1.0))])


def _concentrated(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """The factors that the half of each group's rows with the least distances from `factors` has."""
    near = _measured(rows, factors, "inner")
    half = settle(near.groupBy("g").agg(F.percentile_approx("d", HALF, 2000).alias("most")), "halves")
    inner = near.join(small(half.withColumnRenamed("g", "g2")), F.col("g") == F.col("g2")).where("d <= most")
    return settle(_cholesky(_moments(inner, CONSISTENT)), "factors")


def estimates(rows: DataFrame) -> DataFrame:
    """The mean and covariance factor of each group of rows (g, x0 ... x3)."""
    tried = rows.withColumn("g", F.explode(F.array(*[F.concat(F.lit(f"{k} "), "g") for k in range(STARTS)])))
    # The first step leaves the starts, whose determinants mean nothing.
    now = _concentrated(tried, settle(_starts(rows), "starts"))
    done = [now]
    while True:
        new = _concentrated(tried, now)
        old = now.select(F.col("g").alias("g2"), F.col("size").alias("before"))
        better = settle(new.join(small(old), F.col("g") == F.col("g2")).where(F.col("size") < F.col("before") - FALL).drop("g2", "before"), "better")
        if better.isEmpty():
            break
        done.append(better)
        now = better
    best = reduce(DataFrame.union, done).withColumn("g", F.expr("substring(g, instr(g, ' ') + 1)"))
    names = [c for c in best.columns if c != "g"]
    least = F.min_by(F.struct(*names), "size").alias("best")
    factors = settle(best.groupBy("g").agg(least).select("g", "best.*"), "best")
    last = settle(_cholesky(_moments(_measured(rows, factors).where(F.col("d") <= INNER), 1.0)), "factors")
    return last


def judge(docs: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, distance (null if base_failed), kept."""
    rows, makers = _grouped(settle(vectors(base_statistics(docs, id_col, **columns)), "statistics"))
    out = _measured(rows, estimates(settle(makers, "makers"))).withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d")))
    kept = ~F.col("base_failed") & (F.col("d") <= OUTER)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "distance")
