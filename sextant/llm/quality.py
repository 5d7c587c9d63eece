"""Quality rules: base rules, then robust multivariate outliers per language and source.

Each document gets counts from its whole text, and from them a transformed statistic vector. For each (language, source) the
minimum-covariance-determinant estimate of centre and covariance is sought: from each of several deterministic starts (median and median
absolute deviation with no correlation, with that of the tanh of standardised statistics, and with that of their spatial signs),
concentration steps take the share `support` of rows nearest by Mahalanobis distance for the next centre and covariance until the
determinant no longer falls; two steps on, only the two best starts of a group go on; the estimate of least determinant is used. A
document is rejected if a base rule fails, or if its distance from the centre of its group, with the covariance made
consistent for normal data, is beyond the chi-squared quantile `confidence`. Groups with fewer than min_group rows use the
estimate of their whole language, and languages with fewer that of all rows; large groups count there too. Where there are fewer
than min_group rows in all, no estimate is made and only the base rules judge. All statistics are of all documents; only DataFrame
functions are used. The estimates are made from documents that pass the base rules, and min_group counts these.

Quantiles come from counts of fine buckets (a thousandth of a statistic, a 64th of a doubling of a distance), which add up in any order, so
a group that holds most rows is no task of its own. Rows meet the groups' estimates by a broadcast where the groups are counted to be
few, else by a shuffle with the largest groups broadcast.

Edge cases: a null or empty text has no words and fails the base rule; a null language or source is a group of its own; a null
doc_id is kept as it is; repeated rows are judged alike; an empty table gives no rows; other columns are ignored by
quality_verdicts and kept by drop_low_quality, whatever they are called.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import BROADCAST_GROUPS, identity, join_groups, let, materialize, table, words

SYMBOLS = "#*$%&|<>"
#: The transformed statistics, and the least standard deviation that each is given (so that a constant one can't reject small changes).
FEATURES = {"f_words": 0.25, "f_word_len": 0.04, "f_symbols": 0.5, "f_dup_lines": 0.05, "f_repeats": 0.1, "f_upper": 0.25}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]
#: Buckets of a statistic's unit and of a doubling of a squared distance.
UNIT, OCTAVE = 1000, 64


def _repeat_words(ws: Column) -> Column:
    """Words in 3-word windows that occur twice or more, first included; windows are compared as words, sorted by hash."""
    n = F.size(ws)
    pairs = F.zip_with(ws, F.slice(ws, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hashes = F.slice(F.zip_with(pairs, F.slice(ws, 3, n), lambda p, c: F.xxhash64(p["a"], p["b"], c)), 1, n - 2)
    keys = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    place = lambda k: k["i"]

    def same(a: Column, b: Column) -> Column:
        i, j = place(a), place(b)
        return (a["h"] == b["h"]) & reduce(lambda x, y: x & y, [F.get(ws, i + d) == F.get(ws, j + d) for d in range(3)])

    def covered(ks: Column) -> Column:
        hit = F.filter(ks, lambda k, i: F.coalesce(F.when(i > 0, same(k, F.get(ks, i - 1))), F.lit(False)) | F.coalesce(same(k, F.get(ks, i + 1)), F.lit(False)))
        at = F.sort_array(F.transform(hit, place))
        return let(at, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda s, x: s + x))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(keys, covered))


def text_counts(text: Column) -> Column:
    """A struct of the counts, from the whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _repeat_words(ws).alias("n_repeat_words"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    return let(words(t), counted)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _features() -> dict[str, Column]:
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return {
        "f_words": F.log(n + 1),
        "f_word_len": F.log((chars + 1) / (n + 1)),
        "f_symbols": F.log(1 + 100 * F.col("n_symbols") / (n + 1)),
        "f_dup_lines": F.col("n_dup_lines") / (n + 1),
        "f_repeats": F.col("n_repeat_words") / (n + 1),
        "f_upper": F.log(1 + 100 * F.col("n_upper") / (chars + 1)),
    }


def _chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-16:
        term *= x / (a + i)
        total += term
        i += 1
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def _whitening(c: Column, d: int) -> Column:
    """A struct of w, the inverse of the Cholesky factor of the covariances c, and log_det; matrices are the rows of a lower triangle in one array."""
    at = lambda i, j: (i * (i + 1) / 2 + j).cast("int")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(d) for j in range(i + 1)])
    none = F.array().cast("array<double>")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    row = lambda m, i, j: F.slice(m, at(i, F.lit(0)) + 1, j)  # noqa: E731  the first j numbers of row i

    def factor(l: Column, x: Column) -> Column:
        i, j = x["i"], x["j"]
        rest = F.get(c, at(i, j)) - total(F.zip_with(row(l, i, j), F.when(i == j, row(l, i, j)).otherwise(row(l, j, j)), lambda a, b: a * b))
        return F.concat(l, F.array(F.when(i == j, F.sqrt(F.greatest(rest, F.lit(1e-9)))).otherwise(rest / F.get(l, at(j, j)))))

    def inverse(l: Column) -> Column:
        def cell(w: Column, x: Column) -> Column:
            i, j = x["i"], x["j"]
            rest = total(F.transform(F.sequence(j, F.greatest(i - 1, j)), lambda k: F.when(k < i, F.get(l, at(i, k)) * F.get(w, at(k, j))).otherwise(0.0)))
            return F.concat(w, F.array(F.when(i == j, 1 / F.get(l, at(i, i))).otherwise(-rest / F.get(l, at(i, i)))))

        log_det = total(F.transform(F.array(*[F.lit(i) for i in range(d)]), lambda i: 2 * F.log(F.get(l, at(i, i)))))
        return F.struct(F.aggregate(cells, none, cell).alias("w"), log_det.alias("log_det"))

    return let(F.aggregate(cells, none, factor), inverse)


def _distance2(names: list[str], m: Column, w: Column) -> Column:
    """The squared Mahalanobis distance of a row from the centre m, with w of _whitening."""
    z = [F.col(n) - F.get(m, F.lit(i)) for i, n in enumerate(names)]
    rows = [reduce(lambda a, b: a + b, [F.get(w, F.lit(i * (i + 1) // 2 + j)) * z[j] for j in range(i + 1)]) for i in range(len(names))]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def _quantile(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys and at: the bucket in which the share of a group's rows is reached; counts: keys, bucket, n (as many rows as buckets)."""
    group = Window.partitionBy(*keys)
    so_far = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumns({"_to": so_far, "_all": F.sum("n").over(group)}).filter(F.col("_to") >= F.col("_all") * share)
    return reached.groupBy(*keys).agg(F.min("bucket").alias("at"))


def _bucket(distance2: Column) -> Column:
    return F.floor(F.log2(distance2 + 1e-12) * OCTAVE).cast("int")


def _medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """grp and an array of the median of each value over its rows."""
    each = rows.select("grp", F.posexplode(F.array(*[F.floor(v * UNIT).cast("long") for v in values])).alias("k", "bucket"))
    at = _quantile(each.groupBy("grp", "k", "bucket").agg(F.count("*").alias("n")), ["grp", "k"], 0.5)
    return at.groupBy("grp").agg(F.array(*[(F.max(F.when(F.col("k") == i, F.col("at"))) + 0.5) / UNIT for i in range(len(values))]).alias(name))


def _moments(values: list[Column]) -> list[Column]:
    """h (rows), their means m, and their covariances c as the rows of a lower triangle."""
    n = F.count("*")
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1)]
    return [
        n.alias("h"),
        F.array(*[F.avg(v) for v in values]).alias("m"),
        F.array(*[F.avg(values[i] * values[j]) - F.avg(values[i]) * F.avg(values[j]) for i, j in pairs]).alias("c"),
    ]


def least_determinants(fit: DataFrame, names: list[str], floor: list[float], support: float, max_steps: int, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """grp, n (rows), start, log_det, h (rows in the estimate's subset), m, w and at (bucket of the distance that the support reaches) of the
    estimate of least determinant; fit: grp and names."""
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sizes = materialize(fit.groupBy("grp").agg(F.count("*").alias("n")))
    few = sizes.count() <= broadcast_groups
    small = F.broadcast if few else lambda df: df  # of tables with a row or some for each group
    met = lambda rows, groups: rows.join(F.broadcast(groups), "grp") if few else join_groups(rows, materialize(groups), "grp", "n", broadcast_groups=0)
    centre = materialize(sizes.join(small(_medians(fit, [F.col(n) for n in names], "m")), "grp"))
    spread = _medians(met(fit, centre), [F.abs(F.col(n) - F.get("m", F.lit(i))) for i, n in enumerate(names)], "s")
    scale = F.zip_with("s", F.array(*[F.lit(f) for f in floor]), lambda s, f: F.sqrt(F.pow(1.4826 * s, 2) + f * f))
    scaled = materialize(centre.join(small(spread), "grp").withColumn("s", scale))
    z = [(F.col(n) - F.get("m", F.lit(i))) / F.get("s", F.lit(i)) for i, n in enumerate(names)]
    norm = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in z]) + 1e-12)
    turned = met(fit, scaled).select("grp", *[x.alias(f"z{i}") for i, x in enumerate(z)], norm.alias("norm"))
    kinds = {"tanh": [F.tanh(F.col(f"z{i}")) for i in range(d)], "sign": [F.col(f"z{i}") / F.col("norm") for i in range(d)]}
    one = lambda kind, xs: F.struct(F.lit(kind).alias("start"), *[x.alias(f"u{i}") for i, x in enumerate(xs)])
    turned = turned.select("grp", F.explode(F.array(*[one(k, xs) for k, xs in kinds.items()])).alias("u"))
    linked = turned.groupBy("grp", F.col("u.start").alias("start")).agg(*_moments([F.col(f"u.u{i}") for i in range(d)])).select("grp", "start", "c")
    linked = linked.unionByName(sizes.select("grp", F.lit("diagonal").alias("start"), F.array(*[F.lit(float(i == j)) for i, j in pairs]).alias("c")))
    c = lambda i, j: F.get("c", F.lit(i * (i + 1) // 2 + j))
    related = [F.lit(1.0) if i == j else c(i, j) / F.sqrt((c(i, i) + 1e-9) * (c(j, j) + 1e-9)) for i, j in pairs]
    covariances = F.array(*[r * F.get("s", F.lit(i)) * F.get("s", F.lit(j)) for (i, j), r in zip(pairs, related, strict=True)])
    first = scaled.join(small(linked), "grp").withColumn("whitening", _whitening(covariances, d))
    kept = ["grp", "start", "n", "h", "log_det", "m", "w", "done"]
    stats = materialize(first.select("grp", "start", "n", F.lit(0).cast("long").alias("h"), F.lit(float("inf")).alias("log_det"), "m", "whitening.w", F.lit(False).alias("done")))

    # expressions that every step uses
    place = _bucket(_distance2(names, F.col("s.m"), F.col("s.w")))
    of_rows, wide = _moments([F.col(n) for n in names]), F.array(*[F.lit(floor[i] ** 2 if i == j else 0.0) for i, j in pairs])
    whitening = _whitening(F.zip_with("c", wide, lambda x, y: x + y), d)

    def near(stats: DataFrame, more: list[str]) -> DataFrame:
        """fit's rows for each start of their group, with the bucket of their distance."""
        groups = stats.groupBy("grp").agg(F.first("n").alias("n"), F.collect_list(F.struct("start", "n", "h", "log_det", "m", "w", *more)).alias("s"))  # a few starts a group
        rows = met(fit, groups).select("grp", *names, F.explode("s").alias("s"))
        return rows.withColumn("bucket", place)

    def cut(stats: DataFrame) -> DataFrame:
        counts = near(stats, []).groupBy("grp", F.col("s.start").alias("start"), "bucket").agg(F.count("*").alias("n"))
        return _quantile(counts, ["grp", "start"], support)

    for step in range(max_steps):
        active = stats.filter(~F.col("done"))
        inside = near(active.join(small(cut(active)), ["grp", "start"]), ["at"]).filter(F.col("bucket") <= F.col("s.at"))
        moments = inside.groupBy("grp", F.col("s.start").alias("start")).agg(F.first("s").alias("old"), *of_rows)
        moments = moments.withColumn("whitening", whitening)
        falls = F.col("whitening.log_det") < F.col("old.log_det") - 1e-3
        new = F.struct(F.col("old.n").alias("n"), "h", F.col("whitening.log_det").alias("log_det"), "m", F.col("whitening.w").alias("w"))
        old = F.struct(*[F.col(f"old.{c}").alias(c) for c in ("n", "h", "log_det", "m", "w")])
        after = moments.select("grp", "start", F.when(falls, new).otherwise(old).alias("c"), (~falls).alias("done")).select("grp", "start", "c.*", "done")
        after = after.select(*kept).unionByName(stats.filter("done").select(*kept))
        if step == 1:
            after = after.withColumn("_place", F.row_number().over(Window.partitionBy("grp").orderBy("log_det", "start"))).filter("_place <= 2").drop("_place")
        stats = materialize(after)
        if stats.filter(~F.col("done")).isEmpty():
            break
    best = stats.groupBy("grp").agg(F.min_by(F.struct(*[c for c in kept if c not in ("grp", "done")]), F.struct("log_det", "start")).alias("b")).select("grp", "b.*")
    best = materialize(best)
    return materialize(best.join(small(cut(best).select("grp", "at")), "grp"))


def _grouped(rows: DataFrame, min_group: int, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Adds grp, by whose estimate a row is judged: its language and source, else its whole language, else all rows (null if even these are
    too few); and fits, the groups in use that the row belongs to."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source"))
    rows = rows.withColumns({"_fine": F.concat_ws("\x00", lang, source), "_mid": lang})
    fit = F.sum(F.when(~F.col("base_failed"), 1).otherwise(0))
    fine = rows.groupBy("_fine", "_mid").agg(fit.alias("_n"), F.count("*").alias("_rows")).withColumn("_own", F.col("_n") >= min_group)
    mid = fine.groupBy("_mid").agg((F.sum("_n") >= min_group).alias("_large"), F.sum("_n").alias("_n_mid"), F.bool_or(~F.col("_own")).alias("_asked"))
    whole = mid.agg((F.coalesce(F.sum("_n_mid"), F.lit(0)) >= min_group).alias("_enough"), F.coalesce(F.bool_or(F.col("_asked") & ~F.col("_large")), F.lit(False)).alias("_all_asked"))
    by_lang, by_all = F.concat(F.lit("language "), F.col("_mid")), F.lit("all")
    grp = F.when(F.col("_own"), F.col("_fine")).when(F.col("_large"), by_lang).when(F.col("_enough"), by_all)
    fits = F.array(F.when(F.col("_own"), F.col("_fine")), F.when(F.col("_large") & F.col("_asked"), by_lang), F.when(F.col("_enough") & F.col("_all_asked"), by_all))
    names = fine.join(mid, "_mid").join(F.broadcast(whole)).select("_fine", F.col("_rows").alias("_n"), grp.alias("grp"), F.array_compact(fits).alias("fits"))
    return join_groups(rows, materialize(names), "_fine", "_n", "left", broadcast_groups).drop("_fine", "_mid", "_n")


def quality_verdicts(df: DataFrame, keys: list[str], support: float = 0.75, confidence: float = 0.999999, max_steps: int = 30, min_group: int = 100, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """keys, the counts, base_failed, distance2 (null where no estimate was made) and kept of each document of (text, lang, source)."""
    names, d = list(FEATURES), len(FEATURES)
    own = [f"_key{i}" for i in range(len(keys))]
    counted = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "lang", "source", text_counts(F.col("text")).alias("_c")).select(*own, "lang", "source", "_c.*")
    counted = counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).withColumns(_features())
    rows = materialize(_grouped(materialize(counted), min_group, broadcast_groups))
    fit = rows.filter(~F.col("base_failed")).select(F.explode("fits").alias("grp"), *names)
    final = least_determinants(fit, names, list(FEATURES.values()), support, max_steps, broadcast_groups)
    final = materialize(final.join(rows.groupBy("grp").agg(F.count("*").alias("_rows")), "grp"))
    # consistent for normal data: the support quantile of the distances is that of the chi-squared law
    reached = F.pow(F.lit(2.0), (F.col("at") + 0.5) / OCTAVE)
    scaled = _distance2(names, F.col("m"), F.col("w")) * F.lit(chi2_quantile(support, d)) / F.greatest(reached, F.lit(chi2_quantile(support, d) * 0.25))
    limit = chi2_quantile(confidence, d)
    judged = join_groups(rows, final, "grp", "_rows", "left", broadcast_groups).withColumn("distance2", scaled)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= limit, F.lit(True))
    return judged.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], *COUNTS, "base_failed", "distance2", kept.alias("kept"))


def drop_low_quality(docs: DataFrame, **parameters) -> DataFrame:
    """docs without those that the rules reject, all columns kept."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_user"), identity("doc_id", "text", "lang", "source").alias("_key"))
    bad = quality_verdicts(keyed.select("_key", *[F.col(f"_user.{c}").alias(c) for c in ("text", "lang", "source")]), ["_key"], **parameters).filter(~F.col("kept"))
    return keyed.join(bad.select("_key"), "_key", "left_anti").select("_user.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality_verdicts(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2", "n_upper")
