"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame
operations only.

Each text becomes a vector of four transformed statistics (word length, symbol share, repeated
lines, repeated word windows). Per language and source the three quarters of the rows with the
least covariance determinant are sought, from three fixed starts around the coordinate-wise medians
(median deviations alone, with the correlation of spatial signs, with that of hyperbolic tangents).
Concentration steps take the rows within the 75 % quantile of the Mahalanobis distance and estimate
centre and covariance anew, which never raises the determinant: after ``TRIALS`` steps each group goes
on with the start of least determinant, until no determinant moves any more.

Rows beyond the ``SURE`` quantile of chi-square are rejected. Where the core itself scatters more than
that distribution, the cut is raised by the same factor. Variances have floors: a statistic that hardly
varies in a group must move visibly before it counts. So in groups of little scatter the cut is
conservative: it keeps more than ``SURE`` says.

Groups under ``MIN_ROWS`` rows are pooled: first per language, then all together; a pool that is
still smaller rejects nothing. Quantiles are taken from histograms of rounded values, counted by group
and value first, so a source with a third of all rows costs a row a task and value in each shuffle, and
no task gets the rows of a group.

Defined results. Null or empty text: no words, base_failed. Null lang or source: a group of their
own, together with the empty string. Repeated rows count as often as they occur. Empty tables give
empty results. Columns besides doc_id, text, lang and source are ignored or carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, shingle_hashes, stored, words_of

WINDOW = 5
MIN_WORDS = 10
#: Share of a group's rows that the estimates rest on.
CORE = 0.75
#: Concentration steps of all starts, bound of those of the best, and the change of the determinant's
#: logarithm below which they end.
TRIALS, STEPS, STABLE = 2, 40, 1e-4
STARTS = 3
MIN_ROWS = 50
#: Probability that a row of the fitted distribution is kept.
SURE = 1 - 1e-7
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats")
#: Least standard deviation of each feature.
FLOORS = (0.06, 0.25, 0.25, 0.25)
#: Estimates are broadcast for up to this many groups (some 200 bytes each), beyond it joined by shuffle.
BROADCAST_GROUPS = 50_000
_P = len(FEATURES)


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more; ``windows`` are hashes by position."""
    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        steps = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - F.get(places, j), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(ordered: Column) -> Column:
        def twin(j: Column, k: Column) -> Column:
            return F.coalesce(F.get(ordered, j)["h"] == F.get(ordered, k)["h"], F.lit(False))

        several = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda j: twin(j, j - 1) | twin(j, j + 1))
        return F.array_sort(F.transform(several, lambda j: F.get(ordered, j)["i"]))

    def count(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ordered, places), covered))

    return let(windows, count)


def statistics(docs: DataFrame) -> DataFrame:
    """The base statistics of each row, with a ``version`` that tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    by_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(shingle_hashes(w, WINDOW)).cast("long").alias("n_repeat_words"),
        ),
    )
    by_lines = let(
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("version"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        by_words.alias("w"), by_lines.alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    rows = rows.select("doc_id", "version", "lang", "source", "w.*", "l.*", "n_symbols")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _features(rows: DataFrame) -> DataFrame:
    """Logarithms of shrunken ratios: short texts are drawn to the middle, where their noise ends."""
    return rows.withColumns({
        "f_length": F.log((F.col("word_chars") + 200) / (F.col("n_words") + 40)),
        "f_symbols": F.log1p(100 * F.col("n_symbols") / (F.col("word_chars") + 100)),
        "f_lines": F.log1p(10 * F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        "f_repeats": F.log1p(10 * F.col("n_repeat_words") / (F.col("n_words") + 40)),
    })


def _chi2_even(x: float, dof: int) -> float:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_even(mid, dof) < share else (low, mid)
    return high


def _factor(cov: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Cholesky factor of a covariance as column expressions."""
    out: dict[tuple[int, int], Column] = {}
    for i in range(_P):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - out[i, k] * out[j, k]
            out[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / out[j, j]
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, from columns m<i> and l<i><j>."""
    solved: list[Column] = []
    for i in range(_P):
        rest = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for z in solved[1:]:
        total = total + z * z
    return total


def _bin(distance: Column) -> Column:
    """Few distinct values that rise with the distance."""
    return F.round(F.log1p(F.greatest(F.least(distance, F.lit(1e8)), F.lit(0.0))), 3)


class _Groups:
    """How tables with a row a group (or a few) are joined: by broadcast if the groups are counted and few,
    else by a shuffle that can be split at a hot group."""

    def __init__(self, known: DataFrame):
        self.few = known.count() <= BROADCAST_GROUPS

    def join(self, rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(table) if self.few else table, keys, how)


def _quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], share: float) -> DataFrame:
    """(keys, quantiles under the names of ``values``), from counts of each rounded value."""
    pairs = F.array(*[F.struct(F.lit(name).alias("of"), value.alias("at")) for name, value in values.items()])
    counted = rows.select(*keys, F.explode(pairs).alias("v")).groupBy(*keys, "v.of", "v.at").agg(F.count("*").alias("often"))
    return counted.groupBy(*keys).agg(*[F.expr(f"percentile(at, {share}, often) FILTER (WHERE of = '{name}')").alias(name) for name in values])


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with the key of the group whose estimates they follow."""
    usable = rows.where(~F.col("base_failed"))
    by_source = usable.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = by_source.where(F.col("n") < MIN_ROWS).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    keys = by_source.join(small, "lang", "left").select(
        "lang", "source",
        F.when(F.col("n") >= MIN_ROWS, F.concat_ws("\x01", F.lit("source"), "lang", "source"))
        .when(F.col("n_lang") >= MIN_ROWS, F.concat_ws("\x01", F.lit("lang"), "lang"))
        .otherwise("all").alias("group"),
    )
    keys = stored(keys)
    return _Groups(keys).join(rows, keys, ["lang", "source"], "left")


def _lower(name: str) -> list[str]:
    return [f"{name}{i}{j}" for i in range(_P) for j in range(i + 1)]


def _with_factor(df: DataFrame, cov: dict[tuple[int, int], Column], keys: list[str]) -> DataFrame:
    """(keys, centre, Cholesky factor, logarithm of the determinant), variances lifted to their floors."""
    lifted = {(i, j): F.greatest(c, F.lit(FLOORS[i] ** 2)) if i == j else c for (i, j), c in cov.items()}
    df = df.select(*keys, *[f"m{i}" for i in range(_P)], *[c.alias(f"c{i}{j}") for (i, j), c in lifted.items()])
    factor = _factor({(i, j): F.col(f"c{i}{j}") for i, j in lifted})
    df = df.select(*keys, *[f"m{i}" for i in range(_P)], *[c.alias(f"l{i}{j}") for (i, j), c in factor.items()])
    return df.withColumn("det", 2 * sum((F.log(f"l{i}{i}") for i in range(_P)), F.lit(0.0)))


def starts(usable: DataFrame, middle: DataFrame, groups: _Groups) -> DataFrame:
    """(group, start, n, m<i>, l<i><j>, det): the first estimates of each group, around its medians."""
    apart = {f"s{i}": F.round(F.abs(F.col(f) - F.col(f"m{i}")), 3) for i, f in enumerate(FEATURES)}
    spread = stored(_quantiles(groups.join(usable, middle, ["group"]), ["group"], apart, 0.5))
    scale = [F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])) for i in range(_P)]
    both = stored(middle.join(spread, "group").select("group", *[f"m{i}" for i in range(_P)], *[s.alias(f"s{i}") for i, s in enumerate(scale)]))
    placed = groups.join(usable, both, ["group"])
    z = [(F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}") for i, f in enumerate(FEATURES)]
    length = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    kinds = {"a": [x / F.greatest(length, F.lit(1e-9)) for x in z], "b": [F.tanh(x) for x in z]}
    products = [F.avg(x[i] * x[j]).alias(f"{k}{i}{j}") for k, x in kinds.items() for i in range(_P) for j in range(i + 1)]
    held = [F.first(f"{c}{i}").alias(f"{c}{i}") for c in "ms" for i in range(_P)]
    moments = stored(placed.groupBy("group").agg(F.count("*").alias("n"), *held, *products))

    def correlation(k: str, i: int, j: int) -> Column:
        if k == "":
            return F.lit(0.0)
        return F.coalesce(F.col(f"{k}{i}{j}") / F.sqrt(F.nullif(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}"), F.lit(0.0))), F.lit(0.0))

    found = None
    for number, k in enumerate(("", "a", "b")):
        cov = {(i, j): F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(1.0) if i == j else correlation(k, i, j)) for i in range(_P) for j in range(i + 1)}
        one = _with_factor(moments.withColumn("start", F.lit(number)), cov, ["group", "start", "n"])
        found = one if found is None else found.unionByName(one)
    return found


def concentrated(usable: DataFrame, state: DataFrame, groups: _Groups) -> DataFrame:
    """The estimates after one concentration step, with the quantile of the distances before it."""
    placed = groups.join(usable, state, ["group"]).withColumn("bin", _bin(_distance()))
    cut = stored(_quantiles(placed, ["group", "start"], {"cut": F.col("bin")}, CORE))
    core = groups.join(placed, cut, ["group", "start"]).where(F.col("bin") <= F.col("cut"))
    moments = core.groupBy("group", "start").agg(
        F.first("n").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i in range(_P) for j in range(i + 1)],
    )
    # the covariance of the core understates that of a normal distribution by this factor
    factor = CORE / _chi2_even(chi2_quantile(CORE, _P), _P + 2)
    cov = {(i, j): factor * (F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) for i in range(_P) for j in range(i + 1)}
    return _with_factor(moments, cov, ["group", "start", "n"])


def estimates(rows: DataFrame) -> DataFrame:
    """(group, n, m<i>, l<i><j>, scale): centre and Cholesky factor of the scatter of each group, and the
    factor by which its core scatters more than the distribution that the cut assumes."""
    usable = rows.where(~F.col("base_failed")).select("group", *FEATURES)
    # small tables are stored before they are joined: their size is then known, and where they are
    # too large to broadcast, a join that shuffles both sides can be split at a hot group
    middle = stored(_quantiles(usable, ["group"], {f"m{i}": F.round(f, 3) for i, f in enumerate(FEATURES)}, 0.5))
    groups = _Groups(middle)
    state = stored(starts(usable, middle, groups))
    for _ in range(TRIALS):
        state = stored(concentrated(usable, state, groups))
    best = state.groupBy("group").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    state = stored(state.join(best, ["group", "start"]))
    for _ in range(STEPS):
        before = state.select("group", F.col("det").alias("was"))
        state = stored(concentrated(usable, state, groups))
        moved = state.join(before, "group").agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
        if moved is None or moved < STABLE:
            break
    placed = groups.join(usable, state, ["group"]).withColumn("bin", _bin(_distance()))
    core = stored(_quantiles(placed, ["group"], {"core": F.col("bin")}, CORE))
    scale = F.greatest(F.expm1("core") / chi2_quantile(CORE, _P), F.lit(1.0))
    return state.join(core, "group").select("group", "n", *[f"m{i}" for i in range(_P)], *_lower("l"), scale.alias("scale"))


def judged(docs: DataFrame) -> DataFrame:
    """The statistics of each row, its squared distance and whether it is kept."""
    measured = stored(_features(statistics(docs)))  # texts are read once, all else works on the vectors
    rows = stored(grouped(measured))
    fitted = stored(estimates(rows))
    found = _Groups(fitted).join(rows, fitted, ["group"], "left").withColumn("distance", _distance())
    outlier = F.coalesce((F.col("n") >= MIN_ROWS) & (F.col("distance") > chi2_quantile(SURE, _P) * F.col("scale")), F.lit(False))
    return found.select(*rows.columns, "distance", (~F.col("base_failed") & ~outlier).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, with their own columns."""
    gone = judged(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).distinct()
    version = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_doc"]) & (version == gone["_version"]), "left_anti")
