"""Hypothesis tests between two columns, chosen by their roles and by normality."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.lookup import attach
from ..functions.moments import k_squared, k_squared_p
from ..functions.ranks import average_ranks
from ..functions.shapiro import shapiro_wilk
from ..functions.staging import stage_table
from ..functions.tails import chi2_sf, f_sf, normal_sf, t_two_sided
from ..schema import as_double, column_roles, present, require_columns
from .correlation import pearson_values, spearman_values
from .describe import crosstab

# Fixed values.
ALPHA = 0.05
SHAPIRO_LIMIT = 5_000
MIN_PAIRS = 5
MIN_CATEGORICAL_ROWS = 10
EXACT_GROUP = 8
PEARSON = "Pearson Correlation Test"
SPEARMAN = "Spearman Rank Correlation Test"
CHI_SQUARE = "Chi-Square Test of Independence"
WELCH = "Welch's Two-Sample T-Test"
MANN_WHITNEY = "Mann-Whitney U Test"
ANOVA = "One-Way ANOVA Test"
KRUSKAL = "Kruskal-Wallis H Test (Non-parametric ANOVA)"

RESULT_SCHEMA = (
    "var1 string, var2 string, test_name string, statistic double, p_value double, "
    "null_rejected boolean, interpretation string"
)


@dataclass
class TestResult:
    """One test's outcome. ``figures`` holds further scalars such as degrees of freedom."""

    __test__ = False

    var1: str
    var2: str
    test_name: str = ""
    statistic: float = 0.0
    p_value: float = 1.0
    interpretation: str = ""
    figures: dict[str, float] = field(default_factory=dict)
    details: DataFrame | None = None

    @property
    def null_rejected(self) -> bool:
        return bool(self.test_name) and self.p_value < ALPHA

    def to_df(self, df: DataFrame) -> DataFrame:
        row = (
            self.var1,
            self.var2,
            self.test_name,
            float(self.statistic),
            float(self.p_value),
            self.null_rejected,
            self.interpretation,
        )
        return df.sparkSession.createDataFrame([row], RESULT_SCHEMA)


# --- normality ---------------------------------------------------------------------------------


def _moments(x):
    return [
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.var_samp(x).alias("var"),
        F.coalesce(F.skewness(x), F.lit(0.0)).alias("g"),
        (F.kurtosis(x) + 3.0).alias("b"),
    ]


def dagostino(df: DataFrame, column: str) -> DataFrame:
    """(column, n, statistic, p_value) of the K-squared test, one aggregate."""
    require_columns(df, column)
    n = F.col("n").cast("double")
    k2 = F.when(F.col("n") >= 8, k_squared(n, F.col("g"), F.col("b")))
    return (
        df.agg(*_moments(as_double(df, column)))
        .select(F.lit(column).alias("column"), "n", k2.alias("statistic"))
        .withColumn("p_value", k_squared_p(F.col("statistic")))
    )


def group_moments(df: DataFrame, category: str, value: str) -> DataFrame:
    """Staged (category, n, mean, var, g, b, big_p): one row per group of the present rows.

    ``big_p`` is the K-squared p-value of groups too large for the Shapiro-Wilk test.
    """
    rows = _pair(df, category, value)
    grouped = rows.groupBy("category").agg(*_moments(F.col("value")))
    n = F.col("n").cast("double")
    big = F.when(F.col("n") > SHAPIRO_LIMIT, k_squared_p(k_squared(n, F.col("g"), F.col("b"))))
    return stage_table(grouped.withColumn("big_p", big))


def _pair(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.select(
        present(df, category).alias("category"), as_double(df, value).alias("value")
    ).na.drop()


def shapiro_by_group(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """(category, n, w, p) for the groups of 3 to ``SHAPIRO_LIMIT`` rows; larger ones are never ranked."""
    table = groups.select("category", F.col("n").alias("size"), "mean")
    small = attach(rows, table, ["category"], "size", total).where(F.col("size").between(3, SHAPIRO_LIMIT))
    return shapiro_wilk(small, "category", "value", "size", "mean")


def group_normality(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, n, method, p_value, is_normal) per group; below 3 rows a group is not normal."""
    rows = _pair(df, category, value)
    groups = group_moments(df, category, value)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shapiro = shapiro_by_group(rows, groups, total).select(
        "category", "n", F.lit("shapiro").alias("method"), F.col("p").alias("p_value")
    )
    big = groups.where(F.col("n") > SHAPIRO_LIMIT).select(
        "category", "n", F.lit("k_squared").alias("method"), F.col("big_p").alias("p_value")
    )
    tiny = groups.where("n < 3").select(
        "category", "n", F.lit("none").alias("method"), F.lit(None).cast("double").alias("p_value")
    )
    normal = F.coalesce(F.col("p_value") > ALPHA, F.lit(False))
    return shapiro.unionByName(big).unionByName(tiny).withColumn("is_normal", normal)


def check_normality(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Whether each column passes Shapiro-Wilk (up to 5000 values) or K-squared (above)."""
    moments = df.agg(F.array(*[F.struct(*_moments(as_double(df, c))) for c in columns]).alias("m"))
    n = F.col("n").cast("double")
    big = F.when(F.col("n") > SHAPIRO_LIMIT, k_squared_p(k_squared(n, F.col("g"), F.col("b"))))
    # The formula is evaluated once per column on the aggregated rows.
    rows = moments.select(F.posexplode("m").alias("i", "m")).select("i", "m.*")
    tested = {r["i"]: r for r in rows.select("i", "n", "mean", big.alias("p")).collect()}
    small = [i for i, r in tested.items() if 3 <= r["n"] <= SHAPIRO_LIMIT]
    p = {i: r["p"] for i, r in tested.items()}
    if small:
        cells = [F.struct(F.lit(i).alias("i"), as_double(df, columns[i]).alias("x"), F.lit(tested[i]["n"]).alias("n"), F.lit(tested[i]["mean"]).alias("mean")) for i in small]
        values = df.select(F.inline(F.array(*cells))).where("x IS NOT NULL")
        p |= {r["i"]: r["p"] for r in shapiro_wilk(values, "i", "x", "n", "mean").collect()}
    return {c: tested[i]["n"] >= 3 and (p[i] or 0.0) > ALPHA for i, c in enumerate(columns)}


# --- correlation tests -------------------------------------------------------------------------


def _correlation_p(r: float | None, n: int) -> float:
    if r is None or n < 3:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def _complete(df: DataFrame, var1: str, var2: str) -> DataFrame:
    return df.select(as_double(df, var1).alias("a"), as_double(df, var2).alias("b")).na.drop()


def correlation_test(df: DataFrame, var1: str, var2: str, method: str = "pearson") -> TestResult:
    """Coefficient and two-sided p-value on the rows where both columns are present."""
    rows = _complete(df, var1, var2)
    n = rows.count()
    values = pearson_values if method == "pearson" else spearman_values
    r = values(rows, {"a": F.col("a"), "b": F.col("b")})[("a", "b")]
    result = TestResult(var1, var2, PEARSON if method == "pearson" else SPEARMAN)
    result.statistic = float("nan") if r is None else r
    result.p_value = _correlation_p(r, n)
    result.figures = {"n": n}
    return result


# --- contingency -------------------------------------------------------------------------------


def chi_square_test(df: DataFrame, var1: str, var2: str) -> TestResult:
    """Chi-square test of independence with the continuity correction for 2 x 2 tables.

    Only observed combinations are stored. Those that never occur contribute their expected
    counts, which sum to ``N`` minus the expected counts of the observed ones.
    """
    cells = stage_table(crosstab(df, var1, var2))
    rows_ = cells.groupBy("a").agg(F.sum("n").alias("ra"), F.count(F.lit(1)).alias("_w"))
    columns_ = cells.groupBy("b").agg(F.sum("n").alias("cb"), F.count(F.lit(1)).alias("_w"))
    n, n_cells = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    k1, inv1 = rows_.agg(F.count(F.lit(1)), F.sum(F.lit(1.0) / F.col("ra"))).first()
    k2, inv2 = columns_.agg(F.count(F.lit(1)), F.sum(F.lit(1.0) / F.col("cb"))).first()
    result = TestResult(var1, var2, details=cells)
    result.figures = {"n": n, "levels1": k1, "levels2": k2}
    if n < MIN_CATEGORICAL_ROWS:
        result.interpretation = (
            f"Fewer than {MIN_CATEGORICAL_ROWS} rows have both values: no Chi-Square test was run."
        )
        return result
    if k1 < 2 or k2 < 2:
        result.interpretation = (
            "The Chi-Square test needs two categories in each variable: "
            f"'{var1}' has {k1}, '{var2}' has {k2}."
        )
        return result

    with_rows = attach(cells, rows_, ["a"], "_w", n_cells).drop("_w")
    full = attach(with_rows, columns_, ["b"], "_w", n_cells).drop("_w")
    expected = F.col("ra") * F.col("cb") / float(n)
    gap = F.col("n") - expected
    observed, covered, largest = full.agg(
        F.sum(gap * gap / expected), F.sum(expected), F.max(F.abs(gap))
    ).first()
    dof = (k1 - 1) * (k2 - 1)
    if dof == 1:
        # In a 2 x 2 table all four deviations are equal.
        corrected = largest - min(0.5, largest)
        statistic = corrected * corrected * n * inv1 * inv2
    else:
        statistic = observed + (n - covered if n_cells < k1 * k2 else 0.0)
    result.test_name = CHI_SQUARE
    result.statistic = statistic
    result.p_value = chi2_sf(statistic, dof)
    result.figures["dof"] = dof
    return result


# --- group comparisons -------------------------------------------------------------------------


def welch_t_test(groups: DataFrame) -> tuple[float, float, float]:
    """(t, degrees of freedom, p) from the moments of two groups, in category order."""
    a, b = groups.orderBy("category").limit(2).collect()
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    if va + vb == 0:
        return float("nan"), float("nan"), float("nan")
    t = (a["mean"] - b["mean"]) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    return t, dof, t_two_sided(t, dof)


def anova_test(groups: DataFrame) -> tuple[float, int, int, float]:
    """(F, between df, within df, p) from group moments; the group table may be of any length."""
    k, n, total = groups.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    ).first()
    off = F.col("mean") - F.lit(total / n)
    between, within = groups.agg(
        F.sum(F.col("n") * off * off), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)))
    ).first()
    df1, df2 = k - 1, n - k
    if within == 0 or df2 == 0:
        statistic = math.inf if between > 0 else float("nan")
    else:
        statistic = (between / df1) / (within / df2)
    return statistic, df1, df2, f_sf(statistic, df1, df2) if statistic == statistic else float("nan")


def _partitions(total: int, small: int, coefficients: list[int], period: int) -> int:
    """Coefficient of q^total in 1 / ((1 - q)(1 - q)(1 - q^2) ... (1 - q^small)).

    Each factor is put over 1 - q^period, which leaves ``coefficients`` as numerator.
    """
    if total < 0:
        return 0
    found = 0
    for j in range(total % period, min(total, len(coefficients) - 1) + 1, period):
        found += coefficients[j] * math.comb((total - j) // period + small, small)
    return found


def exact_u_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, from the number of arrangements of the two groups by their U.

    By symmetry these are the arrangements with U of at most n1 * n2 - u: a sum over the subsets of the smaller group's
    factors, in whole numbers, whose cost does not depend on the larger group.
    """
    small, large = sorted((n1, n2))
    most = small * large - math.ceil(u)
    period = math.lcm(*range(1, small + 1)) if small else 1
    coefficients = [1]
    for step in [1, *range(1, small + 1)]:
        widened = [0] * (len(coefficients) + period - step)
        for i, c in enumerate(coefficients):
            if c:
                for offset in range(0, period, step):
                    widened[i + offset] += c
        coefficients = widened
    arrangements = 0
    for size in range(small + 1):
        for chosen in combinations(range(large + 1, large + small + 1), size):
            arrangements += (-1) ** size * _partitions(most - sum(chosen), small, coefficients, period)
    return float(Fraction(arrangements, math.comb(small + large, small)))


def mann_whitney(
    df: DataFrame, category: str, value: str, first: object = None
) -> tuple[float, float, dict[str, float]]:
    """(U of the first group, two-sided p, figures); groups in category order.

    ``first`` is the smaller category, looked up if not given.

    One pre-aggregated row per distinct value carries both groups' counts, so no join is needed.
    """
    rows = _pair(df, category, value)
    if first is None:
        first = rows.agg(F.min("category").alias("m")).first()["m"]
    freq = rows.groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == F.lit(first)).alias("n1")
    )
    n = F.col("n").cast("double")
    row = (
        average_ranks(freq, "value", "n")
        .agg(
            F.sum("n").alias("total"),
            F.sum("n1").alias("n1"),
            F.sum(F.col("n1") * F.col("rank")).alias("r1"),
            F.sum(n * n * n - n).alias("ties"),
        )
        .first()
    )
    total, n1, r1, ties = row["total"], row["n1"], row["r1"], row["ties"]
    n2 = total - n1
    u1 = r1 - n1 * (n1 + 1) / 2.0
    u = max(u1, float(n1) * n2 - u1)
    figures = {"n1": n1, "n2": n2}
    if min(n1, n2) <= EXACT_GROUP and ties == 0:
        return u1, min(1.0, 2.0 * exact_u_sf(u, n1, n2)), figures
    variance = n1 * n2 / 12.0 * ((total + 1) - ties / (float(total) * (total - 1)))
    if variance <= 0:
        return u1, 1.0, figures
    z = (u - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return u1, min(1.0, 2.0 * normal_sf(z)), figures


def kruskal_wallis(df: DataFrame, category: str, value: str) -> tuple[float, int, float]:
    """(H with tie correction, degrees of freedom, p) for any number of groups."""
    rows = _pair(df, category, value)
    cells = stage_table(rows.groupBy("value", "category").agg(F.count(F.lit(1)).alias("n")))
    freq = cells.groupBy("value").agg(
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_cells")
    )
    ranks = stage_table(average_ranks(freq, "value", "_n"))
    t = F.col("_n").cast("double")
    total, n_cells, ties = ranks.agg(
        F.sum("_n"), F.sum("_cells"), F.sum(t * t * t - t)
    ).first()
    # Ranks are centred, so the group sums do not lose digits on long columns.
    centred = F.col("rank") - (total + 1) / 2.0
    sums = (
        attach(cells, ranks, ["value"], "_cells", n_cells)
        .groupBy("category")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * centred).alias("s"))
    )
    k, spread = sums.agg(F.count(F.lit(1)), F.sum(F.col("s") * F.col("s") / F.col("n"))).first()
    correction = 1.0 - ties / (float(total) ** 3 - total)
    h = 12.0 / (float(total) * (total + 1)) * spread
    if correction <= 0:
        return float("nan"), k - 1, float("nan")
    h /= correction
    return h, k - 1, chi2_sf(h, k - 1)


def compare_groups(df: DataFrame, category: str, value: str) -> TestResult:
    """Welch or Mann-Whitney for two groups, ANOVA or Kruskal-Wallis for more."""
    groups = group_moments(df, category, value)
    result = TestResult(category, value, details=groups.select("category", "n", "mean"))
    k, total, smallest, failed, unknown = groups.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum("n"), F.lit(0)),
        F.min("n"),
        F.count_if((F.col("n") > SHAPIRO_LIMIT) & ~F.coalesce(F.col("big_p") > ALPHA, F.lit(False))),
        F.count_if(F.col("n").between(3, SHAPIRO_LIMIT)),
    ).first()
    result.figures = {"groups": k, "n": total}
    if k < 2:
        result.interpretation = (
            f"A group comparison needs two groups: '{category}' has {k} with values of '{value}'."
        )
        return result
    normal = smallest >= 3 and failed == 0
    if normal and unknown:
        tested = shapiro_by_group(_pair(df, category, value), groups, total)
        normal = tested.where(~(F.col("p") > ALPHA)).limit(1).count() == 0
    if k == 2 and normal:
        result.test_name = WELCH
        result.statistic, dof, result.p_value = welch_t_test(groups)
        result.figures["dof"] = dof
    elif k == 2:
        result.test_name = MANN_WHITNEY
        first = groups.agg(F.min("category").alias("m")).first()["m"]
        result.statistic, result.p_value, _ = mann_whitney(df, category, value, first)
    elif normal:
        result.test_name = ANOVA
        result.statistic, _, _, result.p_value = anova_test(groups)
    else:
        result.test_name = KRUSKAL
        result.statistic, _, result.p_value = kruskal_wallis(df, category, value)
    result.figures["all_normal"] = float(normal)
    return result


# --- router ------------------------------------------------------------------------------------


def run_hypothesis_test(df: DataFrame, var1: str, var2: str) -> TestResult:
    """Choose and run the fitting test for two columns and explain its outcome in a sentence."""
    require_columns(df, var1, var2)
    roles = column_roles(df)
    numeric1, numeric2 = roles[var1] == "numeric", roles[var2] == "numeric"
    if numeric1 and numeric2:
        rows = _complete(df, var1, var2)
        n = rows.limit(MIN_PAIRS).count()
        if n < MIN_PAIRS:
            text = f"Fewer than {MIN_PAIRS} rows have both values: no correlation test was run."
            return TestResult(var1, var2, interpretation=text)
        both = all(check_normality(rows, ["a", "b"]).values())
        result = correlation_test(df, var1, var2, "pearson" if both else "spearman")
        basis = "both variables look normal" if both else "at least one variable is not normal"
        subject = f"a monotonic or linear relationship between '{var1}' and '{var2}'"
    elif not numeric1 and not numeric2:
        result = chi_square_test(df, var1, var2)
        basis = f"{int(result.figures.get('dof', 0))} degrees of freedom"
        subject = f"a dependence between '{var1}' and '{var2}'"
    else:
        category, value = (var2, var1) if numeric1 else (var1, var2)
        result = compare_groups(df, category, value)
        result.var1, result.var2 = var1, var2
        normal = bool(result.figures.get("all_normal"))
        basis = "all groups look normal" if normal else "at least one group is not normal"
        subject = f"a difference of '{value}' between the levels of '{category}'"
    if result.test_name:
        verdict = "significant, the null hypothesis is rejected" if result.null_rejected else (
            "not significant, the null hypothesis stands"
        )
        result.interpretation = (
            f"{result.test_name} ({basis}): statistic {result.statistic:.4f}, "
            f"p-value {result.p_value:.4e}. The evidence for {subject} is {verdict}."
        )
    return result
