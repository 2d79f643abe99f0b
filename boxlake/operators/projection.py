"""The player projection: minutes, regressed rates, context factors and count intervals."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.functions.nullsafe import positive, sdiv

# Fixed values of the published model. Statistic: league rate a minute, stabilising minutes, half-life of form in games.
STATS = {"pts": (0.4182, 81.0, 6.0), "reb": (0.1762, 34.0, 8.0), "ast": (0.0915, 36.0, 8.0), "fg3m": (0.0315, 62.0, 12.0), "tov": (0.0570, 209.0, 15.0), "blk": (0.0202, 69.0, 20.0), "stl": (0.0314, 322.0, 30.0)}
CORRELATION = {("pts", "reb"): 0.30, ("pts", "ast"): 0.17, ("reb", "ast"): 0.20}
HOME = {True: 1.012, False: 0.988}
REST = {0: 0.985, 1: 1.000, 2: 1.005, 3: 1.005}
MINUTES_HALFLIFE, MINUTES_MAX, SD_FLOOR, Z80 = 2.0, 48.0, 0.15, 1.2816
BLEND_MINUTES, BASE_WEIGHT, FORM_WEIGHT = 400.0, 0.75, 0.25


def aged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``age``: rows back from the newest of its key."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])) - 1)


def decayed(value: Column, halflife: float) -> tuple[Column, Column]:
    """Aggregates over rows with ``age``: the exponentially weighted mean and variance of a column; null values only age the others."""
    w = F.when(value.isNotNull(), F.pow(F.lit(0.5), F.col("age") / halflife))
    mean = F.sum(w * value) / F.sum(w)
    square = F.sum(w * value * value) / F.sum(w)
    return mean, F.greatest(square - mean * mean, F.lit(0.0))


def minute_sums(minutes: str) -> list[Column]:
    """Aggregates over rows with ``age``, from which ``minute_range`` is made."""
    mean, variance = decayed(F.col(minutes).cast("double"), MINUTES_HALFLIFE)
    return [mean.alias("__m"), F.sqrt(variance).alias("__sd")]


def minute_range() -> list[Column]:
    """minutes_mean, minutes_low, minutes_high: short half-life, a floor under the spread, within 0 and 48."""
    m = F.least(F.greatest(F.coalesce("__m", F.lit(0.0)), F.lit(0.0)), F.lit(MINUTES_MAX))
    half = Z80 * F.greatest(F.coalesce("__sd", F.lit(0.0)), SD_FLOOR * m)
    return [m.alias("minutes_mean"), F.greatest(m - half, F.lit(0.0)).alias("minutes_low"), F.least(m + half, F.lit(MINUTES_MAX)).alias("minutes_high")]


def project_minutes(rows: DataFrame, keys: list[str], minutes: str) -> DataFrame:
    """keys, minutes_mean, minutes_low, minutes_high from rows with ``age``."""
    return rows.groupBy(*keys).agg(*minute_sums(minutes)).select(*keys, *minute_range())


def regressed_rate(stat: str, s_total: Column, s_min: Column, c_total: Column, c_min: Column, form: Column, form_min: Column) -> Column:
    """Per minute: season and career are each padded with the league's rate, blended by the season's minutes, and mixed with form."""
    league, k, _ = STATS[stat]
    padded = lambda total, played: (total + k * league) / (played + k)
    w = s_min / (s_min + BLEND_MINUTES)
    base = w * padded(s_total, s_min) + (1 - w) * padded(c_total, c_min)
    recent = F.coalesce(F.when(form.isNotNull(), sdiv(F.greatest(form, F.lit(0.0)), positive(form_min))), base)
    return F.greatest(BASE_WEIGHT * base + FORM_WEIGHT * recent, F.lit(0.0))


def context_factors(team_pace: Column, opp_pace: Column, league_pace: Column, opp_rating: Column, league_rating: Column, home: Column, rest: Column) -> dict[str, Column]:
    """The pace, opponent, venue and rest factors; what is unknown counts 1."""
    pace = sdiv(positive(team_pace) * positive(opp_pace), positive(league_pace) * positive(league_pace))
    opponent = sdiv(positive(opp_rating), positive(league_rating))
    venue = F.when(F.coalesce(home, F.lit(False)), HOME[True]).otherwise(HOME[False])
    days = F.least(F.greatest(rest, F.lit(0)), F.lit(3))
    rested = F.when(rest.isNull(), 1.0)
    for d, factor in REST.items():
        rested = rested.when(days == d, factor)
    one = F.lit(1.0)
    return {"pace": F.coalesce(pace, one), "opponent": F.coalesce(opponent, one), "venue": venue, "rest": F.coalesce(rested, one)}


def context_multiplier(*known: Column) -> Column:
    """Product of the context factors."""
    return reduce(mul, context_factors(*known).values())


def factor_contribution(mean: Column, factor: Column) -> Column:
    """A factor's signed share of a projected mean, to first order."""
    return mean * (factor - 1)


def count_probabilities(mean: Column, alpha: Column, upto: int) -> Column:
    """Array of the chances of 0 to ``upto`` under a negative binomial (Poisson at alpha 0), each from the one before; null without a mean, all at 0 if it is not over 0."""
    poisson = alpha <= 1e-12
    size = F.when(poisson, F.lit(1.0)).otherwise(1 / alpha)
    odds = mean / (size + mean)
    start = F.when(~(mean > 0), F.lit(1.0)).when(poisson, F.exp(-mean)).otherwise(F.pow(1 + alpha * mean, -size))
    step = lambda held, k: F.concat(held, F.array(F.element_at(held, -1) * F.when(~(mean > 0), 0.0).when(poisson, mean / k).otherwise(odds * (k - 1 + size) / k)))
    return F.when(mean.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(upto)), F.array(start.cast("double")), step))


def effective_alpha(mean: Column, alpha: Column, multiplier: Column) -> Column:
    """The dispersion whose variance is ``multiplier`` times the pooled one's, at least 0."""
    return F.greatest(multiplier * alpha + F.coalesce(sdiv(multiplier - 1, positive(mean)), F.lit(0.0)), F.lit(0.0))


def combined(sds: dict[str, Column]) -> Column:
    """Standard deviation of a sum of statistics whose residuals correlate."""
    names = list(sds)
    variance = sum((sds[n] * sds[n] for n in names), F.lit(0.0))
    for (x, y), rho in CORRELATION.items():
        if x in sds and y in sds:
            variance = variance + 2 * rho * sds[x] * sds[y]
    return F.sqrt(variance)


def count_interval(mean: Column, alpha: Column, level: float = 0.8) -> Column:
    """struct(low, high): the integers around the rounded mean that hold ``level`` of a negative binomial (Poisson at alpha 0), grown on the likelier side, the lower if equal.

    Each chance follows from the one beside it. The growth takes no more steps than six standard deviations and ten; it
    stops where it holds enough. A mean that is not over 0 gives (0, 0), a null mean null.
    """
    alpha = F.greatest(F.coalesce(alpha, F.lit(0.0)), F.lit(0.0))
    poisson = alpha <= 1e-12
    size = F.when(poisson, F.lit(1.0)).otherwise(1 / alpha)
    odds = mean / (size + mean)
    up = lambda k: F.when(poisson, mean / (k + 1)).otherwise(odds * (k + size) / (k + 1))
    at = F.bround(mean).cast("int")
    start = F.when(poisson, F.exp(-mean)).otherwise(F.pow(1 + alpha * mean, -size))
    chance = F.when(at > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(at - 1, F.lit(0))), start, lambda c, k: c * up(k))).otherwise(start)
    state = lambda low, high, held, below, above: F.struct(low.alias("low"), high.alias("high"), held.alias("held"), below.alias("below"), above.alias("above"))
    none = F.lit(-1.0)

    def grow(s: Column, _: Column) -> Column:
        down = state(s["low"] - 1, s["high"], s["held"] + s["below"], F.when(s["low"] > 1, s["below"] / up(s["low"] - 2)).otherwise(none), s["above"])
        rise = state(s["low"], s["high"] + 1, s["held"] + s["above"], s["below"], s["above"] * up(s["high"] + 1))
        full = (s["held"] >= level) | ((s["low"] <= 0) & (s["above"] <= 1e-300))
        return F.when(full, s).when(s["below"] >= s["above"], down).otherwise(rise)

    first = F.struct(at.alias("at"), chance.alias("c"))
    steps = F.ceil(6 * F.sqrt(mean + alpha * mean * mean)).cast("int") + 10
    walked = F.transform(F.array(first), lambda x: F.aggregate(F.sequence(F.lit(1), steps), state(x["at"], x["at"], x["c"], F.when(x["at"] > 0, x["c"] / up(x["at"] - 1)).otherwise(none), x["c"] * up(x["at"])), grow))[0]
    found = F.struct(walked["low"].alias("low"), walked["high"].alias("high"))
    return F.when(mean > 0, found).when(mean.isNotNull(), F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))


def with_intervals(df: DataFrame, mean: str, alpha: str, level: float = 0.8) -> DataFrame:
    """df with ``low`` and ``high``; null means give nulls."""
    interval = count_interval(F.col("__m"), F.col("__a"), level)
    ready = df.withColumns({"__m": F.col(mean).cast("double"), "__a": F.col(alpha).cast("double")}).withColumn("__i", interval)
    return ready.withColumn("low", F.col("__i.low")).withColumn("high", F.col("__i.high")).drop("__i", "__m", "__a")


def interval_sql(base: str, keys: str, level: float = 0.8) -> str:
    """The same as common table expressions over a relation with ``mean`` and ``alpha``, ending in ``intervals`` (keys, mean, low, high)."""
    up = lambda k: f"case when poi then mean / ({k} + 1) else mean / (sz + mean) * ({k} + sz) / ({k} + 1) end"
    return f"""i0 as (select row_number() over () rid, {keys}, mean, greatest(coalesce(alpha, 0), 0) al from {base}),
 i1 as (select *, al <= 1e-12 poi, case when al <= 1e-12 then 1.0 else 1.0 / al end sz, cast(round_even(mean, 0) as bigint) at_ from i0 where mean > 0),
 i2 as (select *, case when poi then exp(at_ * ln(mean) - mean - lgamma(at_ + 1)) else exp(lgamma(at_ + sz) - lgamma(sz) - lgamma(at_ + 1) - sz * ln(1 + mean / sz) + at_ * ln(mean / (sz + mean))) end chance from i1),
 walk as (select rid, mean, sz, poi, at_ low, at_ high, cast(chance as double) held, cast(case when at_ > 0 then chance / ({up("(at_ - 1)")}) else -1 end as double) below, cast(chance * ({up("at_")}) as double) above from i2
  union all select rid, mean, sz, poi, case when below >= above then low - 1 else low end, case when below >= above then high else high + 1 end, held + case when below >= above then below else above end,
   case when below < above then below when low > 1 then below / ({up("(low - 2)")}) else -1.0 end, case when below >= above then above else above * ({up("(high + 1)")}) end from walk where held < {level} and (low > 0 or above > 1e-300)),
 intervals as (select {keys}, mean, case when mean is not null then coalesce(w.low, 0) end low, case when mean is not null then coalesce(w.high, 0) end high, al from i0 left join (select rid, min(low) low, max(high) high from walk group by 1) w using (rid))"""


DISPERSION_MIN_MINUTES, DISPERSION_PRIOR_GAMES, CONTEXT_MIN_ROWS = 5.0, 60.0, 25  # fixed values of the fits


def padded_rate(stat: str, total: Column, minutes: Column) -> Column:
    """Per minute: the total padded with the league's rate over the statistic's stabilising minutes."""
    league, k, _ = STATS[stat]
    return (total + k * league) / (minutes + k)


def expected_counts(lines: DataFrame, keys: list[str], keep: list[str], minutes: str = "min") -> DataFrame:
    """keep, the statistics of lines and mu_<stat>: minutes times the padded rate of the line's ``keys``.

    Lines under DISPERSION_MIN_MINUTES leave; a null statistic counts neither itself nor its minutes and has no mean.
    """
    used = lines.where(F.col(minutes) >= DISPERSION_MIN_MINUTES).dropna(subset=keys)
    own = Window.partitionBy(*keys)  # sums beside their lines: a join would shuffle the lines for each side
    total = lambda c: F.coalesce(F.sum(c).over(own), F.lit(0))
    rate = lambda s: padded_rate(s, total(F.col(s)), total(F.when(F.col(s).isNotNull(), F.col(minutes))))
    means = [F.when(F.col(s).isNotNull(), F.col(minutes) * rate(s)).alias(f"mu_{s}") for s in STATS]
    return used.select(*keep, *STATS, *means)


def pooled_alphas(lines: DataFrame, player: str, minutes: str = "min") -> DataFrame:
    """One row, alpha_<stat>: the dispersion that all lines together show around their players' rates; 0 without lines."""
    mu = {s: F.col(f"mu_{s}") for s in STATS}
    fit = lambda s: F.sum((F.pow(F.col(s) - mu[s], 2) - mu[s]) * mu[s] * mu[s]) / F.sum(F.pow(mu[s], 4))
    return expected_counts(lines, [player], [], minutes).agg(*(F.greatest(F.coalesce(fit(s), F.lit(0.0)), F.lit(0.0)).alias(f"alpha_{s}") for s in STATS))


def dispersion_multipliers(lines: DataFrame, alphas: DataFrame, player: str, scope: list[str], minutes: str = "min") -> DataFrame:
    """player, c_<stat>: how much more a player varies than the pool, measured season by season and shrunk towards 1 by 60 games.

    ``alphas`` is the one row of ``pooled_alphas``.
    """
    mu = {s: F.col(f"mu_{s}") for s in STATS}
    z = lambda s: F.pow(F.col(s) - mu[s], 2) / (mu[s] + F.col(f"alpha_{s}") * mu[s] * mu[s])
    shrunk = lambda s: (F.coalesce(F.sum(z(s)), F.lit(0.0)) + DISPERSION_PRIOR_GAMES) / (F.count(mu[s]) + DISPERSION_PRIOR_GAMES)
    return expected_counts(lines, [player, *scope], [player], minutes).crossJoin(F.broadcast(alphas)).groupBy(player).agg(*(shrunk(s).alias(f"c_{s}") for s in STATS))


def rest_bucket(days: Column) -> Column:
    """Days since the last game, held to 0 to 3; null if unknown."""
    return F.when(days.isNotNull(), F.least(F.greatest(days, F.lit(0)), F.lit(3))).cast("int")


def fitted_context(rows: DataFrame, least: int = CONTEXT_MIN_ROWS) -> DataFrame:
    """factor (venue or rest), bucket, n, value, fitted: realised over predicted sums, venue first and rest after venue.

    ``rows`` has actual, raw (predicted without either factor), is_home and rest_days. Rows without a positive prediction or with a null or
    negative actual are left out; a bucket under ``least`` rows keeps its published value. Sums combine before they meet: two and four rows.
    """
    used = rows.where("actual >= 0 and raw > 0").withColumn("bucket", F.coalesce("is_home", F.lit(False)).cast("int"))

    def settled(sums: DataFrame, published: dict[int, float], name: str) -> DataFrame:
        known = sums.sparkSession.createDataFrame(list(published.items()), "bucket int, default double")
        good = (F.coalesce("n", F.lit(0)) >= least) & (F.col("num") > 0) & (F.col("den") > 0)
        full = known.join(F.broadcast(sums), "bucket", "left")
        good = F.coalesce(good, F.lit(False))
        return full.select(F.lit(name).alias("factor"), "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(good, F.col("num") / F.col("den")).otherwise(F.col("default")).alias("value"), good.alias("fitted"))

    sums = lambda df, by, den: df.groupBy(by.alias("bucket")).agg(F.count("*").alias("n"), F.sum("actual").alias("num"), F.sum(den).alias("den"))
    venue = settled(sums(used, F.col("bucket"), F.col("raw")), {int(k): v for k, v in HOME.items()}, "venue")
    corrected = used.join(F.broadcast(venue.select("bucket", F.col("value").alias("__venue"))), "bucket").where("rest_days is not null")
    rest = settled(sums(corrected, rest_bucket(F.col("rest_days")), F.col("raw") * F.col("__venue")), REST, "rest")
    return venue.unionByName(rest)


def project_stats(players: DataFrame) -> DataFrame:
    """players with mean_, sd_, delta_ and alpha_<stat>: minutes x regressed rate x context, with the spread of a count that disperses like the player.

    ``players`` has a row per player: minutes_mean, context, and for each statistic s_, sm_, sg_ (season total, its minutes and games), c_total_, cm_
    (career), f_, fm_ (form and its minutes), alpha_ (pooled) and c_ (multiplier; null counts 1). No season gives no delta.
    """
    mean, alpha, average = {}, {}, {}
    zero = F.lit(0.0)
    for s in STATS:
        n = lambda p, s=s: F.col(f"{p}_{s}")
        rate = regressed_rate(s, F.coalesce(n("s"), zero), F.coalesce(n("sm"), zero), F.coalesce(n("c_total"), zero), F.coalesce(n("cm"), zero), n("f"), n("fm"))
        mean[s] = F.greatest(F.col("minutes_mean") * rate * F.col("context"), zero).alias(f"mean_{s}")
        average[s] = sdiv(n("s"), n("sg"))
    staged = players.withColumns({f"mean_{s}": mean[s] for s in STATS})
    for s in STATS:
        alpha[s] = effective_alpha(F.col(f"mean_{s}"), F.coalesce(F.col(f"alpha_{s}"), zero), F.coalesce(F.col(f"c_{s}"), F.lit(1.0)))
    staged = staged.withColumns({f"effective_{s}": alpha[s] for s in STATS} | {f"delta_{s}": F.col(f"mean_{s}") - average[s] for s in STATS})
    spread = lambda s: F.sqrt(F.col(f"mean_{s}") + F.col(f"effective_{s}") * F.col(f"mean_{s}") * F.col(f"mean_{s}"))
    return staged.withColumns({f"sd_{s}": spread(s) for s in STATS})
