"""Valuation of listings from comparable trades.

Listings are joined to trades once per different (district, area) pair, never per listing: the pairs stay few
while listings grow, so the band join's output follows the trades. Every tier of a fallback ladder is an
aggregate of its own, and the first that has enough trades is chosen by a CASE, in one pass.
A null price, area or date is unknown and never counts as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators import lineage

# Fixed values of the valuation rules.
AREA_BAND = 3.0
WIDE_BAND = 10.0
LOW_DISCOUNT = 0.9
LEAST_FOR_QUARTILE = 4
NEW_BUILD_YEARS = 10
COMPLEX_CAP = 5
RECENT = 8


def base_and_low(value: Column, n: Column) -> tuple[Column, Column]:
    """Median, and the lower quartile (or a discounted median where there are too few values). Aggregates; one buffer for both."""
    quantiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5)))
    base = quantiles[1]
    return base, F.when(n >= LEAST_FOR_QUARTILE, quantiles[0]).otherwise(base * LOW_DISCOUNT)


def in_band(a: Column, b: Column, band: float) -> Column:
    return F.abs(a - b) <= band


def pairs_of(listings: DataFrame) -> DataFrame:
    return listings.where("district is not null and area is not null").select("district", "area").distinct()


def live(trades: DataFrame) -> DataFrame:
    """Trades that count: no direct deals, and with an amount."""
    return trades.where("not direct and amount is not null and amount <> 0")


def band_join(listings: DataFrame, trades: DataFrame, band: float = AREA_BAND) -> DataFrame:
    """Trades of each different (district, area) of listings: district, area, and the trade's columns but its district, area as trade_area.

    Joined on the district and on buckets of areas as wide as the band, a pair with its bucket and both beside it, so that a trade meets only pairs near it.
    """
    return _banded(pairs_of(listings), trades, band)


def _banded(pairs: DataFrame, trades: DataFrame, band: float, *keys: str) -> DataFrame:
    """pairs (district, area, keys and more) with the trades in their band that have the same keys."""
    bucket = lambda c: F.floor(c / band).cast("long")
    t = trades.withColumnsRenamed({"area": "trade_area", "district": "trade_district"} | {k: f"trade_{k}" for k in keys}).withColumn("trade_bucket", bucket(F.col("trade_area")))
    p = pairs.withColumn("bucket", F.explode(F.sequence(bucket(F.col("area")) - 1, bucket(F.col("area")) + 1)))
    on = (F.col("district") == F.col("trade_district")) & (F.col("bucket") == F.col("trade_bucket")) & in_band(F.col("trade_area"), F.col("area"), band)
    for k in keys:
        on = on & (F.col(k) == F.col(f"trade_{k}"))
    return p.join(t, on).drop("trade_district", "bucket", "trade_bucket", *[f"trade_{k}" for k in keys])


#: Ranges of values to a factor of e.
STEPS = 256


def _range(x: Column) -> Column:
    """The range of a value: never less for a greater one. Equal in width by logarithm, so that outliers don't empty them."""
    return F.when(x > 0, F.floor(F.ln(x) * STEPS)).otherwise(-(1 << 40))


def band_quantiles(pairs: DataFrame, values: DataFrame, band: float) -> DataFrame:
    """district, area, n, base, low of the values in each pair's band. pairs: district, area; values: district, area, x; exact.

    What is copied into bands are counts by range, whose number doesn't grow with the values; they say in which ranges the ranks of median and quartile lie, and only
    the values of those, a few in several hundred, are copied after them.
    """
    ranged = lineage.written(values.groupBy("district", "area", "x").agg(F.count(F.lit(1)).alias("m")).withColumn("range", _range(F.col("x"))))
    sums = ranged.groupBy("district", "area", "range").agg(F.sum("m").alias("m"))
    sums = _banded(pairs, sums, band).groupBy("district", "area", "range").agg(F.sum("m").alias("m"))
    whole = Window.partitionBy("district", "area")
    before = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = [(F.col("n") - 1) * q for q in (0.25, 0.5)]
    ranks = [f(p).cast("long") for p in places for f in (F.floor, F.ceil)]
    here = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("m"))
    held = here(ranks[0]) | here(ranks[1]) | here(ranks[2]) | here(ranks[3])
    held = sums.withColumns({"before": before(whole.orderBy("range")), "n": F.sum("m").over(whole)}).where(held)
    held = lineage.written(held.select("district", "area", "range", F.col("before").alias("below"), "n"))
    found = _banded(held, ranged, band, "range").groupBy("district", "area", "range", "below", "n", "x").agg(F.sum("m").alias("m"))
    in_range = Window.partitionBy("district", "area", "range").orderBy("x")
    found = found.withColumn("before", F.col("below") + before(in_range))
    found = found.groupBy("district", "area").agg(F.max("n").alias("n"), *[F.min(F.when(here(k), F.col("x"))).alias(f"x{i}") for i, k in enumerate(ranks)])

    def quantile(i: int) -> Column:
        place, x, y = places[i // 2], F.col(f"x{i}"), F.col(f"x{i + 1}")
        return F.when(x == y, x).otherwise((F.ceil(place) - place) * x + (place - F.floor(place)) * y)

    base = quantile(2)
    return found.select("district", "area", "n", base.alias("base"), F.when(F.col("n") >= LEAST_FOR_QUARTILE, quantile(0)).otherwise(base * LOW_DISCOUNT).alias("low"))


def band_groups(listings: DataFrame, trades: DataFrame, band: float = AREA_BAND) -> DataFrame:
    """district, area, n, base, low of the trades' amounts in the band."""
    return band_quantiles(pairs_of(listings), trades.select("district", "area", F.col("amount").alias("x")), band)


def band_summary(listings: DataFrame, trades: DataFrame, band: float = AREA_BAND) -> DataFrame:
    """district, area, n, base, low. Direct deals don't count."""
    return band_groups(listings, live(trades), band)


def price_per_area(listings: DataFrame, trades: DataFrame, band: float = WIDE_BAND, least: int = 5) -> DataFrame:
    """district, area, n, base, low: from prices per area in a wider band, times the area; only with at least so many trades."""
    found = band_quantiles(pairs_of(listings), _per_area(live(trades).where("area > 0")), band).where(F.col("n") >= least)
    return found.select("district", "area", "n", (F.col("base") * F.col("area")).alias("base"), (F.col("low") * F.col("area")).alias("low"))


def _per_area(trades: DataFrame) -> DataFrame:
    return trades.select("district", "area", (F.col("amount") / F.col("area")).alias("x"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, which has one row for each key; null keys meet null keys."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in keys})
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return left.join(named, on).drop(*[f"__{c}" for c in keys])


def capped_weights(rows: DataFrame, group: list[str], cap: int = COMPLEX_CAP) -> DataFrame:
    """rows with weight: a complex with more than cap rows in a group counts as cap rows. Counts are joined, so that a large complex is split like any other join's key."""
    n = rows.groupBy(*group, "complex").agg(F.count(F.lit(1)).alias("__n"))
    return _joined(rows, n, [*group, "complex"]).withColumn("weight", F.least("__n", F.lit(cap)) / F.col("__n")).drop("__n")


#: Ranges of values that a group is cut into, so that a hot group is many tasks.
RANGES = 1024


def weighted_quantiles(rows: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row a group: quantiles of value by weight.

    A value's place is the weight before it over all weight but the last value's; between places the quantile is linear.
    Rows of one value and weight are one row of counts first. The weight before a range of values comes from sums by range, of which a group has at most RANGES,
    and the weight before a row from its own range, so that no window holds a whole group.
    """
    packed = rows.groupBy(*group, F.col(value).alias("x"), "weight").agg(F.count(F.lit(1)).alias("m"))
    ends = packed.groupBy(*group).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.sum(F.col("weight") * F.col("m")) - F.max_by("weight", F.struct("x", "weight"))).alias("total"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(RANGES - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES))).otherwise(0).cast("int")
    ranged = _joined(packed, ends, group).select(*group, "x", "weight", "m", "total", place.alias("range"))
    sums = ranged.groupBy(*group, "range").agg(F.sum(F.col("weight") * F.col("m")).alias("s"), F.min("x").alias("start"))
    over = Window.partitionBy(*group).orderBy("range")
    sums = sums.select(*group, "range", F.coalesce(F.sum("s").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("left"), F.sum("s").over(over).alias("right"), F.lead("start").over(over).alias("after"))
    both = _joined(ranged, sums, [*group, "range"])
    within = Window.partitionBy(*group, "range").orderBy("x", "weight")
    before = F.col("left") + F.coalesce(F.sum(F.col("weight") * F.col("m")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = lambda w: F.when(F.col("total") > 0, w / F.col("total")).otherwise(F.lit(0.0))
    # the places of the first and the last of a row's m equal values, and of the next row's first
    placed = both.withColumn("before", before).select(
        *group, "x", share(F.col("before")).alias("first"), share(F.col("before") + F.col("weight") * (F.col("m") - 1)).alias("last"),
        F.coalesce(F.lead("x").over(within), "after").alias("next_x"), F.coalesce(F.lead(share(F.col("before"))).over(within), F.when(F.col("after").isNotNull(), share(F.col("right")))).alias("next_first"),
    )

    def at(q: float) -> Column:
        part = F.when(F.col("next_first") == F.col("last"), F.lit(0.0)).otherwise((q - F.col("last")) / (F.col("next_first") - F.col("last")))
        return F.when(F.col("last") >= q - 1e-12, F.col("x")).when(F.col("next_first") >= q, F.col("x") + (F.col("next_x") - F.col("x")) * part)

    return placed.groupBy(*group).agg(*[F.coalesce(F.min(at(q)), F.max("x")).alias(name) for name, q in quantiles.items()])


def capped_summary(rows: DataFrame, group: list[str], value: str = "amount", cap: int = COMPLEX_CAP) -> DataFrame:
    """group columns, n, base, low, with each complex's share capped."""
    n = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    q = weighted_quantiles(capped_weights(rows, group, cap), group, value, {"base": 0.5, "quarter": 0.25})
    low = F.when(F.col("n") >= LEAST_FOR_QUARTILE, F.col("quarter")).otherwise(F.col("base") * LOW_DISCOUNT)
    return q.join(n, group).select(*group, "n", "base", low.alias("low"))


def capped_complexes(rows: DataFrame, group: list[str], cap: int = COMPLEX_CAP) -> DataFrame:
    """group columns, complex, n of complexes with more rows than the cap."""
    return rows.groupBy(*group, "complex").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)


def _district_tiers(listings: DataFrame, trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of new builds. By district and area: t1, same area (3), and t2, the wide band by price per area (5), from one join; by district, for large areas: t4, large units by price per area (5).

    Each is struct(basis, n, base, low), and null without enough trades.
    """
    new = lineage.written(live(trades).where("area > 0 and new_build").select("district", "area", "amount", "large"))
    pairs, c = pairs_of(listings), F.col

    def tier(name: str, found: DataFrame, least: int, times: Column, alias: str) -> DataFrame:
        value = F.struct(F.lit(name).alias("basis"), "n", (c("base") * times).alias("base"), (c("low") * times).alias("low"))
        return found.where(c("n") >= least).select("district", "area", value.alias(alias))

    small = tier("district_newbuild", band_groups(listings, new), 3, F.lit(1), "t1").join(
        tier("district_area_ppa", band_quantiles(pairs, _per_area(new), WIDE_BAND), 5, c("area"), "t2"), ["district", "area"], "full")
    # a district's large units as a band of one area
    whole = lambda df: df.withColumn("area", F.lit(0.0))
    large = band_quantiles(whole(pairs.select("district").distinct()), whole(_per_area(new.where("large"))), WIDE_BAND).drop("area")
    big = listings.where("large").select("district", "area").distinct().join(large, "district")
    return small, tier("district_large_ppa", big, 5, c("area"), "t4")


def ladder(listings: DataFrame, trades: DataFrame) -> DataFrame:
    """district, area, basis, n, base, low: the first of the district's tiers with enough trades. Listings' own complexes: listing_ladder."""
    small, big = _district_tiers(listings, trades)
    found = pairs_of(listings).join(small, ["district", "area"], "left").join(big, ["district", "area"], "left")
    return found.withColumn("t", F.coalesce("t1", "t2", "t4")).select("district", "area", "t.basis", "t.n", "t.base", "t.low")


def listing_ladder(listings: DataFrame, trades: DataFrame) -> DataFrame:
    """id, basis, n, base, low of every listing: the first tier with enough trades.

    listings: id, district, area, large, complex, unit; trades: complex as listings have it (names are matched by same_complex).
    Tiers: same complex and area (1); the district's first two tiers; same complex by price per area (3); the district's large units. The
    last two are not for penthouses, whose unit ends in P.
    """
    deals, n = live(trades), F.count(F.lit(1))
    value = lambda name: F.struct(F.lit(name).alias("basis"), "n", "base", "low")
    t = deals.select(F.col("district").alias("d"), F.col("complex").alias("c"), F.col("area").alias("trade_area"), "amount")
    units = listings.where("complex is not null").select("district", "complex", "area").distinct()
    base, low = base_and_low(F.col("amount"), n)
    own = units.join(t, (F.col("district") == F.col("d")) & (F.col("complex") == F.col("c")) & in_band(F.col("trade_area"), F.col("area"), AREA_BAND))
    own = own.groupBy("district", "complex", "area").agg(n.alias("n"), base.alias("base"), low.alias("low"))
    own = own.select("district", "complex", "area", value("same_complex").alias("t0"))
    base, low = base_and_low(F.col("amount") / F.col("area"), n)
    sizes = deals.where("area > 0").groupBy("district", "complex").agg(n.alias("m"), base.alias("b"), low.alias("l")).where("m >= 3")
    found = listings.join(own, ["district", "complex", "area"], "left").join(sizes, ["district", "complex"], "left")
    for tier in _district_tiers(listings, trades):
        found = found.join(tier, ["district", "area"], "left")
    other = F.when(F.col("m").isNotNull() & (F.col("area") > 0), F.struct(
        F.lit("same_complex_ppa").alias("basis"), F.col("m").alias("n"), (F.col("b") * F.col("area")).alias("base"), (F.col("l") * F.col("area")).alias("low")))
    penthouse = F.coalesce(F.trim("unit").rlike("(?i)P$"), F.lit(False))
    chosen = F.coalesce("t0", "t1", "t2", F.when(~penthouse, F.coalesce(other, "t4")))
    return found.withColumn("t", chosen).select("id", "t.basis", "t.n", "t.base", "t.low")


def nearest_tier(candidates: DataFrame, radii: tuple[int, ...] = (1000, 1500, 2000), enough: int = 5, few: int = 3) -> DataFrame:
    """listing, stage, n, base: comparables from the nearest tier that has enough trades.

    candidates: listing, same_dong, metres (null without coordinates), pending (coordinates not looked up yet), direct, amount. Tiers: the
    same dong within the last radius or without coordinates, then each radius. If no tier has enough, the first with a
    few counts, named stage_few. Any pending candidate leaves the listing without a stage.
    """
    tiers = {"dong": F.col("same_dong") & (F.coalesce("metres", F.lit(0)) <= radii[-1])} | {f"r{r}": F.coalesce(F.col("metres") <= r, F.lit(False)) for r in radii}
    live = lambda c: c & ~F.col("direct")
    sums = candidates.groupBy("listing").agg(
        F.bool_or("pending").alias("pending"),
        *[F.count_if(live(c)).alias(f"n_{k}") for k, c in tiers.items()],
        *[F.median(F.when(live(c), F.col("amount"))).alias(f"m_{k}") for k, c in tiers.items()],
    )
    chosen = [F.when(F.col(f"n_{k}") >= n, F.struct(F.lit(k + s).alias("stage"), F.col(f"n_{k}").alias("n"), F.col(f"m_{k}").alias("base"))) for n, s in ((enough, ""), (few, "_few")) for k in tiers]
    return sums.withColumn("t", F.when(~F.col("pending"), F.coalesce(*chosen))).select("listing", "t.stage", "t.n", "t.base")


def latest(rows: DataFrame, group: list[str], order: list[Column], n: int = RECENT) -> DataFrame:
    """The first n rows of each group in an order that must be total."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)


def nearest_area_per_group(listings: DataFrame, others: DataFrame, band: float, groups: int) -> DataFrame:
    """listing, group, other, difference: of each other group in the district the nearest area within the band; the latest groups only.

    listings: listing, district, area, group. others: other, district, area, group, at.
    """
    # of each group the one listed first for an area, so that the join's output follows the different districts, areas and groups, not the rows
    o = others.where("area is not null").groupBy(F.col("district").alias("d"), F.col("area").alias("a"), F.col("group").alias("g")).agg(F.min_by(F.struct("other", "at"), "other").alias("o"))
    near = pairs_of(listings).join(o.where("g is not null"), (F.col("district") == F.col("d")) & in_band(F.col("a"), F.col("area"), band)).withColumn("difference", F.abs(F.col("a") - F.col("area")))
    best = near.groupBy("district", "area", "g").agg(F.min_by(F.struct("o.other", "difference", "o.at"), F.struct("difference", "o.other")).alias("b"))
    best = best.select("district", "area", "g", "b.other", "b.difference", "b.at")
    # one more than needed, since a listing's own group may be among them
    best = latest(best, ["district", "area"], [F.col("at").desc(), F.col("g")], groups + 1).drop("rn")
    mine = listings.select("listing", "district", "area", "group").join(best, ["district", "area"]).where(F.col("group") != F.col("g"))
    return latest(mine.select("listing", F.col("g").alias("group"), "other", "difference", "at"), ["listing"], [F.col("at").desc(), F.col("group")], groups).drop("rn", "at")


MOVE_IN_DISCOUNT = 0.90


def jeonse(listings: DataFrame, rents: DataFrame) -> DataFrame:
    """id, basis, n, jeonse, weak: the median deposit without monthly rent of the listing's complex, else of the district's new builds (three at least), less a discount.

    listings: id, district, complex, area; rents: district, complex (as listings have it), area, deposit, monthly, new_build.
    """
    pool = rents.where("deposit is not null and deposit <> 0 and coalesce(monthly, 0) = 0")
    t = pool.select(F.col("district").alias("d"), F.col("complex").alias("c"), F.col("area").alias("rent_area"), "deposit", "new_build")
    units = listings.where("complex is not null").select("district", "complex", "area").distinct()
    own = units.join(t, (F.col("district") == F.col("d")) & (F.col("complex") == F.col("c")) & in_band(F.col("rent_area"), F.col("area"), AREA_BAND))
    own = own.groupBy("district", "complex", "area").agg(F.struct(F.lit("same_complex").alias("basis"), F.count(F.lit(1)).alias("n"), F.median("deposit").alias("m")).alias("own"))
    near = band_groups(listings, pool.where("new_build").withColumnRenamed("deposit", "amount"), AREA_BAND)
    near = near.where("n >= 3").select("district", "area", F.struct(F.lit("district_newbuild").alias("basis"), "n", F.col("base").alias("m")).alias("near"))
    found = listings.select("id", "district", "complex", "area").join(own, ["district", "complex", "area"], "left").join(near, ["district", "area"], "left").withColumn("t", F.coalesce("own", "near"))
    return found.select("id", "t.basis", "t.n", (F.col("t.m") * MOVE_IN_DISCOUNT).alias("jeonse"), F.coalesce(F.col("t.n") < 5, F.lit(True)).alias("weak"))


def diagnosis(listings: DataFrame, trades: DataFrame) -> DataFrame:
    """district, area, in_band, new_in_band, direct, latest: why a pair has few comparables."""
    few = trades.groupBy("district", "area", "direct", "new_build").agg(F.count(F.lit(1)).alias("m"), F.max("date").alias("date"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0))
    return band_join(listings, few).groupBy("district", "area").agg(
        total(~F.col("direct")).alias("in_band"), total(~F.col("direct") & F.col("new_build")).alias("new_in_band"), total(F.col("direct")).alias("direct"), F.max("date").alias("latest"),
    )


def shortage(listings: DataFrame, trades: DataFrame) -> DataFrame:
    """district, area, trades, new, band, band_new, wide, wide_new, largest_new, reason: why a pair has no estimate. Direct deals don't count; one join for both bands."""
    few = live(trades).groupBy("district", "area", "new_build").agg(F.count(F.lit(1)).alias("m"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0))
    whole = few.groupBy("district").agg(F.sum("m").alias("trades"), total(F.col("new_build")).alias("new"), F.max(F.when(F.col("new_build"), F.col("area"))).alias("largest_new"))
    near = in_band(F.col("trade_area"), F.col("area"), AREA_BAND)
    bands = band_join(listings, few, WIDE_BAND).groupBy("district", "area").agg(
        total(near).alias("band"), total(near & F.col("new_build")).alias("band_new"), F.sum("m").alias("wide"), total(F.col("new_build")).alias("wide_new"),
    )
    found = pairs_of(listings).join(whole, "district", "left").join(bands, ["district", "area"], "left").na.fill(0, ["trades", "new", "band", "band_new", "wide", "wide_new"])
    return found.withColumn("reason", F.when(F.col("trades") < 10, "few trades").when(F.col("new") < 5, "few new builds")
                            .when((F.col("wide_new") < 5) & (F.col("area") > F.col("largest_new") + WIDE_BAND), "no new build as large").when((F.col("band") >= 3) & (F.col("band_new") < 3), "only old builds of the area")
                            .otherwise("under the least number"))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres, rounded."""
    rad = F.radians
    h = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lng2) - rad(lng1)) / 2), 2)
    return F.round(2 * 6_371_000 * F.asin(F.sqrt(h))).cast("long")


#: Metres of a degree of latitude, and how many times as wide cells are by longitude.
DEGREE, WIDER = 111_194.0, 1.5


def nearest_point(homes: DataFrame, points: DataFrame, step: float = 0.1) -> DataFrame:
    """id, point, metres: of each home the nearest point, of equally near ones the least. homes: id, lat, lng; points: point, plat, plng. Homes without coordinates have none.

    Homes meet the points of their grid cell and those around. Who found a point nearer than a cell is wide is done; the others look again in cells of four times the width, until none is
    left: where points are dense a home meets a few, and only homes far from all points meet many.
    """
    left, done = homes.where("lat is not null and lng is not null").select("id", "lat", "lng"), []
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    while True:
        cell = lambda c, width: F.floor(F.col(c) / width).cast("int")
        whole = step * WIDER > 360
        x, y = (cell("lat", step), cell("lng", step * WIDER)) if not whole else (F.lit(0), F.lit(0))
        px, py = (cell("plat", step), cell("plng", step * WIDER)) if not whole else (F.lit(0), F.lit(0))
        cells = [F.struct((px + i).alias("x"), (py + j).alias("y")) for i, j in (around if not whole else [(0, 0)])]
        spread = points.select("point", "plat", "plng", F.inline(F.array(*cells)))
        pair = F.struct(metres(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng")).alias("metres"), "point")
        met = left.withColumns({"x": x, "y": y}).join(spread, ["x", "y"], "left").groupBy("id", "lat", "lng").agg(F.min(F.when(F.col("point").isNotNull(), pair)).alias("best"))
        sure = F.lit(DEGREE * step) * F.least(F.lit(1.0), WIDER * F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + step))))
        met = lineage.cut(met.withColumn("sure", F.lit(whole) | F.coalesce(F.col("best.metres") < sure, F.lit(False))))
        done.append(met.where("sure and best is not null").select("id", "best.point", "best.metres"))
        left = met.where("not sure").select("id", "lat", "lng")
        if whole or left.isEmpty():
            break
        step *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def same_complex(apt: Column, name: Column, umd: Column, dong: Column) -> Column:
    """Names that contain one another once spaces and marks are gone; dongs equal where both are known. Blank names never match."""
    plain = lambda c: F.regexp_replace(c, r"(?U)[\s()·\-]|아파트", "")
    a, b = plain(apt), plain(name)
    known = F.coalesce(umd, F.lit("")) != F.lit("")
    same_dong = ~known | (F.coalesce(dong, F.lit("")) == "") | (F.split(umd, " ")[0] == dong)
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)) & same_dong, F.lit(False))
