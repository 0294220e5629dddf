"""Checks a sequence finding has to survive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from throughline.config import FAMILIES, PITCH, Cols
from throughline.functions import hashing
from throughline.operators.metrics import bootstrap, drawn, observed
from throughline.session import small_side, stage

STRATUM = ["pitcher", "count_state", "pitch_number", "stand", "p_throws", "multiset"]
SIMILAR = ["pitcher", "count_state", "pitch_number"]
#: Hash digits of a bucket.
WIDTH = 3
#: Rows of a stratum that one task orders.
LARGE = 200_000


def order_ablation(intervals: DataFrame) -> DataFrame:
    """Order counts only where the lower bound of its gain over both U and L1 is above zero."""
    return intervals.withColumn("order_matters", F.col("order_lo") > 0)


def _swap(df: DataFrame, strata: list[str], fields: list[str], seed: int, width: int = WIDTH,
          extra: list[str] | None = None, c: Cols = PITCH) -> DataFrame:
    """Each row takes `fields` from the next row of its stratum in hashed order, the last from
    the first: a random cyclic permutation without a join. `donor_id` is null for a row alone
    in its stratum.

    A stratum that a hot actor fills is no one task's work: if it has more than `LARGE` rows, they are
    ordered within buckets, the first `width` digits of their hash. Only the last row of a bucket, whose
    next row is the first of a later bucket, meets the others of its stratum, at most 16 ** `width` of
    them; all other rows are moved once, without their hash. The result depends neither on `width` nor on `LARGE`.
    """
    strata = [*(extra or []), *strata]
    token = F.struct(F.col(c.row).alias("id"), *fields)
    # equal hashes of two strata put both in buckets, which changes no donor
    stratum = F.xxhash64(*strata)
    large = small_side(df.groupBy(stratum.alias("_s")).agg(F.count("*").alias("_n")).filter(F.col("_n") > LARGE).select("_s"))
    split = not large.isEmpty()
    digest = hashing.digest(seed, *(extra or []), c.row)
    rows, within = df, strata
    if split:
        rows = (df.withColumn("_s", stratum).join(large.withColumn("_large", F.lit(True)), "_s", "left").drop("_s")
                .withColumn("_bucket", F.when(F.col("_large"), F.substring(digest, 1, width)).otherwise("")))
        within = [*strata, "_bucket"]
    # what follows from a row is made after it has moved
    rows = rows.repartition(*within).withColumn("_h", digest)
    inside = W.partitionBy(*within).orderBy("_h", c.row)
    rows = rows.withColumns({"_next": F.lead(token).over(inside), "_first": F.first(token).over(inside)}).drop("_h")
    if split:
        apart = F.col("_large").isNotNull() & F.col("_next").isNull()
        between = W.partitionBy(*strata).orderBy("_bucket")
        ends = rows.filter(apart).withColumn("_next", F.coalesce(F.lead("_first").over(between), F.first("_first").over(between)))
        rows = rows.filter(~apart).unionByName(ends).drop("_large")
    rows = rows.withColumn("_donor", F.coalesce("_next", "_first"))
    return rows.withColumns({
        "donor_id": F.when(F.col("_donor.id") != F.col(c.row), F.col("_donor.id")),
        **{f"donor_{f}": F.col(f"_donor.{f}") for f in fields},
    }).drop("_next", "_first", "_donor", "_bucket")


def permute_history(df: DataFrame, fields: list[str], seed: int, width: int = WIDTH,
                    strata: list[str] | None = None, c: Cols = PITCH) -> DataFrame:
    """Histories exchanged among decisions alike in actor, count, place, hands and multiset.

    First decisions have no history to exchange and are left out.
    """
    return _swap(df.filter(F.col(c.order) >= 2), strata or STRATUM, fields, seed, width, c=c)


def pseudo_history(df: DataFrame, fields: list[str], seed: int, width: int = WIDTH,
                   c: Cols = PITCH) -> DataFrame:
    """History of another episode by the same actor in the same count and place."""
    return _swap(df.filter(F.col(c.order) >= 2), SIMILAR, fields, seed, width, c=c)


def moved_share(swapped: DataFrame, by: list[str]) -> DataFrame:
    """Fine strata often hold one episode; how many rows could move at all."""
    return swapped.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("donor_id").isNotNull().cast("double")).alias("moved"))


def _planted(seed: int, c: Cols) -> Column:
    """A reward that depends on the count and the current action only, plus hashed noise."""
    place = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col(c.action))
    return (F.lit(0.01) * (F.col("strikes") - F.col("balls")) + F.lit(0.002) * place
            + F.lit(0.1) * (hashing.uniform(seed, c.row) - 0.5))


def plant_null(df: DataFrame, seed: int, c: Cols = PITCH) -> DataFrame:
    """Logged rows with a reward that history cannot move."""
    return df.withColumn(c.reward, _planted(seed, c))


def plant_effect(df: DataFrame, beta: float, seed: int, c: Cols = PITCH) -> DataFrame:
    """The null reward plus `beta` per unit of speed difference from the previous decision."""
    gap = F.coalesce(F.abs(F.col("release_speed") - F.col("prev_release_speed")), F.lit(0.0))
    return df.withColumn(c.reward, _planted(seed, c) + F.lit(beta) * gap)


def speed_gap_slope(df: DataFrame, by: list[str], c: Cols = PITCH) -> DataFrame:
    """Slope of reward on the speed difference: sign and size of a planted effect."""
    gap = F.abs(F.col("release_speed") - F.col("prev_release_speed"))
    rows = df.filter(F.col(c.order) >= 2)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(F.col(c.reward), gap).alias("slope"),
        F.regr_r2(F.col(c.reward), gap).alias("gain"))


def counterfactual(df: DataFrame, fields: list[str], seed: int, strata: list[str] | None = None,
                   width: int = WIDTH, c: Cols = PITCH) -> DataFrame:
    """Every decision beside the history of another row of its stratum, in `donor_<field>`.

    `donor_id` is null where a row keeps its own: first decisions, which have none, and rows alone
    in their stratum.
    """
    first = df.filter(~F.coalesce(F.col(c.order) >= 2, F.lit(False))).withColumns({
        "donor_id": F.lit(None).cast(df.schema[c.row].dataType), **{f"donor_{f}": F.col(f) for f in fields}})
    return permute_history(df, fields, seed, width, strata, c).unionByName(first)


def own_and_donor(swapped: DataFrame, keys: list[str], fields: list[str], keep: list[str]) -> DataFrame:
    """Two rows for each decision, `donor` 0 and 1: its context under its own history and under the donor's.

    Counted by `keep`, so that what meets the model's cells is one row for each distinct pair.
    """
    def side(donor: int) -> Column:
        return F.struct(F.lit(donor).alias("donor"), *[F.col(f"donor_{k}" if donor and k in fields else k).alias(k) for k in keys])

    keep = [k for k in keep if k not in keys]
    moved = F.col("donor_id").isNotNull().cast("long").alias("_moved")
    long = swapped.select(*keep, moved, F.inline(F.array(side(0), side(1))))
    return long.groupBy(*keep, *keys, "donor").agg(F.count("*").alias("n"), F.sum("_moved").alias("moved"))


def gap_intervals(losses: DataFrame, cluster: list[str], by: list[str], views: list[str], replicates: int,
                  seed: int) -> DataFrame:
    """Per view the mean loss under own and donor histories, and their gap with a clustered interval.

    `losses` has `n`, `moved`, `donor` and a mean loss per view in `loss_<view>` (see `own_and_donor`).
    """
    def of(donor: int, value: Column) -> Column:
        return F.when(F.col("donor") == donor, value).otherwise(F.lit(0.0))

    sums = {"n": of(0, F.col("n").cast("double")), "moved": of(0, F.col("moved").cast("double"))}
    for v in views:
        sums |= {f"{side}_{v.lower()}": of(d, F.col("n") * F.col(f"loss_{v.lower()}")) for d, side in enumerate(("own", "donor"))}
    reps = bootstrap(losses, cluster, sums, by, replicates, seed).filter(F.col("n") > 0)
    cells = F.array(*[F.struct(F.lit(v).alias("state_view"), (F.col(f"own_{v.lower()}") / F.col("n")).alias("_own"),
                               (F.col(f"donor_{v.lower()}") / F.col("n")).alias("_donor")) for v in views])
    long = reps.select(*by, "replicate", "n", "moved", F.inline(cells)).withColumn("_gap", F.col("_donor") - F.col("_own"))
    return long.groupBy(*by, "state_view").agg(
        observed("n").cast("long").alias("n"), observed("moved").cast("long").alias("moved"),
        observed("_own").alias("loss_own"), observed("_donor").alias("loss_donor"), observed("_gap").alias("gap"),
        F.percentile(drawn("_gap"), 0.025).alias("gap_lo"), F.percentile(drawn("_gap"), 0.975).alias("gap_hi"))


def _known(value: Column, kind: DataType) -> Column:
    """Whether a struct or array has no null in it."""
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a & b, [_known(value[f.name], f.dataType) for f in kind.fields], value.isNotNull())
    if isinstance(kind, ArrayType):
        return value.isNotNull() & F.forall(value, lambda x: _known(x, kind.elementType))
    return value.isNotNull()


#: Rows of a stratum that are ordered together.
BLOCK = 4096


def shifted_sums(df: DataFrame, own: list[str], donor: list[str], terms: dict[str, Callable[[Column, Column], Column]],
                 rounds: int, seed: int, strata: list[str] | None = None, block: int = BLOCK, c: Cols = PITCH) -> DataFrame:
    """Per round r from 0 to `rounds`, the sums of `terms` over all decisions with a history, each beside
    the history of a row some places on in its stratum's hashed order (from the end on to the start). A stratum
    of n rows draws its places in round r from the first min(n, rounds + 1), by a number of its own; they
    are none in round 0, which is the observed one.

    `terms` are functions of a row's `own` fields and of another row's `donor` fields. One order
    serves all rounds: the log moves once, as lists of a stratum's rows, and comes out as one sum for each round.
    A stratum of more than `block` rows is dealt out by its hash in parts of about that size; of a
    part, only the first `rounds` histories go to the part before it.
    """
    strata = strata or STRATUM
    rows = df.filter(F.col(c.order) >= 2).select(
        *strata, hashing.digest(seed, c.row).alias("_h"), F.col(c.row).alias("_id"),
        F.struct(*own).alias("own"), F.struct(*donor).alias("donor"))
    large = (rows.groupBy(*strata).agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
             .select(*strata, F.ceil(F.col("_n") / F.lit(block)).alias("_parts")))
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    dealt = (rows.join(small_side(large), strata, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
             .withColumn("_part", F.floor(place * F.col("_parts"))))
    lists = stage(dealt.groupBy(*strata, "_parts", "_part").agg(
        F.array_sort(F.collect_list(F.struct("_h", "_id", "own", "donor"))).alias("_rows")).withColumn("_u", hashing.uniform(seed, *strata)), "shifts")
    line = W.partitionBy(*strata).orderBy("_part")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = (lists.filter("_parts > 1").select(*strata, "_part", F.slice(F.col("_rows")["donor"], 1, rounds).alias("_head"))
             .withColumn("_next", F.coalesce(F.lead("_head").over(line), F.first("_head").over(whole))))
    full = F.when(F.size("_next") == rounds, F.col("_next")).otherwise(
        F.raise_error(F.lit("a part of a stratum holds fewer rows than there are rounds")))
    long = lists.filter("_parts > 1").join(heads.drop("_head"), [*strata, "_part"]).select(
        "_u", "_rows", F.concat(F.col("_rows")["donor"], full).alias("_donors"))
    short = lists.filter("_parts = 1").select("_u", "_rows", F.col("_rows")["donor"].alias("_donors"))

    known = F.forall(F.col("_rows")["own"], lambda x: _known(x, rows.schema["own"].dataType)) & F.forall(
        "_donors", lambda x: _known(x, rows.schema["donor"].dataType))
    lists = long.unionByName(short).withColumns({"_known": known, "_places": F.least(F.size("_donors"), F.lit(rounds + 1))})

    def drawn_places(r: Column) -> Column:
        return F.floor((r * F.col("_u") - F.floor(r * F.col("_u"))) * F.col("_places")).cast("int")

    # One decision and round at a time in generated code, as lambdas over the lists are interpreted.
    each = (lists.filter("_known").select("_u", "_places", "_donors", F.posexplode(F.col("_rows")["own"]).alias("_i", "_own"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round")))
    met = F.col("_donors")[(F.col("_i") + drawn_places(F.col("round"))) % F.size("_donors")]
    fast = each.groupBy("round").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t(F.col("_own"), met)).alias(k) for k, t in terms.items()])

    # A list with a null adds nothing to a sum that meets it, which only the list as a whole knows. Equal places are summed once.
    def summed(term: Callable[[Column, Column], Column]) -> Column:
        def at(places: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.size("_rows") - 1), F.lit(0.0), lambda total, i: total + term(
                F.col("_rows")[i]["own"], F.col("_donors")[(i + places) % F.size("_donors")]))
        return F.transform(F.sequence(F.lit(0), F.col("_places") - 1), at)

    apart = lists.filter("NOT _known").select("_u", "_places", F.size("_rows").alias("n"), *[summed(t).alias(f"_s{i}") for i, t in enumerate(terms.values())])
    slow = apart.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round")).select(
        "round", F.col("n").cast("long").alias("n"), *[F.col(f"_s{i}")[drawn_places(F.col("round"))].alias(k) for i, k in enumerate(terms)])
    return fast.unionByName(slow).groupBy("round").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in terms])


def permutation_pvalue(gains: DataFrame, names: list[str], slack: float = 1e-12) -> DataFrame:
    """Per name, the share of rounds (the observed one counts as one) whose gain is no less than the observed one.

    `gains` has one row a round with a gain per name; round 0 is observed. `slack` takes up the order of summing.
    """
    long = gains.unpivot(["round"], names, "statistic", "gain")
    both = long.groupBy("statistic").agg(
        F.max(F.when(F.col("round") == 0, F.col("gain"))).alias("observed_gain"),
        F.collect_list(F.when(F.col("round") > 0, F.col("gain"))).alias("_drawn"))
    as_large = F.size(F.filter("_drawn", lambda g: g >= F.col("observed_gain") - F.lit(slack)))
    return both.select("statistic", "observed_gain", F.size("_drawn").cast("long").alias("rounds"),
                       (F.aggregate("_drawn", F.lit(0.0), lambda a, g: a + g) / F.size("_drawn")).alias("mean_permuted_gain"),
                       ((1 + as_large) / (F.lit(1) + F.size("_drawn"))).alias("p_value"))
