"""Scoring rewrite candidates and choosing among them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions import vectors as vx
from penprint.plans.keys import join_on

TERMS = ["e1", "e2", "e3", "e4", "copy_ratio"]


@dataclass(frozen=True)
class Weights:
    """Energy weights of the five terms, in the order of ``TERMS``."""

    e1: float = 1.0
    e2: float = 2.0
    e3: float = 2.0
    e4: float = 1.0
    copy_ratio: float = 3.0


# The second published setting.
STYLE_HEAVY = Weights(e2=3.0)
NEAR_COPY = 0.85


def edit_penalty(candidate: Column, text: Column) -> Column:
    return penalty_of(F.levenshtein(candidate, text), text)


def copy_ratio(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; 1 for two empty texts."""
    return ratio_of(F.levenshtein(a, b), a, b)


def penalty_of(distance: Column, text: Column) -> Column:
    return distance / F.greatest(F.length(text), F.lit(1))


def ratio_of(distance: Column, a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - distance / longer)


def with_edit_terms(df: DataFrame, candidate: str, text: str) -> DataFrame:
    """Add ``e4`` and ``copy_ratio`` with the edit distance, the costly part, worked out once."""
    a, b = F.col(candidate), F.col(text)
    measured = df.withColumn("__distance", F.levenshtein(a, b))
    return measured.withColumns(
        {"e4": penalty_of(F.col("__distance"), b), "copy_ratio": ratio_of(F.col("__distance"), a, b)}
    ).drop("__distance")


def with_copy_ratio(df: DataFrame, candidate: str = "candidate", text: str = "input_text") -> DataFrame:
    return df.withColumn("copy_ratio", copy_ratio(F.col(candidate), F.col(text)))


def drop_near_copies(
    df: DataFrame,
    key: str = "input_id",
    cand: str = "cand_id",
    candidate: str = "candidate",
    text: str = "input_text",
    limit: float = NEAR_COPY,
) -> DataFrame:
    """Candidates below the copy limit; all of an input's candidates where none is below.

    The candidates of one input, some rewrites of one text, are looked at together, so that the edit
    distance is worked out once.
    """
    rated = with_copy_ratio(df, candidate, text).withColumn("__ok", F.col("copy_ratio") < limit)
    both = rated.withColumn("__any_ok", F.max("__ok").over(Window.partitionBy(key)))
    return both.where(F.col("__ok") | ~F.col("__any_ok")).drop("__ok", "__any_ok")


def score_candidate(
    df: DataFrame,
    candidate: str = "candidate",
    text: str = "input_text",
    target: str = "target_vec",
    cand_style: str = "cand_style",
    cand_meaning: str = "cand_meaning",
    text_meaning: str = "input_meaning",
    mu: str = "mu",
    sigma: str = "sigma",
) -> DataFrame:
    """All five terms: likelihood, style distance, meaning distance, edit penalty and copy ratio."""
    return with_edit_terms(df, candidate, text).withColumns(
        {
            "e1": vx.neg_log_density(F.col(target), F.col(mu), F.col(sigma)),
            "e2": 1.0 - vx.cosine(F.col(cand_style), F.col(target)),
            "e3": 1.0 - vx.dot(vx.unit(F.col(text_meaning)), vx.unit(F.col(cand_meaning))),
        }
    )


def energy(weights: Weights = Weights()) -> Column:
    total = F.lit(0.0)
    for term in TERMS:
        total = total + F.col(term) * getattr(weights, term)
    return total


def total_energy(df: DataFrame, weights: Weights = Weights(), out: str = "energy") -> DataFrame:
    return df.withColumn(out, energy(weights))


def best_candidate(
    df: DataFrame, key: str = "input_id", cand: str = "cand_id", keep: tuple[str, ...] = ("candidate",)
) -> DataFrame:
    """The candidate of least energy per input; ties go to the lowest ``cand``.

    A candidate without an energy is taken only where no other has one.
    """
    first = F.min_by(F.struct(cand, "energy", *keep), F.struct(F.col("energy").isNull(), "energy", cand))
    return df.groupBy(key).agg(first.alias("b")).select(key, "b.*")


def span_mask(
    df: DataFrame, place: Column, text: str = "text", sentinel: str = "<extra_id_0>", fewest: int = 6
) -> DataFrame:
    """Replace two neighbouring tokens by a sentinel; texts under ``fewest`` tokens stay as they are.

    ``place`` is any non-negative integer; it is reduced to 0 .. n-3.
    """
    tokens = F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")
    staged = df.withColumn("__t", tokens).withColumn(
        "__i", F.pmod(place, F.greatest(F.size("__t") - 2, F.lit(1))).cast("int")
    )
    rest = F.col("__i") + 3
    masked = F.concat(
        F.slice("__t", F.lit(1), F.col("__i")),
        F.array(F.lit(sentinel)),
        F.slice("__t", rest, F.greatest(F.size("__t") - rest + 1, F.lit(0))),
    )
    return staged.withColumn(
        "masked", F.when(F.size("__t") < fewest, F.col(text)).otherwise(F.array_join(masked, " "))
    ).drop("__t", "__i")


def greedy_refine(
    starts: DataFrame,
    proposals: DataFrame,
    key: str = "input_id",
    steps: int | None = None,
    weights: Weights = Weights(),
    compat: bool = False,
) -> DataFrame:
    """Accept proposals in step order whenever they lower the energy.

    ``starts`` has one row per input with ``text`` (the input), ``current`` and the model terms
    ``e1, e2, e3`` of ``current``; ``proposals`` has ``step, proposal, e1, e2, e3``. By default the
    edit and copy terms compare with the input, so the outcome is the first row of least energy
    and no group is gathered. ``compat`` compares with the moving text as the original did, which
    needs an input's proposals in order. All supplied proposals take part unless ``steps`` is given; a
    proposal without an energy is never accepted.
    """
    model = weights.e1 * F.col("e1") + weights.e2 * F.col("e2") + weights.e3 * F.col("e3")
    within = proposals if steps is None else proposals.where((F.col("step") >= 0) & (F.col("step") < steps))

    def closeness(distance: Column, a: Column, b: Column) -> Column:
        return weights.e4 * penalty_of(distance, b) + weights.copy_ratio * ratio_of(distance, a, b)

    if not compat:
        inputs = starts.select(key, "text")
        first = starts.select(key, F.lit(-1).cast("bigint").alias("step"), F.col("current").alias("proposal"), "e1", "e2", "e3")
        later = within.select(key, F.col("step").cast("bigint").alias("step"), "proposal", "e1", "e2", "e3")
        rows = join_on(first.unionByName(later), inputs, [key])
        rated = with_edit_terms(rows, "proposal", "text")
        scored = rated.withColumn("energy", model + (weights.e4 * F.col("e4") + weights.copy_ratio * F.col("copy_ratio")))
        order = F.struct(F.col("energy").isNull(), "energy", "step")
        best = F.min_by(F.struct("proposal", "energy", "step"), order).alias("b")
        return scored.groupBy(key).agg(best).select(
            key, F.col("b.proposal").alias("refined"), F.col("b.energy").alias("energy"), F.col("b.step").alias("last_step")
        )

    one_per_step = (
        within.withColumn("__model", model)
        .groupBy(key, "step")
        .agg(F.min(F.struct(F.col("proposal"), F.col("__model").alias("model"))).alias("p"))
    )
    gathered = one_per_step.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("step").cast("bigint").alias("step"), "p.proposal", "p.model"))).alias("__steps")
    )
    current = F.col("current")
    itself = F.when(current.isNotNull(), F.lit(0))
    base = starts.select(key, current, (model + closeness(itself, current, current)).alias("__e0"))
    both = join_on(base, gathered, [key], "left").withColumn(
        "__steps", F.coalesce("__steps", F.array().cast("array<struct<step:bigint,proposal:string,model:double>>"))
    )
    begin = F.struct(F.col("current").alias("text"), F.col("__e0").alias("energy"), F.lit(-1).cast("bigint").alias("step"))

    def fold(state, p):
        # Arrays of one entry hold what is used more than once: lambdas work out every mention anew.
        distance = F.array(F.levenshtein(p["proposal"], state["text"]))
        energy = F.transform(distance, lambda d: p["model"] + closeness(d, p["proposal"], state["text"]))

        def step(e: Column) -> Column:
            better = e < state["energy"]
            return F.struct(
                F.when(better, p["proposal"]).otherwise(state["text"]).alias("text"),
                F.when(better, e).otherwise(state["energy"]).alias("energy"),
                F.when(better, p["step"]).otherwise(state["step"]).alias("step"),
            )

        return F.get(F.transform(energy, step), F.lit(0))

    return both.select(key, F.aggregate("__steps", begin, fold).alias("r")).select(
        key, F.col("r.text").alias("refined"), F.col("r.energy").alias("energy"), F.col("r.step").alias("last_step")
    )


def select_rewrite(
    scored: DataFrame,
    key: str = "input_id",
    cand: str = "cand_id",
    weights: Weights = Weights(),
    limit: float = NEAR_COPY,
    keep: tuple[str, ...] = ("candidate",),
) -> DataFrame:
    """Near-copy filter, energy and choice in one aggregation.

    Sorting near copies behind all others gives the same winner as dropping them first, with the
    fallback to near copies where an input has nothing else.
    """
    rated = total_energy(scored, weights).withColumn("__copy", F.col("copy_ratio") >= limit)
    first = F.min_by(F.struct(cand, "energy", *keep), F.struct("__copy", F.col("energy").isNull(), "energy", cand))
    return rated.groupBy(key).agg(first.alias("b")).select(key, "b.*")


def rewrite_in_style(
    scored: DataFrame,
    key: str = "input_id",
    cand: str = "cand_id",
    step: str = "step",
    candidate: str = "candidate",
    weights: Weights = Weights(),
    limit: float = NEAR_COPY,
    steps: int | None = None,
) -> DataFrame:
    """Choice and refinement in one call and one aggregation: ``key, rewrite, energy, chosen, last_step``.

    ``scored`` has the five terms. Rows with ``cand`` are candidates: the one of least energy is chosen, near copies
    only where an input has nothing else. Rows with ``step`` are proposals: the choice gives way to the first one of
    least energy if that is lower. A row can be both. Rows without an energy count only where no other is there;
    ``steps`` limits the proposals to those below it, all take part by default.
    """
    rated = total_energy(scored, weights)
    empty = F.col("energy").isNull()
    is_candidate = F.col(cand).isNotNull()
    is_proposal = F.col(step).isNotNull() & ~empty
    if steps is not None:
        is_proposal = is_proposal & (F.col(step) >= 0) & (F.col(step) < steps)
    order = F.struct(F.col("copy_ratio") >= limit, empty, F.col("energy"), F.col(cand))
    chosen = F.min_by(F.struct(F.col(candidate).alias("text"), "energy"), F.when(is_candidate, order)).alias("c")
    refined = F.min_by(
        F.struct(F.col(candidate).alias("text"), "energy", F.col(step).cast("bigint").alias("step")), F.when(is_proposal, F.struct("energy", step))
    ).alias("p")
    both = rated.groupBy(key).agg(chosen, refined).where("c IS NOT NULL")
    better = F.col("p").isNotNull() & (F.col("c.energy").isNull() | (F.col("p.energy") < F.col("c.energy")))
    pick = lambda name: F.when(better, F.col(f"p.{name}")).otherwise(F.col(f"c.{name}"))
    return both.select(
        key,
        pick("text").alias("rewrite"),
        pick("energy").alias("energy"),
        F.col("c.text").alias("chosen"),
        F.when(better, F.col("p.step")).otherwise(-1).cast("bigint").alias("last_step"),
    )
