"""Queries on style vectors, candidates, refinement, fitting and batches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from penprint.catalog.base import ascii_only, quote, register, table, with_ctes
from penprint.functions import vectors as vx
from penprint.operators import fit
from penprint.operators import permute
from penprint.operators import rerank as rr
from penprint.operators import scaled_fit
from penprint.operators import vectors as vec
from penprint.plans.keys import join_on
from penprint.session import stored

DIMS = 64


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("author"), F.col("embedding").alias("vector"))


def long_form(df, keys, vector, out="x"):
    return df.select(*keys, F.posexplode(vector).alias("dim", out)).select(
        *keys, F.col("dim").cast("bigint").alias("dim"), F.round(F.col(out).cast("double"), 6).alias(out)
    )


EMB = "emb AS (SELECT vec_id, label AS author, unnest(range(len(embedding)))::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
UNIT = """unit AS (SELECT vec_id, author, dim, x / greatest(n, 1e-12::DOUBLE) AS x FROM emb JOIN
   (SELECT vec_id, sqrt(sum(x * x)) AS n FROM emb GROUP BY vec_id) USING (vec_id))"""
CENTROID = "centroid AS (SELECT author, dim, avg(x) AS c FROM unit GROUP BY author, dim)"
USER = """usr AS (SELECT author, dim, c / greatest(n, 1e-12::DOUBLE) AS c FROM centroid JOIN
   (SELECT author, sqrt(sum(c * c)) AS n FROM centroid GROUP BY author) USING (author))"""

register(
    "mean_pool",
    lambda spark, sf: long_form(
        vec.mean_pool(embeddings(spark, sf).withColumn("sentence", F.expr("vec_id div 8")), ["author", "sentence"]),
        ["author", "sentence"], "pooled",
    ),
    with_ctes(EMB, "SELECT author, vec_id // 8 AS sentence, dim, round(avg(x), 6) AS x FROM emb GROUP BY 1, 2, 3"),
)
register(
    "mean_pool_masked",
    lambda spark, sf: long_form(
        vec.mean_pool(
            embeddings(spark, sf).withColumn("sentence", F.expr("vec_id div 8")).withColumn("real", F.get("vector", F.lit(0)) > 0),
            ["sentence"], keep="real",
        ),
        ["sentence"], "pooled",
    ),
    with_ctes(EMB, """SELECT vec_id // 8 AS sentence, dim, round(avg(x), 6) AS x FROM emb
        WHERE vec_id IN (SELECT vec_id FROM emb WHERE dim = 0 AND x > 0) GROUP BY 1, 2"""),
)
register(
    "l2_normalize",
    lambda spark, sf: long_form(
        vec.l2_normalize(embeddings(spark, sf).withColumn("vector", F.transform("vector", lambda x: x * 3))), ["vec_id"], "vector"
    ),
    with_ctes(EMB, UNIT, "SELECT vec_id, dim, round(x, 6) AS x FROM unit"),
)
register(
    "style_centroid",
    lambda spark, sf: long_form(vec.style_centroid(embeddings(spark, sf)), ["author"], "style_vector"),
    with_ctes(EMB, UNIT, CENTROID, "SELECT author, dim, round(c, 6) AS x FROM centroid"),
)
register(
    "user_style_vector",
    lambda spark, sf: long_form(vec.user_style_vector(embeddings(spark, sf)), ["author"], "style_vector"),
    with_ctes(EMB, UNIT, CENTROID, USER, "SELECT author, dim, round(c, 6) AS x FROM usr"),
)


def with_target(spark, sf):
    rows = embeddings(spark, sf)
    return vec.pick_author_vector(rows, vec.user_style_vector(rows), "author", "vec_id")


register(
    "pick_author_vector",
    lambda spark, sf: long_form(with_target(spark, sf), ["vec_id", "author"], "style_vector"),
    with_ctes(EMB, UNIT, CENTROID, USER, "SELECT e.vec_id, e.label AS author, dim, round(c, 6) AS x FROM embeddings e JOIN usr ON usr.author = e.label"),
)
register(
    "style_distance",
    lambda spark, sf: vec.style_distance(with_target(spark, sf), "vector", "style_vector").select("vec_id", F.round("e2", 6).alias("e2")),
    with_ctes(EMB, UNIT, CENTROID, USER, "SELECT vec_id, round(1 - sum(x * c), 6) AS e2 FROM unit JOIN usr USING (author, dim) GROUP BY vec_id"),
)
register(
    "semantic_distance",
    lambda spark, sf: vec.semantic_distance(with_target(spark, sf), "vector", "style_vector").select("vec_id", F.round("e3", 6).alias("e3")),
    with_ctes(EMB, UNIT, CENTROID, USER, "SELECT vec_id, round(1 - sum(x * c), 6) AS e3 FROM unit JOIN usr USING (author, dim) GROUP BY vec_id"),
)

# Candidates: the first turn of a conversation is the input, every later turn a rewrite of it.


def pairs(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", ascii_only("text").alias("text"))
    inputs = turns.where(F.col("turn") == 0).select(F.col("conv_id").alias("input_id"), F.col("text").alias("input_text"))
    cands = turns.where(F.col("turn") > 0).select(
        F.col("conv_id").alias("input_id"), F.col("turn").alias("cand_id"), F.col("text").alias("candidate")
    )
    # A copy of the input itself and a light edit of it make the near-copy rule bite.
    copies = inputs.select("input_id", F.lit(1000).cast("bigint").alias("cand_id"), F.col("input_text").alias("candidate"))
    edits = inputs.select(
        "input_id", F.lit(1001).cast("bigint").alias("cand_id"), F.concat("input_text", F.lit(" indeed")).alias("candidate")
    )
    return join_on(cands.unionByName(copies).unionByName(edits), inputs, ["input_id"])


PAIRS = (
    "turns AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x01-\\x7f]', '?', 'g') AS text FROM conversations)",
    "inputs AS (SELECT conv_id AS input_id, text AS input_text FROM turns WHERE turn = 0)",
    """cands AS (SELECT conv_id AS input_id, turn AS cand_id, text AS candidate FROM turns WHERE turn > 0
       UNION ALL SELECT input_id, 1000, input_text FROM inputs UNION ALL SELECT input_id, 1001, input_text || ' indeed' FROM inputs)""",
    """pairs AS (SELECT *, levenshtein(candidate, input_text)::DOUBLE / greatest(length(input_text), 1)::DOUBLE AS e4,
       CASE WHEN length(candidate) = 0 AND length(input_text) = 0 THEN 1.0::DOUBLE
            ELSE 1.0::DOUBLE - levenshtein(candidate, input_text)::DOUBLE / greatest(length(candidate), length(input_text))::DOUBLE END AS copy_ratio
       FROM cands JOIN inputs USING (input_id))""",
)
KEPT = "kept AS (SELECT * FROM (SELECT *, max((copy_ratio < 0.85)::INT) OVER (PARTITION BY input_id) AS any_ok FROM pairs) WHERE copy_ratio < 0.85 OR any_ok = 0)"

register(
    "edit_penalty",
    lambda spark, sf: pairs(spark, sf).select("input_id", "cand_id", rr.edit_penalty(F.col("candidate"), F.col("input_text")).alias("e4")),
    with_ctes(*PAIRS, "SELECT input_id, cand_id, e4 FROM pairs"),
)
register(
    "copy_ratio",
    lambda spark, sf: rr.with_copy_ratio(pairs(spark, sf)).select("input_id", "cand_id", "copy_ratio"),
    with_ctes(*PAIRS, "SELECT input_id, cand_id, copy_ratio FROM pairs"),
)
register(
    "drop_near_copies",
    lambda spark, sf: rr.drop_near_copies(pairs(spark, sf)).select("input_id", "cand_id", "copy_ratio"),
    with_ctes(*PAIRS, KEPT, "SELECT input_id, cand_id, copy_ratio FROM kept"),
)


def scored(spark, sf):
    """Candidates with vectors: a linked embedding as style and meaning, its author's fit as mean
    and deviation, and the centroid of the conversation's author as target. Links reach every row of
    ``embeddings`` and every author, however many there are."""
    emb = embeddings(spark, sf)
    vectors = emb.agg(F.max("vec_id") + 1).scalar()
    authors = emb.agg(F.max("author") + 1).scalar()
    rows = pairs(spark, sf).withColumns(
        {
            "cand_link": F.pmod(F.col("input_id") * 31 + F.col("cand_id") * 7, vectors),
            "input_link": F.pmod(F.col("input_id") * 17, vectors),
            "target_author": F.pmod(F.col("input_id"), authors).cast("int"),
        }
    )
    gauss = fit.fit_author_gaussian(emb)
    cand = emb.join(gauss, "author").select(
        F.col("vec_id").alias("cand_link"), F.col("vector").alias("cand_style"), F.col("vector").alias("cand_meaning"), "mu", "sigma"
    )
    source = emb.select(F.col("vec_id").alias("input_link"), F.col("vector").alias("input_meaning"))
    target = vec.user_style_vector(emb).select(F.col("author").alias("target_author"), F.col("style_vector").alias("target_vec"))
    return rr.score_candidate(rows.join(cand, "cand_link").join(source, "input_link").join(target, "target_author"))


HALF_LOG = 0.5 * math.log(2 * math.pi)
GAUSS = """gauss AS (SELECT author, dim, avg(x) AS mu, stddev_pop(x) AS sigma FROM emb GROUP BY author, dim)"""
SCORED = (
    EMB, UNIT, CENTROID, USER, GAUSS, *PAIRS,
    "top AS (SELECT max(vec_id) + 1 AS v, max(label) + 1 AS a FROM embeddings)",
    "linked AS (SELECT pairs.*, (input_id * 31 + cand_id * 7) % v AS cl, (input_id * 17) % v AS il, input_id % a AS ta FROM pairs, top)",
    f"""dims AS (SELECT input_id, cand_id, avg((c - mu) * (c - mu) / (2 * sigma * sigma) + ln(sigma) + {HALF_LOG!r}::DOUBLE) AS e1,
         1 - sum(a.x * c) AS e2, 1 - sum(a.x * b.x) AS e3
         FROM linked l JOIN unit a ON a.vec_id = cl JOIN unit b ON b.vec_id = il AND b.dim = a.dim
         JOIN usr u ON u.author = ta AND u.dim = a.dim JOIN gauss g ON g.author = a.author AND g.dim = a.dim GROUP BY input_id, cand_id)""",
    "scored AS (SELECT * FROM linked JOIN dims USING (input_id, cand_id))",
    "total AS (SELECT *, e1 + 2 * e2 + 2 * e3 + e4 + 3 * copy_ratio AS energy, e1 + 3 * e2 + 2 * e3 + e4 + 3 * copy_ratio AS energy_heavy FROM scored)",
)


def rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


register(
    "score_candidate",
    lambda spark, sf: scored(spark, sf).select("input_id", "cand_id", *rounded(*rr.TERMS)),
    with_ctes(*SCORED, "SELECT input_id, cand_id, round(e1, 6) AS e1, round(e2, 6) AS e2, round(e3, 6) AS e3, round(e4, 6) AS e4, round(copy_ratio, 6) AS copy_ratio FROM scored"),
)
register(
    "total_energy",
    lambda spark, sf: rr.total_energy(rr.total_energy(scored(spark, sf)), rr.STYLE_HEAVY, "energy_heavy").select(
        "input_id", "cand_id", *rounded("energy", "energy_heavy")
    ),
    with_ctes(*SCORED, "SELECT input_id, cand_id, round(energy, 6) AS energy, round(energy_heavy, 6) AS energy_heavy FROM total"),
)
register(
    "best_candidate",
    lambda spark, sf: rr.best_candidate(rr.total_energy(scored(spark, sf))).select("input_id", "cand_id", "candidate", *rounded("energy")),
    with_ctes(
        *SCORED,
        "SELECT input_id, cand_id, candidate, round(energy, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY energy, cand_id) AS r FROM total) WHERE r = 1",
    ),
)
register(
    "rewrite_selection",
    lambda spark, sf: rr.select_rewrite(scored(spark, sf)).select("input_id", "cand_id", "candidate", *rounded("energy")),
    with_ctes(
        *SCORED,
        "kept AS (SELECT * FROM (SELECT *, max((copy_ratio < 0.85)::INT) OVER (PARTITION BY input_id) AS any_ok FROM total) WHERE copy_ratio < 0.85 OR any_ok = 0)",
        "SELECT input_id, cand_id, candidate, round(energy, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY energy, cand_id) AS r FROM kept) WHERE r = 1",
    ),
)

# Refinement: the chosen candidate is the start, the other candidates are the proposals in order.


def refinement(spark, sf):
    columns = ("input_id", "cand_id", "candidate", "input_text", *rr.TERMS)
    rows = stored(scored(spark, sf).select(*columns), "scored")
    first = rr.select_rewrite(rows, keep=("candidate", "input_text", "e1", "e2", "e3"))
    starts = first.select("input_id", F.col("input_text").alias("text"), F.col("candidate").alias("current"), "e1", "e2", "e3")
    proposals = rows.select("input_id", F.col("cand_id").alias("step"), F.col("candidate").alias("proposal"), "e1", "e2", "e3")
    return starts, proposals


register(
    "greedy_refine",
    lambda spark, sf: rr.greedy_refine(*refinement(spark, sf)).select("input_id", "refined", *rounded("energy")),
    with_ctes(
        *SCORED,
        "kept AS (SELECT * FROM (SELECT *, max((copy_ratio < 0.85)::INT) OVER (PARTITION BY input_id) AS any_ok FROM total) WHERE copy_ratio < 0.85 OR any_ok = 0)",
        "start AS (SELECT input_id, -1 AS step, candidate, energy FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY energy, cand_id) AS r FROM kept) WHERE r = 1)",
        "alls AS (SELECT * FROM start UNION ALL SELECT input_id, cand_id, candidate, energy  FROM total)",
        "SELECT input_id, candidate AS refined, round(energy, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY energy, step) AS r FROM alls) WHERE r = 1",
    ),
)
register(
    "rewrite_pipeline",
    lambda spark, sf: rr.rewrite_in_style(scored(spark, sf).withColumn("step", F.col("cand_id"))).select(
        "input_id", "rewrite", *rounded("energy"), "chosen", "last_step"
    ),
    with_ctes(
        *SCORED,
        "kept AS (SELECT * FROM (SELECT *, max((copy_ratio < 0.85)::INT) OVER (PARTITION BY input_id) AS any_ok FROM total) WHERE copy_ratio < 0.85 OR any_ok = 0)",
        "start AS (SELECT input_id, -1::BIGINT AS step, candidate, energy FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY energy, cand_id) AS r FROM kept) WHERE r = 1)",
        "alls AS (SELECT * FROM start UNION ALL SELECT input_id, cand_id, candidate, energy FROM total)",
        "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY energy, step) AS r FROM alls) WHERE r = 1)",
        """SELECT l.input_id, l.candidate AS rewrite, round(l.energy, 6) AS energy, s.candidate AS chosen, l.step AS last_step
           FROM last l JOIN start s USING (input_id)""",
    ),
)
register(
    "greedy_refine_compat",
    lambda spark, sf: rr.greedy_refine(*refinement(spark, sf), compat=True).select("input_id", "refined", *rounded("energy"), "last_step"),
    with_ctes(
        *SCORED,
        "kept AS (SELECT * FROM (SELECT *, max((copy_ratio < 0.85)::INT) OVER (PARTITION BY input_id) AS any_ok FROM total) WHERE copy_ratio < 0.85 OR any_ok = 0)",
        "start AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY energy, cand_id) AS r FROM kept) WHERE r = 1)",
        "steps AS (SELECT input_id, cand_id, candidate, e1 + 2 * e2 + 2 * e3 AS model, row_number() OVER (PARTITION BY input_id ORDER BY cand_id) AS i FROM scored)",
        """fold(input_id, i, text, energy, last_step) AS (
             SELECT input_id, 0::BIGINT, candidate, e1 + 2 * e2 + 2 * e3 + 3.0::DOUBLE, -1::BIGINT FROM start
             UNION ALL SELECT input_id, i, CASE WHEN e < energy THEN candidate ELSE text END, CASE WHEN e < energy THEN e ELSE energy END,
                              CASE WHEN e < energy THEN cand_id ELSE last_step END
             FROM (SELECT f.*, s.i AS i2, s.candidate, s.cand_id, s.model + levenshtein(s.candidate, f.text)::DOUBLE / greatest(length(f.text), 1)::DOUBLE
                     + 3 * (CASE WHEN greatest(length(s.candidate), length(f.text)) = 0 THEN 1.0::DOUBLE
                       ELSE 1.0::DOUBLE - levenshtein(s.candidate, f.text)::DOUBLE / greatest(length(s.candidate), length(f.text))::DOUBLE END) AS e
                   FROM fold f JOIN steps s ON s.input_id = f.input_id AND s.i = f.i + 1) AS x(input_id, i0, text, energy, last_step, i, candidate, cand_id, e))""",
        "SELECT input_id, text AS refined, round(energy, 6) AS energy, last_step FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY i DESC) AS z FROM fold) WHERE z = 1",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
_SPLIT_WS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
register(
    "span_mask",
    lambda spark, sf: rr.span_mask(
        table(spark, sf, "conversations").select("conv_id", "turn", ascii_only("text").alias("text")), F.col("conv_id") * 31 + F.col("turn") * 7
    ).select("conv_id", "turn", "masked"),
    f"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x01-\\x7f]', '?', 'g') AS text FROM conversations),
        s AS (SELECT *, {_SPLIT_WS} AS l FROM t),
        i AS (SELECT *, (conv_id * 31 + turn * 7) % greatest(len(l) - 2, 1) AS i FROM s)
        SELECT conv_id, turn, CASE WHEN len(l) < 6 THEN text ELSE array_to_string(list_concat(list_concat(l[1:i], ['<extra_id_0>']), l[i + 3:]), ' ') END AS masked FROM i""",
)

# Fitting --------------------------------------------------------------------------------------


def nll_rows(spark, sf):
    emb = embeddings(spark, sf)
    return vec.pick_author_vector(emb, fit.fit_author_gaussian(emb), "author", "vec_id")


register(
    "gaussian_logprob",
    lambda spark, sf: fit.gaussian_logprob(nll_rows(spark, sf), target="vector").select("vec_id", F.round("e1", 6).alias("e1")),
    with_ctes(EMB, GAUSS, f"""SELECT vec_id, round(avg((x - mu) * (x - mu) / (2 * sigma * sigma) + ln(sigma) + {HALF_LOG!r}::DOUBLE), 6) AS e1
        FROM emb JOIN gauss USING (author, dim) GROUP BY vec_id"""),
)
register(
    "gaussian_nll",
    lambda spark, sf: fit.gaussian_nll(nll_rows(spark, sf), target="vector").select("vec_id", F.round("nll", 6).alias("nll")),
    with_ctes(EMB, GAUSS, """SELECT vec_id, round(0.5::DOUBLE * avg((x - mu) * (x - mu) / (sigma * sigma + 1e-6::DOUBLE) + ln(sigma * sigma + 1e-6::DOUBLE)), 6) AS nll
        FROM emb JOIN gauss USING (author, dim) GROUP BY vec_id"""),
)
register(
    "mean_nll",
    lambda spark, sf: fit.mean_nll(fit.gaussian_nll(nll_rows(spark, sf), target="vector")).select("author", F.round("mean_nll", 6).alias("mean_nll"), "n"),
    with_ctes(EMB, GAUSS, """v AS (SELECT author, vec_id, 0.5::DOUBLE * avg((x - mu) * (x - mu) / (sigma * sigma + 1e-6::DOUBLE) + ln(sigma * sigma + 1e-6::DOUBLE)) AS nll
        FROM emb JOIN gauss USING (author, dim) GROUP BY author, vec_id)""", "SELECT author, round(avg(nll), 6) AS mean_nll, count(*) AS n FROM v GROUP BY author"),
)
register(
    "fit_style_gaussian",
    lambda spark, sf: fit.fit_author_gaussian(embeddings(spark, sf))
    .select("author", "n", F.posexplode(F.arrays_zip("mu", "sigma")).alias("dim", "z"))
    .select("author", "n", F.col("dim").cast("bigint").alias("dim"), F.round("z.mu", 6).alias("mu"), F.round("z.sigma", 6).alias("sigma")),
    with_ctes(EMB, "SELECT author, count(*) AS n, dim, round(avg(x), 6) AS mu, round(stddev_pop(x), 6) AS sigma FROM emb GROUP BY author, dim"),
)


def _regression_rows(spark, sf, first=DIMS // 2):
    """Predict the later numbers of a vector from its ``first`` ones: all dimensions take part."""
    return embeddings(spark, sf).select(
        "vec_id",
        vx.as_double(F.slice("vector", 1, first)).alias("features"),
        vx.as_double(F.slice("vector", first + 1, DIMS - first)).alias("target"),
    )


register(
    "fit_linear_gaussian",
    lambda spark, sf: fit.fit_linear_gaussian(_regression_rows(spark, sf, 1), ridge=0.0).select(
        F.col("dim").cast("bigint").alias("dim"),
        *[F.round(c, 6).alias(n) for n, c in (("weight", F.get("weights", F.lit(0))), ("bias", F.col("bias")), ("sigma", F.col("sigma")))],
    ),
    with_ctes(
        EMB,
        """SELECT y.dim - 1 AS dim, round(regr_slope(y.x, f.x), 6) AS weight, round(regr_intercept(y.x, f.x), 6) AS bias,
             round(sqrt(greatest(regr_syy(y.x, f.x) - regr_sxy(y.x, f.x) * regr_sxy(y.x, f.x) / regr_sxx(y.x, f.x), 0) / count(*)), 6) AS sigma
           FROM emb y JOIN emb f USING (vec_id) WHERE f.dim = 0 AND y.dim > 0 GROUP BY y.dim""",
    ),
)


def _scaled_head(spark, sf):
    """Means and deviations of the later half of every vector by its first half: rows only, held against numpy in the tests."""
    rows = _regression_rows(spark, sf)
    head = scaled_fit.head_rows(rows, scaled_fit.fit_scaled_gaussian(rows))
    cells = F.posexplode(F.arrays_zip("weights", "log_weights")).alias("feature", "w")
    return head.select("dim", "bias", "log_bias", cells).select(
        "dim", "feature", F.col("w.weights").alias("weight"), F.col("w.log_weights").alias("log_weight"), "bias", "log_bias"
    )


register("fit_scaled_gaussian", _scaled_head)


def _linear_residuals(spark, sf):
    """Residuals of the fit on half of the dimensions: their mean and their product with every feature."""
    rows = _regression_rows(spark, sf)
    fitted = fit.apply_linear_gaussian(rows, fit.fit_linear_gaussian(rows, ridge=0.0))
    long = fitted.select("features", F.posexplode(F.zip_with("target", "mu", lambda t, m: t - m)).alias("dim", "r"))
    largest = F.array_max(F.transform("features", lambda x: F.abs(x)))
    sums = long.select("dim", "r", largest.alias("m"), F.posexplode("features").alias("feature", "x"))
    return sums.groupBy(F.col("dim").cast("bigint").alias("dim"), F.col("feature").cast("bigint").alias("feature")).agg(
        F.abs(F.round(F.avg("r"), 4)).alias("mean_residual"),
        F.abs(F.round(F.avg(F.col("r") * F.col("x")), 4)).alias("mean_product"),
        F.count(F.lit(1)).alias("n"),
    )


# Zero is what the normal equations say of every pair, so this SQL has constants by right.
register(
    "fit_linear_residuals",
    _linear_residuals,
    f"""SELECT dim, feature, 0.0::DOUBLE AS mean_residual, 0.0::DOUBLE AS mean_product, count(*) AS n
        FROM embeddings, (SELECT unnest(range({DIMS // 2}))::BIGINT AS dim), (SELECT unnest(range({DIMS // 2}))::BIGINT AS feature) GROUP BY dim, feature""",
)
KEY = "((conv_id * 1103515245 + turn * 12345 + 7) % 2147483648)"


def _batches(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"))
    return fit.shuffle_batches(turns, F.expr(KEY), "row_id")


register(
    "shuffle_batches",
    lambda spark, sf: _batches(spark, sf).select("conv_id", "turn", F.col("place").cast("bigint").alias("place"), F.col("batch").cast("bigint").alias("batch")),
    f"""SELECT conv_id, turn, p AS place, p // 12 AS batch FROM
        (SELECT conv_id, turn, row_number() OVER (ORDER BY {KEY}, conv_id * 1000 + turn) - 1 AS p FROM conversations)""",
)


SHUFFLE_SEED = 7


def _permuted(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return permute.permuted_batches(docs, "doc_id", docs.count(), SHUFFLE_SEED)


def _permuted_sql() -> str:
    """Cycle walking as a recursion; its start and every step are one run of the rounds."""
    half = "(SELECT greatest(1, ceil(log2(greatest(count(*), 2)) / 2))::BIGINT AS h, count(*) AS n FROM documents)"

    def rounds(source: str) -> str:
        for key in permute.round_keys(SHUFFLE_SEED):
            mixed = f"((((b + {key} % (1::BIGINT << h)) * {permute.MIXER}) & 4294967295) >> (32 - h))"
            source = f"SELECT doc_id, h, n, b AS a, xor(a, {mixed}) AS b FROM ({source})"
        return f"SELECT doc_id, h, n, (a << h) | b AS x FROM ({source})"

    first = rounds(f"SELECT doc_id, h, n, doc_id >> h AS a, doc_id & ((1::BIGINT << h) - 1) AS b FROM documents, {half}")
    again = rounds("SELECT doc_id, h, n, x >> h AS a, x & ((1::BIGINT << h) - 1) AS b FROM walk WHERE x >= n")
    return f"""WITH RECURSIVE walk AS ({first} UNION ALL {again})
        SELECT doc_id, x AS place, x // {fit.BATCH} AS batch FROM walk WHERE x < n"""


register("permuted_batches", _permuted, _permuted_sql())


def _padded(spark, sf):
    from penprint.functions import text as tx

    rows = _batches(spark, sf).withColumn(
        "prefix_ids", F.transform(tx.words(F.col("text")), lambda w: F.length(w).cast("bigint"))
    )
    return fit.pad_sequences(rows).select(
        "row_id", F.col("batch").cast("bigint").alias("batch"), F.array_join(F.transform("prefix_ids", lambda x: x.cast("string")), ",").alias("ids")
    )


register(
    "pad_sequences",
    _padded,
    f"""WITH b AS (SELECT conv_id * 1000 + turn AS row_id, text, (row_number() OVER (ORDER BY {KEY}, conv_id * 1000 + turn) - 1) // 12 AS batch FROM conversations),
        l AS (SELECT row_id, batch, list_transform(regexp_extract_all(lower(text), {quote('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}), lambda w: length(w)) AS l FROM b),
        m AS (SELECT *, max(len(l)) OVER (PARTITION BY batch) AS m FROM l)
        SELECT row_id, batch, array_to_string(list_resize(l, m, 0), ',') AS ids FROM m""",
)
