"""Links recommendations to completions: retrieval, scoring, tiers, and one-to-one assignment.

Candidates come from three stages, of which the last runs only where the others found nothing within
the date window: equal descriptions in the same entity; equal work ids with agreeing descriptions and
names; and fuzzy retrieval, inside the entity's block or, where there is none or it is too large, through
the rarest tokens. Every stage is an equi-join on a key of the data; ranks within a recommendation are
window functions, so nothing is compared with everything. Pairs are ids until they are scored.

Inputs are standardised tables with ``recommendation_index`` and ``completion_index``. ``ida_key`` is
compared only where both tables carry it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.config import DEFAULT, Config
from worklens.functions import similarity as S
from worklens.functions import text as T
from worklens.operators.similar import bounded, most_similar, profiled, waves
from worklens.sources.staging import apart, stage

ENTITY = ("state_norm_key", "constituency_canonical_key", "mp_canonical_key")
EVIDENCE = ("description_similarity", "mp_similarity", "constituency_similarity", "state_similarity", "ida_similarity", "category_similarity", "amount_similarity", "timeline_match_score", "project_token_overlap")
#: Weights of the first eight kinds of evidence.
WEIGHTS = (0.66, 0.10, 0.09, 0.04, 0.03, 0.03, 0.03, 0.02)
SHORT = ("description", "mp", "constituency", "state", "ida", "category", "amount", "timeline", "token_overlap")
R, C = "recommendation_index", "completion_index"
TAG = "[UNMATCHED REASON] "
#: Rows that a task sorts at once, about; and parts that a frequent token's completions are dealt to.
TASK_ROWS, SALTS = 500_000, 16
#: Rows of one key that meet at once, from each side; pairs of a task, about; and the most rows of a table that is broadcast.
TILE, TASK_PAIRS, BROADCAST_ROWS = 512, 32_000_000, 20_000
#: Completions of a description in an entity up to which all are scored.
FEW = 8

_KEEP = ("work_norm", "work_description", "mp_norm", "mp_canonical", "constituency_canonical", "state_norm", "ida_norm", "category_norm", "category_norm_key", "ida_key", "work_id_key", *ENTITY)


def _plain(df: DataFrame, prefix: str, index: str, amount: str, date: str) -> DataFrame:
    """The columns that linking needs, prefixed."""
    col = lambda c: F.col(c) if c in df.columns else F.lit("")
    return df.select(F.col(index), *(F.coalesce(col(c), F.lit("")).alias(f"{prefix}_{c}") for c in _KEEP if c in df.columns or c != "ida_key"), F.col(amount).cast("double").alias(f"{prefix}_amount"), F.col(date).alias(f"{prefix}_date"))


def _told(side: DataFrame, prefix: str) -> DataFrame:
    """Adds what depends on the description alone."""
    norm, plain = F.col(f"{prefix}_work_norm"), F.col(f"{prefix}_work_description")
    text = F.when(plain != "", plain).otherwise(norm)
    return side.withColumns({f"{prefix}_tokens": T.telling_tokens(norm), f"{prefix}_types": T.work_types(text), f"{prefix}_places": T.place_names(text), f"{prefix}_numbers": T.location_numbers(F.when(norm != "", norm).otherwise(plain))})


def _small(df: DataFrame) -> DataFrame:
    """To be joined by broadcast, if the rows of a staged table are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else apart(df)


def told_once(side: DataFrame, prefix: str) -> DataFrame:
    """A side of plain columns with what depends on the description, computed once a description."""
    texts = [f"{prefix}_work_norm", f"{prefix}_work_description"]
    return side.join(_small(stage(_told(side.select(*texts).distinct(), prefix), "texts")), texts)


def plain_recommendations(df: DataFrame) -> DataFrame:
    return _plain(df, "r", R, "recommended_amount", "recommendation_date")


def plain_completions(df: DataFrame) -> DataFrame:
    return _plain(df, "c", C, "final_amount", "completed_date")


def recommendations_side(df: DataFrame) -> DataFrame:
    return _told(plain_recommendations(df), "r")


def completions_side(df: DataFrame) -> DataFrame:
    return _told(plain_completions(df), "c")


def _days() -> Column:
    return S.days_between(F.col("r_date"), F.col("c_date"))


def _texts_said(pairs: DataFrame, config: Config) -> DataFrame:
    """Adds what the texts of joined sides say: ``_e0`` to ``_e5``, ``_e8``, ``warnings``, their weighted sum ``_base`` and
    their ``_penalty``."""
    pairs = pairs.withColumns(
        {
            "_e0": S.token_set(F.col("r_work_norm"), F.col("c_work_norm")),
            "_e1": S.token_set(F.col("r_mp_canonical"), F.col("c_mp_canonical")),
            "_e2": S.token_set(F.col("r_constituency_canonical"), F.col("c_constituency_canonical")),
            "_e3": S.token_set(F.col("r_state_norm"), F.col("c_state_norm")),
            "_e4": S.token_set(F.col("r_ida_norm"), F.col("c_ida_norm")),
            "_e5": S.token_set(F.col("r_category_norm"), F.col("c_category_norm")),
            "_e8": S.overlap(F.col("r_tokens"), F.col("c_tokens")),
            "_clashes": T.location_conflicts(F.col("r_numbers"), F.col("c_numbers")),
        }
    )
    weighted = reduce(lambda a, b: a + b, (w * F.col(f"_e{i}") for i, w in enumerate(WEIGHTS[:6])))
    differ = lambda key: (F.col(f"r_{key}") != "") & (F.col(f"c_{key}") != "") & (F.col(f"r_{key}") != F.col(f"c_{key}")) if f"r_{key}" in pairs.columns and f"c_{key}" in pairs.columns else F.lit(False)
    checks = [
        (differ("mp_canonical_key"), "different MP", config.penalty_entity),
        (differ("state_norm_key"), "different state", config.penalty_entity),
        (differ("constituency_canonical_key"), "different constituency", config.penalty_entity),
        (differ("ida_key"), "different IDA", config.penalty_ida),
        (differ("category_norm_key"), "different category", config.penalty_category),
        ((F.col("_e8") < 30) & (F.col("_e0") < 95), "weak shared project tokens", config.penalty_anchors),
    ]
    late = [
        (T.differ_both_ways(F.col("r_places"), F.col("c_places")), "conflicting location", config.penalty_entity),
        (T.differ_both_ways(F.col("r_types"), F.col("c_types")), "conflicting project type", config.penalty_entity),
    ]
    given = lambda some: F.filter(F.array(*(F.when(c, F.lit(w)) for c, w, _ in some)), lambda x: x.isNotNull())
    labels = F.array(*(F.lit(g[0]) for g in T.LOCATION_WORDS))
    listed = lambda side, i: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(F.filter(F.col(side), lambda x: x["kind"] == i), lambda x: x["number"]))), lambda n: n.cast("string")), ", "), F.lit("]"))
    numbered = F.transform("_clashes", lambda i: F.concat(F.lit("conflicting location number ("), F.element_at(labels, i + 1), F.lit(": "), listed("r_numbers", i), F.lit(" vs "), listed("c_numbers", i), F.lit(")")))
    penalty = reduce(lambda a, b: a + b, (F.when(c, F.lit(float(p))).otherwise(0.0) for c, _, p in [*checks, *late])) + F.size("_clashes") * config.penalty_entity
    return pairs.withColumns({"_base": weighted, "_penalty": penalty, "warnings": F.concat(given(checks), numbered, given(late))}).drop("_clashes")


def _score(base: Column, penalty: Column, amounts: Column, timeline: Column) -> Column:
    """The score, from what the texts say and the two other kinds of evidence."""
    return F.greatest(F.lit(0.0), base + WEIGHTS[6] * amounts + WEIGHTS[7] * timeline - penalty)


def scored(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds the nine evidences (rounded to two places), ``warnings`` and ``score`` to joined sides."""
    pairs = _texts_said(pairs, config).withColumns({"_e6": S.amount(F.col("r_amount"), F.col("c_amount")), "_e7": S.timeline(_days(), config)})
    pairs = pairs.withColumn("score", _score(*(F.col(c) for c in ("_base", "_penalty", "_e6", "_e7"))))
    return pairs.withColumns({name: F.bround(f"_e{i}", 2) for i, name in enumerate(EVIDENCE)}).drop("_base", "_penalty", *(f"_e{i}" for i in range(9)))


def tiered(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds match_tier, match_confidence and blocker (the first reason against acceptance) from score,
    margin, evidence and warnings."""
    e = {n: F.col(n) for n in EVIDENCE}
    has = lambda w: F.array_contains("warnings", w)
    desc, anchors, score, margin = e["description_similarity"], e["project_token_overlap"], F.col("score"), F.col("margin")
    context = ("mp_similarity", "state_similarity", "constituency_similarity")
    strong = reduce(lambda a, b: a & b, (e[n] >= config.strong_context for n in context))
    hard = has("different MP") | has("different state") | has("different constituency")
    clashes = F.filter("warnings", lambda w: F.startswith(w, F.lit("conflicting ")))
    clean = strong & ~hard & (F.size(clashes) == 0) & (desc >= config.tier2_description) & (anchors >= 25)
    first = clean & (score >= config.tier1_score) & (margin >= config.tier1_margin) & (desc >= config.tier1_description)
    second = clean & (score >= config.tier2_score) & (margin >= config.tier2_margin) & (anchors >= 35)
    fmt = T.formatted
    below = lambda pattern, names, limit: F.filter(F.array(*(F.when(e[n] < limit, fmt(pattern.replace("NAME", n), e[n])) for n in names)), lambda x: x.isNotNull())
    weak_parts = F.filter(F.array(F.when(desc < config.tier2_description, fmt(f"description_similarity=%.1f < {config.tier2_description:g} floor", desc)), F.when(anchors < 25, fmt("project_token_overlap=%.1f < 25 floor", anchors))), lambda x: x.isNotNull())
    rules = [
        (e["amount_similarity"] < config.amount_gate, "", fmt("Amount similarity hard gate failed (amount_similarity=%.1f < 50 required)", e["amount_similarity"])),
        (first & has("different IDA") & (desc < 96), "", fmt("IDA mismatch with insufficient description similarity for override (description_similarity=%.1f < 96 required when IDA differs)", desc)),
        (first & has("different category") & (desc < 95), "", fmt("Category mismatch with insufficient description similarity for override (description_similarity=%.1f < 95 required when category differs)", desc)),
        (first, "Tier 1", F.lit("")),
        (second & has("different IDA") & (desc < 90), "", fmt("IDA mismatch with insufficient description similarity for Tier 2 override (description_similarity=%.1f < 90 required when IDA differs)", desc)),
        (second, "Tier 2", F.lit("")),
        (F.size(clashes) > 0, "", F.concat(F.lit("Conflicting field(s) detected: "), F.array_join(clashes, "; "))),
        (hard, "", F.concat(F.lit("Hard entity mismatch: "), F.array_join(F.array_intersect("warnings", F.array(F.lit("different MP"), F.lit("different state"), F.lit("different constituency"))), ", "))),
        (~strong, "", F.concat(F.lit(f"Insufficient context strength (requires ≥{config.strong_context:g}): "), F.array_join(below("NAME=%.1f", context, config.strong_context), ", "))),
        (F.size(weak_parts) > 0, "", F.concat(F.lit("Weak description signal: "), F.array_join(weak_parts, "; "))),
        (score < config.tier2_score, "", fmt(f"Score below Tier 2 threshold (score=%.3f < {config.tier2_score:g})", score)),
        (margin < config.tier2_margin, "", fmt(f"Score margin too small (margin=%.3f < {config.tier2_margin:g} required)", margin)),
        (anchors < 35, "", fmt("Token overlap below Tier 2 minimum (project_token_overlap=%.1f < 35)", anchors)),
    ]
    tier, blocker = F.lit("Unmatched"), fmt("Score/margin/tier conditions not met (score=%.3f, margin=%.3f)", score, margin)
    for condition, name, reason in reversed(rules):
        tier, blocker = F.when(condition, F.lit(name or "Unmatched")).otherwise(tier), F.when(condition, reason).otherwise(blocker)
    confidence = F.when(F.col("match_tier") == "Tier 1", "Verified").when(F.col("match_tier") == "Tier 2", "Provisional").otherwise("Unmatched")
    return df.withColumns({"match_tier": tier, "blocker": blocker}).withColumn("match_confidence", confidence)


def _token_set(tokens: str) -> Column:
    """What equal lists of tokens share."""
    return F.unhex(F.sha2(F.array_join(tokens, " "), 256))


def _pools(asked: DataFrame, comp: DataFrame, limit: int, config: Config) -> tuple[DataFrame, int]:
    """((key, pool); tasks that they are dealt to by key): of each list of tokens (key, tokens) the completions that share
    one of its rarest indexed tokens, the rarest token's first, at most ``limit`` of them, as an array."""
    least = asked.sparkSession.sparkContext.defaultParallelism
    posts = comp.select(C, F.explode("c_tokens").alias("token"))
    counted = asked.agg(F.sum(F.size("tokens"))).first()[0] or 0
    df = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rare = asked.select("key", F.explode("tokens").alias("token")).join(apart(df), "token").repartition(max(least, counted // TASK_ROWS), "key")
    by = Window.partitionBy("key").orderBy("df", "token")
    rare = rare.withColumns({"rank": F.row_number().over(by), "before": F.lag("df").over(by)}).filter(F.col("rank") <= config.rare_tokens)
    # a token that limit completions have leaves no room for those after it
    rare = stage(rare.filter(F.coalesce("before", F.lit(0)) < limit).drop("before"), "rare")
    # a token gives its first completions; no more than limit of them can be among the pool's first
    used = rare.groupBy("token").agg(F.any_value("df").alias("df"))
    posts = posts.join(apart(used.select("token")), "token")
    salted = posts.repartition(max(least, (used.agg(F.sum("df")).first()[0] or 0) // TASK_ROWS), "token", F.pmod(F.col(C), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(C))).filter(F.col("place") <= limit)
    lists = first.groupBy("token").agg(F.array_sort(F.collect_list(C)).alias("posts"))
    tasks = max(least, (rare.agg(F.sum(F.least("df", F.lit(limit)))).first()[0] or 0) // (4 * TASK_ROWS))
    each = rare.join(apart(lists), "token").select("key", F.struct("rank", "posts").alias("list")).repartition(tasks, "key").groupBy("key").agg(F.array_sort(F.collect_list("list")).alias("lists"))
    pool = F.slice(F.array_distinct(F.flatten(F.transform("lists", lambda x: x["posts"]))), 1, limit)
    return each.select("key", pool.alias("pool")), tasks


def token_pool(rec: DataFrame, comp: DataFrame, limit: int, config: Config = DEFAULT) -> DataFrame:
    """(recommendation_index, completion_index, pool_rank): completions that share one of the recommendation's
    rarest indexed tokens, the rarest token's first, at most ``limit`` of them. Equal lists of tokens are looked up once."""
    asked = stage(rec.filter(F.size("r_tokens") > 0).select(R, _token_set("r_tokens").alias("key"), F.col("r_tokens").alias("tokens")), "asked")
    pools, tasks = _pools(asked.groupBy("key").agg(F.any_value("tokens").alias("tokens")), comp, limit, config)
    return asked.select(R, "key").repartition(tasks, "key").join(apart(pools), "key").select(R, F.posexplode("pool").alias("pool_rank", C)).select(R, C, (F.col("pool_rank") + 1).alias("pool_rank"))


def _key(prefix: str) -> Column:
    """What rows share that have one description in one entity."""
    return F.unhex(F.sha2(F.to_json(F.struct(*(F.col(f"{prefix}_{k}").alias(k) for k in ("work_norm", *ENTITY)))), 256))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(mine, theirs): arrays of the rows of both sides of equal key, some TILE of each at most. Keys of any size are cut on
    both sides, and every piece of one meets every piece of the other; tasks are dealt by numbers of pairs."""
    least = left.sparkSession.sparkContext.defaultParallelism
    count = lambda df, name: df.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    groups = stage(count(left, "_mine").join(apart(count(right, "_theirs")), "key"), "groups")
    pairs = groups.agg(F.sum(F.col("_mine").cast("double") * F.col("_theirs"))).first()[0] or 0
    tasks = max(least, int(pairs // TASK_PAIRS))
    groups = apart(groups.select("key", *(F.ceil(F.col(n) / TILE).alias(n) for n in ("_mine", "_theirs"))))

    def pieces(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        row = F.struct(*(c for c in df.columns if c != "key"))
        cut = df.join(groups, "key").select("key", F.pmod(F.xxhash64(row), F.col(own)).alias(f"{own}_piece"), other, row.alias("row"))
        cut = cut.groupBy("key", f"{own}_piece", other).agg(F.collect_list("row").alias(name))
        return cut.select("key", f"{own}_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"{other}_piece"), name)

    on = ["key", "_mine_piece", "_theirs_piece"]
    sides = pieces(left, "_mine", "_theirs", "mine"), pieces(right, "_theirs", "_mine", "theirs")
    mine, theirs = (side.repartition(tasks, *on) for side in sides)
    return mine.join(apart(theirs), on).select("mine", "theirs")


def _dated(rec: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys and times of both sides."""
    return rec.filter("r_work_norm <> ''").select(R, _key("r").alias("key"), S.micros(F.col("r_date")).alias("r_time")), comp.select(C, _key("c").alias("key"), S.micros(F.col("c_date")).alias("c_time"))


def _alike(rec: DataFrame, comp: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(all pairs of equal descriptions in one entity within the date window; the recommendations that have any)."""
    mine, theirs = (stage(side, "dated") for side in _dated(rec, comp))
    on_time = lambda x: S.in_window(S.days_of(F.col("r_time"), x), config)
    pairs = _met(mine, theirs).select("theirs", F.inline("mine")).select(R, "r_time", F.inline("theirs")).filter(on_time(F.col("c_time")))
    having = _met(mine, theirs.select("key", "c_time").distinct()).select("theirs", F.inline("mine")).filter(F.exists("theirs", lambda x: on_time(x["c_time"])))
    return pairs.select(R, C), having.select(R).distinct()


#: Stands for a time that is missing.
NEVER = -(1 << 63)


def _two_best(batches: Iterator[pa.RecordBatch], config: Config) -> Iterator[pa.RecordBatch]:
    """(recommendation_index, completion_index, score): of each recommendation of ``mine`` the two completions of ``theirs``
    of the best scores, the first of equal ones; the same arithmetic as :func:`scored`."""
    for batch in batches:
        sides = []
        for name in ("mine", "theirs"):
            lists = batch.column(name)
            rows = lists.flatten()
            sides.append((lists.offsets.to_numpy() - lists.offsets[0].as_py(), {f.name: rows.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(rows.type)}))
        (l_ends, left), (r_ends, right) = sides
        found = []
        for i in range(batch.num_rows):
            own, other = ({c: v[ends[i] : ends[i + 1]] for c, v in side.items()} for ends, side in sides)
            order = np.argsort(other[C], kind="stable")
            other = {c: v[order] for c, v in other.items()}
            a, b, start, end = own["r_amount"][:, None], other["c_amount"], own["r_time"][:, None], other["c_time"]
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                fine = (a > 0) & (a < np.inf) & ((b > 0) & (b < np.inf))
                amounts = np.where(fine, 100.0 * np.minimum(a, b) / np.maximum(a, b), 0.0)
                days = np.floor((end - start) / 86_400_000_000)
                known = (start != NEVER) & (end != NEVER)
                timeline = np.where((days >= 0) & (days <= config.date_window), np.maximum(20.0, 100.0 - 45.0 * days / config.date_window), np.where((days >= config.early_days) & (days <= -1), 10.0, 0.0))
                timeline = np.where(known, timeline, 45.0)
                score = np.maximum(0.0, own["_base"][:, None] + WEIGHTS[6] * amounts + WEIGHTS[7] * timeline - own["_penalty"][:, None])
            score[known & ((days < config.early_days) | (days > config.date_window))] = -1.0
            every = np.arange(len(score))
            for _ in range(min(2, score.shape[1])):
                at = score.argmax(axis=1)
                best = score[every, at]
                hit = best >= 0
                found.append((own[R][hit], other[C][at[hit]], best[hit]))
                score[every, at] = -1.0
        columns = [np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype("int64")), pa.array(columns[1].astype("int64")), pa.array(columns[2].astype("float64"))], names=[R, C, "score"])


def _best_alike(rec: DataFrame, comp: DataFrame, config: Config) -> DataFrame:
    """Of the pairs of equal descriptions in one entity within the date window those that can be a recommendation's best or
    next: all where FEW completions have the description, else the two of the best scores, the first of equal ones. What the
    texts say is found once for all rows of equal texts (``r_kind``, ``c_kind``)."""
    mine, theirs = _dated(rec, comp)
    mine = mine.join(apart(rec.select(R, "r_kind", "r_amount")), R)
    theirs = stage(theirs.join(apart(comp.select(C, "c_kind", "c_amount")), C), "alike")
    sizes = theirs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    mine = stage(mine.join(apart(sizes), "key"), "asked")
    on_time = S.in_window(S.days_of(F.col("r_time"), F.col("c_time")), config)
    few = mine.filter(F.col("n") <= FEW).join(apart(theirs), "key").filter(on_time).select(R, C)
    if (mine.agg(F.max("n")).first()[0] or 0) <= FEW:
        return few
    many = mine.filter(F.col("n") > FEW)
    first = lambda df, kind, index: _small(stage(df.groupBy(kind).agg(F.min(index).alias(index)).select(index), "kinds"))
    large = theirs.join(apart(many.select("key").distinct()), "key", "left_semi")
    kinds = rec.join(first(many, "r_kind", R), R, "left_semi").withColumn("key", _key("r")).join(apart(comp.join(first(large, "c_kind", C), C, "left_semi").withColumn("key", _key("c"))), "key")
    said = stage(_texts_said(kinds, config).select("r_kind", F.col("c_kind").alias("key"), "_base", "_penalty"), "said")
    asked = many.select(R, "r_kind", "r_amount", "r_time").join(_small(said), "r_kind").drop("r_kind")
    timed = lambda df, x: df.withColumns({f"{x}_time": F.coalesce(f"{x}_time", F.lit(NEVER)), f"{x}_amount": F.coalesce(f"{x}_amount", F.lit(0.0))})
    met = _met(timed(asked, "r"), timed(large.select(F.col("c_kind").alias("key"), C, "c_amount", "c_time"), "c"))
    found = met.mapInArrow(lambda batches: _two_best(batches, config), f"{R} bigint, {C} bigint, score double")
    best = found.groupBy(R).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), C))).alias("some"))
    best = best.select(R, F.inline(F.slice("some", 1, 2))).select(R, C)
    return few.unionByName(best)


def _by_work_id(rec: DataFrame, comp: DataFrame, config: Config) -> DataFrame:
    first = comp.filter("c_work_id_key <> ''").withColumn("turn", F.row_number().over(Window.partitionBy("c_work_id_key").orderBy(C))).filter(F.col("turn") <= config.candidates).drop("turn")
    pairs = rec.filter("r_work_norm <> ''").join(apart(first), F.col("r_work_id_key") == F.col("c_work_id_key"))
    agree = (S.token_set(F.col("r_work_norm"), F.col("c_work_norm")) >= 80) & (S.token_set(F.col("r_mp_norm"), F.col("c_mp_norm")) >= 95) & (S.token_set(F.col("r_state_norm"), F.col("c_state_norm")) >= 95)
    return pairs.filter(S.in_window(_days(), config)).filter(agree).select(R, C)


def _in_block(rec: DataFrame, comp: DataFrame, config: Config) -> DataFrame:
    """The most similar of the entity's completions."""
    on = [(f"r_{k}", f"c_{k}") for k in ENTITY]
    texts = most_similar(rec, comp, on, "r_work_norm", "c_work_norm", config.candidates, config.similarity_cutoff)
    # ids alone: a text may be that of many completions
    near = rec.select(R, "r_work_norm", *(r for r, _ in on)).join(apart(texts), ["r_work_norm", *(r for r, _ in on)])
    near = near.withColumnsRenamed(dict(on)).join(apart(comp.select(C, "c_work_norm", *(c for _, c in on))), ["c_work_norm", *(c for _, c in on)])
    turn = F.row_number().over(Window.partitionBy(R).orderBy(F.desc("similar"), C))
    return near.select(R, C, turn.alias("place")).filter(F.col("place") <= config.candidates)


def _by_tokens(rec: DataFrame, comp: DataFrame, config: Config) -> DataFrame:
    """Those of the token pool that are nearest in place; equal lists of tokens in one place are looked up once."""
    places = ("state_norm_key", "constituency_canonical_key")
    asked = stage(rec.filter(F.size("r_tokens") > 0).select(R, _token_set("r_tokens").alias("key"), F.col("r_tokens").alias("tokens"), *(f"r_{p}" for p in places)), "asked")
    pools, tasks = _pools(asked.groupBy("key").agg(F.any_value("tokens").alias("tokens")), comp, config.pool_limit, config)
    kinds = asked.select("key", *(f"r_{p}" for p in places)).distinct()
    pool = kinds.repartition(tasks, "key").join(apart(pools), "key").select(*kinds.columns, F.posexplode("pool").alias("pool_rank", C)).join(apart(comp.select(C, *(f"c_{p}" for p in places))), C)
    same_state = F.col("r_state_norm_key") == F.col("c_state_norm_key")
    fit = F.when(same_state & (F.col("r_constituency_canonical_key") == F.col("c_constituency_canonical_key")), 2).when(same_state, 1).otherwise(0)
    # the best level that occurs is kept: its first ones precede all others; a pair in the same constituency is also in the same state
    by = Window.partitionBy(*kinds.columns).orderBy(F.desc("fit"), "pool_rank")
    pool = pool.select(*kinds.columns, C, "pool_rank", fit.alias("fit")).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= config.candidates)
    pool = pool.withColumn("best_fit", F.max("fit").over(Window.partitionBy(*kinds.columns))).filter("fit = best_fit").select(*kinds.columns, C, "place")
    return asked.select(R, *kinds.columns).join(apart(pool), kinds.columns).select(R, C, "place")


def _shared(side: DataFrame, *but: str) -> Column:
    """What rows share that agree in all columns of a side but some."""
    return F.unhex(F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in side.columns if c not in but))), 256))


def candidates(rec: DataFrame, comp: DataFrame, config: Config = DEFAULT, alike: DataFrame | None = None) -> DataFrame:
    """(recommendation_index, completion_index, stage, place, source) of all pairs to score. ``alike``: the pairs of equal
    descriptions to take, some of each recommendation that has any; if not given, all."""
    tag = lambda df, stage, source: df.select(R, C, F.lit(stage).alias("stage"), F.col("place").cast("bigint").alias("place"), F.lit(source).alias("source"))
    alike, having = (alike, alike.select(R).distinct()) if alike is not None else _alike(rec, comp, config)
    named = stage(_by_work_id(rec, comp, config), "named")
    sure = [tag(df.withColumn("place", F.col(C)), i, source) for df, i, source in ((alike, 1, "exact normalized description"), (named, 2, "corroborated Work ID"))]
    rest = rec.filter("r_work_norm <> ''").select(R, *(F.col(f"r_{k}").alias(k) for k in ENTITY)).join(apart(having), R, "left_anti").join(apart(named.select(R).distinct()), R, "left_anti")
    sizes = comp.groupBy(*(F.col(f"c_{k}").alias(k) for k in ENTITY)).agg(F.count(F.lit(1)).alias("block"))
    rest = stage(rest.join(apart(sizes), list(ENTITY), "left").select(R, F.coalesce("block", F.lit(0)).between(1, config.block_limit).alias("blocked")), "rest")
    of = lambda some: rec.join(apart(rest.filter(some).select(R)), R, "left_semi")
    near = tag(_in_block(of("blocked"), comp, config), 3, "blocked fuzzy retrieval")
    far = tag(_by_tokens(of("not blocked"), comp, config), 3, "fuzzy token retrieval")
    late = near.unionByName(far).join(apart(rec.select(R, "r_date")), R).join(apart(comp.select(C, "c_date")), C)
    return sure[0].unionByName(sure[1]).unionByName(late.filter(S.in_window(_days(), config)).select(*sure[0].columns))


def ranked(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The best scored pair of each recommendation, with ``margin`` to the next completion's."""
    one = pairs.withColumn("turn", F.row_number().over(Window.partitionBy(R, C).orderBy(F.desc("score"), "stage", "place"))).filter("turn = 1")
    by = Window.partitionBy(R).orderBy(F.desc("score"), "stage", "place", C)
    best = one.withColumns({"next": F.lead("score").over(by), "turn": F.row_number().over(by)}).filter("turn = 1")
    return best.withColumn("margin", F.col("score") - F.coalesce("next", F.lit(0.0)))


def one_to_one(matches: DataFrame) -> DataFrame:
    """Each completion stays with the recommendation of the best rounded score, of equal ones the first;
    the others become unmatched and keep what was said of their best candidate."""
    by = Window.partitionBy(C).orderBy(F.desc("match_score"), R)
    held = matches.filter(F.col(C) >= 0).withColumn("turn", F.row_number().over(by))
    lost = F.col("turn") > 1
    reason = F.concat(F.lit(f"{TAG}Candidate already assigned to a stronger recommendation (one-to-one matching) || "), "match_reason")
    held = held.withColumns({C: F.when(lost, F.lit(-1).cast("bigint")).otherwise(F.col(C)), "match_score": F.when(lost, 0.0).otherwise(F.col("match_score")), "match_tier": F.when(lost, "Unmatched").otherwise(F.col("match_tier")), "match_confidence": F.when(lost, "Unmatched").otherwise(F.col("match_confidence")), "match_reason": F.when(lost, reason).otherwise(F.col("match_reason"))})
    return held.drop("turn").unionByName(matches.filter(F.col(C) < 0))


RESULT = (R, C, "match_score", "match_tier", "match_confidence", "score_margin", "best_candidate_index", "best_candidate_score", "best_candidate_tier", "match_reason")


def pool_bounds(pool: DataFrame, rec: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: id, text; the pairs of a pool with ``bound``, by key (the recommendation), l_id and r_id)."""
    pool = stage(pool, "pool")
    own = pool.select(R).distinct().join(apart(rec.select(R, F.col("r_work_norm").alias("l_text"))), R)
    met = pool.select(C).distinct().join(apart(comp.select(C, F.col("c_work_norm").alias("r_text"))), C)
    every = own.select(F.col("l_text").alias("text")).union(met.select("r_text")).distinct()
    texts = stage(profiled(every.withColumn("id", F.monotonically_increasing_id()), "text", "profile"), "texts")
    side = lambda name: texts.select(F.col("text").alias(f"{name}_text"), F.col("id").alias(f"{name}_id"), F.col("profile").alias(f"{name}_profile"))
    pairs = pool.join(apart(own.join(side("l"), "l_text")), R).join(apart(met.join(side("r"), "r_text")), C)
    pairs = bounded(pairs, "l_profile", "r_profile").select(F.col(R).alias("key"), "l_id", "r_id", "bound", C, "pool_rank")
    return texts.select("id", "text"), stage(pairs, "pool")


def _fallback(rec: DataFrame, comp: DataFrame, config: Config) -> DataFrame:
    """For recommendations without candidates: the most similar of a small pool, for information only."""
    texts, pool = pool_bounds(token_pool(rec, comp, config.fallback_pool, config), rec, comp)
    pool = reduce(DataFrame.union, waves(pool, texts, 1, -1.0)).join(pool.select("key", "l_id", "r_id", C, "pool_rank"), ["key", "l_id", "r_id"])
    best = pool.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similar"), "pool_rank"))).filter("turn = 1")
    best = best.select(F.col("key").alias(R), C).join(apart(rec), R).join(apart(comp), C)
    told = F.concat_ws(", ", *(T.formatted(f"{n}=%.1f", F.col(n)) for n in EVIDENCE))
    return scored(best, config).select(R, F.col(C).alias("best_candidate_index"), F.round("score", 3).alias("best_candidate_score"), F.concat(F.lit("Best candidate did not reach a match tier; "), told).alias("match_reason"))


def match_records(recommendations: DataFrame, completions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The match of every recommendation, in the ten columns of RESULT and the columns of EVIDENCE (null
    where there was no candidate)."""
    # several branches read each of these, so they are written once
    told = lambda side, index, x: stage(side.withColumns({"profile": _shared(side, index), f"{x}_kind": _shared(side, index, f"{x}_amount", f"{x}_date")}), "plain")
    every, comp = told(plain_recommendations(recommendations), R, "r"), told(plain_completions(completions), C, "c")
    # recommendations that agree in all but their index have the same candidates, so the first of them stands for all
    members = every.select(R, "profile")
    rec = stage(told_once(every.join(apart(members.groupBy("profile").agg(F.min(R).alias(R)).select(R)), R, "left_semi"), "r"), "firsts")
    firsts, rec = rec.select(R, "profile"), rec.drop("profile")
    # of completions that agree in all but their index, two decide the best score and the margin to the next
    turn = F.row_number().over(Window.partitionBy("profile").orderBy(C))
    two = comp.select(C, "profile", turn.alias("turn")).filter("turn <= 2").select(C)
    comp = stage(told_once(comp.drop("profile"), "c"), "completions")
    alike = stage(_best_alike(rec, comp.join(apart(two), C, "left_semi"), config), "alike")
    pairs = stage(candidates(rec, comp, config, alike), "candidates")
    pairs = scored(pairs.join(apart(rec), R).join(apart(comp), C), config).select(*pairs.columns, "score", "warnings", *EVIDENCE)
    best = stage(tiered(ranked(pairs, config), config), "best")
    accepted = F.col("match_tier") != "Unmatched"
    detail = F.concat(F.col("source"), *(T.formatted(f"; {s}=%.1f", F.col(n)) for s, n in zip(SHORT, EVIDENCE)), F.when(F.size("warnings") > 0, F.concat(F.lit("; warnings="), F.array_join("warnings", ", "))).otherwise(F.lit("")))
    found = best.select(
        R, F.when(accepted, F.col(C)).otherwise(F.lit(-1)).cast("bigint").alias(C), F.when(accepted, F.round("score", 3)).otherwise(0.0).alias("match_score"), "match_tier", "match_confidence",
        F.round("margin", 3).alias("score_margin"), F.col(C).alias("best_candidate_index"), F.round("score", 3).alias("best_candidate_score"), F.col("match_tier").alias("best_candidate_tier"),
        F.when(F.col("blocker") != "", F.concat(F.lit(TAG), "blocker", F.lit(" || "), detail)).otherwise(detail).alias("match_reason"), *EVIDENCE,
    )
    missing = stage(rec.join(apart(found.select(R)), R, "left_anti"), "missing")
    hint = _fallback(missing.filter("r_work_norm <> ''"), comp, config)
    none = F.lit("Unmatched")
    bare = missing.select(R, "r_work_norm").join(apart(hint), R, "left").select(
        R, F.lit(-1).cast("bigint").alias(C), F.lit(0.0).alias("match_score"), none.alias("match_tier"), none.alias("match_confidence"), F.lit(0.0).alias("score_margin"),
        F.coalesce("best_candidate_index", F.lit(-1)).cast("bigint").alias("best_candidate_index"), F.coalesce("best_candidate_score", F.lit(0.0)).alias("best_candidate_score"), none.alias("best_candidate_tier"),
        F.when(F.col("r_work_norm") == "", F.lit("Missing work description.")).otherwise(F.coalesce("match_reason", F.lit("No candidate survived description/date screening."))).alias("match_reason"),
        *(F.lit(None).cast("double").alias(n) for n in EVIDENCE),
    )
    said = found.unionByName(bare).join(apart(firsts), R)
    return one_to_one(said.drop(R).join(apart(members), "profile").select(*found.columns))
