"""Samples that match target category proportions (problem 5)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.common import permuted_position
from chronotext.session import table

SEED, FRACTION = 42, 5
#: A retired topic name and what it means now.
RENAMED = {"unemployment": "labor_market"}
REST = "(other)"
#: Between the topics of a leaf; rounds in which a type's leaves are fitted to its topic quotas, and in which unmet ones move to other types.
AND, FIT_ROUNDS, PASS_ROUNDS = "|", 300, 6


def category(name: Column) -> Column:
    """Trimmed, in lower case, with _ for blanks and hyphens; a retired name by its new one; blank is null."""
    c = F.regexp_replace(F.lower(F.trim(name)), r"[\s-]", "_")
    for old, new in RENAMED.items():
        c = F.when(c == old, new).otherwise(c)
    return F.nullif(c, F.lit(""))


def usable_records(rows: DataFrame, id_: str = "id", doc_type: str = "doc_type", top: str = "top") -> DataFrame:
    """(id, types, tops): each id with a doc_type, the categories of any of its rows. Null ids are left out."""
    tops = F.transform(F.coalesce(F.col(top), F.array().cast("array<string>")), lambda x: category(x))
    pairs = rows.select(F.col(id_).alias("id"), category(F.col(doc_type)).alias("t"), F.explode_outer(tops).alias("c")).filter(F.col("id").isNotNull())
    return pairs.groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("types"), F.array_sort(F.collect_set("c")).alias("tops")).filter(F.size("types") > 0)


def wanted_number(share: float, least: int, sample: int) -> int:
    return max(int(least), math.ceil(round(share * sample, 9)))


def category_counts(records: DataFrame, targets: list) -> tuple[int, dict[tuple[str, str], int]]:
    """(usable records, records by target category): as many numbers as there are targets come to the driver."""
    sums = [F.count_if(F.array_contains("types" if t["field_name"] == "doc_type" else "tops", t["category"])).alias(f"c{i}") for i, t in enumerate(targets)]
    row = records.agg(F.count("*").alias("n"), *sums).first()
    return row["n"], {(t["field_name"], t["category"]): row[f"c{i}"] for i, t in enumerate(targets)}


def read_targets(targets: DataFrame) -> list:
    return [r.asDict() for r in targets.select("field_name", category(F.col("category")).alias("category"), F.col("category").alias("as_given"), "share", "min_n").dropna().orderBy("field_name", "category").collect()]


def spread(amount: int, weights: dict, room: dict) -> dict:
    """`amount` over the keys in proportion to their weights, whole numbers by largest remainder, none beyond its room."""
    out = dict.fromkeys(weights, 0)
    while amount > 0:
        open_ = {k: w for k, w in weights.items() if w > 0 and out[k] < room[k]}
        total = sum(open_.values())
        if not open_:
            break
        parts = {k: amount * w / total for k, w in open_.items()}
        give = {k: min(room[k] - out[k], int(p)) for k, p in parts.items()}
        rest = amount - sum(int(p) for p in parts.values())
        for k in sorted(parts, key=lambda k: (int(parts[k]) - parts[k], str(k)))[:rest]:
            give[k] = min(room[k] - out[k], give[k] + 1)
        done = sum(give.values())
        if not done:
            break
        for k, g in give.items():
            out[k] += g
        amount -= done
    return out


def members(topic: str) -> list[str]:
    return [] if topic == REST else topic.split(AND)


def fitted_leaves(room: np.ndarray, holds: np.ndarray, quota: float, topics: np.ndarray) -> np.ndarray:
    """Amounts of the leaves of one type, none beyond its room, that sum to the quota and come as close to the topic quotas
    as they can; holds: leaves x topics. Each topic has a factor, raised while it has too little (a leaf's amount is its
    room times the factors of its topics times a common one), so what a leaf cannot give its siblings of the same topic do."""
    if room.sum() <= quota:
        return room.astype(float)
    force = np.zeros(holds.shape[1])
    x = room * quota / room.sum()
    for _ in range(FIT_ROUNDS):
        pull = room * np.exp(np.clip(holds @ force, -40, 40))
        low, high = 0.0, 1e30
        for _ in range(200):
            mid = np.sqrt(max(low, 1e-30) * high)
            low, high = (mid, high) if np.minimum(room, mid * pull).sum() < quota else (low, mid)
            if high <= low * (1 + 1e-12):
                break
        x = np.minimum(room, high * pull)
        have = x @ holds
        if np.all(np.abs(have - topics) < 0.01):
            break
        force += np.clip(np.log(np.maximum(topics, 1e-6) / np.maximum(have, 1e-6)), -1, 1)
        force = np.clip(force, -30, 30)
    return x


def whole_numbers(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """x in whole numbers, within room; the remainder of each is carried to the next, so sums of neighbours stay close."""
    out, carry = np.zeros(len(x), np.int64), 0.0
    for i, (v, r) in enumerate(zip(x, room)):
        out[i] = max(0, min(int(r), math.floor(carry + v + 0.5)))
        carry += v - out[i]
    for i in range(len(x)):
        if carry < 0.5:
            break
        more = min(int(room[i]) - out[i], math.floor(carry + 0.5))
        out[i] += more
        carry -= more
    return out


def round_up(quota: dict[tuple[str, str], int], leaves: dict[tuple[str, str], int], wanted: dict[str, int]) -> None:
    """Make up for what rounding left short of a topic: one record at a time, within a type, from leaves that can spare it.

    A leaf can spare if none of its topics falls below its own number by it; a few records at most are moved.
    """
    have = {n: sum(q for k, q in quota.items() if n in members(k[1])) for n in wanted}
    for n in sorted(wanted):
        for k in sorted(k for k in leaves if n in members(k[1])):
            for g in sorted((g for g in quota if g[0] == k[0] and n not in members(g[1])), key=lambda g: (-quota[g], g)):
                rest = [m for m in members(g[1]) if m in wanted and m not in members(k[1])]
                while have[n] < wanted[n] and quota.get(k, 0) < leaves[k] and quota[g] > 0 and all(have[m] > wanted[m] for m in rest):
                    quota[g] -= 1
                    quota[k] = quota.get(k, 0) + 1
                    for m in members(g[1]):
                        if m in have:
                            have[m] -= 1
                    for m in members(k[1]):
                        if m in have:
                            have[m] += 1


def allocate(sample: int, tree: dict[str, dict[str, int]], types: dict[str, tuple[float, int]], tops: dict[str, tuple[float, int]]) -> dict[tuple[str, str], int]:
    """Quota of each leaf (type, topics) from the available numbers in `tree`; types, tops: (share, minimum).

    A leaf's topics are those of its records, joined by AND; each counts for all of them. Top-down: the sample over the
    types, what a type cannot give to the others; each type over its leaves so that its topics have their shares, where
    what a leaf cannot give goes to its siblings (leaves of the type with that topic). What a type cannot give of a topic
    is asked of its cousins, the leaves of other types with that topic. What is left goes to records of no target type.
    Then minimums: a category below its minimum takes from the largest leaf that can spare.
    """
    names = sorted(tops)
    room = {t: sum(cs.values()) for t, cs in tree.items()}
    wanted = spread(sample, {t: s for t, (s, _) in types.items()}, {t: room.get(t, 0) for t in types})
    leaf_of = {t: sorted(tree.get(t, {})) for t in types}
    rooms = {t: np.array([tree[t][c] for c in cs], float) for t, cs in leaf_of.items()}
    holds = {t: np.array([[n in members(c) for n in names] for c in cs], float).reshape(len(cs), len(names)) for t, cs in leaf_of.items()}
    share = np.array([tops[n][0] for n in names])
    asked = {t: wanted[t] * share for t in types}
    amount: dict[str, np.ndarray] = {}
    for _ in range(PASS_ROUNDS):
        for t in types:
            amount[t] = fitted_leaves(rooms[t], holds[t], wanted[t], asked[t])
        unmet = share * sum(wanted.values()) - sum((amount[t] @ holds[t] for t in types), np.zeros(len(names)))
        spare = {t: (rooms[t] - amount[t]) @ holds[t] for t in types}
        total = sum(spare.values(), np.zeros(len(names)))
        if not np.any((unmet > 0.5) & (total > 0)):
            break
        for t in types:
            asked[t] = np.maximum(0, amount[t] @ holds[t] + np.where(total > 0, unmet * spare[t] / np.maximum(total, 1e-9), 0))
    quota = {(t, c): int(n) for t in types for c, n in zip(leaf_of[t], whole_numbers(amount[t], rooms[t]))} if types else {}
    leaves = {(t, c): n for t, cs in tree.items() for c, n in cs.items()}
    over = sample - sum(quota.values())
    for only in (lambda k: k[0] in types, lambda k: True):
        more = spread(over, {k: n for k, n in leaves.items() if only(k)}, {k: n - quota.get(k, 0) for k, n in leaves.items()})
        for k, g in more.items():
            quota[k] = quota.get(k, 0) + g
        over -= sum(more.values())
    round_up(quota, leaves, {n: min(wanted_number(tops[n][0], 0, sample), sum(c for k, c in leaves.items() if n in members(k[1]))) for n in names})
    for named, mine_of in ((types, lambda k, n: k[0] == n), (tops, lambda k, n: n in members(k[1]))):
        for name, (_, least) in sorted(named.items()):
            mine = [k for k in leaves if mine_of(k, name)]
            need = min(least, sum(leaves[k] for k in mine)) - sum(quota.get(k, 0) for k in mine)
            for k in sorted(mine, key=lambda k: (quota.get(k, 0) - leaves[k], k)):
                while need > 0 and quota.get(k, 0) < leaves[k]:
                    giver = max((g for g in quota if g not in mine and quota[g] > 1), key=lambda g: (quota[g], g), default=None)
                    if giver is None:
                        need = 0
                        break
                    quota[giver] -= 1
                    quota[k] = quota.get(k, 0) + 1
                    need -= 1
    return {k: q for k, q in quota.items() if q > 0}


def proportional_sample(records: DataFrame, targets: list, seed: int = SEED) -> DataFrame:
    """(id, type, topic, types, tops) of a sample of a FRACTION-th of the records, by quota of each leaf.

    A record is at the leaf of its first target type and of all its target topics, REST if it has none. The leaf counts
    (at most target types times 2 ** target topics) come to the driver; drawing is a seeded order within each leaf, which
    is cut into slices so that a hot leaf is no single task.
    """
    of = lambda f: {t["category"]: (t["share"], int(t["min_n"])) for t in targets if t["field_name"] == f}
    types, tops = of("doc_type"), of("top")
    first = lambda col, names: F.coalesce(*[F.when(F.array_contains(col, n), n) for n in names], F.lit(REST))
    placed = records.withColumn("type", first("types", sorted(types)))
    its = F.array_join(F.filter(F.array(*[F.when(F.array_contains("tops", c), c) for c in sorted(tops)]).cast("array<string>"), lambda x: x.isNotNull()), AND)
    placed = placed.withColumn("topic", F.when(its == "", REST).otherwise(its))
    tree: dict[str, dict[str, int]] = {}
    for r in placed.groupBy("type", "topic").agg(F.count("*").alias("n")).collect():
        tree.setdefault(r["type"], {})[r["topic"]] = r["n"]
    sample = sum(n for cs in tree.values() for n in cs.values()) // FRACTION
    quotas = [(t, c, q) for (t, c), q in sorted(allocate(sample, tree, types, tops).items())]
    quota = records.sparkSession.createDataFrame(quotas, "type string, topic string, quota long")
    drawn = permuted_position(placed.select("id", "type", "topic", "types", "tops"), ["type", "topic"], ["id"], seed).join(quota, ["type", "topic"])
    return drawn.filter(F.col("before") < F.col("quota")).drop("before", "quota")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    return usable_records(table(spark, sf_dir, "annotations")), read_targets(table(spark, sf_dir, "sample_targets"))


def target_report(records: DataFrame, targets: list) -> list[tuple]:
    """(field_name, category, as_given, share, wanted, available, drawn, share_drawn, short, lacking) per target, from the sample as drawn.

    short: fewer were drawn than wanted. lacking: of these, the categories with fewer usable records than wanted.
    """
    usable, available = category_counts(records, targets)
    drawn_n, drawn = category_counts(proportional_sample(records, targets), targets)
    out = []
    for t in targets:
        k = (t["field_name"], t["category"])
        want = wanted_number(t["share"], t["min_n"], usable // FRACTION)
        short = drawn[k] < want
        out.append((*k, t["as_given"], float(t["share"]), want, available[k], drawn[k], round(drawn[k] / drawn_n, 6) if drawn_n else None, short, short and available[k] < want))
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = [(r[0], r[2]) for r in target_report(*_inputs(spark, sf_dir)) if r[-1]]
    return spark.createDataFrame(short, "field_name string, category string")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, targets = _inputs(spark, sf_dir)
    return proportional_sample(records, targets).select("id", "type", "topic")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: wanted, available and drawn records, and whether fewer were drawn than wanted."""
    out = [(*r[:2], *r[3:-1]) for r in target_report(*_inputs(spark, sf_dir))]
    return spark.createDataFrame(out, "field_name string, category string, share double, wanted long, available long, drawn long, share_drawn double, short boolean")


QUERIES = {"p5_found": p5_found, "p5_sample": p5_sample, "p5_report": p5_report}
_CAT = "CASE WHEN regexp_replace(lower(trim({0})), '[\\s-]', '_', 'g') = 'unemployment' THEN 'labor_market' ELSE nullif(regexp_replace(lower(trim({0})), '[\\s-]', '_', 'g'), '') END"
ORACLES = {
    "p5_found": f"""WITH a AS (SELECT id, {_CAT.format("doc_type")} AS dt, top FROM annotations WHERE id IS NOT NULL),
u AS (SELECT DISTINCT id FROM a WHERE dt IS NOT NULL),
n AS (SELECT floor(count(*) / 5) AS sample FROM u),
c AS (SELECT 'doc_type' AS field_name, dt AS category, id FROM a WHERE dt IS NOT NULL
  UNION SELECT 'top', {_CAT.format("t")}, id FROM (SELECT id, unnest(top) AS t FROM a) WHERE id IN (SELECT id FROM u)),
k AS (SELECT field_name, category, count(*) AS n FROM c GROUP BY 1, 2)
SELECT t.field_name, t.category FROM sample_targets t CROSS JOIN n LEFT JOIN k ON k.field_name = t.field_name AND k.category = {_CAT.format("t.category")}
WHERE coalesce(k.n, 0) < greatest(t.min_n, ceil(round(t.share * n.sample, 9)))""",
}
