"""What the queries must return, as DuckDB SQL over the same tables.

Written the plain way (global ranks, whole lists, all pairs), which is right on small tables and is not how
the jobs work.
"""

from __future__ import annotations

DIM = 64


def rnd(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name}"


def draw(*parts: str) -> str:
    text = ", ".join(f"CAST({part} AS VARCHAR)" for part in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 15) AS BIGINT)"


def query(select: str, *tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n" + select


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def cosine(a: str, b: str) -> str:
    return f"({dot(a, b)} / greatest(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 1e-8))"


def l2_score(a: str, b: str) -> str:
    return f"(1 - pow(list_distance({a}, {b}), 2))"


SCORES = {"dot": dot, "cosine": cosine, "l2": l2_score}

# --- logs, items, users, vectors ---

LOG = {
    "events": """log AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id,
         value AS event_value, ts AS datetime, event_type AS event_name, event_type <> 'error' AS label
  FROM events)""",
    "orders": """log AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
         l_quantity AS event_value, o_orderdate AS datetime, 'purchase' AS event_name, TRUE AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}
LOG["priorities"] = """log AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderpriority AS item_id, o_totalprice AS event_value,
         o_orderdate AS datetime, 'order' AS event_name, TRUE AS label FROM orders)"""
PARTS = """parts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id,
         CAST(to_json({'title': p_name, 'genres': string_split(p_type, ' ')}) AS VARCHAR) AS item_text
  FROM part)"""
CUSTOMERS = """customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         CAST(to_json({'c_mktsegment': c_mktsegment, 'c_nationkey': c_nationkey}) AS VARCHAR) AS user_text
  FROM customer)"""
ITEMS = {
    "events": """items AS (
  SELECT s.item_id, p.item_text FROM (SELECT DISTINCT item_id FROM log) s LEFT JOIN parts p USING (item_id))""",
    "orders": "items AS (SELECT * FROM parts)",
    "priorities": "items AS (SELECT DISTINCT item_id, item_id AS item_text FROM log)",
}
VECTORS = """vectors AS (
  SELECT i.item_id, i.item_text, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM items i JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = i.item_id)"""


def text_vector(text: str, dim: int) -> str:
    """Unit-length counts of the text's words by md5, as 32-bit floats like the vectors of a model."""
    words = f"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[^ \\t\\n\\r\\f\\v]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim})"
    counts = f"list_transform(range(0, {dim}), lambda d: CAST(len(list_filter({words}, lambda p: p = d)) AS DOUBLE))"
    return f"list_transform([{counts}], lambda c: list_transform(c, lambda x: CAST(x / greatest(sqrt(list_dot_product(c, c)), 1) AS FLOAT)))[1]"


PART_VECTORS = f"""vectors AS (
  SELECT item_id, item_text, CAST({text_vector('item_text', DIM)} AS DOUBLE[]) AS embedding FROM parts)"""
VECTORS_OF = {
    "events": VECTORS,
    "orders": PART_VECTORS,
    "priorities": "vectors AS (SELECT item_id, item_text, [1.0] AS embedding FROM items)",
}
ALL_VECTORS = """all_vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""

SPLIT = """marked AS (
  SELECT *, CAST(rank() OVER (PARTITION BY user_id ORDER BY datetime) - 1 AS DOUBLE)
            / count(datetime) OVER (PARTITION BY user_id) < CAST(0.8 AS DOUBLE) AS is_train
  FROM log),
held AS (SELECT user_id, count(*) AS n FROM marked WHERE NOT is_train GROUP BY user_id),
active AS (
  SELECT user_id, CAST(rank() OVER (ORDER BY n) - 1 AS DOUBLE) / count(*) OVER ()
                  >= 1 - CAST(0.2 AS DOUBLE) AS uv
  FROM held),
flagged AS (
  SELECT m.*, NOT is_train AND uv AS is_val, NOT is_train AND NOT uv AS is_test, TRUE AS is_predict
  FROM marked m LEFT JOIN active USING (user_id))"""
PLACED = """placed AS (
  SELECT f.*, i.item_text, CASE WHEN is_train THEN 'history' ELSE 'target' END AS part,
         row_number() OVER (PARTITION BY user_id, is_train
           ORDER BY datetime, event_name, event_value, label, f.item_id, i.item_text) - 1 AS pos
  FROM flagged f LEFT JOIN items i ON i.item_id = f.item_id),
histories AS (SELECT user_id AS query_id, pos, item_id FROM placed WHERE part = 'history')"""


def base(log: str) -> tuple[str, ...]:
    return (LOG[log], PARTS, ITEMS[log], SPLIT, PLACED, VECTORS_OF[log])


# --- sequences ---

VOCAB = f"""vocab AS (
  SELECT *, row_number() OVER (ORDER BY {draw('item_id')}, item_id) AS item_idx FROM vectors)"""
INDEXED = """numbered AS (
  SELECT f.user_id, f.item_id, v.item_idx, f.label,
         row_number() OVER by_time - 1 AS pos,
         sum(CAST(label AS INT)) OVER by_time AS hits
  FROM flagged f JOIN vocab v ON v.item_id = f.item_id WHERE is_train
  WINDOW by_time AS (PARTITION BY user_id ORDER BY datetime, event_name, event_value, label, f.item_id
                     ROWS UNBOUNDED PRECEDING)),
indexed AS (
  SELECT n.user_id, n.pos, n.item_id, n.item_idx, n.label, CAST(n.hits AS BIGINT) AS hits
  FROM numbered n
  JOIN (SELECT user_id, max(pos) AS last FROM numbered WHERE label GROUP BY user_id) l USING (user_id)
  WHERE n.pos <= l.last)"""

SAMPLING = {"events": (32, 0, 32, 3), "orders": (8, 3, 64, 5), "priorities": (4, 0, 16, 7)}


def subset(count: str, size: str, *key: str) -> str:
    pick = f"({draw(*key, 'x[1]')} % (x[1] + 1))"
    return (
        f"list_reduce(list_transform(range(CAST({count} - {size} AS BIGINT), CAST({count} AS BIGINT)),"
        f" lambda j: [j]), lambda chosen, x: list_append(chosen,"
        f" CASE WHEN list_contains(chosen, {pick}) THEN x[1] ELSE {pick} END), CAST([] AS BIGINT[]))"
    )


def copies(length: int) -> str:
    return f"""copies AS (
  SELECT user_id, length, unnest(range(0, (length - 1) // {length} + 1)) AS copy
  FROM (SELECT user_id, count(*) AS length FROM indexed GROUP BY user_id))"""


def sampled(log: str) -> tuple[str, ...]:
    """Tables slots, positives and negatives by the reading of the sampling rules."""
    length, ahead, batch, seed = SAMPLING[log]
    place = ("'place'", str(seed), "0", "user_id", "copy")
    negative = ("'negative'", str(seed), "0", "user_id", "copy")
    until = f"least(s.pos + {ahead}, c.length - 1)" if ahead else "c.length - 1"
    return (
        *base(log),
        VOCAB,
        INDEXED,
        copies(length),
        f"""samples AS (
  SELECT *, list_sort({subset('length - 1', f'least(length - 1, {length})', *place)}) AS places FROM copies),
slots AS (
  SELECT user_id, copy, generate_subscripts(places, 1) - 1 AS slot, unnest(places) AS pos FROM samples)""",
        f"""choices AS (
  SELECT s.user_id, s.copy, s.slot, s.pos, h.item_idx AS history_item_idx,
         list(p.item_idx ORDER BY p.pos) FILTER (WHERE p.label) AS later
  FROM slots s
  JOIN copies c ON c.user_id = s.user_id AND c.copy = s.copy
  JOIN indexed h ON h.user_id = s.user_id AND h.pos = s.pos
  LEFT JOIN indexed p ON p.user_id = s.user_id AND p.pos > s.pos AND p.pos <= {until}
  GROUP BY ALL),
positives AS (
  SELECT user_id, copy, slot, pos, history_item_idx,
         CASE WHEN later IS NULL THEN 0
              ELSE later[{draw("'positive'", str(seed), '0', 'user_id', 'copy', 'pos')} % len(later) + 1]
         END AS pos_item_idx
  FROM choices)""",
        f"""unseen AS (
  SELECT u.user_id, coalesce(list(v.item_idx ORDER BY v.item_idx) FILTER (WHERE s.item_idx IS NULL),
                             list(v.item_idx ORDER BY v.item_idx)) AS pool
  FROM (SELECT DISTINCT user_id FROM indexed) u CROSS JOIN vocab v
  LEFT JOIN (SELECT DISTINCT user_id, item_idx FROM indexed) s
    ON s.user_id = u.user_id AND s.item_idx = v.item_idx
  GROUP BY u.user_id),
wanted AS (
  SELECT s.user_id, s.copy, pool, len(places) AS n, CAST(len(pool) AS BIGINT) AS size
  FROM samples s JOIN unseen USING (user_id)),
ranks AS (
  SELECT user_id, copy, pool,
         CASE WHEN size >= n THEN list_transform(list_sort(list_transform(
                {subset('size', 'least(n, size)', *negative)},
                lambda v: {{'k': {draw("'order'", *negative, 'v')}, 'v': v}})), lambda e: e.v)
              ELSE list_transform(range(0, n), lambda i: {draw(*negative, 'i')} % size) END AS picks
  FROM wanted),
negatives AS (
  SELECT user_id, copy, generate_subscripts(picks, 1) - 1 AS slot,
         unnest(list_transform(picks, lambda r: pool[r + 1])) AS neg_item_idx
  FROM ranks)""",
        f"""batches AS (
  SELECT user_id, copy, len(places) AS filled,
         (row_number() OVER (ORDER BY {draw("'batch'", str(seed), '0', 'user_id', 'copy')}, user_id, copy) - 1)
         // {batch} AS batch_id
  FROM samples),
filled AS (
  SELECT b.batch_id, p.*, n.neg_item_idx
  FROM positives p JOIN negatives n USING (user_id, copy, slot) JOIN batches b USING (user_id, copy))""",
    )


LOSSES = (
    "AlignmentLoss", "AlignmentContrastiveLoss", "ContrastiveLoss", "InfoNCELoss", "NCELoss",
    "PairwiseHingeLoss", "PairwiseLogisticLoss",
)


def softplus(x: str) -> str:
    return f"(greatest({x}, 0.0) + ln(1 + exp(-abs({x}))))"


def ranked_losses(masked: bool, hard: int, scale: float, margin: float) -> str:
    """From scored(batch_id, query_id, cand_id, is_target, dot, cosine) to per_query and the sums per batch."""

    def negatives(kind: str) -> str:
        valid = f"{kind} < t_{kind}" if masked else "NOT is_target"
        if not hard:
            return f"{valid} AS n_{kind}"
        nth = f"row_number() OVER (PARTITION BY query_id ORDER BY ({valid}) DESC, {kind} DESC, cand_id)"
        return f"({valid}) AND {nth} <= {hard} AS n_{kind}"

    def over(kind: str, value: str) -> str:
        return f"coalesce(sum({value}) FILTER (WHERE n_{kind}), 0.0) / (count(*) FILTER (WHERE n_{kind}) + 1e-9)"

    beyond = f"(dot - t_dot * (1 - CAST({margin} AS DOUBLE)))"
    return f"""tops AS (
  SELECT *, max(dot) FILTER (WHERE is_target) OVER (PARTITION BY query_id) AS t_dot,
            max(cosine) FILTER (WHERE is_target) OVER (PARTITION BY query_id) AS t_cosine
  FROM scored),
rated AS (SELECT *, {negatives('dot')}, {negatives('cosine')} FROM tops),
per_query AS (
  SELECT batch_id, query_id,
    1 - max(t_cosine) AS AlignmentLoss,
    {over('cosine', f'greatest(cosine - 1 + {margin}, 0.0)')} AS ContrastiveLoss,
    ln(sum(exp({scale} * (dot - t_dot))) FILTER (WHERE n_dot OR is_target)) AS InfoNCELoss,
    {softplus('-max(t_dot)')} + {over('dot', softplus('dot'))} AS NCELoss,
    {over('dot', f'greatest({beyond}, 0.0)')} AS PairwiseHingeLoss,
    {over('dot', softplus(beyond))} AS PairwiseLogisticLoss,
    count(*) FILTER (WHERE n_dot)
      / (least(count(*) - 1, {hard or 'count(*) - 1'}) + 1e-9) AS density
  FROM rated GROUP BY batch_id, query_id),
sums AS (
  SELECT batch_id, count(*) AS n_queries, avg(density) AS neg_density,
    sum(AlignmentLoss + ContrastiveLoss) AS AlignmentContrastiveLoss,
    {', '.join(f'sum({name}) AS {name}' for name in LOSSES if name != 'AlignmentContrastiveLoss')}
  FROM per_query GROUP BY batch_id)"""


def stats(kind: str) -> str:
    out = []
    for side, chosen in (("pos", "is_target"), ("neg", f"n_{kind}")):
        for name, function in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            out.append(rnd(f"{function}({kind}) FILTER (WHERE {chosen})", f"{side}_{name}"))
    return ", ".join(out)


def loss_columns(count: str) -> str:
    sums = [rnd(name, name) for name in LOSSES]
    means = [rnd(f"{name} / ({count} + 1e-9)", f"{name}Mean") for name in LOSSES]
    return ", ".join(sums + means)


def scored_lines() -> str:
    return """scored AS (
  SELECT o_custkey AS batch_id, CAST(l_orderkey AS VARCHAR) AS query_id,
         concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS cand_id,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY concat_ws('-', l_linenumber, l_partkey, l_suppkey)) = 1 AS is_target,
         sqrt(l_extendedprice) / 100 AS dot, 1 - 10 * l_discount AS cosine
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def scored_losses(
    masked: bool = True, hard: int = 0, scale: float = 1.0, margin: float = 0.5
) -> str:
    return query(
        f"SELECT batch_id, n_queries, {loss_columns('n_queries')} FROM sums",
        scored_lines(),
        ranked_losses(masked, hard, scale, margin),
    )


# --- search ---

POOLS = {
    "mean": "avg(x)",
    "max": "max(x)",
    "first": "min_by(x, pos)",
    "last": "max_by(x, pos)",
}


def encoded(mode: str = "mean", length: int = 32, source: str = "histories") -> str:
    """Table encoded(query_id, embedding) from the last known items of each query; and tail."""
    return f"""tail AS (
  SELECT h.query_id, h.pos, h.item_id, v.embedding
  FROM {source} h JOIN vectors v ON v.item_id = h.item_id
  QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY h.pos DESC) <= {length}),
pooled AS (
  SELECT query_id, dim, {POOLS[mode]} AS x
  FROM (SELECT query_id, pos, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM tail)
  GROUP BY query_id, dim),
encoded AS (SELECT query_id, list(x ORDER BY dim) AS embedding FROM pooled GROUP BY query_id)"""


def found(
    metric: str, top_k: int, queries: str, items: str, barred: str | None = None, name: str = "found"
) -> str:
    """Table of the best items per query, all pairs ranked."""
    hidden = (
        f"WHERE NOT EXISTS (SELECT 1 FROM {barred} b WHERE b.query_id = q.query_id AND b.item_id = i.item_id)"
        if barred
        else ""
    )
    return f"""{name} AS (
  SELECT query_id, item_id, item_text, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank
    FROM (SELECT q.query_id, i.item_id, i.item_text,
                 {SCORES[metric]('q.embedding', 'i.embedding')} AS score
          FROM {queries} q CROSS JOIN {items} i {hidden}))
  WHERE rank <= {top_k})"""


CANDIDATES = f"SELECT query_id, item_id, {rnd('score', 'score')}, rank FROM found"
WITH_TEXT = f"SELECT query_id, item_id, item_text, {rnd('score', 'score')}, rank FROM found"
SELF = "self AS (SELECT item_id AS query_id, item_id, '' AS item_text, embedding FROM all_vectors)"


def knn(metric: str) -> str:
    return query(CANDIDATES, ALL_VECTORS, SELF, found(metric, 20, "self", "self"))


def probe_labels(metric: str) -> str:
    unit = f"list_transform(q.embedding, lambda x: x / sqrt({dot('q.embedding', 'q.embedding')}))"
    nearness = {"dot": dot, "l2": l2_score, "cosine": lambda q, c: l2_score(unit, c)}[metric]("q.embedding", "m.centroid")
    return query(
        CANDIDATES,
        f"""labelled AS (
  SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS item_id, '' AS item_text, label,
         CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
means AS (
  SELECT label, list(x ORDER BY dim) AS centroid FROM (
    SELECT label, dim, avg(x) AS x FROM (
      SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM labelled)
    GROUP BY label, dim) GROUP BY label),
probes AS (
  SELECT query_id, m.label FROM labelled q CROSS JOIN means m
  QUALIFY row_number() OVER (PARTITION BY query_id
    ORDER BY round({nearness}, 9) DESC, m.label) <= 3),
outside AS (
  SELECT q.query_id, i.item_id FROM labelled q CROSS JOIN labelled i
  WHERE NOT EXISTS (SELECT 1 FROM probes p WHERE p.query_id = q.query_id AND p.label = i.label))""",
        found(metric, 10, "labelled", "labelled", "outside"),
    )


def hashed(bands: int, bits: int) -> str:
    """The best of the items that share the signs of a band with the query."""
    plane = f"list_transform(range(0, {DIM}), lambda d: 1.0 - 2 * (CAST('0x' || substr(md5(concat(p, '|', d)), 1, 1) AS INT) % 2))"
    return query(
        CANDIDATES,
        ALL_VECTORS,
        f"planes AS (SELECT p, p // {bits} AS band, p % {bits} AS bit, {plane} AS plane FROM range(0, {bands * bits}) t(p))",
        f"""buckets AS (
  SELECT item_id, band, sum(CASE WHEN round({dot('embedding', 'plane')}, 9) >= 0 THEN 1 << bit ELSE 0 END) AS bucket
  FROM all_vectors CROSS JOIN planes GROUP BY item_id, band)""",
        """apart AS (
  SELECT q.item_id AS query_id, i.item_id FROM all_vectors q CROSS JOIN all_vectors i WHERE NOT EXISTS (
    SELECT 1 FROM buckets a JOIN buckets b USING (band, bucket) WHERE a.item_id = q.item_id AND b.item_id = i.item_id))""",
        SELF,
        found("cosine", 20, "self", "self", "apart"),
    )


def nearest_centre(points: str, centres: str, group: str | None, name: str) -> str:
    """Table of the points with the place of the nearest centre (of their group)."""
    on = f"USING ({group})" if group else "ON TRUE"
    more = f", {group}" if group else ""
    return f"""{name} AS (
  SELECT item_id{more}, point, place FROM {points} JOIN {centres} {on}
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(pow(list_distance(point, centre), 2), 12), place) = 1)"""


def moved(placed: str, centres: str, group: str | None, name: str) -> str:
    """Table of the centres moved to the means of their points."""
    key = f"{group}, place" if group else "place"
    return f"""{name} AS (
  SELECT {key}, coalesce(mean, centre) AS centre FROM {centres} LEFT JOIN (
    SELECT {key}, list(x ORDER BY dim) AS mean FROM (
      SELECT {key}, dim, avg(x) AS x FROM (SELECT {key}, generate_subscripts(point, 1) AS dim, unnest(point) AS x FROM {placed})
      GROUP BY {key}, dim) GROUP BY {key}) USING ({key}))"""


def two_levels(total: int, coarse: int, rounds: int) -> str:
    tables = [
        ALL_VECTORS,
        "points AS (SELECT item_id, embedding AS point FROM all_vectors)",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY md5('0|' || item_id), item_id) - 1 AS place, point AS centre FROM points
  QUALIFY place < {coarse})""",
    ]
    for i in range(rounds):
        tables += [nearest_centre("points", f"c{i}", None, f"a{i}"), moved(f"a{i}", f"c{i}", None, f"c{i + 1}")]
    tables += [
        nearest_centre("points", f"c{rounds}", None, "coarse"),
        "groups AS (SELECT item_id, place AS part, point FROM coarse)",
        f"""exact AS (
  SELECT part, ({total} - count(*) OVER ()) * count(*) / sum(count(*)) OVER () AS share FROM groups GROUP BY part),
shares AS (
  SELECT part, 1 + floor(share) + CASE WHEN row_number() OVER (ORDER BY floor(share) - share, part)
    <= {total} - sum(1 + floor(share)) OVER () THEN 1 ELSE 0 END AS k FROM exact),
offsets AS (SELECT part, k, sum(k) OVER (ORDER BY part) - k AS before FROM shares)""",
        """f0 AS (
  SELECT part, place, point AS centre FROM (
    SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5('0|' || item_id), item_id) - 1 AS place FROM groups) JOIN shares USING (part)
  WHERE place < k)""",
    ]
    for i in range(rounds):
        tables += [nearest_centre("groups", f"f{i}", "part", f"b{i}"), moved(f"b{i}", f"f{i}", "part", f"f{i + 1}")]
    tables.append(nearest_centre("groups", f"f{rounds}", "part", "fine"))
    return query("SELECT item_id, CAST(before + place AS INTEGER) AS cluster_id FROM fine JOIN offsets USING (part)", *tables)


def cooccurrence(log: str) -> tuple[str, ...]:
    return (
        *base(log),
        """near AS (
  SELECT a.item_id, b.item_id AS other_id FROM histories a JOIN histories b
    ON b.query_id = a.query_id AND abs(b.pos - a.pos) BETWEEN 1 AND 5 AND a.item_id <> b.item_id),
counts AS (SELECT item_id, other_id, count(*) AS n FROM near GROUP BY ALL)""",
    )


# --- metrics ---

METRICS = (
    "retrieval_normalized_dcg", "retrieval_average_precision", "retrieval_auroc", "retrieval_precision",
    "retrieval_recall", "retrieval_hit_rate", "retrieval_reciprocal_rank",
)


def metrics(log: str, mode: str = "mean", top_k: int = 20) -> tuple[str, ...]:
    """Table scores(query_id, stage, the seven metrics)."""
    return (
        *base(log),
        """stages AS (
  SELECT user_id AS query_id, CASE WHEN bool_or(is_val) THEN 'val' WHEN bool_or(is_test) THEN 'test' END AS stage
  FROM flagged GROUP BY user_id HAVING bool_or(is_val) OR bool_or(is_test))""",
        encoded(mode),
        "asked AS (SELECT * FROM encoded WHERE query_id IN (SELECT query_id FROM stages))",
        found("dot", top_k, "asked", "vectors", "histories"),
        f"""targets AS (
  SELECT DISTINCT user_id AS query_id, item_id FROM placed WHERE part = 'target' AND label),
judged AS (
  SELECT t.query_id, f.rank,
         row_number() OVER (PARTITION BY t.query_id ORDER BY f.rank NULLS LAST) AS nth
  FROM targets t LEFT JOIN found f ON f.query_id = t.query_id AND f.item_id = t.item_id),
sums AS (
  SELECT query_id, count(*) AS relevant, count(rank) AS hits,
         coalesce(sum(1 / log2(rank + 1)), 0) AS dcg, coalesce(avg(nth / rank) FILTER (WHERE rank IS NOT NULL), 0) AS ap,
         min(rank) AS first
  FROM judged GROUP BY query_id),
pairs AS (
  SELECT j.query_id, count(*) AS ordered
  FROM judged j CROSS JOIN range(1, {top_k + 1}) r(place)
  WHERE place > j.rank AND NOT EXISTS (
    SELECT 1 FROM judged o WHERE o.query_id = j.query_id AND o.rank = place)
  GROUP BY j.query_id),
scores AS (
  SELECT query_id, stage,
    dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least({top_k}, relevant) + 1 AS BIGINT)) t(i)) AS retrieval_normalized_dcg,
    ap AS retrieval_average_precision,
    CASE WHEN hits > 0 AND hits < {top_k} THEN coalesce(ordered, 0) / (hits * ({top_k} - hits)) ELSE 0 END AS retrieval_auroc,
    hits / {top_k} AS retrieval_precision,
    hits / relevant AS retrieval_recall,
    CAST(hits > 0 AS INT) AS retrieval_hit_rate,
    coalesce(1 / first, 0) AS retrieval_reciprocal_rank
  FROM sums JOIN stages USING (query_id) LEFT JOIN pairs USING (query_id))""",
    )


ROUNDED_METRICS = ", ".join(rnd(m, m) for m in METRICS)
MEAN_METRICS = ", ".join(rnd(f"avg({m})", m) for m in METRICS)


def pooled(mode: str, unit: bool = False) -> str:
    value = "x / greatest(sqrt(sum(x * x) OVER (PARTITION BY query_id)), 1e-12)" if unit else "x"
    return query(
        f"SELECT query_id, dim - 1 AS dim, {rnd(value, 'value')} FROM pooled", *base("events"), encoded(mode)
    )


def best_run() -> str:
    runs = " UNION ALL ".join(
        f"""SELECT '{mode}' AS run_id, (WITH {', '.join(metrics('events', mode))}
  SELECT avg(retrieval_normalized_dcg) FROM scores WHERE stage = 'val') AS value"""
        for mode in POOLS
    )
    return f"""SELECT run_id, {rnd('value', 'retrieval_normalized_dcg')} FROM ({runs})
ORDER BY value DESC, run_id DESC LIMIT 1"""


REQUESTS = """requests AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS request_id,
         list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS ids
  FROM lineitem GROUP BY l_orderkey),
asked AS (SELECT request_id, unnest(ids) AS item_id, generate_subscripts(ids, 1) - 1 AS pos FROM requests)"""


def recommend_history(log: str) -> str:
    return query(
        WITH_TEXT, *base(log), encoded(), found("dot", 20, "encoded", "vectors", "histories")
    )


def recommend_user(log: str) -> str:
    return query(
        CANDIDATES,
        *base(log),
        """whole AS (
  SELECT user_id AS query_id, item_id,
         row_number() OVER (PARTITION BY user_id ORDER BY CASE part WHEN 'history' THEN 0 ELSE 1 END, pos) AS pos
  FROM placed)""",
        encoded(source="whole"),
        found("cosine", 5, "encoded", "vectors", "tail"),
    )


def history(log: str) -> str:
    return query(
        "SELECT user_id, part, pos, item_id, item_text, event_name, event_value, label FROM placed", *base(log)
    )


def flags(log: str) -> str:
    return query(
        "SELECT user_id, item_id, event_value, event_name, is_train, is_val, is_test, is_predict FROM flagged",
        LOG[log],
        SPLIT,
    )


def slot_query(log: str, select: str) -> str:
    return query(select, *sampled(log))


POSITIVES = "SELECT user_id, copy, slot, pos, history_item_idx, pos_item_idx FROM positives"
NEGATIVES = "SELECT user_id, copy, slot, neg_item_idx FROM negatives"


def padded(role: str, column: str) -> str:
    return f"""array_to_string(list_concat(coalesce({role}, CAST([] AS BIGINT[])),
      list_transform(range(0, seq_len - filled), lambda i: 0)), ',') AS {role}"""


HARD = {"hard": 5, "scale": 2.0, "margin": 0.25}

CHECK_SQL: dict[str, str] = {
    "split_flags_events": flags("events"),
    "split_flags_orders": flags("orders"),
    "split_summary": query(
        """SELECT split, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM (
  SELECT user_id, 'train' AS split FROM flagged WHERE is_train
  UNION ALL SELECT user_id, 'val' FROM flagged WHERE is_val
  UNION ALL SELECT user_id, 'test' FROM flagged WHERE is_test) GROUP BY split""",
        LOG["orders"],
        SPLIT,
    ),
    "val_events": query(
        "SELECT user_id, item_id, event_value FROM flagged WHERE is_val", LOG["orders"], SPLIT
    ),
    "item_text_json": query("SELECT item_id, item_text FROM parts", PARTS),
    "user_text_json": query("SELECT user_id, user_text FROM customers", CUSTOMERS),
    "events_enriched": query(
        """SELECT l.user_id, l.item_id, event_value, event_name, label, item_text, user_text
FROM log l LEFT JOIN parts p ON p.item_id = l.item_id LEFT JOIN customers c ON c.user_id = l.user_id""",
        LOG["orders"],
        PARTS,
        CUSTOMERS,
    ),
    "items_seen_in_train": query(
        """SELECT p.item_id, p.item_text, s.is_train, TRUE AS is_val, TRUE AS is_test, TRUE AS is_predict
FROM parts p LEFT JOIN (SELECT item_id, bool_or(is_train) AS is_train FROM flagged GROUP BY item_id) s USING (item_id)""",
        LOG["orders"],
        PARTS,
        SPLIT,
    ),
    "user_history_events": history("events"),
    "user_history_orders": history("orders"),
    "user_lists": query(
        "SELECT user_id, part, pos, item_id, item_text, event_value, label FROM placed", *base("orders")
    ),
    "user_lists_latest": query(
        """SELECT user_id, part, pos, item_id, item_text, event_value, label FROM placed
QUALIFY row_number() OVER (PARTITION BY user_id, part ORDER BY pos DESC) <= 8""",
        *base("orders"),
    ),
    "users_flagged": query(
        """SELECT c.user_id, n_history, n_target, is_train, is_val, is_test, is_predict
FROM customers c LEFT JOIN (
  SELECT user_id, count(*) FILTER (WHERE is_train) AS n_history, count(*) FILTER (WHERE NOT is_train) AS n_target,
         bool_or(is_train) AS is_train, bool_or(is_val) AS is_val, bool_or(is_test) AS is_test, bool_or(is_predict) AS is_predict
  FROM flagged GROUP BY user_id) USING (user_id)""",
        LOG["orders"],
        CUSTOMERS,
        SPLIT,
    ),
    "table_sizes": query(
        "SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS n_columns FROM parts",
        PARTS,
    ),
    "vocabulary": query(
        f"SELECT item_id, row_number() OVER (ORDER BY {draw('item_id')}, item_id) AS item_idx FROM parts", PARTS
    ),
    "history_trimmed_events": query("SELECT * FROM indexed", *base("events"), VOCAB, INDEXED),
    "history_trimmed_orders": query("SELECT * FROM indexed", *base("orders"), VOCAB, INDEXED),
    "history_copies": query("SELECT * FROM copies", *base("orders"), VOCAB, INDEXED, copies(8)),
    "history_tail": query("SELECT query_id, pos, item_id FROM tail", *base("orders"), encoded(length=8)),
    "sample_sequences_events": slot_query("events", "SELECT * FROM slots"),
    "sample_sequences_orders": slot_query("orders", "SELECT * FROM slots"),
    "sample_positives_events": slot_query("events", POSITIVES),
    "sample_positives_orders": slot_query("orders", POSITIVES),
    "sample_negatives_events": slot_query("events", NEGATIVES),
    "sample_negatives_orders": slot_query("orders", NEGATIVES),
    "sample_negatives_priorities": slot_query("priorities", NEGATIVES),
    "example_texts": slot_query(
        "events",
        """SELECT f.user_id, f.copy, f.slot, h.item_text AS history_item_text, p.item_text AS pos_item_text,
  n.item_text AS neg_item_text
FROM filled f LEFT JOIN vocab h ON h.item_idx = history_item_idx LEFT JOIN vocab p ON p.item_idx = pos_item_idx
LEFT JOIN vocab n ON n.item_idx = neg_item_idx""",
    ),
    "padded_batches": slot_query(
        "orders",
        f"""SELECT user_id, copy, batch_id, seq_len,
  {padded('history', 'history_item_idx')}, {padded('pos', 'pos_item_idx')}, {padded('neg', 'neg_item_idx')}
FROM (
  SELECT b.*, max(filled) OVER (PARTITION BY b.batch_id) AS seq_len, l.history, l.pos, l.neg
  FROM batches b LEFT JOIN (
    SELECT user_id, copy, list(history_item_idx ORDER BY slot) AS history, list(pos_item_idx ORDER BY slot) AS pos,
           list(neg_item_idx ORDER BY slot) AS neg
    FROM filled GROUP BY user_id, copy) l USING (user_id, copy))""",
    ),
    "batch_stats": slot_query(
        "orders",
        f"""SELECT batch_id, size, seq_len, size * seq_len AS numel, attention_non_zero, positive_non_zero,
  {rnd('attention_non_zero / (size * seq_len + 1e-9)', 'attention_density')},
  {rnd('positive_non_zero / (attention_non_zero + 1e-9)', 'positive_density')}
FROM (
  SELECT b.batch_id, count(*) AS size, max(filled) AS seq_len, sum(filled)::BIGINT AS attention_non_zero,
         sum(coalesce(hits, 0))::BIGINT AS positive_non_zero
  FROM batches b LEFT JOIN (
    SELECT user_id, copy, count(*) FILTER (WHERE pos_item_idx <> 0) AS hits FROM filled GROUP BY ALL) USING (user_id, copy)
  GROUP BY b.batch_id)""",
    ),
    "lookup_ordered": query(
        "SELECT request_id, pos, item_id, item_text FROM asked JOIN parts USING (item_id)",
        PARTS,
        REQUESTS,
    ),
    "lookup_store": query(
        "SELECT DISTINCT request_id, item_id, item_text FROM asked JOIN parts USING (item_id)",
        PARTS,
        REQUESTS,
    ),
    "lookup_one": query(
        """SELECT l.user_id AS request_id, l.item_id, v.item_text, v.item_id IS NOT NULL AS is_found
FROM log l LEFT JOIN parts v ON v.item_id = l.item_id""",
        LOG["orders"],
        PARTS,
    ),
    "lookup_user": query(
        """SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_custkey AS VARCHAR) AS user_id, c.user_text,
  c.user_id IS NOT NULL AS is_found
FROM orders LEFT JOIN customers c ON c.user_id = CAST(o_custkey AS VARCHAR)""",
        CUSTOMERS,
    ),
    "prepared_stages": query(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS stage, f.user_id, f.item_id, event_value, item_text, user_text
FROM flagged f LEFT JOIN parts p ON p.item_id = f.item_id LEFT JOIN customers c ON c.user_id = f.user_id
WHERE is_{name}"""
            for name in ("train", "val", "test", "predict")
        ),
        LOG["orders"],
        PARTS,
        CUSTOMERS,
        SPLIT,
    ),
    "new_targets": query(
        """SELECT user_id, item_id FROM (
  SELECT user_id, item_id, is_train, bool_or(is_train) OVER (PARTITION BY user_id, item_id) AS known FROM flagged)
WHERE NOT is_train AND NOT known""",
        LOG["orders"],
        SPLIT,
    ),
    "targets_without_history": query(
        """SELECT user_id, item_id FROM (
  SELECT user_id, item_id, is_train, bool_or(is_train) OVER (PARTITION BY user_id, item_id) AS known FROM flagged)
WHERE NOT is_train AND NOT known""",
        LOG["orders"],
        SPLIT,
    ),
    "raw_files": query(
        """SELECT f.user_id, f.item_id, CAST(event_value AS INTEGER) AS event_value, CAST(CAST(datetime AS TIMESTAMP) AS VARCHAR) AS datetime,
  'rating' AS event_name, label, item_text, user_text, is_train, is_val, is_test
FROM flagged f LEFT JOIN parts p ON p.item_id = f.item_id LEFT JOIN raw_users u ON u.user_id = f.user_id""",
        LOG["orders"],
        PARTS,
        SPLIT,
        """raw_users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(to_json({'gender': substr(c_mktsegment, 1, 1), 'age': c_nationkey,
    'occupation': length(c_name), 'zipcode': CAST(c_custkey AS VARCHAR)}) AS VARCHAR) AS user_text FROM customer)""",
    ),
    "stage_view": query(
        f"""SELECT stage AS view, user_id AS id, part, pos AS place, CAST(event_value AS DOUBLE) AS value
FROM placed JOIN members USING (user_id)
UNION ALL SELECT 'items', item_id, NULL, dim - 1, {rnd('x', 'value')} FROM (
  SELECT item_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM (SELECT item_id, {text_vector('item_text', 16)} AS v FROM parts))
WHERE x <> 0""",
        *base("orders"),
        """members AS (
  SELECT user_id, 'val' AS stage FROM flagged GROUP BY user_id HAVING bool_or(is_val)
  UNION ALL SELECT user_id, 'test' FROM flagged GROUP BY user_id HAVING bool_or(is_test))""",
    ),
    "preview_sizes": """SELECT 'parts' AS name, least(7, count(*)) AS n_rows FROM part
UNION ALL SELECT 'customers', least(7, count(*)) FROM customer UNION ALL SELECT 'regions', least(7, count(*)) FROM region""",
    "pooled_by_model": query(
        """SELECT query_id, dim - 1 AS dim, CAST(count(*) FILTER (WHERE x > 0) AS DOUBLE) AS value
FROM (SELECT query_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM tail) GROUP BY query_id, dim""",
        *base("events"),
        encoded(length=6),
    ),
    "own_metric": query(
        f"SELECT query_id, stage, {rnd('coalesce(max(rank), 0)', 'last_hit')} FROM judged JOIN stages USING (query_id) GROUP BY ALL",
        *metrics("events"),
    ),
    "own_loss": query(
        f"SELECT batch_id, count(*) AS n_queries, {rnd('sum(gap)', 'MeanGap')} FROM gaps GROUP BY batch_id",
        scored_lines(),
        ranked_losses(True, 0, 1.0, 0.5),
        """gaps AS (
  SELECT batch_id, query_id, greatest(1 + coalesce(sum(dot) FILTER (WHERE n_dot), 0.0) / (count(*) FILTER (WHERE n_dot) + 1e-9) - max(t_dot), 0.0) AS gap
  FROM rated GROUP BY batch_id, query_id)""",
    ),
    "knn_copied": knn("l2"),
    "pooled_mean": pooled("mean"),
    "pooled_mean_unit": pooled("mean", unit=True),
    "pooled_max": pooled("max"),
    "pooled_first": pooled("first"),
    "pooled_last": pooled("last"),
    "pooled_or_zero": query(
        f"""SELECT c.user_id AS query_id, d.dim - 1 AS dim, {rnd('coalesce(p.x, 0)', 'value')}
FROM customers c CROSS JOIN range(1, {DIM + 1}) d(dim)
LEFT JOIN pooled p ON p.query_id = c.user_id AND p.dim = d.dim""",
        *base("orders"),
        CUSTOMERS,
        encoded(length=4),
    ),
    **{
        f"prefix_{mode}": query(
            f"""SELECT query_id, pos, dim - 1 AS dim, {rnd(f'{value} OVER (PARTITION BY query_id, dim ORDER BY pos ROWS UNBOUNDED PRECEDING)', 'value')}
FROM (SELECT query_id, pos, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM tail)""",
            *base("events"),
            encoded(),
        )
        for mode, value in (("max", "max(x)"), ("first", "first_value(x)"), ("last", "last_value(x)"))
    },
    "prefix_mean": query(
        f"""SELECT query_id, pos, dim - 1 AS dim,
  {rnd('avg(x) OVER (PARTITION BY query_id, dim ORDER BY pos ROWS UNBOUNDED PRECEDING)', 'value')}
FROM (SELECT query_id, pos, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM tail)""",
        *base("events"),
        encoded(),
    ),
    "pair_similarity": query(
        f"""SELECT a.query_id, a.pos, {rnd(dot('va.embedding', 'vb.embedding'), 'dot')},
  {rnd(cosine('va.embedding', 'vb.embedding'), 'cosine')},
  {rnd("pow(list_distance(va.embedding, vb.embedding), 2) / 2", 'half_l2')}, CAST(1.0 AS DOUBLE) AS unit_norm,
  {rnd(f"va.embedding[1] / sqrt({dot('va.embedding', 'va.embedding')})", 'unit_first')}
FROM histories a JOIN histories b ON b.query_id = a.query_id AND b.pos = a.pos + 1
JOIN vectors va ON va.item_id = a.item_id JOIN vectors vb ON vb.item_id = b.item_id""",
        *base("events"),
    ),
    "knn_exact_dot": knn("dot"),
    "knn_exact_cosine": knn("cosine"),
    "knn_exact_l2": knn("l2"),
    "knn_full_probe": knn("cosine"),
    "knn_pruned_dot": knn("dot"),
    "knn_pruned_cosine": knn("cosine"),
    "knn_pruned_l2": knn("l2"),
    "knn_coded_dot": knn("dot"),
    "knn_coded_cosine": knn("cosine"),
    "knn_coded_l2": knn("l2"),
    "knn_stored_probes": probe_labels("dot"),
    "knn_stored_probes_cosine": probe_labels("cosine"),
    "knn_hashed": hashed(24, 4),
    "clusters_two_levels": two_levels(16, 4, 2),
    "item_cooccurrence_events": query("SELECT * FROM counts", *cooccurrence("events")),
    "item_cooccurrence_orders": query("SELECT * FROM counts", *cooccurrence("orders")),
    "item_mutual_information": query(
        f"""SELECT item_id, other_id, {rnd('weight', 'weight')} FROM (
  SELECT *, ln(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY item_id) * sum(n) OVER (PARTITION BY other_id))) AS weight FROM counts)
WHERE weight > 0""",
        *cooccurrence("events"),
    ),
    "recommend_indexed_events": recommend_history("events"),
    "recommend_indexed_orders": recommend_history("orders"),
    "knn_stored": knn("cosine"),
    "knn_excluding_seen": query(
        CANDIDATES,
        *base("orders"),
        encoded(),
        "seen AS (SELECT user_id AS query_id, item_id FROM log)",
        found("dot", 20, "encoded", "vectors", "seen"),
    ),
    "knn_probe_labels": probe_labels("dot"),
    "knn_probe_labels_cosine": probe_labels("cosine"),
    "knn_probe_labels_l2": probe_labels("l2"),
    # Written as oversampling and filtering afterwards.
    "knn_inner_product": query(
        f"""SELECT query_id, item_id, {rnd('score', 'score')}, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
FROM found f JOIN sizes USING (query_id)
WHERE f.rank <= 2 * (10 + n) AND NOT EXISTS (
  SELECT 1 FROM histories h WHERE h.query_id = f.query_id AND h.item_id = f.item_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.rank) <= 10""",
        *base("events"),
        encoded(),
        "sizes AS (SELECT query_id, count(DISTINCT item_id) AS n FROM histories GROUP BY query_id)",
        found("dot", 1_000_000, "encoded", "vectors"),
    ),
    "recommend_probing": query(
        CANDIDATES,
        *base("orders"),
        encoded(),
        found("cosine", 10, "encoded", "vectors", "histories"),
    ),
    "index_sizes": """SELECT count(*) AS n_items, CAST(pow(2, floor(log2(count(*)) / 2)) AS BIGINT) AS n_clusters,
  CAST(pow(2, floor(log2(count(*)) / 2)) AS BIGINT) AS planned FROM embeddings""",
    "embed_text_default": query(
        f"SELECT doc_id, place AS dim, {rnd('CAST(n / sqrt(squares) AS FLOAT)', 'value')} FROM counts JOIN norms USING (doc_id)",
        """words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\r\\f\\v]+')) AS word FROM documents),
counts AS (
  SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 256 AS place, CAST(count(*) AS DOUBLE) AS n
  FROM words GROUP BY ALL),
norms AS (SELECT doc_id, sum(n * n) AS squares FROM counts GROUP BY doc_id)""",
    ),
    "recommend_history_events": recommend_history("events"),
    "recommend_history_orders": recommend_history("orders"),
    "recommend_user_events": recommend_user("events"),
    "recommend_user_orders": recommend_user("orders"),
    "recommend_item": query(
        CANDIDATES,
        PARTS,
        PART_VECTORS,
        "asked AS (SELECT item_id AS query_id, item_id, embedding FROM vectors)",
        found("cosine", 5, "asked", "vectors", "asked"),
    ),
    "recommend_query": query(
        f"""SELECT f.query_id, f.item_id, {rnd('score', 'score')}, rank FROM found f
JOIN mixed m ON m.query_id = f.query_id WHERE rank <= coalesce(m.top_k, 4)""",
        PARTS,
        PART_VECTORS,
        ALL_VECTORS,
        REQUESTS,
        """inputs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS query_id,
         list(embedding ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS inputs
  FROM lineitem JOIN all_vectors ON item_id = CAST(l_suppkey AS VARCHAR) GROUP BY l_orderkey),
mixed AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS query_id, CAST(o_custkey AS VARCHAR) AS customer,
         CASE WHEN o_orderpriority = '1-URGENT' THEN v.embedding END AS own,
         CASE WHEN o_orderstatus = 'P' THEN i.inputs END AS inputs,
         CASE WHEN o_orderpriority = '5-LOW' THEN 2 END AS top_k
  FROM orders LEFT JOIN all_vectors v ON v.item_id = CAST(o_custkey AS VARCHAR)
  LEFT JOIN inputs i ON i.query_id = CAST(o_orderkey AS VARCHAR)),
named AS (
  SELECT request_id AS query_id, pos, item_id FROM asked JOIN mixed ON query_id = request_id WHERE inputs IS NULL)""",
        encoded(length=3, source="named"),
        """last_inputs AS (
  SELECT query_id, unnest(inputs[-3:]) AS embedding FROM mixed WHERE inputs IS NOT NULL),
input_means AS (
  SELECT query_id, list(x ORDER BY dim) AS embedding FROM (
    SELECT query_id, dim, avg(x) AS x FROM (
      SELECT query_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM last_inputs)
    GROUP BY query_id, dim) GROUP BY query_id),
wanted AS (
  SELECT query_id, coalesce(m.own, i.embedding, e.embedding) AS embedding
  FROM mixed m LEFT JOIN input_means i USING (query_id) LEFT JOIN encoded e USING (query_id)
  WHERE coalesce(m.own, i.embedding, e.embedding) IS NOT NULL),
barred AS (
  SELECT query_id, customer AS item_id FROM mixed
  UNION SELECT query_id, item_id FROM tail
  UNION SELECT query_id, item_id FROM asked JOIN mixed ON query_id = request_id WHERE inputs IS NOT NULL)""",
        found("cosine", 4, "wanted", "vectors", "barred"),
    ),
    "search_vectors": query(
        WITH_TEXT,
        PARTS,
        PART_VECTORS,
        ALL_VECTORS,
        SELF,
        found("l2", 3, "self", "vectors"),
    ),
    "user_metrics_indexed": query(
        f"SELECT query_id, stage, {ROUNDED_METRICS} FROM scores", *metrics("events")
    ),
    "user_metrics_events": query(
        f"SELECT query_id, stage, {ROUNDED_METRICS} FROM scores", *metrics("events")
    ),
    "user_metrics_orders": query(
        f"SELECT query_id, stage, {ROUNDED_METRICS} FROM scores", *metrics("orders")
    ),
    "metrics_mean": query(
        f"SELECT stage, count(*) AS n_queries, {MEAN_METRICS} FROM scores GROUP BY stage",
        *metrics("events"),
    ),
    "best_run": best_run(),
    "flagship": query(
        f"""SELECT query_id AS user_id, {rnd('retrieval_normalized_dcg', 'retrieval_normalized_dcg')}
FROM scores WHERE stage = 'val'""",
        *metrics("events"),
    ),
    "scored_losses": scored_losses(),
    "scored_losses_hard": scored_losses(**HARD),
    "scored_losses_unmasked": scored_losses(masked=False),
    "scored_losses_scaled": scored_losses(scale=500.0),
    "hard_negatives": query(
        f"SELECT batch_id, query_id, cand_id, {rnd('cosine', 'logit')} FROM rated WHERE n_cosine",
        scored_lines(),
        ranked_losses(True, 2, 1.0, 0.5),
    ),
    "logit_stats": query(
        f"""SELECT batch_id, {rnd('neg_density', 'neg_density')}, s.* EXCLUDE (batch_id)
FROM sums JOIN (SELECT batch_id, {stats('dot')} FROM rated GROUP BY batch_id) s USING (batch_id)""",
        scored_lines(),
        ranked_losses(True, 2, 1.0, 0.5),
    ),
}
# Through an index the same rows.
CHECK_SQL |= {
    "recommend_user_indexed": CHECK_SQL["recommend_user_orders"],
    "recommend_item_indexed": CHECK_SQL["recommend_item"],
    "recommend_query_indexed": CHECK_SQL["recommend_query"],
    "search_vectors_indexed": CHECK_SQL["search_vectors"],
}
