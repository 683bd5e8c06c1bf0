"""SQL for DuckDB that gives the result of each query from the same tables."""

from __future__ import annotations

from cartloom.functions import fixed_values as fixed
from verification.queries import ALIAS_WORDS, CUTS, STEP, THEMES, WEIGHTS

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


def any_word(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(word)})" for word in words) + ")"


PART_PRODUCTS = """
SELECT p_partkey AS product_id, p_name AS product_name,
       CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS aisle_id,
       CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
            WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS INTEGER)
         AS department_id
FROM part"""
NAME_PRODUCTS = """
SELECT product_id, product_name, CAST(ascii(product_name) AS INTEGER) AS aisle_id,
       CAST(ascii(noun) * 100 + ascii(substr(noun, 2, 1)) AS INTEGER) AS department_id
FROM (SELECT min(p_partkey) AS product_id, p_name AS product_name,
             split_part(p_name, ' ', 2) AS noun
      FROM part GROUP BY p_name)"""
PART_LINES = """
SELECT l_orderkey AS order_id, l_partkey AS product_id, o_custkey AS customer_id,
       o_orderdate AS order_ts, l_quantity AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
NAME_LINES = """
SELECT l_orderkey AS order_id, min_key AS product_id, o_custkey AS customer_id,
       o_orderdate AS order_ts, l_quantity AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN (SELECT p_name AS key_name, min(p_partkey) AS min_key FROM part GROUP BY p_name)
  ON key_name = p_name"""
WIDE_PRODUCTS = PART_PRODUCTS + """
UNION ALL
SELECT s_suppkey + 1000000000, s_name, s_nationkey, CAST(s_suppkey % 7 + 1 AS INTEGER) FROM supplier"""

GRAINS = {
    "part": (PART_PRODUCTS, PART_LINES),
    "name": (NAME_PRODUCTS, NAME_LINES),
    "wide": (WIDE_PRODUCTS, PART_LINES),
}


def _ctes(**parts: str) -> str:
    return ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())


def _velocity(units: str) -> str:
    return f"""
SELECT p.product_id, p.product_name, p.department_id,
       CAST(u.total_units AS BIGINT) AS total_units,
       CAST(r.total_orders AS BIGINT) AS total_orders, r.reorder_rate
FROM products p
JOIN (SELECT product_id, {units} AS total_units FROM lines GROUP BY product_id) u
  ON u.product_id = p.product_id
JOIN (SELECT product_id, count(DISTINCT order_id) AS total_orders,
             avg(CASE WHEN nth > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS reorder_rate
      FROM (SELECT product_id, order_id, row_number() OVER (
              PARTITION BY customer_id, product_id ORDER BY order_ts, order_id) AS nth
            FROM (SELECT DISTINCT customer_id, product_id, order_id, order_ts FROM lines))
      GROUP BY product_id) r ON r.product_id = p.product_id"""


AFFINITY = """
SELECT a.product_id AS product_id_a, b.product_id AS product_id_b, count(*) AS co_purchase_count
FROM (SELECT DISTINCT order_id, product_id FROM lines) a
JOIN (SELECT DISTINCT order_id, product_id FROM lines) b
  ON a.order_id = b.order_id AND a.product_id < b.product_id
GROUP BY a.product_id, b.product_id"""
SYM = """
SELECT product_id_a AS product_id, product_id_b AS other_id, co_purchase_count FROM affinity
UNION ALL
SELECT product_id_b, product_id_a, co_purchase_count FROM affinity"""
DEMAND = """
SELECT p.product_id, p.product_name, p.aisle_id, p.department_id,
       coalesce(v.total_units, 0) AS total_units, coalesce(v.total_orders, 0) AS total_orders,
       coalesce(v.reorder_rate, 0) AS reorder_rate
FROM products p LEFT JOIN velocity v ON v.product_id = p.product_id"""
CARDS = f"""
SELECT *, 'Product ID: ' || product_id || chr(10) || 'Name: ' || product_name || chr(10)
       || 'Aisle ID: ' || aisle_id || ' | Department ID: ' || department_id || chr(10)
       || 'Demand: total_units=' || total_units || ', total_orders=' || total_orders
       || ', reorder_rate=' || CAST(CAST(reorder_rate AS DECIMAL(10,3)) AS VARCHAR) || chr(10)
       || {quoted(fixed.CARD_USE)} AS text
FROM demand"""
QUERIES_SQL = """
SELECT 'part-' || p_partkey AS query_id, p_name AS user_query FROM part
UNION ALL
SELECT DISTINCT 'word-' || w, w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)
UNION ALL SELECT 'item-' || item_id, text FROM benchmark
UNION ALL SELECT 'nation-' || n_name, n_name FROM nation
UNION ALL SELECT 'supplier-' || s_suppkey, s_name FROM supplier"""
# The nearest products of the queries that have a vector.
HITS = """
SELECT query_id, product_id, score, rank FROM (
  SELECT q.query_id, v.product_id, list_cosine_similarity(q.e, v.e) AS score,
         row_number() OVER (PARTITION BY q.query_id
           ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.product_id) AS rank
  FROM (SELECT 'part-' || vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        UNION ALL
        SELECT 'item-' || vec_id, CAST(embedding AS DOUBLE[])
        FROM embeddings JOIN benchmark ON vec_id = item_id) q,
       (SELECT vec_id AS product_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE vec_id IN (SELECT product_id FROM products)) v)
WHERE rank <= 15"""


def base(grain: str, units: str = "count(*)") -> str:
    products, lines = GRAINS[grain]
    return "WITH " + _ctes(
        products=products,
        lines=lines,
        velocity=_velocity(units),
        affinity=AFFINITY,
        sym=SYM,
        demand=DEMAND,
        cards=CARDS,
        queries=QUERIES_SQL,
        hits=HITS,
    )


def oracle(name: str, sql: str, grain: str | None = None, **extra: str) -> None:
    """Register SQL under a query key, after the common tables of a grain if one is given."""
    if grain:
        head = base(grain, extra.pop("units", "count(*)"))
        sql = head + (",\n" + _ctes(**extra) if extra else "") + "\n" + sql
    ORACLES[name] = sql


def oracle_of_names(name: str, sql: str, **extra: str) -> None:
    """Register SQL for a query over distinct names and for its form over all products."""
    oracle(name, sql, "name", **extra)
    oracle(name + "_wide", sql, "wide", **extra)


def oracle_of_grains(name: str, sql: str, **extra: str) -> None:
    """Register SQL for a query over all lines and for its form with suppliers."""
    oracle(name, sql, "part", **extra)
    oracle(name + "_wide", sql, "wide", **extra)


R6 = "round(reorder_rate, 6) AS reorder_rate"
VELOCITY_OUT = (
    f"SELECT product_id, product_name, department_id, total_units, total_orders, {R6} FROM velocity"
)
oracle("f1_sku_velocity", VELOCITY_OUT, "part")
oracle("f1_sku_velocity_quantity", VELOCITY_OUT, "part", units="sum(quantity)")
oracle("f1_sku_velocity_names", VELOCITY_OUT, "name")
oracle("f2_basket_affinity", "SELECT * FROM affinity", "part")
oracle("f2_basket_affinity_names", "SELECT * FROM affinity", "name")
oracle("f2_basket_affinity_frequent", "SELECT * FROM affinity WHERE co_purchase_count >= 2", "part")
oracle("f2_basket_affinity_blocks", "SELECT * FROM affinity", "part")
CALIBRATE = """
SELECT round((SELECT quantile_cont(co_purchase_count::DOUBLE, 0.75) FROM affinity), 6) AS affinity_high,
       round((SELECT quantile_cont(co_purchase_count::DOUBLE, 0.5) FROM affinity), 6) AS affinity_mid,
       round((SELECT quantile_cont(co_purchase_count::DOUBLE, 0.25) FROM affinity), 6) AS affinity_low,
       round((SELECT quantile_cont(total_units::DOUBLE, 0.5) FROM velocity), 6) AS units_mid,
       round((SELECT quantile_cont(reorder_rate, 0.25) FROM velocity), 6) AS rate_low"""
oracle("a5_calibrate", CALIBRATE, "name")
oracle("a5_calibrate_parts", CALIBRATE, "part")

oracle(
    "a5_calibrate_sketches",
    """SELECT unnest(['affinity_high', 'affinity_mid', 'affinity_low', 'units_mid', 'rate_low']) AS cut_off,
              true AS within_error""",
)
oracle("s2_read_table", PART_PRODUCTS)
oracle("j1_symmetric", "SELECT * FROM sym", "name")
oracle(
    "w1_top_k",
    """SELECT * FROM (SELECT *, row_number() OVER (
         PARTITION BY product_id ORDER BY co_purchase_count DESC, other_id) AS rank FROM sym)
       WHERE rank <= 5""",
    "name",
)
DEMAND_COLUMNS = f"product_id, product_name, aisle_id, department_id, total_units, total_orders, {R6}"
oracle(
    "o3_rerank",
    f"""SELECT {DEMAND_COLUMNS}, cheap_rank, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY department_id
                   ORDER BY demand2.reorder_rate DESC, total_units DESC, product_id) AS rank
          FROM (SELECT *, row_number() OVER (PARTITION BY department_id
                   ORDER BY total_units DESC, product_id) AS cheap_rank FROM demand) demand2
          WHERE cheap_rank <= 25) WHERE rank <= 10""",
    "part",
)
oracle("p1_with_demand", f"SELECT {DEMAND_COLUMNS} FROM demand", "part")
oracle("p1_with_demand_wide", f"SELECT {DEMAND_COLUMNS} FROM demand", "wide")
oracle(
    "p2_lookup",
    VELOCITY_OUT + " WHERE product_id IN (SELECT l_partkey FROM lineitem)",
    "part",
)
oracle_of_grains(
    "p3_exact_name",
    """SELECT query_id, rank, product_id, product_name, total_units FROM (
         SELECT query_id, product_id, product_name, total_units, row_number() OVER (
           PARTITION BY query_id ORDER BY total_units DESC, product_id) AS rank
         FROM queries JOIN demand ON product_name = user_query) WHERE rank <= 5""",
)


def search(condition: str, k: int = 15) -> str:
    return f"""SELECT query_id, rank, product_id, product_name, total_units, {R6} FROM (
  SELECT query_id, product_id, product_name, total_units, reorder_rate, row_number() OVER (
    PARTITION BY query_id ORDER BY total_units DESC, demand.reorder_rate DESC, product_id) AS rank
  FROM asked JOIN demand ON {condition}) WHERE rank <= {k}"""


LIKE = "product_name ILIKE '%' || asked.user_query || '%'"
oracle_of_grains("p4_search_by_name", search(LIKE), asked="SELECT * FROM queries")
oracle(
    "p4_search_wildcards",
    search(LIKE),
    "part",
    asked="SELECT query_id, translate(upper(user_query), ' AE', '%_') AS user_query FROM queries",
)
oracle_of_grains(
    "p4_search_indexed",
    f"""SELECT *, 1 AS run FROM ({search(LIKE)})
        UNION ALL SELECT *, 2 AS run FROM ({search(LIKE.replace("asked", "coded")).replace("asked", "coded")})""",
    asked="SELECT * FROM queries",
    coded="SELECT query_id, translate(upper(user_query), ' AE', '%_') AS user_query FROM queries",
)
oracle(
    "p4_search_escaped",
    search("contains(lower(product_name), lower(asked.user_query))"),
    "part",
    asked="SELECT * FROM queries",
)
CO_PURCHASE = """
SELECT product_id, rank, other_id, product_name, co_purchase_count FROM (
  SELECT s.product_id, s.other_id, p.product_name, s.co_purchase_count, row_number() OVER (
    PARTITION BY s.product_id ORDER BY s.co_purchase_count DESC, s.other_id) AS rank
  FROM sym s JOIN products p ON p.product_id = s.other_id) WHERE rank <= 10"""
oracle("r2_co_purchase", CO_PURCHASE, "name")
oracle("r2_co_purchase_parts", CO_PURCHASE, "part")
oracle("r2_co_purchase_pairs", CO_PURCHASE, "part")
oracle("r2_co_purchase_many", CO_PURCHASE.replace("rank <= 10", "rank <= 55"), "name")
POPULAR = """
SELECT department_id, rank, product_id, product_name, total_units, reorder_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY department_id
    ORDER BY reorder_rate DESC, total_units DESC, product_id) AS rank FROM velocity)
WHERE rank <= 10"""
oracle(
    "r3_popular_alternatives",
    f"SELECT department_id, rank, product_id, product_name, total_units, {R6} FROM popular",
    "part",
    popular=POPULAR,
)
oracle_of_grains(
    "r4_product_card",
    f"""SELECT {DEMAND_COLUMNS}, text FROM cards
        UNION ALL
        SELECT c_custkey + 1000000, NULL, NULL, NULL, NULL, NULL, NULL,
               'Product ID: ' || (c_custkey + 1000000) || ' (not found)' FROM customer""",
)
oracle_of_grains("d1_documents", "SELECT product_id, text FROM cards")
oracle("c1_card_text", "SELECT product_id, text FROM cards", "name")


def family(name: str, buckets, stop_words) -> str:
    lowered = f"lower({name})"
    plain = rf"regexp_replace({lowered}, '\b({'|'.join(stop_words)})\b', '', 'g')"
    plain = rf"regexp_replace({plain}, '[^a-z\s]', ' ', 'g')"
    words = rf"[w FOR w IN regexp_split_to_array({plain}, '\s+') IF length(w) >= 3]"
    rest = f"substr(array_to_string({words}, ' '), 1, 30)"
    return case(
        [(f"contains({lowered}, {quoted(word)})", quoted(label)) for word, label in buckets],
        f"CASE WHEN {rest} = '' THEN 'other' ELSE {rest} END",
    )


oracle(
    "c2_family_key",
    f"""SELECT DISTINCT name, {family("name", fixed.FAMILY_BUCKETS, fixed.FAMILY_STOP_WORDS)} AS family,
          {family("name", (("ring", "rings"), ("old", "vintage")), ("large", "new"))} AS family_of_rules
        FROM (SELECT p_name AS name FROM part UNION ALL SELECT n_name FROM nation
              UNION ALL SELECT c_name FROM customer)""",
)


def theme(anchor: str, items: str, rules) -> str:
    places = {"anchor": f"lower({anchor})", "items": f"lower({items})"}
    return case(
        [(any_word(places[place], words), quoted(label)) for place, words, label in rules],
        quoted(fixed.THEME_DEFAULT),
    )


def steps(value: str, cuts, default: str) -> str:
    return case([(f"{value} >= {cut}", quoted(label)) for cut, label in cuts], quoted(default))


def discount(value: str, cuts=CUTS) -> str:
    return steps(value, cuts.discount, cuts.discount_default)


def impact(rate: str, units: str, value: str, trial, high, many, mid) -> str:
    return case(
        [
            (f"{rate} < {trial}", quoted(fixed.IMPACT_TRIAL)),
            (f"{value} >= {high} AND {units} >= {many}", quoted(fixed.IMPACT_BASKET)),
            (f"{value} >= {mid}", quoted(fixed.IMPACT_ATTACH)),
        ],
        quoted(fixed.IMPACT_DISCOVERY),
    )


def offer(rate: str, units: str, saving: str, trial, many) -> str:
    return case(
        [
            (f"{rate} < {trial}", quoted(fixed.OFFER_TRIAL)),
            (f"{units} >= {many}", f"{quoted(fixed.OFFER_TWO)} || {saving}"),
        ],
        f"{quoted(fixed.OFFER_ONE)} || {saving}",
    )


def placement(theme_column: str) -> str:
    return case(
        [
            (any_word(f"lower({theme_column})", words), quoted(", ".join(spots)))
            for words, spots in fixed.PLACEMENT_RULES
        ],
        quoted(", ".join(fixed.PLACEMENT_DEFAULT)),
    )


PAIR_NAMES = """affinity JOIN products pa ON pa.product_id = product_id_a
     JOIN products pb ON pb.product_id = product_id_b"""
oracle(
    "c3_theme",
    f"""SELECT pa.product_name AS anchor, pb.product_name AS item,
          {theme("pa.product_name", "pb.product_name", THEMES)} AS theme,
          {theme("pa.product_name", "pb.product_name", fixed.THEME_RULES)} AS default_theme
        FROM {PAIR_NAMES}""",
    "name",
)
oracle(
    "c8_placement",
    f"""SELECT anchor, item, {placement("theme")} AS placement FROM (
          SELECT pa.product_name AS anchor, pb.product_name AS item,
            {theme("pa.product_name", "pb.product_name", THEMES)} AS theme FROM {PAIR_NAMES})""",
    "name",
)
PAIR_NUMBERS = "affinity JOIN velocity v ON v.product_id = product_id_a"
DEFAULT_DISCOUNT = steps("co_purchase_count * 400", fixed.DISCOUNT_STEPS, fixed.DISCOUNT_DEFAULT)
oracle(
    "c4_discount",
    f"""SELECT product_id_a, product_id_b, {discount("co_purchase_count")} AS discount,
          {DEFAULT_DISCOUNT} AS default_discount FROM {PAIR_NUMBERS}""",
    "name",
)
oracle(
    "c5_confidence",
    f"""SELECT product_id_a, product_id_b,
          {steps("co_purchase_count", CUTS.confidence, CUTS.confidence_default)} AS confidence,
          {steps("co_purchase_count * 200", fixed.CONFIDENCE_STEPS, fixed.CONFIDENCE_DEFAULT)}
            AS default_confidence FROM {PAIR_NUMBERS}""",
    "name",
)
oracle(
    "c6_impact",
    f"""SELECT product_id_a, product_id_b,
          {impact("reorder_rate", "total_units", "co_purchase_count", 0.25, 80, 1000, 71)} AS impact,
          {impact("(reorder_rate * 2.5)", "(total_units * 50)", "(co_purchase_count * 250)", fixed.TRIAL_RATE,
                  fixed.BASKET_AFFINITY, fixed.BASKET_UNITS, fixed.ATTACH_AFFINITY)} AS default_impact
        FROM {PAIR_NUMBERS}""",
    "name",
)
oracle(
    "c7_offer",
    f"""SELECT product_id_a, product_id_b,
          {offer("reorder_rate", "total_units", discount("co_purchase_count"), 0.25, 1000)} AS offer,
          {offer("(reorder_rate * 2.5)", "(total_units * 50)", DEFAULT_DISCOUNT, fixed.TRIAL_RATE,
                 fixed.BASKET_UNITS)} AS default_offer
        FROM {PAIR_NUMBERS}""",
    "name",
)
WORD_LIST = r"[w FOR w IN regexp_split_to_array(normalised, '\s+') IF w <> '']"
oracle(
    "c9_normalise_query",
    rf"""SELECT conv_id, turn, normalised, len({WORD_LIST}) AS words, len({WORD_LIST}) = 1 AS one_word
         FROM (SELECT *, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS normalised
               FROM conversations)""",
)
oracle(
    "c11_content_hash",
    """SELECT doc_id, sha256(text || lang || source) AS hash,
              sha256(text || '|' || lang || '|' || source) AS separated_hash FROM documents""",
)
oracle(
    "c11_content_hash_lists",
    """SELECT n_nationkey, sha256(n_name || coalesce((SELECT string_agg(c_name, '|' ORDER BY c_name) FROM customer
              WHERE c_nationkey = n_nationkey), '') || coalesce((SELECT r_name FROM region WHERE r_regionkey = n_nationkey), '')) AS hash
       FROM nation""",
)
oracle(
    "c12_file_stem",
    r"""SELECT page_id, regexp_replace(regexp_extract(url, '([^/]+)/*$', 1), '(.)\.[^.]+$', '\1') AS stem
        FROM pages""",
)

ORACLES["f1_sku_velocity_upkeep"] = ORACLES["f1_sku_velocity"]
ORACLES["f2_basket_affinity_upkeep"] = ORACLES["f2_basket_affinity"]

# Promotion
CANDIDATES = """
SELECT r.product_id AS anchor_id, rank, r.other_id AS product_id, p.product_name, p.department_id,
       r.co_purchase_count, coalesce(v.total_units, 0) AS total_units,
       coalesce(v.reorder_rate, 0) AS reorder_rate
FROM (SELECT s.*, row_number() OVER (PARTITION BY s.product_id
        ORDER BY s.co_purchase_count DESC, s.other_id) AS rank
      FROM sym s JOIN products p ON p.product_id = s.other_id) r
JOIN products p ON p.product_id = r.other_id
LEFT JOIN velocity v ON v.product_id = r.other_id
WHERE rank <= 12"""
CANDIDATES_OUT = f"""SELECT anchor_id, rank, product_id, product_name, department_id,
  co_purchase_count, total_units, {R6} FROM candidates"""
oracle("b1_candidates", CANDIDATES_OUT, "name", candidates=CANDIDATES)
oracle("b1_candidates_wide", CANDIDATES_OUT, "wide", candidates=CANDIDATES)

PENALTIES = " + ".join(
    f"CASE WHEN contains(lower(product_name), {quoted(word)}) THEN 12000 ELSE 0 END"
    for word in fixed.ANCHOR_PENALTY_WORDS
)
ONE_WORD = r"NOT regexp_matches(asked, '\s')"
NAMED = rf"""
SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, total_units DESC, reorder_rate DESC, product_id) AS best
FROM (SELECT *, total_units * 1.0::DOUBLE + reorder_rate * 10000.0::DOUBLE
         - length(product_name) * 25.0::DOUBLE
         + CASE WHEN {ONE_WORD} AND lower(product_name) = asked THEN 50000 ELSE 0 END
         + CASE WHEN {ONE_WORD} AND lower(product_name) = asked || 's' THEN 40000 ELSE 0 END
         + CASE WHEN {ONE_WORD} AND starts_with(lower(product_name), asked || ' ') THEN 15000 ELSE 0 END
         - ({PENALTIES}) AS score
      FROM (SELECT query_id, lower(trim(user_query)) AS asked, d.*, row_number() OVER (
              PARTITION BY query_id ORDER BY total_units DESC, reorder_rate DESC, product_id) AS nth
            FROM queries JOIN demand d ON product_name ILIKE '%' || user_query || '%')
      WHERE nth <= 25)"""
CHOSEN = """
SELECT q.query_id, coalesce(n.product_id, h.product_id) AS anchor_id,
       CASE WHEN n.product_id IS NOT NULL THEN 'name' WHEN h.product_id IS NOT NULL THEN 'hit'
            ELSE 'none' END AS source, n.score
FROM queries q LEFT JOIN (SELECT * FROM named WHERE best = 1) n ON n.query_id = q.query_id
LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h ON h.query_id = q.query_id"""
oracle_of_names(
    "b2_anchor",
    "SELECT query_id, anchor_id, source, round(score, 6) AS score FROM chosen",
    named=NAMED,
    chosen=CHOSEN,
)
# Anchors with whether the query lifts the penalty on add-ons.
ALL_ANCHORS = f"""
SELECT product_id AS anchor_id, {any_word("product_name", WEIGHTS.exempt_words)} AS exempt
FROM products"""
SCORED = """
SELECT c.*, a.exempt, c.co_purchase_count * 1.0::DOUBLE + c.reorder_rate * 200.0::DOUBLE
   + least(c.total_units, 5000) / 50.0::DOUBLE
   + CASE WHEN c.department_id = p.department_id THEN 10.0::DOUBLE ELSE 0 END
   - CASE WHEN contains(c.product_name, 'ring') AND NOT a.exempt THEN 4.0::DOUBLE ELSE 0 END AS relevance
FROM candidates c JOIN anchors a ON a.anchor_id = c.anchor_id
JOIN products p ON p.product_id = c.anchor_id"""
PAIRS = """
SELECT a.anchor_id, a.exempt, a.rk AS rk_a, b.rk AS rk_b, a.product_id AS product_id_1,
       b.product_id AS product_id_2, a.product_name AS name_1, b.product_name AS name_2,
       least(a.co_purchase_count, b.co_purchase_count) AS min_count,
       a.relevance + b.relevance
         + 0.3::DOUBLE * least(a.co_purchase_count, b.co_purchase_count) AS score
FROM pool a JOIN pool b ON a.anchor_id = b.anchor_id AND a.exempt = b.exempt AND a.rk < b.rk
  AND split_part(a.product_name, ' ', 2) <> split_part(b.product_name, ' ', 2)
WHERE a.rk <= 10 AND b.rk <= 10"""
POOL = """SELECT *, row_number() OVER (PARTITION BY anchor_id, exempt
   ORDER BY relevance DESC, rank) AS rk FROM scored"""


def _best_pair(*taken: str) -> str:
    """The best pair per anchor that shares no product with the pairs taken before."""
    joins = " ".join(f"JOIN {t} ON {t}.anchor_id = p.anchor_id AND {t}.exempt = p.exempt" for t in taken)
    clash = " AND ".join(
        f"p.{mine} NOT IN ({t}.product_id_1, {t}.product_id_2)"
        for t in taken
        for mine in ("product_id_1", "product_id_2")
    )
    where = f"WHERE {clash}" if taken else ""
    return f"""SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.anchor_id, p.exempt
        ORDER BY p.score DESC, p.rk_a, p.rk_b) AS nth FROM pairs p {joins} {where}) WHERE nth = 1"""


SELECTED = """SELECT 1 AS rank, * FROM first UNION ALL SELECT 2, * FROM second
              UNION ALL SELECT 3, * FROM third"""
CHAIN = dict(
    candidates=CANDIDATES,
    scored=SCORED,
    pool=POOL,
    pairs=PAIRS,
    first=_best_pair(),
    second=_best_pair("first"),
    third=_best_pair("first", "second"),
    selected=SELECTED,
)
oracle_of_names(
    "b3_addon_score",
    "SELECT anchor_id, product_id, exempt, round(relevance, 6) AS relevance FROM scored",
    anchors=ALL_ANCHORS,
    **CHAIN,
)
oracle_of_names(
    "b4_pairs",
    "SELECT anchor_id, product_id_1, product_id_2, round(score, 6) AS score FROM pairs",
    anchors=ALL_ANCHORS,
    **CHAIN,
)
oracle_of_names(
    "b5_disjoint",
    "SELECT anchor_id, rank, product_id_1, product_id_2, round(score, 6) AS score FROM selected",
    anchors=ALL_ANCHORS,
    **CHAIN,
)
DECORATED = f"""
SELECT *, {placement("theme")} AS placement FROM (
  SELECT s.*, d.product_name AS anchor_name,
    {theme("d.product_name", "s.name_1 || ' ' || s.name_2", THEMES)} AS theme,
    {offer("d.reorder_rate", "d.total_units", discount("s.min_count"), 0.25, 1000)} AS offer,
    {steps("s.min_count", CUTS.confidence, CUTS.confidence_default)} AS confidence,
    {impact("d.reorder_rate", "d.total_units", "s.min_count", 0.25, 80, 1000, 71)} AS expected_impact
  FROM selected s JOIN demand d ON d.product_id = s.anchor_id)"""
oracle_of_names(
    "b6_decorate",
    """SELECT anchor_id, rank, round(score, 1) AS bundle_score, theme, offer, confidence, expected_impact,
              placement, anchor_name, name_1, name_2 FROM decorated""",
    anchors=ALL_ANCHORS,
    **CHAIN,
    decorated=DECORATED,
)
ASKED = f"""
SELECT c.query_id, q.user_query, c.anchor_id,
       {any_word("lower(user_query)", WEIGHTS.exempt_words)} AS exempt
FROM chosen c JOIN queries q ON q.query_id = c.query_id"""
QUERY_ANCHORS = "SELECT DISTINCT anchor_id, exempt FROM asked WHERE anchor_id IS NOT NULL"
PROMOTION = dict(
    named=NAMED, chosen=CHOSEN, asked=ASKED, anchors=QUERY_ANCHORS, **CHAIN, decorated=DECORATED
)
STATUS = """CASE WHEN a.anchor_id IS NULL THEN 'no_anchor'
            WHEN NOT EXISTS (SELECT 1 FROM candidates k WHERE k.anchor_id = a.anchor_id) THEN 'no_candidates'
            WHEN NOT EXISTS (SELECT 1 FROM decorated k WHERE k.anchor_id = a.anchor_id AND k.exempt = a.exempt)
            THEN 'no_bundles' ELSE 'ok' END AS status"""
PROMOTED = f"""SELECT a.query_id, a.anchor_id, {STATUS}, d.rank, round(d.score, 1) AS bundle_score, d.theme, d.offer,
              d.confidence, d.expected_impact, d.placement, d.product_id_1, d.product_id_2, d.min_count
       FROM asked a LEFT JOIN decorated d ON d.anchor_id = a.anchor_id AND d.exempt = a.exempt"""
oracle("b8_promote", PROMOTED, "name", **PROMOTION)
oracle("b8_promote_wide", PROMOTED, "wide", **PROMOTION)
oracle(
    "b8_statuses",
    f"""SELECT anchor_id, exempt, status, CASE status WHEN 'ok' THEN n ELSE 0 END AS n_bundles,
               CASE status WHEN 'ok' THEN NULL ELSE 'Anchor: ' || coalesce(product_name, '(unknown)') || '. '
                 || CASE status WHEN 'no_bundles' THEN {quoted(fixed.TEXT_NO_BUNDLES)}
                                ELSE {quoted(fixed.TEXT_NO_CANDIDATES)} END END AS message
        FROM (SELECT a.*, p.product_name, n, CASE WHEN p.product_id IS NULL THEN 'unknown_product'
                WHEN c.anchor_id IS NULL THEN 'no_candidates' WHEN n = 0 THEN 'no_bundles' ELSE 'ok' END AS status
              FROM (SELECT a.*, (SELECT count(*) FROM decorated d WHERE d.anchor_id = a.anchor_id) AS n FROM anchors a) a
              LEFT JOIN products p ON p.product_id = a.anchor_id
              LEFT JOIN (SELECT DISTINCT anchor_id FROM candidates) c ON c.anchor_id = a.anchor_id)""",
    "wide",
    few="SELECT * FROM sym WHERE (least(product_id, other_id) * 31 + greatest(product_id, other_id)) % 60 = 0",
    anchors="""SELECT anchor_id, anchor_id % 2 = 0 AS exempt FROM (
        SELECT product_id AS anchor_id FROM products UNION ALL SELECT -n_nationkey - 1 FROM nation)""",
    **{**CHAIN, "candidates": CANDIDATES.replace("FROM sym s", "FROM few s")},
    decorated=DECORATED,
)
ITEM = """'   - ' || {0}.product_name || ' (affinity=' || {0}.co_purchase_count || ', rr='
  || CAST(CAST({0}.reorder_rate AS DECIMAL(10,3)) AS VARCHAR) || ', units=' || {0}.total_units || ')'"""
BLOCKS = f"""
SELECT d.anchor_id, d.exempt, string_agg(
   d.rank || '. Bundle Score=' || CAST(CAST(round(d.score, 1) AS DECIMAL(20,1)) AS VARCHAR) || chr(10)
   || '   Theme: ' || d.theme || chr(10) || '   Offer: ' || d.offer || chr(10)
   || '   Confidence: ' || d.confidence || chr(10)
   || '   Expected impact: ' || d.expected_impact || chr(10)
   || '   Placement: ' || d.placement || chr(10)
   || '   - ' || d.anchor_name || ' (Anchor)' || chr(10)
   || {ITEM.format("a")} || chr(10) || {ITEM.format("b")} || chr(10), chr(10) ORDER BY d.rank) AS body
FROM decorated d
JOIN candidates a ON a.anchor_id = d.anchor_id AND a.product_id = d.product_id_1
JOIN candidates b ON b.anchor_id = d.anchor_id AND b.product_id = d.product_id_2
GROUP BY d.anchor_id, d.exempt"""
HEAD = "\n".join([fixed.TEXT_HEAD, "", fixed.TEXT_ANCHOR, ""])
RENDERED = f"""
SELECT query_id, status, CASE status WHEN 'no_anchor' THEN {quoted(fixed.TEXT_NO_ANCHOR)}
       WHEN 'ok' THEN {quoted(HEAD)} || text || chr(10) || chr(10) || {quoted(fixed.TEXT_BUNDLES)} || chr(10)
         || body || chr(10) || {quoted(chr(10).join(fixed.TEXT_WHY))}
       ELSE 'Anchor: ' || product_name || '. ' || CASE status WHEN 'no_bundles'
         THEN {quoted(fixed.TEXT_NO_BUNDLES)} ELSE {quoted(fixed.TEXT_NO_CANDIDATES)} END END AS result_text
FROM (SELECT a.query_id, {STATUS}, c.text, c.product_name, b.body
      FROM asked a LEFT JOIN cards c ON c.product_id = a.anchor_id
      LEFT JOIN blocks b ON b.anchor_id = a.anchor_id AND b.exempt = a.exempt)"""
oracle("b7_render_wide", RENDERED, "wide", **PROMOTION, blocks=BLOCKS)
oracle("b7_render", RENDERED, "name", **PROMOTION, blocks=BLOCKS)
oracle(
    "s9_run_log",
    """SELECT sha256('batch-1|' || a.query_id) AS run_id, a.user_query AS query,
              '/promo-recommendations' AS endpoint, false AS debug,
              CASE WHEN starts_with(a.query_id, 'nation-') THEN 'error' ELSE 'ok' END AS status,
              length(a.user_query) * CAST(1.5 AS DOUBLE) AS latency_ms,
              n AS bundle_count, a.anchor_id AS anchor_product_id,
              substr(repeat(p.product_name, 30), 1, 200) AS anchor_name,
              CASE WHEN starts_with(a.query_id, 'nation-') THEN substr(repeat(a.user_query, 200), 1, 500) END
                AS error_message,
              '2024-05-06' AS run_day, a.user_query AS payload_query, r.result_text AS payload_text,
              (SELECT theme FROM decorated d WHERE d.anchor_id = a.anchor_id AND d.exempt = a.exempt AND d.rank = 1)
                AS payload_theme,
              n AS payload_bundles
       FROM (SELECT *, (SELECT count(*) FROM decorated d WHERE d.anchor_id = k.anchor_id AND d.exempt = k.exempt)
               AS n FROM asked k) a
       JOIN rendered r ON r.query_id = a.query_id LEFT JOIN products p ON p.product_id = a.anchor_id""",
    "name",
    **PROMOTION,
    blocks=BLOCKS,
    rendered=RENDERED,
)

# Retrieval and recommendation
NEAREST = """
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score, row_number() OVER (
    PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS rank
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) q,
       (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v) WHERE rank <= 5"""
oracle("v1_vector_search", NEAREST)
oracle("v1_vector_search_blocks", NEAREST)
oracle("v2_vector_index_all_lists", NEAREST)
oracle("v2_index_quality", "SELECT true AS recall_reached, true AS vectors_kept, true AS bytes_kept")
oracle("v2_lsh_quality", "SELECT true AS recall_reached, true AS share_kept")
oracle(
    "v1_search_documents",
    """SELECT h.query_id, h.rank, h.product_id, c.text, round(h.score, 6) AS score
       FROM hits h JOIN cards c ON c.product_id = h.product_id WHERE h.rank <= 5""",
    "part",
)
ALIASES = f"""
SELECT DISTINCT keyword, unnest(['old ' || keyword, 'new ' || keyword]) AS product_name
FROM (SELECT split_part(p_name, ' ', 2) AS keyword FROM part)
WHERE keyword IN ({", ".join(map(quoted, ALIAS_WORDS))})
UNION ALL SELECT lower(s_name), s_name FROM supplier"""
PRODUCT_CHOICE = """
SELECT q.query_id, coalesce(a.product_id, h.product_id) AS product_id,
       CASE WHEN a.product_id IS NOT NULL THEN 'alias' WHEN h.product_id IS NOT NULL THEN 'hit'
            ELSE 'none' END AS source
FROM queries q
LEFT JOIN (SELECT * FROM (SELECT query_id, d.product_id, row_number() OVER (
             PARTITION BY query_id ORDER BY d.total_units DESC, d.product_id) AS nth
           FROM queries JOIN aliases ON contains(lower(user_query), lower(keyword))
           JOIN demand d ON d.product_name = aliases.product_name) WHERE nth = 1) a
  ON a.query_id = q.query_id
LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h ON h.query_id = q.query_id"""
oracle_of_grains("r1_choose_product", "SELECT * FROM choice", aliases=ALIASES, choice=PRODUCT_CHOICE)
FOUND = """
SELECT product_id AS chosen_id, 'co_purchase' AS source, rank, other_id AS product_id, product_name,
       co_purchase_count, NULL::BIGINT AS total_units, NULL::DOUBLE AS reorder_rate FROM together
UNION ALL
SELECT p.product_id, 'popular', m.rank, m.product_id, m.product_name, NULL, m.total_units, m.reorder_rate
FROM products p JOIN popular m ON m.department_id = p.department_id
WHERE p.product_id NOT IN (SELECT product_id FROM together)"""
RECOMMENDED = """
SELECT c.query_id, c.product_id AS chosen_id,
       coalesce(f.source, CASE WHEN c.product_id IS NULL THEN 'no_match' ELSE 'no_pairs' END) AS source,
       f.rank, f.product_id, f.product_name, f.co_purchase_count, f.total_units, f.reorder_rate
FROM choice c LEFT JOIN found f ON f.chosen_id = c.product_id"""
RECOMMENDATION = dict(
    aliases=ALIASES,
    choice=PRODUCT_CHOICE,
    popular=POPULAR,
    together=CO_PURCHASE,
    found=FOUND,
    recommended=RECOMMENDED,
)
oracle_of_grains(
    "r5_recommend",
    f"""SELECT query_id, chosen_id, source, rank, product_id, product_name, co_purchase_count,
          total_units, {R6} FROM recommended""",
    **RECOMMENDATION,
)
RECOMMENDED_TEXT = f"""
SELECT r.query_id, r.chosen_id, CASE WHEN r.chosen_id IS NULL THEN {quoted(fixed.TEXT_NO_MATCH)}
  ELSE {quoted(fixed.TEXT_CHOSEN)} || chr(10) || c.text || chr(10) || chr(10)
    || 'Frequently bought together (based on basket affinity) for product_id=' || r.chosen_id || ':'
    || chr(10) || CASE WHEN r.source = 'co_purchase' THEN r.body
         ELSE {quoted(fixed.TEXT_NO_PAIRS)} || chr(10) || chr(10)
           || 'Popular alternatives in the same department (department_id=' || c.department_id || '):'
           || CASE WHEN r.source = 'popular' THEN chr(10) || r.body ELSE '' END END END AS text
FROM (SELECT query_id, chosen_id, max(source) AS source, string_agg(
        CASE WHEN source = 'co_purchase'
             THEN '- ' || product_name || ' (co_purchase_count=' || co_purchase_count || ')'
             ELSE '- ' || product_name || ' (reorder_rate='
               || CAST(CAST(reorder_rate AS DECIMAL(10,3)) AS VARCHAR) || ', units=' || total_units || ')'
        END, chr(10) ORDER BY rank) AS body
      FROM recommended GROUP BY query_id, chosen_id) r
LEFT JOIN cards c ON c.product_id = r.chosen_id"""
oracle_of_grains("r5_recommend_text", RECOMMENDED_TEXT, **RECOMMENDATION)

# Sources and sinks
oracle(
    "s1_csv_ingest",
    """SELECT order_id, product_id, customer_id, strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts,
              quantity FROM lines""",
    "part",
)
oracle("s3_write_documents", "SELECT product_id, text FROM cards", "part")
oracle(
    "s5_rebuild_vectors",
    """SELECT c.product_id, c.text,
              array_to_string([CAST(CAST(floor(x * 10000) AS BIGINT) AS VARCHAR) FOR x IN CAST(embedding AS DOUBLE[])], ' ') AS elements
       FROM cards c JOIN embeddings ON vec_id = c.product_id""",
    "part",
)
oracle(
    "s6_load_report",
    """SELECT count(*) AS rows_written, count(*) AS rows_found, true AS complete FROM documents""",
)

# Corpus
DOC_LINES = """
SELECT source || '/' || doc_id || '.md' AS path, doc_id || '.md' AS file_name,
       unnest(lines) AS line, generate_subscripts(lines, 1) AS nr
FROM (SELECT *, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))
               AS lines FROM documents WHERE text <> '')"""


def chunks(step: int) -> str:
    return f"""
SELECT path, file_name || ':' || min(nr) AS symbol, 'file' AS kind, CAST(min(nr) AS INTEGER) AS start_line,
       CAST(max(nr) AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY nr) AS text
FROM doc_lines GROUP BY path, file_name, (nr - 1) // {step}"""


def corpus_sql(body: str, **extra: str) -> str:
    return "WITH " + _ctes(doc_lines=DOC_LINES, short=chunks(STEP), **extra) + "\n" + body


oracle("a4_counts", corpus_sql("SELECT count(*) AS rows, count(DISTINCT path) AS distinct_path FROM short"))
oracle("s8_chunk_round_trip", corpus_sql("SELECT * FROM short"))
oracle("t1_chunk_lines", corpus_sql(chunks(fixed.CHUNK_LINES)))
oracle("t1_chunk_lines_short", corpus_sql("SELECT * FROM short"))
oracle(
    "t2_head_chunk",
    corpus_sql(
        f"""SELECT path, file_name AS symbol, 'file' AS kind, 1 AS start_line,
               CAST(max(nr) AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY nr) AS text
            FROM doc_lines WHERE nr <= {STEP} GROUP BY path, file_name"""
    ),
)
CONVERSATION_TEXT = "string_agg(text || chr(10), '' ORDER BY turn)"
oracle("s7_text_tree", f"SELECT conv_id, {CONVERSATION_TEXT} AS text FROM conversations GROUP BY conv_id")
oracle(
    "s10_grouped_text",
    """SELECT conv_id, part, line, CAST(row_number() OVER (PARTITION BY conv_id, part ORDER BY nth, k) - 1 AS INTEGER) AS nr
       FROM (SELECT conv_id, nth, nth // 3 AS part, unnest(lines) AS line, generate_subscripts(lines, 1) AS k
             FROM (SELECT conv_id, string_split(text, chr(10)) AS lines,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations))""",
)
oracle(
    "a6_concat_parts",
    """SELECT conv_id, nth // 3 AS part, string_agg(text, chr(10) ORDER BY nth) AS text
       FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations)
       GROUP BY conv_id, nth // 3""",
)
oracle(
    "a6_concat_ordered",
    """SELECT conv_id, CAST(0 AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY turn) AS text
       FROM conversations GROUP BY conv_id""",
)
HEADINGS = """
SELECT conv_id AS doc, turn AS pos, CASE role WHEN 'user' THEN 0 ELSE 1 END AS level, role || turn AS name
FROM conversations WHERE role IN ('user', 'assistant')"""
BLOCKS_SQL = """
SELECT h.*, coalesce((SELECT min(n.pos) - 1 FROM headings n
                      WHERE n.doc = h.doc AND n.pos > h.pos AND n.level <= h.level),
                     (SELECT max(turn) FROM conversations WHERE conv_id = h.doc)) AS "end"
FROM headings h"""
SEGMENTS = "WITH " + _ctes(headings=HEADINGS, blocks=BLOCKS_SQL) + """
SELECT doc, pos, level, name, "end", coalesce((
         SELECT string_agg(p.name, '.' ORDER BY p.pos) FROM blocks p
         WHERE p.doc = b.doc AND p.pos < b.pos AND b.pos <= p."end"
       ) || '.', '') || name AS symbol
FROM blocks b"""
oracle(
    "t3_index_files",
    corpus_sql(
        """SELECT path, symbol, kind, CAST(nr AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line,
                  (SELECT string_agg(l.line, chr(10) ORDER BY l.nr) FROM code l
                   WHERE l.path = n.path AND l.nr BETWEEN n.nr AND n.last) AS text
           FROM named n
           UNION ALL
           SELECT path, path, 'file', 1, CAST(max(nr) AS INTEGER), string_agg(line, chr(10) ORDER BY nr)
           FROM code WHERE path NOT IN (SELECT path FROM heads) GROUP BY path
           UNION ALL SELECT * FROM plain""",
        code="""SELECT 'conv' || conv_id || '.py' AS path, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
                       CASE role WHEN 'user' THEN 'class User' || turn || ':'
                                 WHEN 'assistant' THEN '    def turn' || turn || '(self):' ELSE '        pass' END AS line
                FROM conversations""",
        heads="""SELECT path, nr, CASE role WHEN 'user' THEN 0 ELSE 4 END AS level,
                        CASE role WHEN 'user' THEN 'class' ELSE 'function' END AS kind,
                        CASE role WHEN 'user' THEN 'User' ELSE 'turn' END || turn AS name
                 FROM code WHERE role IN ('user', 'assistant')""",
        spans="""SELECT h.*, coalesce((SELECT min(o.nr) - 1 FROM heads o
                   WHERE o.path = h.path AND o.nr > h.nr AND o.level <= h.level),
                   (SELECT max(nr) FROM code l WHERE l.path = h.path)) AS last FROM heads h""",
        named="""SELECT s.*, coalesce((SELECT string_agg(p.name, '.' ORDER BY p.nr) FROM spans p
                   WHERE p.path = s.path AND p.nr < s.nr AND s.nr <= p.last) || '.', '') || name AS symbol
                 FROM spans s""",
        plain=chunks(fixed.CHUNK_LINES),
    ),
)
oracle(
    "t3_index_tree",
    """WITH file AS (
         SELECT conv_id, (nth - 1) // 2 AS part, sum(len(string_split(text, chr(10)))) AS lines
         FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) GROUP BY ALL
       ), conv AS (
         SELECT conv_id, CAST(sum(ceil(lines / 200)) AS BIGINT) AS n_chunks, CAST(sum(lines) AS BIGINT) AS n_lines FROM file GROUP BY conv_id)
       SELECT conv_id, 'file' AS kind, n_chunks, n_lines, (SELECT count(*) FROM file) AS files, 0 AS empty_files,
              (SELECT CAST(sum(n_chunks) AS BIGINT) FROM conv) AS chunks FROM conv""",
)
oracle("t3_segment_blocks", SEGMENTS)
oracle("t3_segment_blocks_pieces", SEGMENTS)
oracle(
    "t3_chunk_blocks",
    corpus_sql(
        """SELECT path, symbol, 'passage' AS kind, CAST(nr AS INTEGER) AS start_line,
                  CAST(last AS INTEGER) AS end_line,
                  (SELECT string_agg(l.line, chr(10) ORDER BY l.nr) FROM doc_lines l
                   WHERE l.path = n.path AND l.nr BETWEEN n.nr AND n.last) AS text
           FROM named n
           UNION ALL
           SELECT path, file_name, 'file', 1, CAST(max(nr) AS INTEGER),
                  string_agg(line, chr(10) ORDER BY nr)
           FROM doc_lines WHERE nr <= 5 AND path NOT IN (SELECT path FROM heads)
           GROUP BY path, file_name""",
        heads=r"""SELECT path, nr, length(regexp_extract(line, '^([A-Za-z]+) ([A-Za-z]+) ', 1)) AS level,
                         regexp_extract(line, '^([A-Za-z]+) ([A-Za-z]+) ', 2) AS name
                  FROM doc_lines WHERE regexp_matches(line, '^([A-Za-z]+) ([A-Za-z]+) ')""",
        spans="""SELECT h.*, coalesce((SELECT min(o.nr) - 1 FROM heads o
                   WHERE o.path = h.path AND o.nr > h.nr AND o.level <= h.level),
                   (SELECT max(nr) FROM doc_lines l WHERE l.path = h.path)) AS last FROM heads h""",
        named="""SELECT s.*, coalesce((SELECT string_agg(p.name, '.' ORDER BY p.nr) FROM spans p
                   WHERE p.path = s.path AND p.nr < s.nr AND s.nr <= p.last) || '.', '') || name AS symbol
                 FROM spans s""",
    ),
)
TERMS = """
SELECT unnest(string_split(p_name, ' ')) AS term FROM part UNION SELECT lang FROM documents"""
oracle(
    "t4_grep",
    corpus_sql(
        """SELECT term, path, start_line, symbol, rank FROM (
             SELECT term, path, start_line, symbol, row_number() OVER (
               PARTITION BY term ORDER BY path, start_line, symbol) AS rank
             FROM terms JOIN short ON contains(lower(text), lower(term))) WHERE rank <= 25""",
        terms=TERMS,
    ),
)
ORACLES["t4_grep_indexed"] = ORACLES["t4_grep"]
oracle(
    "t4_grep_items",
    """SELECT term, path, start_line, symbol, rank FROM (
         SELECT b.text AS term, source || '/' || doc_id || '.md' AS path, 1 AS start_line, '' AS symbol,
                row_number() OVER (PARTITION BY b.text
                  ORDER BY source || '/' || doc_id || '.md') AS rank
         FROM (SELECT DISTINCT text FROM benchmark) b
         JOIN documents d ON contains(lower(d.text), lower(b.text))) WHERE rank <= 25""",
)
CATALOGUE = """
SELECT lower(p_type) || '/' || lower(p_brand) AS path, p_name AS symbol,
       CAST(p_partkey AS INTEGER) AS start_line, p_name || ' ' || p_brand || ' ' || p_type AS text
FROM part"""
CATALOGUE_TERMS = "SELECT DISTINCT user_query AS term FROM queries"
oracle(
    "t5_find_symbol",
    """SELECT term, rank, match, path, start_line, symbol FROM (
         SELECT *, row_number() OVER (PARTITION BY term ORDER BY path, start_line, symbol) AS rank
         FROM (SELECT term, path, start_line, symbol,
                      CASE WHEN lower(symbol) = lower(trim(term)) THEN 'exact' ELSE 'partial' END AS match,
                      min(CASE WHEN lower(symbol) = lower(trim(term)) THEN 0 ELSE 1 END)
                        OVER (PARTITION BY term) AS tier
               FROM terms JOIN catalogue ON contains(lower(symbol), lower(trim(term))))
         WHERE (tier = 0) = (match = 'exact')) WHERE rank <= 5""",
    "part",
    terms=CATALOGUE_TERMS,
    catalogue=CATALOGUE,
)
oracle(
    "t6_rank_chunks",
    """SELECT term, path, start_line, symbol, score, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY term
           ORDER BY score DESC, path, start_line, symbol) AS rank
         FROM (SELECT term, path, start_line, symbol, CAST(
                 CASE WHEN contains(lower(text), lower(term)) THEN 50 ELSE 0 END
                 + CASE WHEN contains(lower(symbol), lower(term)) THEN 80 ELSE 0 END
                 + CASE WHEN starts_with(path, 'economy/') THEN -500 ELSE 0 END
                 + CASE WHEN starts_with(path, 'promo/brand#1') OR starts_with(path, 'large/')
                        THEN 60 ELSE 0 END AS BIGINT) AS score
               FROM terms CROSS JOIN catalogue) WHERE score > 0) WHERE rank <= 5""",
    "part",
    terms=CATALOGUE_TERMS,
    catalogue=CATALOGUE,
)
ORACLES["t6_rank_chunks_indexed"] = ORACLES["t6_rank_chunks"]
oracle(
    "p6_select_chunks",
    corpus_sql(
        """SELECT path, symbol, kind, start_line, end_line FROM short
           WHERE (starts_with(path, 'src1/') OR starts_with(path, 'src2')) AND ends_with(path, '.md')"""
    ),
)
EDGES = "SELECT DISTINCT 's.' || l_suppkey AS src, 'p.' || l_partkey AS dst FROM lineitem"
oracle(
    "a3_adjacency",
    f"""WITH edges AS ({EDGES})
        SELECT src AS node, 'callees' AS direction, dst AS neighbour FROM edges
        UNION SELECT dst, 'callers', src FROM edges""",
)
oracle(
    "t7_trace",
    """WITH edges AS (SELECT DISTINCT 's.' || l_suppkey AS src, CAST(l_partkey AS VARCHAR) AS dst
                      FROM lineitem),
       links AS (SELECT src AS node, 'callees' AS direction, dst AS neighbour FROM edges
                 UNION SELECT dst, 'callers', src FROM edges),
       terms AS (SELECT 's.' || p_partkey AS term, CAST(p_partkey AS VARCHAR) AS tail FROM part)
       SELECT term, node AS matched, direction, neighbour FROM terms JOIN links ON node = term
       UNION ALL
       SELECT term, node, direction, neighbour FROM terms JOIN links ON node = tail
       WHERE term NOT IN (SELECT node FROM links)""",
)
oracle(
    "t9_filter_edges",
    f"""SELECT src, dst FROM ({EDGES})
        WHERE dst NOT IN (SELECT 'p.' || p_partkey FROM part WHERE p_type = 'PROMO')""",
)
oracle(
    "t8_refresh",
    """SELECT d.doc_id, sha256(d.text) AS hash,
              CASE WHEN l.toxic = 0 THEN 'kept' ELSE 'new:' || length(d.text) END AS payload
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
oracle(
    "j6_state_table",
    """SELECT d.doc_id, sha256(d.text) AS hash, CASE WHEN l.toxic = 0 THEN 'first' ELSE 'second' END AS payload
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang IN ('en', 'de')""",
)
oracle(
    "j6_changed_rows",
    """SELECT d.doc_id, sha256(d.text) AS hash FROM documents d
       WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
)


MODULE_CHUNKS = """
base AS (
  SELECT 'shop/' || p_type || '.py' AS path, 'p.' || p_partkey AS symbol, CAST(p_partkey AS INT) AS line,
         concat_ws(' ', p_name, p_brand) AS text, p_partkey AS number, p_size AS size FROM part
  UNION ALL SELECT 'shop/suppliers.py', 's.' || s_suppkey, CAST(s_suppkey AS INT), s_name, s_suppkey, 50 FROM supplier
  UNION ALL SELECT 'shop/suppliers.py', NULL, 1, s_name, 1, 50 FROM supplier WHERE s_suppkey = 1
), edges AS (SELECT DISTINCT 's.' || l_suppkey AS src, 'p.' || l_partkey AS dst FROM lineitem),
chunk AS (
  SELECT 2 AS v, path, symbol, line, text FROM base
  UNION ALL
  SELECT 1, path, symbol, line, CASE WHEN size < 5 THEN upper(text) ELSE text END
  FROM (SELECT * FROM base WHERE number % 11 <> 0
        UNION ALL SELECT * REPLACE (symbol || '_old' AS symbol) FROM base WHERE number % 13 = 0)
), edge AS (
  SELECT 2 AS v, src, dst FROM edges
  UNION ALL SELECT 1, src, dst FROM edges WHERE NOT (src LIKE '%7' AND dst LIKE '%3')
  UNION ALL SELECT 1, src, dst || '0' FROM edges WHERE src LIKE '%9' AND dst LIKE '%1'
), link AS (SELECT v, src AS node, 'callees' AS way, dst AS other FROM edge UNION SELECT v, dst, 'callers', src FROM edge),
tail AS (
  SELECT v, symbol, node FROM (
    SELECT v, symbol, symbol AS node, 1 AS nth FROM chunk UNION SELECT v, symbol, regexp_extract(symbol, '[^.]*$'), 2 FROM chunk)
  WHERE (v, node) IN (SELECT (v, node) FROM link) QUALIFY row_number() OVER (PARTITION BY v, symbol ORDER BY nth) = 1
), list AS (
  SELECT v, symbol, way, string_agg(other, '|' ORDER BY other) AS hashed, string_agg(other, ', ' ORDER BY other) AS shown
  FROM tail JOIN link USING (v, node) GROUP BY ALL
), full_chunk AS (
  SELECT c.*, path || '::' || c.symbol AS key, a.shown AS callers, b.shown AS callees,
         sha256(text || coalesce(a.hashed, '') || coalesce(b.hashed, '')) AS hash
  FROM chunk c LEFT JOIN list a ON a.v = c.v AND a.symbol = c.symbol AND a.way = 'callers'
  LEFT JOIN list b ON b.v = c.v AND b.symbol = c.symbol AND b.way = 'callees'
), state AS (
  SELECT n.*, 'summary of ' || length(coalesce(o.text, n.text)) AS summary, CASE WHEN o.hash IS NULL THEN 2 ELSE 1 END AS version
  FROM (SELECT * FROM full_chunk WHERE v = 2) n LEFT JOIN (SELECT * FROM full_chunk WHERE v = 1) o
    ON n.key IS NOT DISTINCT FROM o.key AND n.hash = o.hash
)"""
oracle("t8_refresh_modules", f"WITH {MODULE_CHUNKS} SELECT key, hash, summary, version FROM state")
oracle(
    "s10_module_pages",
    f"""WITH {MODULE_CHUNKS}, page AS (
  SELECT regexp_extract(path, '([^/]+)\\.py$', 1) AS module, line, path, key, 2 AS nth,
         '## `' || coalesce(symbol, '') || '`' || repeat(chr(10), 2)
         || '- **File:** `' || path || '` (lines ' || line || '-' || (line + 1) || ')' || chr(10)
         || '- **Called by:** ' || coalesce(callers, '(not shown)') || chr(10)
         || '- **Calls:** ' || coalesce(callees, '(none)') || repeat(chr(10), 2)
         || summary || repeat(chr(10), 2)
         || '```python' || chr(10) || trim(text) || chr(10) || '```' || repeat(chr(10), 2) AS part FROM state
), heads AS (
  SELECT DISTINCT module, NULL::INT AS line, NULL AS path, NULL AS key, 0 AS nth, '# `' || module || '` Module' || chr(10) AS part FROM page
  UNION ALL SELECT DISTINCT module, NULL, NULL, NULL, 1,
    '_Generated documentation. Parts that did not change are kept from the run before._' || chr(10) FROM page
), whole AS (
  SELECT module, string_agg(part || chr(10), '' ORDER BY line NULLS FIRST, path NULLS FIRST, key NULLS FIRST, nth) AS text
  FROM (SELECT * FROM heads UNION ALL SELECT * FROM page) GROUP BY module
)
SELECT module, sha256(text) AS page_hash, length(text) AS chars FROM whole""",
)
