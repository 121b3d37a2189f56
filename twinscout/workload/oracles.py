"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from twinscout.functions.text import MODIFIERS, SPEC_NUMBERS, STOP_WORDS
from twinscout.operators.cache import PLACEHOLDER
from twinscout.operators.orientation import ORIENTATIONS
from twinscout.workload import views

ORACLES: dict[str, str] = {}

WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v) + "'" for v in values) + "]"


# --- string snippets -----------------------------------------------------------------


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean(x: str) -> str:
    kept = f"regexp_replace(lower({x}), '[^a-z0-9{WS}-]', ' ', 'g')"
    return f"coalesce(replace(replace({kept}, 'rear view', 'rearview'), 'rearviewmirror', 'rearview mirror'), '')"


def tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda w: w <> ''))"


def keywords(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda w: NOT list_contains({_list(STOP_WORDS)}, w))"


def models(c: str) -> str:
    runs = rf"regexp_extract_all({c}, '\b[a-z0-9-]+\b')"
    mixed = "lambda w: regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')"
    return f"list_distinct(list_filter({runs}, {mixed}))"


def numbers(c: str) -> str:
    found = rf"regexp_extract_all({c}, '\b[0-9]+\b')"
    bare = r"lambda n: regexp_replace(n, '^0+([0-9])', '\1')"
    return f"list_distinct(list_transform({found}, {bare}))"


def only_one(a: str, b: str) -> str:
    """Values in exactly one of two lists."""
    left = f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
    right = f"list_filter({b}, lambda x: NOT list_contains({a}, x))"
    return f"list_concat({left}, {right})"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def number_conflict(a: str, b: str) -> str:
    odd = f"list_filter({only_one(a, b)}, lambda x: NOT list_contains({_list(SPEC_NUMBERS)}, x))"
    return f"(len({odd}) > 0)"


def modifier_conflict(a: str, b: str) -> str:
    odd = f"list_filter({_list(MODIFIERS)}, lambda m: list_contains({a}, m) <> list_contains({b}, m))"
    return f"(len({odd}) > 0)"


def model_conflict(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND {shared(a, b)} = 0)"


def mismatch(a: str, b: str) -> str:
    """``a`` and ``b`` are aliases having cols m, n, w (models, numbers, words)."""
    return (
        f"({model_conflict(f'{a}.m', f'{b}.m')} OR {number_conflict(f'{a}.n', f'{b}.n')} "
        f"OR {modifier_conflict(f'{a}.w', f'{b}.w')})"
    )


def as_set(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


def stem(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$')"
    return rf"regexp_replace({name}, '^(.*[^.].*)\.[^.]*$', '\1', 's')"


def label(price: str) -> str:
    return (
        f"CASE WHEN {price} IS NULL OR {price} = 0 THEN 'N/A' "
        f"ELSE 'AED ' || CAST(CAST(round_even({price}, 0) AS BIGINT) AS VARCHAR) END"
    )


def shown(price: str) -> str:
    return f"CASE WHEN {price} <> 0 THEN CAST(round_even({price}, 0) AS DOUBLE) END"


def six(x: str) -> str:
    return f"round({x}, 6)"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def cosine(a: str, b: str) -> str:
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


# --- views ---------------------------------------------------------------------------

LISTINGS = """listings AS (
  SELECT p_partkey + 1 AS row_id, 'Z' || p_partkey AS sku,
    concat_ws(' ', p_name, 'X' || (p_size % 5), p_brand, p_type,
              CASE WHEN p_size % 4 = 0 THEN 'Pro' END) AS title,
    p_retailprice AS price,
    CASE p_size WHEN 1 THEN 'nan' WHEN 2 THEN ' ' WHEN 3 THEN NULL
      ELSE 'https://img.example/Z' || p_partkey END AS image_url,
    p_type AS source_file, p_brand AS brand,
    p_partkey % (SELECT count(*) FROM embeddings) AS image_vec_id,
    (7 * p_partkey + 3) % (SELECT count(*) FROM embeddings) AS text_vec_id
  FROM part)"""
VEC = "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
IMAGES = """images AS (
  SELECT l.row_id AS image_id, upper(l.sku) AS sku_key, v.vec_id, v.v
  FROM listings l JOIN vec v ON l.image_vec_id = v.vec_id)"""
LEADS = """leads AS (
  SELECT brand, source_file, min_by(row_id, row_id) AS query_id, min_by(sku, row_id) AS sku,
    min_by(title, row_id) AS title, min_by(image_vec_id, row_id) AS image_vec_id,
    min_by(text_vec_id, row_id) AS text_vec_id, max_by(sku, row_id) AS last_sku,
    max_by(image_vec_id, row_id) AS last_image_vec_id
  FROM listings GROUP BY ALL)"""
ATTRIBUTES = """attributes AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'z' || o_custkey ELSE 'Z' || o_custkey END AS sku,
    o_orderkey + 1 AS row_id,
    CASE WHEN o_orderstatus = 'P' THEN 'ZZ' || o_orderkey END AS zsku,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS brand,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS color,
    CAST(o_orderkey % 4 AS INTEGER) AS stock,
    o_totalprice AS match_count,
    nullif(o_orderstatus, 'F') AS product_url,
    repeat('https://img.example/' || o_orderkey || CASE WHEN o_orderstatus = 'O' THEN ' ; ' ELSE ', ' END,
           o_orderkey % 9) AS urls
  FROM orders)"""
MANIFEST = f"""manifest AS (
  SELECT 'Z' || p_partkey || CASE WHEN p_type = 'SMALL' THEN '.png' ELSE '.jpg' END AS file_name,
    CASE WHEN p_brand = 'Brand#13' THEN 0 ELSE p_size * 1000 END AS length,
    p_size + 1700000000 AS mtime
  FROM part WHERE p_type <> 'PROMO')"""
FLAGSHIP_SCORES = f"""{LISTINGS}, {VEC}, {IMAGES},
q AS (SELECT list_transform(range(1, 65), lambda i: a.v[i] + b.v[i]) AS v
  FROM vec a, vec b WHERE a.vec_id = {views.FLAGSHIP_IMAGES[0]} AND b.vec_id = {views.FLAGSHIP_IMAGES[1]}),
vec_scores AS (SELECT vec.vec_id, {dot('vec.v', 'q.v')} AS score FROM vec, q),
all_hits AS (
  SELECT 1 AS query_id, image_id, sku_key, score,
    row_number() OVER (ORDER BY score DESC, image_id) AS hit
  FROM images JOIN vec_scores USING (vec_id))"""
BATCH_SCORES = f"""{LISTINGS}, {VEC}, {IMAGES}, {LEADS},
qv AS (
  SELECT query_id, CASE WHEN a.vec_id = b.vec_id THEN a.v
    ELSE list_transform(range(1, 65), lambda i: a.v[i] + b.v[i]) END AS v
  FROM leads JOIN vec a ON a.vec_id = image_vec_id JOIN vec b ON b.vec_id = last_image_vec_id),
vec_scores AS (SELECT query_id, vec.vec_id, {dot('vec.v', 'qv.v')} AS score FROM vec, qv),
all_hits AS (
  SELECT query_id, image_id, sku_key, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS hit
  FROM images JOIN vec_scores USING (vec_id)),
queries AS (
  SELECT query_id, source_file AS kind, sku, last_sku,
    CASE WHEN source_file IN ('PROMO', 'LARGE') THEN '' ELSE title END AS given,
    text_vec_id AS given_vec, 0.10 AS min_score,
    CASE WHEN source_file = 'ECONOMY' THEN 0.70 ELSE 0.05 END AS text_floor,
    CASE WHEN source_file = 'SMALL' THEN 5 ELSE 500 END AS top,
    source_file = 'STANDARD' AS strict,
    CASE WHEN source_file = 'ECONOMY' THEN 900 END AS min_price,
    CASE WHEN source_file = 'ECONOMY' THEN 1500 END AS max_price
  FROM leads),
stems AS (
  SELECT query_id, 0 AS pos, CASE WHEN kind = 'LARGE' THEN 'upload-' || query_id ELSE sku END AS sku
  FROM queries UNION ALL SELECT query_id, 1, last_sku FROM queries WHERE kind <> 'LARGE'),
by_stem AS (
  SELECT query_id, l.title, l.row_id, l.text_vec_id,
    row_number() OVER (PARTITION BY query_id ORDER BY pos, l.row_id) AS place
  FROM stems JOIN listings l USING (sku) JOIN queries USING (query_id) WHERE given = ''),
by_score AS (
  SELECT h.query_id, l.title, l.row_id, l.text_vec_id,
    row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.hit, l.row_id) AS place
  FROM all_hits h JOIN listings l ON l.sku = h.sku_key JOIN queries q ON q.query_id = h.query_id
  WHERE given = '' AND hit <= 2000 AND h.query_id NOT IN (SELECT query_id FROM by_stem)),
refs AS (
  SELECT query_id, given AS reference_title, NULL AS reference_row, given_vec AS ref_vec
  FROM queries WHERE given <> ''
  UNION ALL SELECT query_id, title, row_id, text_vec_id FROM by_stem WHERE place = 1
  UNION ALL SELECT query_id, title, row_id, text_vec_id FROM by_score WHERE place = 1)"""


def features(name: str, source: str, title: str) -> str:
    """Two CTEs giving cols k, m, n, w of every row of ``source``."""
    return f"""{name}_c AS (SELECT *, {clean(title)} AS c FROM {source}),
{name} AS (SELECT *, {keywords('c')} AS k, {models('c')} AS m, {numbers('c')} AS n, {tokens('c')} AS w
  FROM {name}_c)"""


BATCH = f"""{BATCH_SCORES}, {features('lf', 'listings', 'title')}, {features('rf', 'refs', 'reference_title')},
sims AS (
  SELECT query_id, t.vec_id AS text_vec_id, {cosine('t.v', 'r.v')} AS sim
  FROM refs JOIN vec r ON r.vec_id = ref_vec, vec t),
matches AS (
  SELECT q.query_id, q.top, l.row_id, l.sku, l.title, l.price, l.source_file,
    h.score AS ai_score, s.sim AS text_similarity,
    row_number() OVER (PARTITION BY q.query_id ORDER BY h.score DESC, s.sim DESC, l.row_id) AS rank
  FROM queries q JOIN rf ON rf.query_id = q.query_id
    JOIN all_hits h ON h.query_id = q.query_id AND h.hit <= 2000 AND h.score >= q.min_score
    JOIN lf l ON upper(l.sku) = h.sku_key
    JOIN sims s ON s.query_id = q.query_id AND s.text_vec_id = l.text_vec_id AND s.sim >= q.text_floor
  WHERE (q.min_price IS NULL OR l.price >= q.min_price) AND (q.max_price IS NULL OR l.price <= q.max_price)
    AND {shared('rf.k', 'l.k')} > 0 AND (NOT q.strict OR NOT {mismatch('rf', 'l')})),
result AS (SELECT * FROM matches WHERE rank <= top)"""


def flagship(top_k: int, strict: bool = False) -> str:
    wanted = features("wanted", f"(SELECT '{views.FLAGSHIP_TITLE}' AS t)", "t")
    keep = f"AND NOT {mismatch('wanted', 'l')}" if strict else ""
    return f"""{FLAGSHIP_SCORES}, {features('lf', 'listings', 'title')}, {wanted},
sims AS (
  SELECT t.vec_id AS text_vec_id, {cosine('t.v', 'r.v')} AS sim
  FROM vec t, vec r WHERE r.vec_id = {views.FLAGSHIP_TITLE_VECTOR}),
matches AS (
  SELECT 1 AS query_id, l.row_id, l.sku, l.title, l.price, l.source_file,
    h.score AS ai_score, s.sim AS text_similarity,
    row_number() OVER (ORDER BY h.score DESC, s.sim DESC, l.row_id) AS rank
  FROM lf l JOIN all_hits h ON upper(l.sku) = h.sku_key JOIN sims s USING (text_vec_id), wanted
  WHERE h.hit <= {top_k} AND h.score >= 0.10 AND s.sim >= 0.05 AND l.price BETWEEN 900 AND 960
    AND {shared('wanted.k', 'l.k')} > 0 {keep}),
result AS (SELECT * FROM matches WHERE rank <= 500)"""


PUBLISHED = f"""SELECT query_id, rank, row_id, sku, title, price, source_file,
  sku || '.jpg' AS image_filename, {six('ai_score')} AS ai_score,
  {six('text_similarity')} AS text_similarity FROM result"""

DOC_PAIRS = f"""docs AS (SELECT doc_id, text, {clean('text')} AS c FROM documents),
f AS (SELECT doc_id, {keywords('c')} AS k, {models('c')} AS m, {numbers('c')} AS n FROM docs),
pairs AS (SELECT a.doc_id, a.k AS ak, b.k AS bk, a.m AS am, b.m AS bm, a.n AS an, b.n AS bn
  FROM f a JOIN f b ON b.doc_id = a.doc_id + 1)"""
LISTING_PAIRS = f"""{LISTINGS}, {features('lf', 'listings', 'title')},
pairs AS (SELECT a.row_id, a.k AS ak, b.k AS bk, a.w AS aw, b.w AS bw
  FROM lf a JOIN lf b ON b.row_id = a.row_id + 1)"""


def overlap(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
        f"ELSE {six(f'{shared(a, b)} / CAST(least(len({a}), len({b})) AS DOUBLE)')} END"
    )


UNION = """SELECT CAST(p_partkey AS VARCHAR) AS "SKU", p_name AS "Title", p_retailprice AS "Price",
  NULL::VARCHAR AS "Segment", NULL::VARCHAR AS "Language" FROM part
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, NULL, c_mktsegment, NULL FROM customer
UNION ALL SELECT 'D' || doc_id, text, NULL, NULL, lang FROM documents"""

LAST_ATTRIBUTES = """per_sku AS (
  SELECT *, row_number() OVER (PARTITION BY sku ORDER BY row_id DESC) AS back,
    min(row_id) OVER (PARTITION BY sku) AS seen FROM attributes),
per_key AS (
  SELECT *, row_number() OVER (PARTITION BY upper(sku) ORDER BY seen) AS variant
  FROM per_sku WHERE back = 1),
looked_up AS (SELECT upper(sku) AS key, * EXCLUDE (sku, row_id) FROM per_key WHERE variant = 1)"""


def url_parts(x: str) -> str:
    parts = f"CASE WHEN contains({x}, ';') THEN string_split({x}, ';') ELSE string_split({x}, ',') END"
    return f"list_filter(list_transform({parts}, lambda u: {strip('u')}), lambda u: u <> '')"


def card(own_image: str) -> str:
    """Card columns of rows with sku, price and the attribute columns."""
    return f"""coalesce(zsku, sku) AS zsku, coalesce(brand, 'Generic') AS brand,
  coalesce(color, '') AS color, CASE WHEN stock <> 0 THEN CAST(stock AS VARCHAR) ELSE '' END AS stock,
  coalesce(product_url, '') AS product_url,
  concat_ws('|', coalesce(brand, 'Generic'), color, CASE WHEN stock <> 0 THEN CAST(stock AS VARCHAR) END) AS tags,
  CAST(coalesce(len({url_parts('urls')}), 0) AS INTEGER) AS image_count,
  CASE WHEN urls <> '' THEN array_to_string(({url_parts('urls')})[1:6], '|') ELSE {own_image} END AS thumbnails,
  coalesce(CAST(CAST(trunc(match_count) AS BIGINT) AS VARCHAR), '1') || ' SKU' AS match_badge,
  {label('price')} AS price_label"""


IMAGE_PATH = f"""CASE WHEN sku || '.jpg' IN (SELECT file_name FROM manifest WHERE length > 0) THEN 'images/' || sku || '.jpg'
  WHEN sku || '.png' IN (SELECT file_name FROM manifest WHERE length > 0) THEN 'images/' || sku || '.png'
  ELSE '{PLACEHOLDER}' END"""

CARDS = f"""cards AS (
  SELECT o_custkey AS query_id, CAST(o_orderkey + 1 AS INTEGER) AS rank, {shown('price')} AS shown_price
  FROM (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN 0.4
    WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS price FROM orders))"""


def page(order: str) -> str:
    return f"""WITH {CARDS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position
FROM cards"""


FETCH = """log AS (
  SELECT event_id, user_id AS run_id, 'Z' || event_id AS sku,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'rejected'
      WHEN 'view' THEN 'stored' ELSE 'failed' END AS outcome FROM events)"""

SCOPE = f"""{LISTINGS}, {features('lf', 'listings', 'title')}"""

FILES = """files AS (
  SELECT vec_id, 'z' || vec_id || '.bmp' AS file_name, 'Z' || vec_id AS sku_key, label,
    CASE WHEN label > 1 THEN 8 END AS side,
    CASE label WHEN 0 THEN 0 WHEN 1 THEN 22 ELSE 246 END AS length FROM embeddings)"""


def _orientations() -> str:
    """Seven orders of the 64 pixels (1-based), written out as list expressions."""
    cell = {
        "Original": "r * 8 + c",
        "Rotate 90": "c * 8 + (7 - r)",
        "Rotate 180": "(7 - r) * 8 + (7 - c)",
        "Rotate 270": "(7 - c) * 8 + r",
        "Flip LR": "r * 8 + (7 - c)",
        "Flip UD": "(7 - r) * 8 + c",
        "Flip LR + Rotate 90": "c * 8 + r",
    }
    rows = []
    for name in ORIENTATIONS:
        index = cell[name].replace("r", "(i // 8)").replace("c", "(i % 8)")
        rows.append(f"SELECT '{name}' AS orientation, list_transform(range(64), lambda i: {index} + 1) AS o")
    return " UNION ALL ".join(rows)


ORACLES.update(
    {
        # sources and sinks
        "load_listings": f"""WITH {LISTINGS} SELECT row_number() OVER (ORDER BY source_file, row_id) AS row_id,
  CASE WHEN source_file = 'SMALL' THEN 'B' ELSE '' END || sku AS sku, title, price, source_file || CASE source_file WHEN 'MEDIUM' THEN '.csv' WHEN 'STANDARD' THEN '.csv'
    WHEN 'PROMO' THEN '.json' ELSE '.parquet' END AS source_file, brand AS "Best_Brand" FROM listings""",
        "prefer_curated_table": f"""WITH {LISTINGS} SELECT sku AS "SKU", title AS "Title" FROM listings""",
        "normalize_columns": """SELECT 'Z' || p_partkey AS "Best_ZSKU", p_partkey AS "SKU", p_name AS "Title",
  p_retailprice AS "Price", p_size AS "Best_Price", p_brand AS "Best_Brand" FROM part""",
        "union_evolving": UNION,
        "assign_row_id": """WITH ids AS (
  SELECT 'customer.parquet' AS source_file, c_custkey AS natural_key FROM customer
  UNION ALL SELECT 'documents.parquet', doc_id FROM documents
  UNION ALL SELECT 'pages.parquet', page_id FROM pages
  UNION ALL SELECT 'part.parquet', p_partkey FROM part
  UNION ALL SELECT 'supplier.parquet', s_suppkey FROM supplier)
SELECT source_file, natural_key, row_number() OVER (ORDER BY source_file, natural_key) AS row_id FROM ids""",
        "combine_listings": """SELECT source_file, count(*) AS total_rows, count(DISTINCT p) AS parts,
  count(DISTINCT d) AS docs, count(t) AS texts, CAST(sum(length(t)) AS BIGINT) AS text_chars, count(o) AS orders
FROM (SELECT 'part.parquet' AS source_file, p_partkey AS p, NULL AS d, NULL AS t, NULL AS o FROM part
  UNION ALL SELECT 'documents.parquet', NULL, doc_id, text, NULL FROM documents
  UNION ALL SELECT 'labels.parquet', NULL, doc_id, NULL, NULL FROM labels
  UNION ALL SELECT 'conversations.parquet', NULL, NULL, text, NULL FROM conversations
  UNION ALL SELECT 'benchmark.parquet', NULL, NULL, text, NULL FROM benchmark
  UNION ALL SELECT 'orders.parquet', NULL, NULL, NULL, o_orderkey FROM orders
  UNION ALL SELECT 'customer.parquet', NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'supplier.parquet', NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'nation.parquet', NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'region.parquet', NULL, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'lineitem.parquet', NULL, NULL, NULL, NULL FROM lineitem
  UNION ALL SELECT 'events.parquet', NULL, NULL, NULL, NULL FROM events
  UNION ALL SELECT 'pages.parquet', NULL, NULL, NULL, NULL FROM pages
  UNION ALL SELECT 'embeddings.parquet', NULL, NULL, NULL, NULL FROM embeddings) GROUP BY source_file""",
        "write_combined": UNION,
        "write_matches": f"WITH {BATCH} {PUBLISHED}",
        "read_matches": f"WITH {flagship(2000)} {PUBLISHED}",
        "image_scan": f"""WITH {FILES} SELECT file_name, sku_key, side AS width, side AS height
FROM files WHERE length > 0""",
        # image cache
        "image_validity": f"""WITH {FILES} SELECT file_name, length,
  CASE label WHEN 0 THEN 'empty' WHEN 1 THEN 'corrupt' ELSE 'ok' END AS status FROM files""",
        "bad_images": "SELECT count(*) FILTER (WHERE label < 2) AS bad_images FROM embeddings",
        "image_dims": f"""WITH {FILES} SELECT a.vec_id AS id_a, a.side AS width_a, a.side AS height_a,
  b.side AS width_b, b.side AS height_b FROM files a JOIN files b ON b.vec_id = a.vec_id + 1
WHERE a.length > 0 AND b.length > 0""",
        "missing_images": f"""WITH {LISTINGS}, {MANIFEST} SELECT sku, image_url,
  'images/' || sku || '.jpg' AS dest FROM listings
WHERE image_url IS NOT NULL AND trim(image_url) NOT IN ('', 'nan')
  AND sku || '.jpg' NOT IN (SELECT file_name FROM manifest WHERE length > 0)""",
        "fetch_plan": f"""WITH {LISTINGS}, {MANIFEST}, {features('lf', '(SELECT * FROM listings WHERE price >= 901)', 'title')},
{features('wanted', "(SELECT title AS t FROM listings WHERE sku = 'Z7' AND price >= 901)", 't')},
hits AS (SELECT row_id FROM lf, wanted WHERE {shared('lf.k', 'wanted.k')} > 0)
SELECT sku, image_url, 'images/' || sku || '.jpg' AS dest FROM listings
WHERE price >= 901 AND (row_id IN (SELECT row_id FROM hits) OR NOT EXISTS (SELECT 1 FROM hits))
  AND image_url IS NOT NULL AND trim(image_url) NOT IN ('', 'nan')
  AND sku || '.jpg' NOT IN (SELECT file_name FROM manifest WHERE length > 0)""",
        "fetch_outcome": f"WITH {FETCH} SELECT event_id, sku, outcome FROM log",
        "fetch_progress": f"""WITH {FETCH}, c AS (
  SELECT run_id, count(*) FILTER (WHERE outcome <> 'pending') AS completed, count(*) AS total
  FROM log GROUP BY run_id)
SELECT run_id, completed, total,
  CAST(trunc(CAST(completed AS DOUBLE) / CAST(total AS DOUBLE) * CAST(100 AS DOUBLE)) AS BIGINT) AS percent FROM c""",
        "keyword_fetch_scope": f"""WITH {SCOPE}, {features('wanted', f"(SELECT '{views.FLAGSHIP_TITLE}' AS t)", 't')},
hits AS (SELECT row_id FROM lf, wanted WHERE {shared('lf.k', 'wanted.k')} > 0)
SELECT row_id, sku, title FROM listings
WHERE row_id IN (SELECT row_id FROM hits) OR NOT EXISTS (SELECT 1 FROM hits)""",
        "keyword_fetch_scope_fallback": f"""WITH {SCOPE}, {features('bf', 'benchmark', 'text')},
hits AS (SELECT item_id, row_id FROM lf, bf WHERE {shared('lf.k', 'bf.k')} > 0)
SELECT row_id, sku, title FROM listings WHERE row_id IN (SELECT row_id FROM hits)
  OR EXISTS (SELECT 1 FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM hits))""",
        "index_delta": f"""WITH {MANIFEST}, idx AS (
  SELECT 'images/Z' || p_partkey || CASE WHEN p_type = 'SMALL' THEN '.png' ELSE '.jpg' END AS path,
    CASE WHEN p_brand = 'Brand#13' THEN 0 ELSE p_size * 1000 END + CASE WHEN p_brand = 'Brand#3' THEN 1 ELSE 0 END AS length,
    p_size + 1700000000 - CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END AS mtime
  FROM part WHERE p_brand <> 'Brand#1'),
cur AS (SELECT 'images/' || file_name AS path, length, mtime FROM manifest)
SELECT path, 'add' AS action FROM cur WHERE path NOT IN (SELECT path FROM idx)
UNION ALL SELECT path, 'remove' FROM idx WHERE path NOT IN (SELECT path FROM cur)
UNION ALL SELECT path, 'update' FROM cur JOIN idx USING (path)
  WHERE cur.length <> idx.length OR cur.mtime <> idx.mtime""",
        "local_image_path": f"""WITH {LISTINGS}, {MANIFEST}
SELECT row_id, sku, {IMAGE_PATH} AS image_path FROM listings""",
        # filters
        "price_range": f"WITH {LISTINGS} SELECT row_id, sku, price FROM listings WHERE price BETWEEN 905 AND 960",
        "price_range_text": """SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 905 AND 960
  AND p_type IN ('ECONOMY', 'STANDARD', 'SMALL')""",
        "title_contains": f"""WITH {LISTINGS} SELECT row_id, sku, title, image_url FROM listings
WHERE regexp_matches(title, 'RING x1', 'i')""",
        "title_contains_documents": """SELECT doc_id + 1 AS row_id, 'D' || doc_id AS sku FROM documents
WHERE regexp_matches(text, 'licen[cs]e', 'i')""",
        "keyword_prefilter": f"""WITH {LISTINGS}, {LEADS}, {features('lf', 'listings', 'title')},
{features('qf', 'leads', 'title')}
SELECT q.query_id, l.row_id FROM qf q, lf l WHERE {shared('q.k', 'l.k')} > 0""",
        "keyword_prefilter_documents": f"""WITH {features('d', 'documents', 'text')}, {features('b', 'benchmark', 'text')},
dk AS (SELECT doc_id, unnest(k) AS word FROM d), bk AS (SELECT item_id, unnest(k) AS word FROM b)
SELECT DISTINCT item_id AS query_id, doc_id + 1 AS row_id FROM dk JOIN bk USING (word)""",
        "strict_model_match": f"""WITH {LISTINGS}, {LEADS}, {features('lf', 'listings', 'title')},
{features('qf', 'leads', 'title')}
SELECT l.row_id, l.title, q.title AS other FROM lf l JOIN qf q USING (brand, source_file)
WHERE NOT {mismatch('l', 'q')}""",
        "strict_model_match_documents": f"""WITH {features('f', 'documents', 'text')}
SELECT a.doc_id, {mismatch('a', 'b')} AS mismatch FROM f a JOIN f b ON b.doc_id = a.doc_id + 1""",
        "semantic_text_sim": f"""WITH {VEC} SELECT 1 AS query_id, t.vec_id AS text_vec_id,
  {six(cosine('t.v', 'r.v'))} AS text_similarity FROM vec t, vec r
WHERE r.vec_id = {views.FLAGSHIP_TITLE_VECTOR}""",
        "text_threshold": f"""WITH {VEC}, s AS (SELECT 1 AS query_id, t.vec_id AS text_vec_id,
  {six(cosine('t.v', 'r.v'))} AS text_similarity, CASE WHEN t.vec_id > 100 THEN 0.1 ELSE 0.0 END AS min_text_sim
  FROM vec t, vec r WHERE r.vec_id = {views.FLAGSHIP_TITLE_VECTOR})
SELECT query_id, text_vec_id, text_similarity, CAST(min_text_sim AS DOUBLE) AS min_text_sim FROM s
WHERE text_similarity >= CASE WHEN min_text_sim > 0 THEN min_text_sim ELSE 0.70 END""",
        "visual_threshold": f"""WITH {FLAGSHIP_SCORES} SELECT query_id, sku_key, {six('score')} AS visual_score
FROM all_hits WHERE hit <= 2000 AND score >= 0.2""",
        # strings and sets
        "clean_title": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
        "title_keywords": f"""WITH c AS (SELECT doc_id, {clean('text')} AS c FROM documents)
SELECT doc_id, {as_set(keywords('c'))} AS keywords FROM c""",
        "title_overlap": f"WITH {DOC_PAIRS} SELECT doc_id, {overlap('ak', 'bk')} AS overlap FROM pairs",
        "title_overlap_listings": f"WITH {LISTING_PAIRS} SELECT row_id, {overlap('ak', 'bk')} AS overlap FROM pairs",
        "model_codes": f"""WITH c AS (SELECT page_id, {clean('html')} AS c FROM pages)
SELECT page_id, {as_set(models('c'))} AS models FROM c""",
        "model_conflict": f"WITH {DOC_PAIRS} SELECT doc_id, {model_conflict('am', 'bm')} AS conflict FROM pairs",
        "number_conflict": f"""WITH {DOC_PAIRS} SELECT doc_id,
  {as_set(f"list_filter(an, lambda x: NOT list_contains({_list(SPEC_NUMBERS)}, x))")} AS numbers,
  {number_conflict('an', 'bn')} AS conflict FROM pairs""",
        "modifier_conflict": f"""WITH {LISTING_PAIRS} SELECT row_id,
  {as_set(f"list_filter({_list(MODIFIERS)}, lambda m: list_contains(aw, m))")} AS modifiers,
  {modifier_conflict('aw', 'bw')} AS conflict FROM pairs""",
        "query_image_list": f"""WITH p AS (
  SELECT doc_id, list_filter(list_transform(string_split(replace(text, ' ', ' ; '), ';'), lambda u: {strip('u')}),
    lambda u: u <> '') AS images FROM documents)
SELECT doc_id, CAST(unnest(range(len(images))) AS INTEGER) AS position, unnest(images) AS image FROM p""",
        "file_stem": f"SELECT page_id, {stem('url')} AS stem FROM pages",
        "sku_key": f"WITH {LISTINGS} SELECT row_id, upper(title) AS sku_key FROM listings",
        "image_url_list": f"""WITH {ATTRIBUTES} SELECT row_id, CAST(len({url_parts('urls')}) AS INTEGER) AS image_count,
  array_to_string(({url_parts('urls')})[1:6], '|') AS thumbnails FROM attributes""",
        "price_label": f"""SELECT o_orderkey, {label("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END")} AS price_label
FROM orders""",
        "match_count_label": f"""WITH {ATTRIBUTES} SELECT row_id,
  CASE WHEN stock > 0 THEN CAST(CAST(trunc(match_count) AS BIGINT) AS VARCHAR) ELSE '1' END || ' SKU' AS match_badge
FROM attributes""",
        # vectors and images
        "visual_search": f"""WITH {FLAGSHIP_SCORES} SELECT query_id, image_id, sku_key, {six('score')} AS score, hit
FROM all_hits WHERE hit <= 2000""",
        "visual_search_small_cut": f"""WITH {FLAGSHIP_SCORES} SELECT query_id, image_id, sku_key,
  {six('score')} AS score, hit FROM all_hits WHERE hit <= 50""",
        "visual_search_batch": f"""WITH {BATCH_SCORES} SELECT query_id, image_id, {six('score')} AS score, hit
FROM all_hits WHERE hit <= 100""",
        "visual_scores": f"""WITH {FLAGSHIP_SCORES} SELECT query_id, brand AS sku_key,
  {six('min(score)')} AS visual_score, min(hit) AS hit
FROM all_hits JOIN listings ON row_id = image_id WHERE hit <= 2000 GROUP BY query_id, brand""",
        "embed_batches": """SELECT doc_id, array_to_string(list_transform(range(26), lambda i:
  length(text) - length(replace(text, chr(CAST(97 + i AS INTEGER)), ''))), ',') AS letters,
  NULL::VARCHAR AS embed_error FROM documents""",
        "orientation_corr": f"""WITH {VEC}, o AS ({_orientations()}),
centred AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS d FROM vec)
SELECT a.vec_id AS id_a, b.vec_id AS id_b, orientation,
  {six(dot('a.d', 'list_transform(o, lambda i: b.d[i])') + ' / sqrt(' + dot('a.d', 'a.d') + ' * ' + dot('b.d', 'b.d') + ')')} AS correlation
FROM centred a JOIN centred b ON b.vec_id = a.vec_id + 1, o""",
        # joins
        "has_visual_score": f"""WITH {FLAGSHIP_SCORES} SELECT row_id, sku FROM listings
WHERE upper(sku) IN (SELECT sku_key FROM all_hits WHERE hit <= 50)""",
        "attach_visual_score": f"""WITH {FLAGSHIP_SCORES}, {ATTRIBUTES}
SELECT query_id, row_id, sku, {six('score')} AS visual_score
FROM attributes JOIN all_hits ON upper(sku) = sku_key WHERE hit <= 2000""",
        "enrich_attributes": f"""WITH {LISTINGS}, {ATTRIBUTES}, {LAST_ATTRIBUTES}
SELECT l.row_id, l.sku, a.zsku AS "Best_ZSKU", a.brand AS "Best_Brand", a.color AS "Best_Color",
  a.stock AS "Best_Stock", a.match_count AS "Match_Count"
FROM listings l LEFT JOIN looked_up a ON a.key = upper(l.sku)""",
        "resolve_reference_title": f"WITH {BATCH_SCORES} SELECT query_id, reference_title, reference_row FROM refs",
        # aggregates
        "price_bounds": f"""WITH {BATCH} SELECT q.query_id, coalesce(CAST(trunc(min(r.price)) AS BIGINT), 0) AS min_price,
  coalesce(CAST(trunc(max(r.price)) AS BIGINT), 999) AS max_price
FROM queries q LEFT JOIN result r ON r.query_id = q.query_id GROUP BY q.query_id""",
        "result_summary": f"""WITH {BATCH} SELECT q.query_id, count(r.query_id) AS total_matches,
  CASE WHEN max(ai_score) > 0 THEN printf('%.3f', max(ai_score)) ELSE 'N/A' END AS best_visual,
  CASE WHEN max(text_similarity) > 0 THEN printf('%.3f', max(text_similarity)) ELSE 'N/A' END AS best_text
FROM queries q LEFT JOIN result r ON r.query_id = q.query_id GROUP BY q.query_id""",
        "sku_profile": """SELECT count(*) AS total_rows,
  count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey END) AS unique_skus,
  count(*) - count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey END) AS duplicate_skus FROM lineitem""",
        "last_row_per_sku": f"""WITH {ATTRIBUTES} SELECT sku, row_id, brand AS "Best_Brand", match_count AS "Match_Count"
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY row_id DESC) AS back FROM attributes) WHERE back = 1""",
        "filter_counts": f"""WITH {SCOPE}, {features('wanted', f"(SELECT '{views.FLAGSHIP_TITLE}' AS t)", 't')}
SELECT count(*) AS original, count(*) FILTER (WHERE price >= 905) AS min_price,
  count(*) FILTER (WHERE price BETWEEN 905 AND 960) AS max_price,
  count(*) FILTER (WHERE price BETWEEN 905 AND 960 AND {shared('lf.k', 'wanted.k')} > 0) AS keyword
FROM lf, wanted""",
        # ranking and report
        "rank_matches": f"""WITH {ATTRIBUTES}, s AS (
  SELECT coalesce(CAST(CAST('0x' || substr(md5(brand), 1, 6) AS INTEGER) AS BIGINT), -1) AS query_id,
    CAST(stock AS DOUBLE) AS visual_score, round(match_count / 100000) AS text_similarity, row_id
  FROM attributes),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY visual_score DESC, text_similarity DESC, row_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 300""",
        "facet_price": f"WITH {CARDS} SELECT * FROM cards WHERE coalesce(shown_price, 0) BETWEEN 0 AND 100000",
        "facet_price_open_end": f"WITH {CARDS} SELECT * FROM cards WHERE coalesce(shown_price, 0) >= 50000",
        "sort_by_rank": page("rank"),
        "sort_price_desc": page("CASE WHEN shown_price > 0 THEN 0 ELSE 1 END, CASE WHEN shown_price > 0 THEN shown_price END DESC, rank"),
        "sort_price_asc": page("CASE WHEN shown_price IS NULL THEN 1 ELSE 0 END, shown_price, rank"),
        "match_record": f"""WITH {LISTINGS} SELECT 1 AS query_id,
  CASE WHEN source_file = 'PROMO' THEN 'Unknown' ELSE source_file END AS source_file, row_id, sku, title, price,
  CAST(0.5 AS DOUBLE) AS ai_score, CAST(0.25 AS DOUBLE) AS text_similarity, sku || '.jpg' AS image_filename,
  CAST(row_id AS INTEGER) AS rank FROM listings""",
        "card_fields": f"""WITH {ATTRIBUTES}, rows AS (SELECT *, match_count AS price FROM attributes)
SELECT row_id, sku, {card("''")} FROM rows""",
        "selection_export": f"""WITH {BATCH}, {ATTRIBUTES}, {LAST_ATTRIBUTES},
chosen AS (SELECT r.query_id, r.rank, r.sku, coalesce(a.zsku, r.sku) AS zsku
  FROM result r LEFT JOIN looked_up a ON a.key = upper(r.sku) WHERE {shown('r.price')} < 950),
s AS (SELECT query_id, sku, min(rank) AS first_rank FROM chosen GROUP BY ALL),
z AS (SELECT query_id, zsku, min(rank) AS first_rank FROM chosen GROUP BY ALL)
SELECT s.query_id, string_agg(s.sku, chr(10) ORDER BY s.first_rank) AS sku_text, count(*) AS sku_count,
  any_value(zt.zsku_text) AS zsku_text
FROM s JOIN (SELECT query_id, string_agg(zsku, chr(10) ORDER BY first_rank) AS zsku_text FROM z GROUP BY query_id) zt
  USING (query_id) GROUP BY s.query_id""",
        # whole searches
        "find_duplicates": f"WITH {flagship(2000)} {PUBLISHED}",
        "find_duplicates_small_cut": f"WITH {flagship(50)} {PUBLISHED}",
        "find_duplicates_strict": f"WITH {flagship(2000, strict=True)} {PUBLISHED}",
        "find_duplicates_batch": f"WITH {BATCH} {PUBLISHED}",
        "report_view": f"""WITH {flagship(2000)}, {ATTRIBUTES}, {LAST_ATTRIBUTES}, {MANIFEST},
joined AS (
  SELECT r.row_id, r.sku, r.price, r.rank, a.* EXCLUDE (key), {shown('r.price')} AS shown_price,
    {IMAGE_PATH.replace('sku ||', 'r.sku ||')} AS image_path
  FROM result r LEFT JOIN looked_up a ON a.key = upper(r.sku)),
kept AS (SELECT *, row_number() OVER (ORDER BY shown_price DESC NULLS LAST, rank) AS position
  FROM joined WHERE coalesce(shown_price, 0) BETWEEN 901 AND 955)
SELECT row_id, sku, rank, position, image_path, {card('image_path')} FROM kept""",
    }
)


NODES = f"""{LISTINGS}, {features('lf', 'listings', 'title')},
facts AS (
  SELECT row_id, list_sort(k) AS k, list_sort(m) AS m,
    list_sort(list_filter(n, lambda x: NOT list_contains({_list(SPEC_NUMBERS)}, x))) AS n,
    list_sort(list_filter({_list(MODIFIERS)}, lambda x: list_contains(w, x))) AS w
  FROM lf WHERE len(k) > 0),
nodes AS (SELECT k, m, n, w, min(row_id) AS node FROM facts GROUP BY ALL),
near AS MATERIALIZED (
  SELECT a AS p, b AS q FROM nodes a JOIN nodes b ON a.node < b.node
  WHERE {shared('a.k', 'b.k')} / CAST(least(len(a.k), len(b.k)) AS DOUBLE) >= 0.8),
pairs AS MATERIALIZED (SELECT p.node AS a, q.node AS b FROM near WHERE NOT {mismatch('p', 'q')}),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT node, node AS met FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.met),
roots AS (SELECT node, min(met) AS group_id FROM reach GROUP BY node),
members AS (SELECT row_id, group_id FROM facts JOIN nodes USING (k, m, n, w) JOIN roots USING (node))"""


def classes(name: str, source: str, row: str) -> str:
    return f"{name} AS (SELECT list_sort(k) AS k, min({row}) AS class_id FROM {source} WHERE len(k) > 0 GROUP BY 1)"


def overlapping(pairs: str) -> str:
    return f"""SELECT a.class_id AS left_id, b.class_id AS right_id, CAST({shared('a.k', 'b.k')} AS INTEGER) AS shared,
  {overlap('a.k', 'b.k')} AS overlap FROM {pairs}
  {shared('a.k', 'b.k')} / CAST(least(len(a.k), len(b.k)) AS DOUBLE) >= 0.8"""


def letters(title: str) -> str:
    return f"list_transform(range(97, 123), lambda i: CAST(length({title}) - length(replace({title}, chr(CAST(i AS INTEGER)), '')) AS DOUBLE))"


def raw_titles() -> str:
    """The flagship search with letter counts of the titles themselves as their vectors."""
    sql = flagship(2000)
    a, b = sql.index("sims AS ("), sql.index("matches AS (")
    sims = f"""lettered AS (SELECT row_id, {letters('title')} AS v FROM listings),
sims AS (SELECT row_id, {cosine('t.v', 'r.v')} AS sim FROM lettered t, (SELECT {letters("t")} AS v FROM wanted) r),
"""
    return (sql[:a] + sims + sql[b:]).replace("JOIN sims s USING (text_vec_id)", "JOIN sims s USING (row_id)").replace("s.sim >= 0.05", "s.sim >= 0.9")


ORACLES.update(
    {
        # whole catalogs
        "find_duplicates_raw_titles": f"WITH {raw_titles()} {PUBLISHED}",
        "visual_search_pruned": ORACLES["visual_search"],
        "visual_search_pruned_small_cut": ORACLES["visual_search_small_cut"],
        "visual_search_pruned_batch": ORACLES["visual_search_batch"],
        "apply_index_delta": f"""WITH {MANIFEST} SELECT 'images/' || file_name AS path,
  CAST(regexp_extract(file_name, '[0-9]+') AS BIGINT) + 1 AS image_id, CAST(length AS BIGINT) AS length,
  CAST(mtime AS BIGINT) AS mtime FROM manifest""",
        "visual_search_after_delta": f"""WITH {FLAGSHIP_SCORES}
SELECT query_id, image_id, sku_key, {six('score')} AS score, row_number() OVER (ORDER BY h.score DESC, image_id) AS hit
FROM all_hits h JOIN listings l ON l.row_id = h.image_id WHERE l.source_file <> 'PROMO'
QUALIFY row_number() OVER (ORDER BY h.score DESC, image_id) <= 50""",
        "overlap_join": f"""WITH {LISTINGS}, {features('lf', 'listings', 'title')}, {classes('c', 'lf', 'row_id')}
{overlapping('c a JOIN c b ON a.class_id < b.class_id WHERE')}""",
        "overlap_classes": f"""WITH docs AS (SELECT doc_id, {keywords('c')} AS k FROM (SELECT doc_id, {clean('text')} AS c FROM documents)),
{classes('c', 'docs', 'doc_id + 1')}
SELECT doc_id + 1 AS row_id, class_id FROM docs d JOIN c ON list_sort(d.k) = c.k""",
        "overlap_join_benchmark": f"""WITH docs AS (SELECT doc_id, {keywords('c')} AS k FROM (SELECT doc_id, {clean('text')} AS c FROM documents)),
items AS (SELECT item_id, {keywords('c')} AS k FROM (SELECT item_id, {clean('text')} AS c FROM benchmark)),
{classes('c', 'items', 'item_id')}, {classes('d', 'docs', 'doc_id + 1')}
{overlapping('c a, d b WHERE')}""",
        "duplicate_groups": f"WITH RECURSIVE {NODES} SELECT row_id, group_id FROM members",
        "duplicate_group_report": f"""WITH RECURSIVE {NODES},
placed AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY price, row_id) AS place FROM listings JOIN members USING (row_id))
SELECT group_id, count(*) AS listings, min(price) AS least_price, max(price) AS most_price, count(DISTINCT source_file) AS sources,
  min(row_id) FILTER (place = 1) AS representative, min(sku) FILTER (place = 1) AS sku, min(title) FILTER (place = 1) AS title
FROM placed GROUP BY group_id""",
        "keyword_pairs": ORACLES["keyword_prefilter_documents"],
        "filtered_scores": ORACLES["attach_visual_score"],
        "turned_copies": f"""WITH {VEC}, o AS ({_orientations()}),
turned AS (
  SELECT vec_id, v, CASE label % 3 WHEN 0 THEN list_reverse(v)
    WHEN 1 THEN list_transform(range(64), lambda i: v[(i // 8) * 8 + 8 - i % 8]) ELSE v END AS t
  FROM vec JOIN embeddings USING (vec_id)),
images AS (
  SELECT vec_id AS id, v FROM vec
  UNION ALL SELECT vec_id + 1000000, list_transform(range(1, 65), lambda i: t[i] + v[i] / 50) FROM turned),
centred AS (SELECT id, list_transform(v, lambda x: x - list_avg(v)) AS d FROM images),
scaled AS (SELECT id, list_transform(d, lambda x: x / sqrt({dot('d', 'd')})) AS d FROM centred),
views AS (SELECT id, orientation, list_transform(o, lambda i: d[i]) AS d FROM scaled, o)
SELECT a.id AS id_a, b.id AS id_b, arg_max(orientation, {dot('a.d', 'b.d')}) AS orientation, {six('max(' + dot('a.d', 'b.d') + ')')} AS correlation
FROM scaled a JOIN views b ON a.id < b.id WHERE {dot('a.d', 'b.d')} >= 0.95 GROUP BY a.id, b.id""",
        "price_range_batch": f"""WITH {LISTINGS}, {LEADS},
asked AS (SELECT query_id, CASE WHEN source_file <> 'PROMO' THEN CAST(query_id AS DOUBLE) / 10 + CAST(899.9 AS DOUBLE) - CAST(1.25 AS DOUBLE) END AS low,
  CASE WHEN source_file <> 'LARGE' THEN CAST(query_id AS DOUBLE) / 10 + CAST(899.9 AS DOUBLE) + CAST(3 AS DOUBLE) END AS high FROM leads)
SELECT query_id, row_id FROM listings, asked WHERE (low IS NULL OR price >= low) AND (high IS NULL OR price <= high)""",
        "fetch_schedule": """WITH hosts AS (
  SELECT 'P' || page_id AS sku, coalesce(lower(regexp_extract(url, '^[^/?#]*://([^/?#]*)', 1)), '') AS host FROM pages),
rounds AS (SELECT sku, host, (row_number() OVER (PARTITION BY host ORDER BY sku) - 1) // 4 AS round FROM hosts),
places AS (SELECT sku, host, round, row_number() OVER (PARTITION BY round ORDER BY host, sku) - 1 AS place FROM rounds)
SELECT sku, host, round, place // 30 AS slot, CAST(place % 30 AS INTEGER) AS worker FROM places""",
        "prepared_fetches": f"""WITH {LISTINGS}, {MANIFEST}, {features('lf', '(SELECT * FROM listings WHERE price >= 901)', 'title')},
{features('wanted', "(SELECT title AS t FROM listings WHERE sku = 'Z7' AND price >= 901)", 't')},
hits AS (SELECT row_id FROM lf, wanted WHERE {shared('lf.k', 'wanted.k')} > 0),
bad AS (SELECT file_name FROM manifest JOIN listings ON regexp_extract(file_name, '^[^.]*') = sku WHERE length = 0 OR brand = 'Brand#7'),
plan AS (SELECT sku, 'images/' || sku || '.jpg' AS dest, sku || '.jpg' IN (SELECT file_name FROM bad) AS damaged FROM listings
  WHERE price >= 901 AND (row_id IN (SELECT row_id FROM hits) OR NOT EXISTS (SELECT 1 FROM hits))
    AND image_url IS NOT NULL AND trim(image_url) NOT IN ('', 'nan')
    AND sku || '.jpg' NOT IN (SELECT file_name FROM manifest WHERE file_name NOT IN (SELECT file_name FROM bad))),
rounds AS (SELECT *, (row_number() OVER (ORDER BY sku) - 1) // 4 AS round FROM plan),
places AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY sku) - 1 AS place FROM rounds)
SELECT sku, dest, CASE WHEN damaged THEN 'damaged' ELSE 'absent' END AS reason, round, place // 30 AS slot,
  CAST(place % 30 AS INTEGER) AS worker FROM places""",
        "refreshed_index": f"""WITH {MANIFEST} SELECT count(*) AS files, count(DISTINCT file_name) AS paths,
  CAST(1 AS INTEGER) AS version_1, CAST(2 AS INTEGER) AS version_2, CAST(2 AS INTEGER) AS version_3 FROM manifest""",
        "sku_profile_sketch": """SELECT count(*) AS total_rows, min(o_totalprice) AS least_price, max(o_totalprice) AS most_price,
  TRUE AS distinct_close, TRUE AS median_close FROM orders""",
        "encode_titles_once": f"""WITH {LISTINGS} SELECT title, 1 AS times_encoded,
  array_to_string(list_transform(range(97, 123), lambda i: length(title) - length(replace(title, chr(CAST(i AS INTEGER)), ''))), ',') AS letters
FROM (SELECT DISTINCT title FROM listings)""",
    }
)


def _typed(sql: str, **types: str) -> str:
    """Give integer columns the width Spark gives them."""
    casts = ", ".join(f"CAST({column} AS {kind}) AS {column}" for column, kind in types.items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


for _name, _types in {
    "write_matches": {"rank": "INTEGER"},
    "read_matches": {"query_id": "BIGINT", "rank": "INTEGER"},
    "image_validity": {"length": "BIGINT"},
    "semantic_text_sim": {"query_id": "BIGINT"},
    "text_threshold": {"query_id": "BIGINT"},
    "visual_threshold": {"query_id": "BIGINT"},
    "visual_search": {"query_id": "BIGINT", "hit": "INTEGER"},
    "visual_search_small_cut": {"query_id": "BIGINT", "hit": "INTEGER"},
    "visual_search_batch": {"hit": "INTEGER"},
    "visual_search_pruned": {"query_id": "BIGINT", "hit": "INTEGER"},
    "visual_search_pruned_small_cut": {"query_id": "BIGINT", "hit": "INTEGER"},
    "visual_search_pruned_batch": {"hit": "INTEGER"},
    "visual_search_after_delta": {"query_id": "BIGINT", "hit": "INTEGER"},
    "encode_titles_once": {"times_encoded": "BIGINT"},
    "visual_scores": {"query_id": "BIGINT", "hit": "INTEGER"},
    "attach_visual_score": {"query_id": "BIGINT"},
    "rank_matches": {"rank": "INTEGER"},
    "sort_by_rank": {"position": "INTEGER"},
    "sort_price_desc": {"position": "INTEGER"},
    "sort_price_asc": {"position": "INTEGER"},
    "match_record": {"query_id": "BIGINT"},
    "find_duplicates": {"query_id": "BIGINT", "rank": "INTEGER"},
    "find_duplicates_raw_titles": {"query_id": "BIGINT", "rank": "INTEGER"},
    "find_duplicates_small_cut": {"query_id": "BIGINT", "rank": "INTEGER"},
    "find_duplicates_strict": {"query_id": "BIGINT", "rank": "INTEGER"},
    "find_duplicates_batch": {"rank": "INTEGER"},
    "report_view": {"rank": "INTEGER", "position": "INTEGER"},
}.items():
    ORACLES[_name] = _typed(ORACLES[_name], **_types)
