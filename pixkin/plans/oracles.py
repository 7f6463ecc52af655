"""DuckDB SQL for the queries of the image engine that SQL can express: written for that engine, from the semantics, not from plans."""

from __future__ import annotations

import numpy as np

from pixkin.config import MODES, WEIGHTS, Settings

S = MODES["sensitive"]


def numbers(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in np.asarray(values).ravel()) + "]"


# Where each of nine columns lies among eight, and the lowest eight cosines of 32 values that are interpolated from eight.
_at = np.clip((np.arange(9) + 0.5) * (8 / 9) - 0.5, 0, 7)
_low = np.floor(_at).astype(int)
_at32 = np.clip((np.arange(32) + 0.5) * (8 / 32) - 0.5, 0, 7)
_spread = np.zeros((32, 8))
for _i, _x in enumerate(_at32):
    _spread[_i, int(_x)] += 1 - (_x - int(_x))
    _spread[_i, min(7, int(_x) + 1)] += _x - int(_x)
_k, _n = np.arange(8)[:, None], np.arange(32)[None]
COSINES = (np.sqrt(np.where(_k == 0, 1 / 32, 2 / 32)) * np.cos((2 * _n + 1) * _k * np.pi / 64)) @ _spread
_left, _right = ("[" + ", ".join(str(x) for x in v) + "]" for v in (_low + 1, np.minimum(7, _low + 1) + 1))


def turned_list(g: str, t: int) -> str:
    place = {0: "i + 1", 90: "(7 - i % 8) * 8 + i // 8 + 1", 180: "64 - i", 270: "i % 8 * 8 + 8 - i // 8"}[t]
    return f"list_transform(range(0, 64), lambda i: {g}[{place}])"


def hash_bits(t: int) -> str:
    """Bit strings of the three hashes of g{t}: average, difference, perceptual (c{t}: its coefficients)."""
    nine = lambda c: f"(g{t}[i // 8 * 8 + {_left}[{c}]] + (g{t}[i // 8 * 8 + {_right}[{c}]] - g{t}[i // 8 * 8 + {_left}[{c}]]) * {numbers(_at - _low)}[{c}])"
    return f"""  array_to_string(list_transform(g{t}, lambda x: CASE WHEN x >= mean THEN '1' ELSE '0' END), '')::BIT AS a{t},
  array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN {nine('i % 8 + 1')} > {nine('i % 8 + 2')} THEN '1' ELSE '0' END), '')::BIT AS d{t},
  array_to_string(list_transform(c{t}, lambda x: CASE WHEN x > list_sort(c{t}[2:])[32] THEN '1' ELSE '0' END), '')::BIT AS p{t}"""


def coefficients(t: int) -> str:
    across = f"list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 8), lambda k: g{t}[i // 8 * 8 + k + 1] * m[i % 8 * 8 + k + 1])))"
    return f"{across} AS r{t}"


def coefficients_down(t: int) -> str:
    down = f"list_sum(list_transform(range(0, 8), lambda k: r{t}[k * 8 + i % 8 + 1] * m[i // 8 * 8 + k + 1]))"
    return f"list_transform(list_transform(range(0, 64), lambda i: {down}), lambda x: CASE WHEN abs(x) < 1e-9 THEN 0 ELSE x END) AS c{t}"


#: Vectors as 8 x 8 pictures: bit strings of three hashes and four turns, aspect, brightness, grey values.
PICTURES = f"""
b AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, {numbers(COSINES)} AS m FROM embeddings WHERE len(embedding) = 64),
b0 AS (SELECT *, list_transform(v, lambda x: floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (x + 1) * 127.5::DOUBLE)))) AS gray FROM b),
g AS (SELECT *, list_sum(gray) / 64 AS mean, {", ".join(f"{turned_list('gray', t)} AS g{t}" for t in (0, 90, 180, 270))} FROM b0),
g1 AS (SELECT *, {", ".join(map(coefficients, (0, 90, 180, 270)))} FROM g),
g2 AS (SELECT *, {", ".join(map(coefficients_down, (0, 90, 180, 270)))} FROM g1),
pic AS (SELECT vec_id, v, gray,
""" + ",\n".join(map(hash_bits, (0, 90, 180, 270))) + """,
  vec_id % 5 * 0.1::DOUBLE + 1.0::DOUBLE AS aspect, mean / 255 AS luminance, (vec_id % 7 * 100 + 1000) * 800.0::DOUBLE AS pixels FROM g2)"""


def candidates(s: Settings) -> str:
    turns = "\nUNION ALL\n".join(
        f"""SELECT x.vec_id AS source, y.vec_id AS target, {t} AS turn, bit_count(xor(x.a0, y.a{t})) AS a, bit_count(xor(x.d0, y.d{t})) AS d, bit_count(xor(x.p0, y.p{t})) AS p,
  abs(x.aspect - {y}) / greatest(x.aspect, {y}) AS aspect, abs(x.luminance - y.luminance) AS lum FROM pic x JOIN pic y ON x.vec_id < y.vec_id"""
        for t, y in ((0, "y.aspect"), (90, "(1 / y.aspect)"), (180, "y.aspect"), (270, "(1 / y.aspect)"))
    )
    return PICTURES + f""",
turns AS ({turns}),
aligned AS (SELECT *, p * 0.5::DOUBLE + d * 0.3::DOUBLE + a * 0.2::DOUBLE + aspect * 20 AS r FROM turns
  QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY p * 0.5::DOUBLE + d * 0.3::DOUBLE + a * 0.2::DOUBLE + aspect * 20, turn) = 1),
cand AS (SELECT *, r + lum * 10 AS rank FROM aligned
  WHERE (aspect <= 0.38 OR least(a, d, p) <= 4) AND (lum <= 0.35 OR least(a, d, p) <= 4)
    AND (least(a, d, p) <= 4 OR (a <= {s.a + 3})::INT + (d <= {s.d + 3})::INT + (p <= {s.p + 3})::INT >= 2))"""


def topk(s: Settings) -> str:
    return candidates(s) + f""",
ends AS (SELECT *, unnest([source, target]) AS e FROM cand),
best AS (SELECT DISTINCT source, target, turn, a, d, p, aspect, lum, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY e ORDER BY rank, source DESC, target DESC) AS place FROM ends) WHERE place <= {s.top_k})"""


CANDIDATES, TOPK = candidates(S), topk(S)

PAIR_COLUMNS = "source, target, turn, CAST(a AS INT) AS a, CAST(d AS INT) AS d, CAST(p AS INT) AS p, round(aspect, 6) AS aspect, round(rank, 6) AS rank"

_value = " + ".join(f"({e}) * {WEIGHTS[n]}::DOUBLE" for n, e in (
    ("p", "1 - p / 64.0::DOUBLE"), ("d", "1 - d / 64.0::DOUBLE"), ("a", "1 - a / 64.0::DOUBLE"), ("ssim", "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ssim))"), ("histogram", "histogram"),
    ("aspect", "exp(-4 * aspect)"), ("resolution", "resolution"),
))
_weight = " + ".join(f"{WEIGHTS[n]}::DOUBLE" for n in ("p", "d", "a", "ssim", "histogram", "aspect", "resolution"))


def scored(S: Settings) -> str:
    return topk(S) + f""",
gs AS (SELECT b.*, x.gray AS gx, CASE b.turn WHEN 0 THEN y.gray WHEN 90 THEN {turned_list("y.gray", 90)} WHEN 180 THEN {turned_list("y.gray", 180)} ELSE {turned_list("y.gray", 270)} END AS gy,
  list_transform(x.v, lambda z: abs(z)) AS hx, list_transform(y.v, lambda z: abs(z)) AS hy, least(x.pixels, y.pixels) / greatest(1.0::DOUBLE, x.pixels, y.pixels) AS resolution
  FROM best b JOIN pic x ON b.source = x.vec_id JOIN pic y ON b.target = y.vec_id),
ms AS (SELECT *, list_reduce(gx, lambda s, v: s + v, 0.0::DOUBLE) / 64 AS mx, list_reduce(gy, lambda s, v: s + v, 0.0::DOUBLE) / 64 AS my,
  list_reduce(hx, lambda s, v: s + v, 0.0::DOUBLE) AS sx, list_reduce(hy, lambda s, v: s + v, 0.0::DOUBLE) AS sy FROM gs),
vs AS (SELECT *, list_reduce(list_transform(gx, lambda v: (v - mx) * (v - mx)), lambda s, v: s + v, 0.0::DOUBLE) / 63 AS vx, list_reduce(list_transform(gy, lambda v: (v - my) * (v - my)), lambda s, v: s + v, 0.0::DOUBLE) / 63 AS vy,
  list_reduce(list_transform(range(1, 65), lambda i: (gx[i] - mx) * (gy[i] - my)), lambda s, v: s + v, 0.0::DOUBLE) / 63 AS cov,
  list_reduce(list_transform(range(1, 65), lambda i: sqrt(hx[i] / sx * (hy[i] / sy))), lambda s, v: s + v, 0.0::DOUBLE) AS root FROM ms),
met AS (SELECT source, target, turn, a, d, p, aspect, resolution, least(1.0::DOUBLE, root) AS histogram,
  CASE WHEN gx = gy THEN 1.0::DOUBLE ELSE (2 * mx * my + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE) / ((mx * mx + my * my + 6.5025::DOUBLE) * (vx + vy + 58.5225::DOUBLE)) END AS ssim FROM vs),
sc AS (SELECT *, floor(({_value}) / ({_weight}) * 100 + 0.5::DOUBLE) AS plain FROM met),
sd AS (SELECT *, CAST(CASE WHEN aspect > {S.aspect} THEN floor(plain * greatest(0.72::DOUBLE, 1 - (aspect - {S.aspect}::DOUBLE) * 0.55::DOUBLE) + 0.5::DOUBLE) ELSE plain END AS INT) AS score,
  (p <= {S.p})::INT + (d <= {S.d})::INT + (a <= {S.a})::INT AS hashes FROM sc),
se AS (SELECT *, (hashes > 0)::INT + (ssim >= {S.ssim})::INT + (histogram >= {S.histogram})::INT AS fam FROM sd),
sf AS (SELECT *, CASE WHEN score >= {S.certain} AND fam >= 3 AND (hashes > 0 OR ssim >= {S.ssim}) THEN 'almost-certain-duplicate' WHEN score >= {S.probable} AND fam >= 2 THEN 'probable-duplicate'
  WHEN score >= {S.review} AND ssim >= {S.review_ssim} AND (hashes >= 2 OR histogram >= {S.histogram}) THEN 'needs-review' ELSE 'probably-different' END AS category FROM se),
sg AS (SELECT *, CASE WHEN category = 'almost-certain-duplicate' AND fam >= 3 THEN 'very-high' WHEN category IN ('almost-certain-duplicate', 'probable-duplicate') AND fam >= 2 THEN 'high'
  WHEN category = 'needs-review' THEN 'medium' ELSE 'low' END AS confidence, category = 'almost-certain-duplicate' OR (category = 'probable-duplicate' AND score >= 84) AS strong FROM sf)"""


def reasons(s: Settings) -> str:
    two = lambda x: f"replace(printf('%.2f', {x}), '.', ',')"
    number = lambda x: f"{x:.2f}".replace(".", ",")
    return f"""concat_ws(' | ',
  'pHash-Abstand ' || p || '/64 ' || CASE WHEN p <= {s.p} THEN 'liegt im Grenzwert (≤ {s.p})' ELSE 'überschreitet den Grenzwert ({s.p})' END || '.',
  CASE WHEN hashes >= 2 THEN hashes || ' unabhängige Bild-Hashes stimmen ausreichend überein.' END,
  'SSIM ' || {two('ssim')} || ' ' || CASE WHEN ssim >= {s.ssim} THEN 'bestätigt eine ähnliche Bildstruktur' ELSE 'liefert keine starke Strukturbestätigung' END || ' (Grenzwert {number(s.ssim)}).',
  'Histogramm-Ähnlichkeit ' || {two('histogram')} || ' ' || CASE WHEN histogram >= {s.histogram} THEN 'stützt den Treffer' ELSE 'liegt unter dem Modus-Grenzwert' END || ' (Grenzwert {number(s.histogram)}).',
  CASE WHEN aspect > {s.aspect} THEN 'Die Seitenverhältnisse unterscheiden sich deutlich; der Gesamtwert wurde reduziert.' ELSE 'Die Seitenverhältnisse sind mit dem gewählten Modus vereinbar.' END,
  '{s.label}-Modus: technische Einstufung ab {s.review}/{s.probable}/{s.certain} Punkten.')"""


ASSESSED = "source, target, round(ssim, 6) AS ssim, round(histogram, 6) AS histogram, round(resolution, 6) AS resolution, score, category, confidence, strong"

#: Pairs where every third record has no turned hashes.
LEGACY = f"""{PICTURES},
lp AS (SELECT * REPLACE (CASE WHEN vec_id % 2 = 0 THEN 1.5::DOUBLE ELSE 0.65::DOUBLE END AS aspect), vec_id % 3 <> 0 AS whole FROM pic),
turns AS ({" UNION ALL ".join(
    f"SELECT x.vec_id AS source, y.vec_id AS target, {t} AS turn, bit_count(xor(x.a0, y.a{t})) AS a, bit_count(xor(x.d0, y.d{t})) AS d, bit_count(xor(x.p0, y.p{t})) AS p, "
    f"abs(x.aspect - {y}) / greatest(x.aspect, {y}) AS aspect, abs(x.luminance - y.luminance) AS lum, x.aspect AS ax, y.aspect AS ay, y.whole FROM lp x JOIN lp y ON x.vec_id < y.vec_id" + (" WHERE y.whole" if t else "")
    for t, y in ((0, "y.aspect"), (90, "(1 / y.aspect)"), (180, "y.aspect"), (270, "(1 / y.aspect)")))}),
aligned AS (SELECT *, p * 0.5::DOUBLE + d * 0.3::DOUBLE + a * 0.2::DOUBLE + aspect * 20 AS r FROM turns
  QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY p * 0.5::DOUBLE + d * 0.3::DOUBLE + a * 0.2::DOUBLE + aspect * 20, turn) = 1),
tested AS (SELECT *, r + lum * 10 AS rank, (aspect <= 0.38 OR least(a, d, p) <= 4) AND (lum <= 0.35 OR least(a, d, p) <= 4)
    AND (least(a, d, p) <= 4 OR (a <= {S.a + 3})::INT + (d <= {S.d + 3})::INT + (p <= {S.p + 3})::INT >= 2) AS passes, abs(ax - 1 / ay) / greatest(ax, 1 / ay) AS crossed FROM aligned),
legacy AS (SELECT source, target, CASE WHEN passes THEN turn WHEN ay < ax THEN 90 ELSE 270 END AS turn, a, d, p, CASE WHEN passes THEN aspect ELSE crossed END AS aspect, rank FROM tested
  WHERE passes OR (NOT whole AND crossed <= 0.08 AND lum <= 0.08 AND least(a, d, p) <= 32 AND (a + d + p) / 3.0::DOUBLE <= 38))"""

ENTRIES = r"""
n AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS archive,
  regexp_replace(url, '^[a-z]+://[^/]*/', '') || '-' || page_id::VARCHAR || ['.jpg', '.PNG', '.txt', '.webp', '', '.tif', '/.hidden.gif', '/thumbs.db', '.bmp', '/../x.png', '.zip'][1 + CASE WHEN page_id % 46 = 0 THEN 9 WHEN page_id % 23 = 0 THEN 10 ELSE page_id % 9 END] AS filename,
  page_id % 31 = 0 AS directory, CASE WHEN page_id % 19 = 0 THEN 0 ELSE length(html) END AS size, page_id % 97 = 5 AS encrypted FROM pages),
m AS (SELECT *, floor(size / (page_id % 120 + 1.0::DOUBLE))::BIGINT AS packed, row_number() OVER (PARTITION BY archive ORDER BY page_id) - 1 AS idx,
  list_filter(string_split(replace(filename, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.') AS seg FROM n),
o AS (SELECT *, CASE WHEN filename = '' OR regexp_matches(filename, '[\x00-\x1f\x7f]') OR filename[1] IN ('/', chr(92)) OR regexp_matches(filename, '^[a-zA-Z]:') OR list_contains(seg, '..') OR len(seg) = 0 THEN NULL ELSE nfc_normalize(array_to_string(seg, '/')) END AS path FROM m),
q AS (SELECT *, lower(string_split(path, '.')[-1]) AS ext, string_split(path, '/')[-1] AS base FROM o),
r AS (SELECT *, CASE WHEN ext IN ('jpg', 'jpeg') THEN 'jpeg' WHEN ext IN ('heic', 'heif', 'hif') THEN 'heic' WHEN ext IN ('bmp', 'dib') THEN 'bmp' WHEN ext IN ('tif', 'tiff') THEN 'tiff' WHEN ext IN ('png', 'webp', 'avif', 'gif') THEN ext END AS format FROM q),
s AS (SELECT *, CASE WHEN directory THEN 'directory' WHEN size = 0 THEN 'empty' WHEN base[1] = '.' OR lower(base) = 'thumbs.db' OR len(list_filter(string_split(lower(path), '/'), lambda x: x = '__macosx')) > 0 THEN 'system' WHEN format IS NULL THEN 'unsupported' END AS skip FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY archive, lower(path) ORDER BY idx) AS nth, sum(CASE WHEN directory THEN 0 ELSE size END) OVER (PARTITION BY archive ORDER BY idx) AS total, sum((skip IS NULL)::INT) OVER (PARTITION BY archive ORDER BY idx) AS images FROM s),
u AS (SELECT *, CASE WHEN path IS NULL THEN 'unsafe-path' WHEN nth > 1 THEN 'duplicate-path' WHEN directory THEN NULL WHEN total > 21474836480 THEN 'archive-too-large' WHEN encrypted THEN 'encrypted-zip'
  WHEN size > 0 AND (packed = 0 OR size / packed::DOUBLE > 100) THEN 'compression-ratio' WHEN regexp_matches(path, '(?i)\.(zip|zipx|jar|apk|epub)$') THEN 'nested-zip' WHEN skip IS NOT NULL THEN NULL
  WHEN size > 78643200 THEN 'entry-too-large' WHEN images > 10000 THEN 'too-many-images' END AS code FROM t)"""

EDGES = """
e AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, l_partkey::VARCHAR AS source_id, l_suppkey::VARCHAR AS target_id, l_discount >= 0.05 AS strong, CAST(l_quantity AS INT) AS score,
  CASE WHEN l_returnflag = 'R' THEN 'almost-certain-duplicate' WHEN l_returnflag = 'A' THEN 'probable-duplicate' WHEN l_linestatus = 'O' THEN 'needs-review' ELSE 'probably-different' END AS category,
  CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_returnflag = 'A' THEN 3 WHEN l_linestatus = 'O' THEN 2 ELSE 1 END AS cr FROM lineitem),
k AS (SELECT p_partkey::VARCHAR AS id FROM part),
best AS (SELECT * FROM e WHERE source_id <> target_id AND source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)
  QUALIFY row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY strong DESC, score DESC, cr DESC, id) = 1)"""

_lat, _lon = "({k} * 37 % 180 - 90)::DOUBLE", "({k} * 73 % 360 - 180)::DOUBLE"


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(({c} - {a}) * pi() / 180 / 2), 2) + cos({a} * pi() / 180) * cos({c} * pi() / 180) * pow(sin(({d} - {b}) * pi() / 180 / 2), 2))"
    return f"12742017.6::DOUBLE * atan2(sqrt({h}), sqrt(greatest(0.0::DOUBLE, 1 - {h})))"


def _place(p: str) -> tuple[str, str]:
    return f"CASE WHEN {p}event_id % 3 <> 0 THEN {p}event_id % 2 * 0.0001::DOUBLE END", f"CASE WHEN {p}event_id % 3 <> 0 THEN {p}event_id % 5 * 0.02::DOUBLE END"


CONTEXT = f"""WITH n AS (SELECT *, lead(event_id) OVER w AS n_event_id, lead(ts) OVER w AS n_ts, lead(event_type) OVER w AS n_event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT event_id, n_event_id, {haversine(*_place(""), *_place("n_"))} AS metres, abs(epoch_us(ts) // 1000 - epoch_us(n_ts) // 1000) / 1000.0::DOUBLE AS seconds, event_type = n_event_type AS same, event_id % 2 = 0 AND n_event_id % 2 = 0 AS zoned FROM n WHERE n_event_id IS NOT NULL),
q AS (SELECT *, coalesce(exp(metres * (-ln(2.0::DOUBLE) / 50)) * 0.45::DOUBLE, 0) + coalesce(exp(seconds * (-ln(2.0::DOUBLE) / 120)) * 0.35::DOUBLE, 0) + coalesce(same::INT * 0.2::DOUBLE, 0) AS value,
  (CASE WHEN metres IS NULL THEN 0 ELSE 0.45::DOUBLE END) + 0.35::DOUBLE + 0.2::DOUBLE AS weight FROM p)
SELECT event_id, n_event_id, CASE WHEN coalesce(metres >= 5000, false) OR (seconds > 86400 AND zoned) THEN 'conflicts' WHEN coalesce(metres <= 25, false)::INT + (seconds <= 2)::INT >= 2 THEN 'corroborates' ELSE 'neutral' END AS status,
  CAST(floor(value / weight * 100 + 0.5::DOUBLE) AS INT) AS score, round(metres, 3) AS distance, seconds, same AS same_camera FROM q"""

_heads = "['FFD8FFE0', '89504E470D0A1A0A00', '52494646000000005745425056', '474946383761', '474946383961', '424D0000', '49492A00', '4D4D002A', '000000186674797061766966', '00000018667479706D696631', '504B0304', '504B0506', '0000', 'FFD8']"

#: Documents in groups of one source and language, their comparisons split by tier.
GROUPS = """x AS (SELECT *, source || '-' || lang AS group_id, min(doc_id) OVER (PARTITION BY source, lang) AS ref, 'name ' || (doc_id % 10)::VARCHAR || '-' || source AS name, source || '/' || lang || '/' || doc_id::VARCHAR AS path FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT group_id, ref, doc_id, CASE WHEN toxic = 1 THEN 'manual-review' ELSE 'strong' END AS tier, n_chars % 101 AS score, coalesce(quality = 0, false) AS review, n_chars % 3 = 0 AS decided, lower(name || chr(10) || path) AS t FROM x WHERE doc_id <> ref),
g AS (SELECT c.group_id, c.tier, c.ref, count(*) AS candidates, max(c.score) AS best_score, bool_or(c.review) AS hit, bool_or(c.decided) AS decided, bool_or(contains(c.t, 'src1')) OR bool_or(contains(lower(x.name || chr(10) || x.path), 'src1')) AS found FROM c JOIN x ON c.ref = x.doc_id GROUP BY c.group_id, c.tier, c.ref)"""


def _natural(column: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({column}), '[0-9]+|[^0-9]+'), lambda s: CASE WHEN s[1] BETWEEN '0' AND '9' THEN lpad(s, 20, '0') ELSE s END), '')"


#: Complete-link groups of vectors. A round merges all pairs of clusters that can merge (as many strong edges as members multiplied) and are the best of both.
LINKED = f"""WITH RECURSIVE {scored(S)},
es AS (SELECT *, row_number() OVER (ORDER BY strong DESC, score DESC, category, id) AS rk FROM (
  SELECT 'v' || lpad(source::VARCHAR, 9, '0') AS s, 'v' || lpad(target::VARCHAR, 9, '0') AS t, 'v' || lpad(source::VARCHAR, 9, '0') || '::v' || lpad(target::VARCHAR, 9, '0') AS id, score, turn, score >= 45 AS strong,
    CASE WHEN score >= 45 THEN 'a' ELSE 'b' END AS category FROM sg)),
sl AS (SELECT s AS x, t AS y, rk FROM es WHERE strong),
m AS (SELECT 0 AS i, image, image AS core FROM (SELECT x AS image FROM sl UNION SELECT y FROM sl)
  UNION ALL
  SELECT i, image, core FROM (
    WITH z AS (SELECT core, count(*) AS n FROM m GROUP BY core),
    pr AS (SELECT least(a.core, b.core) AS x, greatest(a.core, b.core) AS y, min(rk) AS rk, count(*) AS n FROM sl JOIN m a ON sl.x = a.image JOIN m b ON sl.y = b.image WHERE a.core <> b.core GROUP BY ALL),
    lv AS (SELECT pr.x, pr.y, pr.rk FROM pr JOIN z zx ON zx.core = pr.x JOIN z zy ON zy.core = pr.y WHERE pr.n = zx.n * zy.n),
    ch AS (SELECT c, min(rk) AS rk FROM (SELECT x AS c, rk FROM lv UNION ALL SELECT y, rk FROM lv) GROUP BY c),
    mu AS (SELECT lv.x, lv.y FROM lv JOIN ch cx ON cx.c = lv.x AND cx.rk = lv.rk JOIN ch cy ON cy.c = lv.y AND cy.rk = lv.rk)
    SELECT m.i + 1 AS i, m.image, coalesce(mu.x, m.core) AS core FROM m LEFT JOIN mu ON mu.y = m.core WHERE (SELECT count(*) FROM mu) > 0)),
co AS (SELECT image, core FROM m WHERE i = (SELECT max(i) FROM m) QUALIFY count(*) OVER (PARTITION BY core) > 1),
ie AS (SELECT a.core AS draft, es.* FROM es JOIN co a ON es.s = a.image JOIN co b ON es.t = b.image WHERE a.core = b.core),
re AS (SELECT id AS draft, es.* FROM es WHERE id NOT IN (SELECT id FROM ie)),
mb AS (SELECT core AS draft, image FROM co UNION ALL SELECT draft, unnest([s, t]) FROM re),
tt AS (SELECT draft, image, sum(score) AS total FROM (SELECT draft, unnest([s, t]) AS image, score FROM ie UNION ALL SELECT draft, unnest([s, t]), score FROM re) GROUP BY ALL),
rf AS (SELECT draft, first(image ORDER BY total DESC, k % 7 DESC, k % 11 DESC, image) AS reference FROM (SELECT mb.*, coalesce(total, 0) AS total, substr(image, 2)::BIGINT AS k FROM mb LEFT JOIN tt USING (draft, image)) GROUP BY draft),
ot AS (SELECT mb.draft, string_agg(image, ',' ORDER BY image) AS rest FROM mb JOIN rf USING (draft) WHERE image <> reference GROUP BY mb.draft),
dr AS (SELECT rf.draft, reference, rest, 0 AS kind, true AS strong, 0 AS score, 'a' AS category, (SELECT string_agg(id, ',' ORDER BY id) FROM ie WHERE ie.draft = rf.draft) AS edges FROM rf JOIN ot USING (draft) WHERE draft IN (SELECT core FROM co)
  UNION ALL SELECT rf.draft, reference, rest, 1, re.strong, re.score, re.category, re.id FROM rf JOIN ot USING (draft) JOIN re USING (draft)),
gr AS (SELECT *, 'group-' || row_number() OVER (ORDER BY reference, kind, strong DESC, score DESC, category, draft) AS id FROM dr)"""

SQL = {
    "complete_link_groups": LINKED + " SELECT id, reference AS reference_id, CASE WHEN kind = 0 THEN reference || ',' || rest ELSE reference END AS members, CASE WHEN kind = 0 THEN '' ELSE rest END AS uncertain, edges, 'unreviewed' AS status FROM gr",
    "resolved_comparisons": LINKED + """,
cd AS (SELECT gr.id AS group_id, gr.kind, gr.reference, gr.draft, mb.image FROM gr JOIN mb ON mb.draft = gr.draft WHERE mb.image <> gr.reference),
al AS (SELECT draft, s, t, id, score, turn, strong FROM ie UNION ALL SELECT draft, s, t, id, score, turn, strong FROM re),
be AS (SELECT cd.group_id, cd.image, first(al ORDER BY al.strong DESC, al.score DESC, al.id) AS e FROM cd JOIN al ON al.draft = cd.draft AND (al.s = cd.image OR al.t = cd.image) GROUP BY ALL),
bb AS (SELECT cd.*, be.e, coalesce(CASE WHEN be.e.s = cd.image THEN be.e.t ELSE be.e.s END, cd.reference) AS base FROM cd LEFT JOIN be USING (group_id, image))
SELECT group_id, image AS candidate_id, CASE WHEN kind = 0 THEN 'strong-member' ELSE 'manual-review' END AS kind, base AS base_id, base = reference AS direct,
  CASE WHEN kind = 0 THEN 'strong' WHEN e.score % 7 = 0 THEN 'low-priority' ELSE 'manual-review' END AS tier, CAST(CASE WHEN e IS NULL THEN 0 WHEN e.t = image THEN e.turn ELSE (360 - e.turn) % 360 END AS INT) AS turn, e.score AS score FROM bb""",
    "ahash_embeddings": f"WITH {PICTURES} SELECT vec_id, "
    + ", ".join(
        f"lower(lpad(to_hex(list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN ({h}{t}::VARCHAR)[i] = '1' THEN (1::UBIGINT << (64 - i)::UBIGINT) ELSE 0::UBIGINT END), lambda s, x: s + x)), 16, '0')) AS {h}_hash_{t}" for h in "adp" for t in (0, 90)
    )
    + " FROM pic",
    "turned_hashes": f"WITH {PICTURES} SELECT vec_id, "
    + ", ".join(
        f"lower(lpad(to_hex(list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN ({h}{t}::VARCHAR)[i] = '1' THEN (1::UBIGINT << (64 - i)::UBIGINT) ELSE 0::UBIGINT END), lambda s, x: s + x)), 16, '0')) AS {h}_hash_{t}" for h in "adp" for t in (180, 270)
    )
    + ", " + ", ".join(f"CAST(bit_count(xor({h}0, {h}{t})) AS INT) AS {h}_moves_{t}" for h in "adp" for t in (90, 180, 270))
    + " FROM pic",
    "legacy_pairs": f"WITH {LEGACY} SELECT {PAIR_COLUMNS} FROM legacy",
    "assess_pairs_balanced": f"WITH {scored(MODES['balanced'])} SELECT {ASSESSED} FROM sg",
    "pair_reasons": f"WITH {scored(S)} SELECT source, target, {reasons(S)} AS reasons FROM sg",
    "hamming_neighbours": f"WITH {PICTURES}, w AS (SELECT vec_id, a0, d0, p0, lead(a0) OVER (ORDER BY vec_id) AS a, lead(d0) OVER (ORDER BY vec_id) AS d, lead(p0) OVER (ORDER BY vec_id) AS p FROM pic) "
    "SELECT vec_id, CAST(bit_count(xor(a0, a)) AS INT) AS a_distance, CAST(bit_count(xor(d0, d)) AS INT) AS d_distance, CAST(bit_count(xor(p0, p)) AS INT) AS p_distance FROM w WHERE a IS NOT NULL",
    "candidate_gate": f"WITH {CANDIDATES} SELECT {PAIR_COLUMNS} FROM cand",
    "topk_per_item": f"WITH {TOPK} SELECT {PAIR_COLUMNS} FROM best",
    "assess_pairs": f"WITH {scored(S)} SELECT {ASSESSED} FROM sg",
    "category_counts": " UNION ALL ".join(f"SELECT * FROM (WITH {scored(m)} SELECT '{name}' AS mode, category, confidence, count(*) AS pairs, max(score) AS best, min(score) AS worst FROM sg GROUP BY ALL)" for name, m in MODES.items()),
    "histogram_similarity": "WITH h AS (SELECT user_id, "
    + "["
    + ", ".join(f"count(*) FILTER (md5(event_type)[1] IN ({', '.join(repr(c) for c in k)}))::DOUBLE" for k in ("0123", "456", "789", "abc", "def"))
    + "] AS h FROM events GROUP BY user_id), w AS (SELECT user_id, h, lead(user_id) OVER (ORDER BY user_id) AS next_id, lead(h) OVER (ORDER BY user_id) AS n FROM h) "
    "SELECT user_id, next_id, round(least(1.0::DOUBLE, list_reduce(list_transform(range(1, 6), lambda i: sqrt(h[i] / list_sum(h) * (n[i] / list_sum(n)))), lambda s, x: s + x)), 6) AS overlap FROM w WHERE next_id IS NOT NULL",
    "ssim_pairs": f"WITH {PICTURES}, w AS (SELECT vec_id, gray AS gx, lead(gray) OVER (ORDER BY vec_id) AS gy FROM pic), m AS (SELECT *, list_sum(gx) / 64 AS mx, list_sum(gy) / 64 AS my FROM w WHERE gy IS NOT NULL), "
    "v AS (SELECT *, list_sum(list_transform(gx, lambda x: (x - mx) * (x - mx))) / 63 AS vx, list_sum(list_transform(gy, lambda x: (x - my) * (x - my))) / 63 AS vy, list_sum(list_transform(range(1, 65), lambda i: (gx[i] - mx) * (gy[i] - my))) / 63 AS cov FROM m) "
    "SELECT vec_id, round((2 * mx * my + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE) / ((mx * mx + my * my + 6.5025::DOUBLE) * (vx + vy + 58.5225::DOUBLE)), 6) AS ssim FROM v",
    "haversine_pairs": f"WITH f AS (SELECT s_nationkey, min(s_suppkey) AS first FROM supplier GROUP BY s_nationkey) SELECT s_suppkey, first, round({haversine(_lat.format(k='s_suppkey'), _lon.format(k='s_suppkey'), _lat.format(k='first'), _lon.format(k='first'))}, 3) AS metres FROM supplier JOIN f USING (s_nationkey)",
    "metadata_context": CONTEXT,
    "entry_validation": f"WITH {ENTRIES} SELECT page_id, path AS normal_path, code, skip, format FROM u",
    "archive_summary": f"WITH {ENTRIES}, f AS (SELECT archive, format, min(idx) AS i FROM u WHERE skip IS NULL AND format IS NOT NULL GROUP BY ALL), g AS (SELECT archive, string_agg(format, ',' ORDER BY i) AS formats FROM f GROUP BY archive) "
    "SELECT u.archive, arg_min(code, idx) FILTER (code IS NOT NULL) AS code, CAST(coalesce(min(idx) FILTER (code IS NOT NULL), -1) AS INT) AS at_index, count(*) FILTER (NOT directory) AS total_entries, count(*) FILTER (skip IS NULL) AS supported_images, "
    "count(*) FILTER (skip IS NOT NULL AND NOT directory) AS skipped_entries, CAST(sum(CASE WHEN directory THEN 0 ELSE size END) AS BIGINT) AS total_bytes, coalesce(any_value(g.formats), '') AS formats FROM u LEFT JOIN g USING (archive) GROUP BY u.archive",
    "magic_sniff": f"WITH h AS (SELECT p_partkey, {_heads}[1 + p_size % 14] AS h FROM part) SELECT p_partkey, CASE WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, '52494646') AND h[17:24] = '57454250' THEN 'webp' "
    "WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 'gif' WHEN starts_with(h, '424D') THEN 'bmp' WHEN h[1:8] IN ('49492A00', '4D4D002A') THEN 'tiff' WHEN h[9:16] = '66747970' AND contains(h[17:], '61766966') THEN 'avif' "
    "WHEN h[9:16] = '66747970' AND contains(h[17:], '6D696631') THEN 'heic' END AS format, h[1:8] IN ('504B0304', '504B0506', '504B0708') AS is_zip FROM h",
    "csv_escape": r"WITH d AS (SELECT doc_id, ['', '=', ' +', chr(9), '-', '@'][1 + doc_id % 6] || text AS t FROM documents), e AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^[\t\r\n ]*[=+\-@]|^[\t\r]') THEN '''' || t ELSE t END AS t FROM d), "
    "f AS (SELECT doc_id, CASE WHEN t IS NULL THEN '' WHEN contains(t, ';') OR contains(t, '\"') OR contains(t, chr(10)) OR contains(t, chr(13)) THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END AS t FROM e) SELECT doc_id, md5(t) AS cell_md5, length(t) AS cell_length FROM f",
    "best_edge_per_pair": f"WITH {EDGES} SELECT id, source_id, target_id, strong, score, category FROM best",
    "review_pairs": f"WITH {EDGES} SELECT id, source_id, target_id, score FROM best WHERE category <> 'probably-different' AND id NOT IN (SELECT id FROM best WHERE strong AND category <> 'probably-different')",
    "reference_scores": f"WITH {EDGES}, en AS (SELECT target_id AS draft, unnest([source_id, target_id]) AS image, score FROM best), ts AS (SELECT draft, image, sum(score) AS total FROM en GROUP BY ALL), "
    "pf AS (SELECT ts.*, coalesce(p_size * 10, 0) AS pixels, coalesce(floor(p_retailprice), 0) AS bytes FROM ts LEFT JOIN part ON p_partkey::VARCHAR = image) "
    "SELECT draft, first(image ORDER BY total DESC, pixels DESC, bytes DESC, image) AS reference, count(*) AS members FROM pf GROUP BY draft",
    "decision_rollup": "WITH d AS (SELECT doc_id, source, lang, floor(n_chars / 100) AS page, CASE WHEN n_chars % 5 = 0 THEN 'different' WHEN n_chars % 7 = 0 THEN 'later' WHEN n_chars % 11 = 0 THEN 'duplicate' ELSE 'unreviewed' END AS own, "
    "CASE WHEN toxic = 1 THEN 'later' WHEN quality = 0 THEN 'different' WHEN quality = 1 THEN 'unreviewed' END AS rel FROM documents LEFT JOIN labels USING (doc_id)), "
    "r AS (SELECT source, lang, page, count(rel) AS n, count(*) FILTER (rel = 'later') AS l, count(*) FILTER (rel = 'different') AS f, min(doc_id) AS ref FROM d GROUP BY source, lang, page), "
    "j AS (SELECT doc_id, ref, CASE WHEN own = 'duplicate' THEN 'duplicate' WHEN own = 'later' OR l > 0 THEN 'later' WHEN n > 0 AND n = f THEN 'different' WHEN own = 'different' THEN 'different' WHEN n > 0 THEN 'unreviewed' ELSE own END AS decision FROM d JOIN r USING (source, lang, page)) "
    "SELECT doc_id, decision, CASE WHEN decision = 'duplicate' THEN 'bestätigtes-duplikat' WHEN decision = 'later' THEN 'ungeklärt' WHEN decision = 'unreviewed' AND doc_id <> ref THEN 'ungeklärt' ELSE 'behalten' END AS category FROM j",
    "result_query": f"WITH {GROUPS} SELECT group_id, tier, ref::VARCHAR AS reference_id, candidates, best_score FROM g WHERE tier = 'strong' AND hit AND found ORDER BY best_score DESC, group_id, tier LIMIT 20",
    "result_orders": f"WITH {GROUPS}, k AS (SELECT g.*, x.n_chars AS size, {_natural("x.name")} AS nk, {_natural("x.path")} AS pk FROM g JOIN x ON g.ref = x.doc_id WHERE g.decided) "
    + " UNION ALL ".join(
        f"(SELECT '{n}' AS sort, group_id, tier, ref::VARCHAR AS reference_id, candidates, best_score FROM k ORDER BY {o}, group_id, tier LIMIT 5 OFFSET 5)"
        for n, o in (("similarity-desc", "best_score DESC"), ("similarity-asc", "best_score"), ("name", "nk"), ("path", "pk"), ("size", "size DESC"), ("group-size", "candidates DESC"))
    ),
    "result_tiers": f"WITH {GROUPS}, t AS (SELECT tier, count(*) AS groups FROM g GROUP BY tier) SELECT tier, groups FROM t UNION ALL SELECT 'shown ' || tier AS tier, groups FROM t WHERE tier = 'strong'",
    "name_tools": r"""WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[\x00-\x1f\x7f]', '_', 'g'), '[<>:"/\\|?*]', '_', 'g') AS u FROM pages), """
    r"""s AS (SELECT page_id, url, substr(regexp_replace(u, '[. ]+$', ''), 1, 180) AS n, substr(regexp_replace(u || '-bericht', '[. ]+$', ''), 1, 180) AS stem FROM c) SELECT page_id, CASE WHEN n = '' THEN 'bericht' ELSE n END AS safe_name, string_split(url, '/')[-1] AS base, 'jpeg' AS format, stem FROM s""",
    "error_codes": f"WITH {ENTRIES} SELECT code, CASE code WHEN 'encrypted-zip' THEN 'encrypted-zip' WHEN 'compression-ratio' THEN 'limit-exceeded' WHEN 'archive-too-large' THEN 'limit-exceeded' WHEN 'entry-too-large' THEN 'limit-exceeded' WHEN 'too-many-images' THEN 'limit-exceeded' ELSE 'invalid-zip' END AS public, "
    "false AS recoverable, count(*) AS entries FROM u WHERE code IS NOT NULL GROUP BY code",
    "error_ids": f"WITH {ENTRIES}, w AS (SELECT page_id, code || chr(0) || coalesce(path, '') || chr(0) || 'message' AS t FROM u WHERE code IS NOT NULL) SELECT page_id, 'zip-' || lower(lpad(to_hex(list_reduce(list_transform(range(1, length(t) + 1), "
    "lambda i: unicode(t[i])::HUGEINT), lambda s, x: (xor(s, x) * 16777619) % 4294967296, 2166136261::HUGEINT)::UBIGINT), 8, '0')) AS error_id FROM w",
}
