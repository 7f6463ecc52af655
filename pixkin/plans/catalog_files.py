"""Queries over files made from the tables (plans.standins): archives, entries, pictures, capture metadata, the store. With their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixkin.functions import bits, exif, names
from pixkin.operators import comparisons
from pixkin.operators.skew import cut, delete, new_path, stored
from pixkin.plans import standins
from pixkin.plans.oracles import numbers
from pixkin.sources import archive, images
from pixkin.sources.store import Store


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in archives, listed from the central directories."""
    e = archive.read_entries(standins.page_archives(read(spark, sf_dir, "pages")))
    return e.select("archive", "index", "filename", "directory", "compressed_size", "uncompressed_size", "encrypted", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"))


def archive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry by its path, whichever archive has it."""
    found = archive.read_one(standins.page_archives(read(spark, sf_dir, "pages")), ".\\p37.html")
    return found.select("archive", "index", F.sha2("content", 256).alias("content_sha256"))


def archive_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files: identities from name, length, time and both ends of 512 bytes."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    content = F.encode("text", "UTF-8")
    files = d.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), F.timestamp_millis(F.col("doc_id") * 1000).alias("modificationTime"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return archive.identity(files, 512).select("name", "size", "fingerprint")


def archive_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures unpacked and verified (sizes of the uncompressed kind), and the findings on those that aren't."""
    found, errors = archive.read_images(standins.picture_archives(read(spark, sf_dir, "embeddings")))
    good = found.select("archive", "path", "name", "format", F.when(F.col("format") == "bmp", F.col("size")).alias("size"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("boolean").alias("fatal"))
    none = lambda kind: F.lit(None).cast(kind)
    return good.unionByName(errors.select("archive", "path", none("string").alias("name"), none("string").alias("format"), none("long").alias("size"), "code", "fatal"))


def features_by_vector(found: DataFrame) -> DataFrame:
    return images.image_features(found).withColumn("vec_id", F.regexp_extract("name", r"v(\d+)", 1).cast("long"))


def picture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = archive.read_images(standins.picture_archives(read(spark, sf_dir, "embeddings")))
    return features_by_vector(found)


def picture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of decoded pictures, shown as their orientation says: grey pixels, brightness, colours and hashes."""
    f = picture_features(spark, sf_dir)
    bins = F.array_join(F.transform("histogram", lambda x: (x * 64).cast("int").cast("string")), ",")
    unturned = lambda h: bits.to_hex(F.element_at("variants", 1)[h]).alias(f"{h}_hash")
    return f.select("vec_id", "format", "width", "height", "aspect", F.round("luminance", 6).alias("luminance"), F.md5(F.hex("gray")).alias("gray_md5"), bins.alias("colours"), unturned("a"), unturned("d"), unturned("p"), F.size("variants").alias("variants"), "decode_error")


def thumbnail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails of pictures as JPEG files, read again: their format and size, and whether they are as bright as the pictures (noise of halved colours moves it a little)."""
    found = stored(archive.read_images(standins.picture_archives(read(spark, sf_dir, "embeddings")))[0])  # both ways start from what is unpacked once
    made = cut(images.thumbnails(found.select(F.regexp_extract("name", r"v(\d+)", 1).cast("long").alias("vec_id"), "format", "content")))
    again = images.image_features(made.select("vec_id", names.format_of_bytes(F.col("content")).alias("format"), "content"))
    before = features_by_vector(found).select("vec_id", F.col("luminance").alias("was"))
    return again.join(before, "vec_id").select("vec_id", "format", "width", "height", (F.abs(F.col("luminance") - F.col("was")) < 0.1).alias("as_bright"), "decode_error")


def picture_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture metadata read from the files."""
    m = lambda n: F.col(f"metadata.{n}")
    found, _ = archive.read_images(standins.picture_archives(read(spark, sf_dir, "embeddings")))
    f = features_by_vector(found.where("format = 'png'"))  # the others aren't decoded
    return f.select("vec_id", m("make").alias("make"), m("model").alias("model"), m("orientation").alias("orientation"), F.date_format(m("at"), "yyyy-MM-dd HH:mm:ss.SSS").alias("taken"), m("zoned").alias("zoned"), F.round(m("latitude"), 6).alias("latitude"), F.round(m("longitude"), 6).alias("longitude"), m("altitude").alias("altitude"), F.size(m("warnings")).alias("warnings"))


def exif_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd texts as cameras write them: phrases, offsets, fractions, dates, places."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    pick = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), (i % len(x)).cast("int"))
    date = F.concat(F.date_format("ts", "yyyy:MM:dd"), pick(" ", "T", "  "), F.date_format("ts", "HH:mm:ss"), pick("", ".5", "", ".1234", " x"))
    odd = F.when(i % 11 == 0, "2023:02:30 10:00:00").when(i % 13 == 0, "0000:01:01 10:00:00").otherwise(date)
    offset, fraction = exif.utc_offset(pick("+02:00", " -05:30 ", "+15:00", "02:00", None)), exif.subseconds(pick("5", " 1234 ", "x1", None, "07"))
    place = exif.gps((i % 200 - 100).cast("double"), (i % 400 - 200).cast("double"))
    turn = exif.orientation(pick("3", "Rotate 90 CW", " mirror  horizontal ", "9", "Horizontal (normal)", None, "12"))
    at = exif.captured_at(odd, offset, fraction)
    return e.select(
        "event_id", exif.clean_text(F.concat(F.lit("  "), F.col("event_type"), F.lit(" ﬁ \t x "), F.repeat(F.lit("long "), (i % 60).cast("int")))).alias("text"), turn.alias("orientation"), offset.alias("offset"), fraction.alias("fraction"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS").alias("taken"), place["latitude"].alias("latitude"), place["longitude"].alias("longitude"), place["warning"].alias("warning"), exif.altitude(F.col("value"), (i % 3).cast("int")).alias("altitude"),
    )


def hex_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex digits of either case read as hashes, odd ones refused; names that agree with their content; scales of turned pictures."""
    p = read(spark, sf_dir, "part")
    digits = F.substring(F.md5("p_name"), 1, 16)
    text = F.when(F.col("p_partkey") % 5 == 0, F.upper(digits)).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("g"), F.substring(digits, 2, 15))).when(F.col("p_partkey") % 11 == 0, F.substring(digits, 1, 15)).otherwise(digits)
    head = F.unhex(F.get(F.array(F.lit("FFD8FFE0"), F.lit("89504E470D0A1A0A00"), F.lit("424D0000")), (F.col("p_partkey") % 3).cast("int")))
    name = F.concat(F.lit("x."), F.get(F.array(F.lit("jpg"), F.lit("PNG")), (F.col("p_partkey") % 2).cast("int")))
    scale = comparisons.fit_scale((F.col("p_size") % 5) * 0.5, F.lit(1.5), (F.col("p_partkey") % 4 * 90).cast("int"))
    return p.select("p_partkey", bits.from_hex(text).alias("hash"), names.content_matches(name, head).alias("agrees"), F.round(scale, 6).alias("scale"))


def stored_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by fingerprint: written, one replaced, one deleted, thumbnails refused, and what is left."""
    path = new_path(spark, "store")
    store = Store(spark, path)
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), "o_totalprice", "o_orderstatus")
    for status in ("F", "O", "P"):
        store.put("images", o.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), status)
    store.put("images", o.where("o_orderstatus = 'F' and o_totalprice > 100000").drop("o_orderstatus"), "F")
    kinds = F.unhex(F.get(F.array(F.lit("FFD8FF00"), F.lit("89504E470D0A1A0A00"), F.lit("424D0000"), F.lit("")), (F.col("o_orderkey") % 4).cast("int")))
    store.put_thumbnails(o.select(F.col("o_orderkey").cast("string").alias("key"), kinds.alias("content")), "T")
    store.delete("P")
    left = store.get("images").select(F.lit("images").alias("stored"), "fingerprint", F.col("o_orderkey").cast("string").alias("key"))
    out = cut(left.unionByName(store.get("thumbnails", "T").select(F.lit("thumbnails").alias("stored"), "fingerprint", "key")))
    delete(spark, path)
    return out


def keyed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by source and document: put, some put again (the later one counts), compacted, some deleted, one put anew; and values that nobody agreed to keep."""
    path = new_path(spark, "store")
    store = Store(spark, path)
    d = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("fingerprint"), F.col("doc_id").cast("string").alias("key"), "doc_id", "n_chars")
    kind = F.when(F.col("n_chars") % 3 == 0, "duplicate").when(F.col("n_chars") % 3 == 1, "later").otherwise("different")
    log = store.keyed("decisions")
    log.put(d.select("fingerprint", "key", kind.alias("decision")))
    log.put(d.where("doc_id % 2 = 0").select("fingerprint", "key", F.explode(F.array(F.struct(F.lit("later").alias("decision"), F.timestamp_seconds(F.lit(1)).alias("at")), F.struct(F.lit("unreviewed").alias("decision"), F.timestamp_seconds(F.lit(2)).alias("at")))).alias("e")).select("fingerprint", "key", "e.*"))
    log.compact()
    log.delete(d.where("doc_id % 5 = 0"))
    log.put(d.where("doc_id % 25 = 0").select("fingerprint", "key", F.lit("different").alias("decision")))
    refused = store.keyed("values").put(d)
    store.agree(True)
    kept = store.keyed("values").put(d.where("doc_id % 10 = 3").select("fingerprint", "key", F.lit("value").alias("decision")))
    rows = log.get().select(F.lit("decision").alias("stored"), "fingerprint", "key", "decision")
    out = rows.unionByName(store.keyed("values").get().select(F.lit(f"{refused} {kept}").alias("stored"), "fingerprint", "key", "decision"))
    out = cut(out)
    delete(spark, path)
    return out


ALL = (keyed_decisions, archive_entries, archive_lookup, archive_identity, archive_images, picture_records, thumbnail_files, picture_metadata, exif_texts, hex_hashes, stored_analyses)

_at64 = (np.arange(9) + 0.5) * (64 / 9) - 0.5
_low64 = np.floor(_at64).astype(int)
_k, _n = np.arange(8)[:, None], np.arange(32)[None]
_cosines = (np.sqrt(np.where(_k == 0, 1 / 32, 2 / 32)) * np.cos((2 * _n + 1) * _k * np.pi / 64)).reshape(8, 8, 4).sum(2)
_places = {1: "r * 8 + c", 2: "r * 8 + 7 - c", 3: "(7 - r) * 8 + 7 - c", 4: "(7 - r) * 8 + c", 5: "c * 8 + r", 6: "(7 - c) * 8 + r", 7: "(7 - c) * 8 + 7 - r", 8: "c * 8 + 7 - r"}
_shown = "CASE turn " + " ".join(f"WHEN {o} THEN {e.replace('r', '(i // 8)').replace('c', '(i % 8)')}" for o, e in _places.items()) + " ELSE i END"
_lists = lambda v: "[" + ", ".join(str(int(x)) for x in v) + "]"
_nine = lambda c: f"(gray[i // 8 * 8 + {_lists(_low64 // 8 + 1)}[{c}]] + (gray[i // 8 * 8 + {_lists(np.minimum(63, _low64 + 1) // 8 + 1)}[{c}]] - gray[i // 8 * 8 + {_lists(_low64 // 8 + 1)}[{c}]]) * {numbers(_at64 - _low64)}[{c}])"
_hex = lambda h: f"lower(lpad(to_hex(list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN {h}[i] THEN (1::UBIGINT << (64 - i)::UBIGINT) ELSE 0::UBIGINT END), lambda s, x: s + x)), 16, '0'))"

ENTRIES = """
e AS (SELECT vec_id AS i, embedding, vec_id // 64 AS z, 'p/v' || vec_id || '.' || CASE WHEN vec_id % 13 = 0 THEN 'txt' WHEN vec_id % 17 = 0 THEN 'gif' WHEN vec_id % 2 = 1 THEN 'png' WHEN vec_id % 4 = 2 THEN 'webp' ELSE 'bmp' END AS path,
  vec_id // 64 % 5 = 3 AND vec_id % 64 = 5 AS disguised, vec_id % 19 = 0 AS spoiled FROM embeddings WHERE len(embedding) = 64),
j AS (SELECT *, 'pictures-' || z || '.zip' AS archive, CASE WHEN spoiled THEN 'corrupt-entry' WHEN disguised THEN 'nested-zip' WHEN i % 17 = 0 THEN 'format-mismatch' END AS code FROM e WHERE i % 13 <> 0),
q AS (SELECT DISTINCT z FROM j WHERE code = 'nested-zip'),
good AS (SELECT * FROM j WHERE code IS NULL AND z NOT IN (SELECT z FROM q))"""

#: Pixels as they are shown, their grey values and colours.
SHOWN = f"""{ENTRIES},
p0 AS (SELECT i, path, CASE WHEN i % 2 = 1 THEN i % 9 ELSE 1 END AS turn, list_transform(embedding, lambda x: floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (x::DOUBLE + 1) * 127.5::DOUBLE)))) AS v FROM good),
p1 AS (SELECT i, path, list_transform(range(0, 64), lambda i: v[({_shown}) + 1]) AS r, list_transform(range(0, 64), lambda i: v[(({_shown}) + 21) % 64 + 1]) AS g, list_transform(range(0, 64), lambda i: v[(({_shown}) + 42) % 64 + 1]) AS b FROM p0),
p2 AS (SELECT *, list_transform(range(1, 65), lambda i: floor(r[i] * 0.299::DOUBLE + g[i] * 0.587::DOUBLE + b[i] * 0.114::DOUBLE + 0.5::DOUBLE)) AS gray, {numbers(_cosines)} AS m FROM p1),
h0 AS (SELECT i, unnest(r) / 255 AS r, unnest(g) / 255 AS g, unnest(b) / 255 AS b FROM p1),
h1 AS (SELECT *, greatest(r, g, b) AS high, greatest(r, g, b) - least(r, g, b) AS delta FROM h0),
h2 AS (SELECT *, CASE WHEN delta = 0 THEN 360 ELSE (CASE WHEN high = r THEN (g - b) / delta WHEN high = g THEN (b - r) / delta + 2 ELSE (r - g) / delta + 4 END) * 60 + 360 END AS wide, CASE WHEN high = 0 THEN 0 ELSE delta / high END AS sat FROM h1),
h20 AS (SELECT *, CASE WHEN wide >= 360 THEN wide - 360 ELSE wide END AS hue FROM h2),
h3 AS (SELECT i, (least(7, floor(hue / 360 * 8)) * 16 + least(3, floor(sat * 4)) * 4 + least(3, floor(high * 4)))::INT AS bin, count(*) AS n FROM h20 GROUP BY ALL),
h4 AS (SELECT i, array_to_string(list_transform(range(0, 128), lambda k: coalesce(map_from_entries(list((bin, n)))[k], 0)::VARCHAR), ',') AS colours FROM h3 GROUP BY i),
d1 AS (SELECT *, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 8), lambda k: gray[i // 8 * 8 + k + 1] * m[i % 8 * 8 + k + 1]))) AS across, list_sum(gray) / 64 AS mean FROM p2),
d2 AS (SELECT *, list_transform(list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 8), lambda k: across[k * 8 + i % 8 + 1] * m[i // 8 * 8 + k + 1]))), lambda x: CASE WHEN abs(x) < 1e-9 THEN 0 ELSE x END) AS c FROM d1),
d3 AS (SELECT *, list_transform(gray, lambda x: x >= mean) AS ab, list_transform(range(0, 64), lambda i: {_nine('i % 8 + 1')} > {_nine('i % 8 + 2')}) AS db, list_transform(c, lambda x: x > list_sort(c[2:])[32]) AS pb FROM d2)"""

SQL = {
    "archive_entries": "SELECT 'pages-' || (page_id // 64) || '.zip' AS archive, CAST(row_number() OVER (PARTITION BY page_id // 64 ORDER BY page_id) - 1 AS INT) AS index, 'p' || page_id || '.html' AS filename, false AS directory, strlen(coalesce(html, '')) AS compressed_size, strlen(coalesce(html, '')) AS uncompressed_size, false AS encrypted, '2024-01-02 03:04:06' AS last_modified FROM pages",
    "archive_lookup": "SELECT 'pages-' || (page_id // 64) || '.zip' AS archive, CAST(n AS INT) AS index, sha256(coalesce(html, '')) AS content_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY page_id // 64 ORDER BY page_id) - 1 AS n FROM pages) WHERE page_id = 37",
    "archive_identity": f"""WITH f AS (SELECT doc_id, encode(text) AS b, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
      g AS (SELECT *, doc_id || '.zip' AS name, greatest(least(n, 512), n - 512) AS start FROM f)
      SELECT name, n AS size, sha256(encode('{archive.IDENTITY_TAG}' || chr(10) || '{{"name":"' || name || '","size":' || n || ',"lastModified":' || (doc_id * 1000) || ',"chunkBytes":512}}' || chr(10)) || b[1:512] || CASE WHEN start < n THEN b[start + 1:n] ELSE ''::BLOB END) AS fingerprint FROM g""",
    "archive_images": f"""WITH {ENTRIES} SELECT archive, path, string_split(path, '/')[2] AS name, CASE WHEN i % 2 = 1 THEN 'png' WHEN i % 4 = 2 THEN 'webp' ELSE 'bmp' END AS format, CASE WHEN i % 4 = 0 THEN 246::BIGINT END AS size, NULL::VARCHAR AS code, NULL::BOOLEAN AS fatal FROM good
      UNION ALL SELECT archive, path, NULL, NULL, NULL, code, code = 'nested-zip' FROM j WHERE code IS NOT NULL""",
    "picture_records": f"""WITH {SHOWN} SELECT i AS vec_id, CASE WHEN i % 2 = 1 THEN 'png' WHEN i % 4 = 2 THEN 'webp' ELSE 'bmp' END AS format, 8::INT AS width, 8::INT AS height, 1.0::DOUBLE AS aspect, round(mean / 255, 6) AS luminance,
      md5(array_to_string(list_transform(range(0, 4096), lambda k: lpad(to_hex(gray[k // 512 * 8 + k % 64 // 8 + 1]::INT), 2, '0')), '')) AS gray_md5, colours, {_hex('ab')} AS a_hash, {_hex('db')} AS d_hash, {_hex('pb')} AS p_hash, 4::INT AS variants, NULL::VARCHAR AS decode_error FROM d3 JOIN h4 USING (i)""",
    "thumbnail_files": f"WITH {ENTRIES} SELECT i AS vec_id, 'jpeg' AS format, 8::INT AS width, 8::INT AS height, true AS as_bright, NULL::VARCHAR AS decode_error FROM good",
    "picture_metadata": f"""WITH {ENTRIES}, o AS (SELECT i, i % 100 + 0.5::DOUBLE AS la, (i % 180) + 0.01::DOUBLE AS lo FROM good WHERE i % 2 = 1)
      SELECT i AS vec_id, 'ACME Inc' AS make, 'M' || (i % 7) AS model, CASE WHEN i % 9 > 0 THEN (i % 9)::INT END AS orientation,
      strftime(make_timestamp(2024, i % 9 + 1, 10 + i % 10, 7, i % 10, 9) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') || '.' || rpad((i % 1000)::VARCHAR, 3, '0')[1:3] AS taken, true AS zoned,
      CASE WHEN la <= 90 THEN round(CASE WHEN i % 3 > 0 THEN la ELSE -la END, 6) END AS latitude, CASE WHEN la <= 90 THEN round(lo, 6) END AS longitude, -(i % 500)::DOUBLE AS altitude, ((la > 90)::INT + (i % 9 = 0)::INT) AS warnings FROM o""",
    "exif_texts": """WITH e AS (SELECT *, event_id AS i FROM events),
      t AS (SELECT *, ['+02:00', ' -05:30 ', '+15:00', '02:00', NULL][1 + i % 5] AS o, ['5', ' 1234 ', 'x1', NULL, '07'][1 + i % 5] AS f, ['3', 'Rotate 90 CW', ' mirror  horizontal ', '9', 'Horizontal (normal)', NULL, '12'][1 + i % 7] AS w,
        CASE WHEN i % 11 = 0 THEN NULL WHEN i % 13 = 0 THEN NULL WHEN i % 3 = 2 THEN NULL ELSE 1 END AS fine FROM e),
      u AS (SELECT *, CASE WHEN regexp_full_match(trim(o), '[+-](0[0-9]|1[0-4]):[0-5][0-9]') THEN trim(o) END AS off, CASE WHEN regexp_full_match(trim(f), '[0-9]+') THEN rpad(trim(f)[1:3], 3, '0') END AS frac FROM t),
      x AS (SELECT *, date_trunc('second', ts) AS s, coalesce(frac, CASE i % 5 WHEN 1 THEN '500' WHEN 3 THEN '123' END, '000') AS ms,
        CASE off WHEN '+02:00' THEN INTERVAL 2 HOUR WHEN '-05:30' THEN -INTERVAL 330 MINUTE ELSE INTERVAL 0 HOUR END AS shift FROM u)
      SELECT event_id, CASE WHEN length(event_type || ' fi x ' || repeat('long ', (i % 60)::INT)) > 0 THEN trim(event_type || ' fi x ' || repeat('long ', (i % 60)::INT))[1:200] END AS text,
        CASE i % 7 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 2 WHEN 4 THEN 1 END::INT AS orientation, off AS "offset", frac AS fraction, CASE WHEN fine = 1 THEN strftime(s - shift, '%Y-%m-%d %H:%M:%S') || '.' || ms END AS taken,
        CASE WHEN abs(i % 200 - 100) <= 90 AND abs(i % 400 - 200) <= 180 THEN (i % 200 - 100)::DOUBLE END AS latitude, CASE WHEN abs(i % 200 - 100) <= 90 AND abs(i % 400 - 200) <= 180 THEN (i % 400 - 200)::DOUBLE END AS longitude,
        CASE WHEN NOT (abs(i % 200 - 100) <= 90 AND abs(i % 400 - 200) <= 180) THEN 'Ungültige GPS-Koordinaten wurden verworfen.' END AS warning, CASE WHEN i % 3 = 1 THEN -value ELSE value END AS altitude FROM x""",
    "hex_hashes": """WITH p AS (SELECT *, md5(p_name)[1:16] AS h FROM part),
      q AS (SELECT *, list_reduce(list_transform(range(1, 17), lambda i: (strpos('0123456789abcdef', h[i]) - 1)::HUGEINT), lambda s, x: s * 16 + x) AS n, (p_size % 5) * 0.5::DOUBLE AS ref FROM p)
      SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND (p_partkey % 7 = 0 OR p_partkey % 11 = 0) THEN NULL ELSE (CASE WHEN n >= 9223372036854775808 THEN n - 18446744073709551616 ELSE n END)::BIGINT END AS hash,
      (p_partkey % 2 = 0 AND p_partkey % 3 = 0) OR (p_partkey % 2 = 1 AND p_partkey % 3 = 1) AS agrees,
      round(CASE WHEN p_partkey % 4 IN (1, 3) AND ref > 0 THEN least(ref, 1 / 1.5::DOUBLE) / least(ref / 1.5::DOUBLE, 1) ELSE 1 END, 6) AS scale FROM q""",
    "keyed_decisions": """SELECT 'decision' AS stored, coalesce(source, 'none') AS fingerprint, doc_id::VARCHAR AS key,
      CASE WHEN doc_id % 25 = 0 THEN 'different' WHEN doc_id % 2 = 0 THEN 'unreviewed' WHEN n_chars % 3 = 0 THEN 'duplicate' WHEN n_chars % 3 = 1 THEN 'later' ELSE 'different' END AS decision FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 25 = 0
      UNION ALL SELECT 'False True', coalesce(source, 'none'), doc_id::VARCHAR, 'value' FROM documents WHERE doc_id % 10 = 3""",
    "stored_analyses": """SELECT 'images' AS stored, o_orderstatus AS fingerprint, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_totalprice > 100000)
      UNION ALL SELECT 'thumbnails', 'T', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 4 IN (0, 1)""",
}


def queries():
    return {f.__name__: f for f in ALL}
