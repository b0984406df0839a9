"""SQL of the training-data queries, written independently of the operators: chats by lengths and digests, links by joined shingles, containers by their bytes."""

from __future__ import annotations

#: What a turn's text gains by escaping: a backslash for each backslash, for each # behind a #, and for each closing mark.
GAINED = r"""(length(t) - length(replace(t, '\', ''))) + (length(t) - length(replace(t, '#', '')) - len(regexp_extract_all(t, '#+'))) + len(regexp_extract_all(t, '</turn>'))"""
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, r, t)),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn NULLS FIRST, r, t), '') AS loss,
  CAST(sum(4 + length(r) + length(r) - length(replace(r, ':', '')) + 2 + length(t) + {GAINED} + 9) AS BIGINT) AS formatted_chars FROM c GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, false AS rewrites FROM g"""

SYMBOLS = r"[\x{00a0}-\x{00a9}\x{00ab}-\x{00b1}\x{00b4}\x{00b6}-\x{00b8}\x{00bb}\x{00bf}\x{00d7}\x{00f7}\x{2000}-\x{2bff}\x{2e00}-\x{2e7f}\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{fe10}-\x{fe6f}\x{ff00}-\x{ff0f}\x{ff1a}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}\x{fffd}]"
UNSPACED = r"([\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3005}-\x{3007}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}])"
JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
x AS (SELECT t, row_number() OVER (ORDER BY min(doc_id)) AS n, min(doc_id) AS name FROM d GROUP BY 1),
w AS (SELECT n, regexp_extract_all(regexp_replace(regexp_replace(t, '{SYMBOLS}', ' ', 'g'), '{UNSPACED}', ' \1 ', 'g'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM x),
s AS (SELECT DISTINCT n, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
z AS (SELECT n, count(*) AS size FROM s GROUP BY 1),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.n < b.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z za ON za.n = a JOIN z zb ON zb.n = b WHERE 5 * common >= 4 * (za.size + zb.size - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT c.n, e.b FROM c JOIN e ON c.m = e.a),
k AS (SELECT n, min(m) AS first FROM c GROUP BY 1), f AS (SELECT a AS n, count(*) AS links FROM e GROUP BY 1)
SELECT doc_id, CASE WHEN z.n IS NULL THEN doc_id ELSE coalesce(y.name, x.name) END AS class_id, coalesce(links, 0) AS n_links
FROM d JOIN x USING (t) LEFT JOIN z USING (n) LEFT JOIN k USING (n) LEFT JOIN x y ON y.n = k.first LEFT JOIN f ON f.n = x.n"""


def crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc(hexed: str) -> str:
    """SQL of the CRC-32 of bytes given as hex digits."""
    numbers = f"list_transform(range(0, CAST(length({hexed}) // 2 AS BIGINT)), lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {numbers}), lambda c, b: xor(c >> 8, list_extract(crc_of, 1 + (xor(c, b) & 255)))), 4294967295)"


def u32(*xs: str | int) -> str:
    return " || ".join(f"'{x:08x}'" if isinstance(x, int) else f"printf('%08x', CAST({x} AS BIGINT))" for x in xs)


def tag(*kinds: str) -> str:
    return " || ".join("'" + k.encode("latin-1").hex() + "'" for k in kinds)


def zeros(n: int) -> str:
    return f"'{'00' * n}'"


MATRIX = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
# Sizes of the boxes follow from the numbers of chunks c and runs r; the header is the file type, the movie box and the head of the media box.
HEADER = " || ".join([
    u32(28), tag("ftyp", "isom"), u32(0x200), tag("isomiso2mp41"),
    u32("8 + 120 + 112 + 92 + 60 + stbl"), tag("moov"), u32(120), tag("mvhd"), u32(1 << 24), zeros(16), u32(8000), u32(0, "n"), u32(0x10000), "'0100'", zeros(10), MATRIX, zeros(24), u32(2),
    u32("112 + 92 + 60 + stbl"), tag("trak"), u32(104), tag("tkhd"), u32(1 << 24 | 7), zeros(16), u32(1, 0), u32(0, "n"), zeros(8), "'0000000001000000'", MATRIX, zeros(8),
    u32("92 + 60 + stbl"), tag("mdia"), u32(44), tag("mdhd"), u32(1 << 24), zeros(16), u32(8000), u32(0, "n"), "'55c40000'",
    u32(40), tag("hdlr"), u32(0), zeros(4), tag("soun"), zeros(12), tag("samples\0"),
    u32("60 + stbl"), tag("minf"), u32(16), tag("smhd"), u32(0), zeros(4), u32(36), tag("dinf"), u32(28), tag("dref"), u32(0, 1), u32(12), tag("url "), u32(1),
    u32("stbl"), tag("stbl"), u32(52), tag("stsd"), u32(0, 1), u32(36), tag("raw "), zeros(6), "'0001'", zeros(8), "'0001000800000000'", u32(8000 << 16),
    u32(24), tag("stts"), u32(0, 1, "units", 64),
    u32("16 + 4 * c"), tag("stss"), u32(0, "c"), "array_to_string(list_transform(range(0, c), lambda k: printf('%08x', CAST(64 * k + 1 AS BIGINT))), '')",
    u32("16 + 12 * len(runs)"), tag("stsc"), u32(0, "len(runs)"), "array_to_string(list_transform(runs, lambda x: printf('%08x%08x00000001', CAST(x[1] AS BIGINT), CAST(x[2] AS BIGINT))), '')",
    u32(20), tag("stsz"), u32(0, 64, "units"),
    u32("16 + 4 * c"), tag("stco"), u32(0, "c"), "array_to_string(list_transform(range(0, c), lambda k: printf('%08x', CAST(28 + 392 + stbl + 8 + 4096 * k AS BIGINT))), '')",
    u32("8 + n"), tag("mdat"),
])
MEDIA = f"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, rpad(x, CAST(greatest(1, ceil(length(x) / 128.0)) AS INT) * 128, '0') AS x FROM t),
u AS (SELECT *, length(x) // 2 AS n, length(x) // 128 AS units, CAST(ceil(length(x) / 8192.0) AS BIGINT) AS c FROM p),
r AS (SELECT *, list_concat(CASE WHEN c > 1 THEN [[1, 64]] ELSE [] END, CASE WHEN c = 1 OR units - 64 * (c - 1) <> 64 THEN [[c, units - 64 * (c - 1)]] ELSE [] END) AS runs, {crc_table()} AS crc_of FROM u),
s AS (SELECT *, 152 + 8 * c + 12 * len(runs) AS stbl FROM r),
m AS (SELECT *, {HEADER} || x AS media FROM s),
k AS (SELECT *, list_transform(range(0, c), lambda i: (length(media) - length(x)) // 2 + 4096 * i) AS places FROM m),
f AS (SELECT *, array_to_string(list_transform(places, lambda a: printf('%02x%02x%02x%02x00000000', a & 255, (a >> 8) & 255, (a >> 16) & 255, (a >> 24) & 255) || '4000000000000000'), '') AS le FROM k)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(x)) AS payload_sha256, CAST({crc("right(x, 128)")} AS BIGINT) AS tail_crc32, length(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'soun/raw/8000/' || n || '/' || units || '/' || c || '/' || printf('%08x', CAST({crc("le")} AS BIGINT)) AS feature, 'raw ' AS codec, CAST(n AS DOUBLE) / 8000 AS duration_s, c AS keyframes,
  md5('[' || array_to_string(list_transform(places, lambda a: '{{"offset":' || a || ',"length":64}}'), ',') || ']') AS keyframes_md5 FROM f"""


LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT *, translate(regexp_extract(line, '(?s)^[\x20\x09-\x0D]*(.*?)[\x20\x09-\x0D]*$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""


def means(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """SQL of the clusters: each round compares every vector with every centroid."""
    near = "SELECT a.id, arg_min(c.c, ROW(CAST(list_sum(list_transform(range(1, {d} + 1), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i]))) AS HUGEINT), c.c)) AS c FROM x a, c{r} c GROUP BY a.id".replace("{d}", str(dim))
    parts = [
        f"""x AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(1024.0::DOUBLE * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM x ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.replace('{r}', str(r))})")
        parts.append(
            f"""s{r} AS (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS e, unnest(range({dim})) AS i FROM x JOIN a{r} USING (id)) GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""
        )
    last = f"a{rounds} AS ({near.replace('{r}', str(rounds))})"
    done = f"""o AS (SELECT x.vec_id, a.c, CAST(list_sum(list_transform(range(1, {dim + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS BIGINT) AS distance, sha256(array_to_string(c.v, ',')) AS h
  FROM x JOIN a{rounds} a USING (id) JOIN c{rounds} c ON c.c = a.c)"""
    return (
        "WITH " + ",\n".join([*parts, last, done]) + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256,
  count(*) OVER (PARTITION BY c) AS size FROM o"""
    )


NEGATIVES = r"""
WITH x AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, len(embedding) AS dim, list_transform(embedding, lambda e: floor(256.0::DOUBLE * CAST(e AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND a.dim = b.dim),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 10"""
