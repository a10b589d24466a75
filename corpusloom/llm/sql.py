"""DuckDB SQL for the rows of op1, op3, op5, op11 and op13, by other ways than the operators': all token sets, all runs, all 100-byte
strings, checksums by half bytes, words with a letter left out."""

from __future__ import annotations

from . import licenses, resampling, spelling, suffixes, urls


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_tokens(source: str) -> str:
    """The sorted distinct tokens of `url`, with the parts of the url, for every row of `source`."""
    return f"""SELECT *, list_sort(list_distinct(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x)
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '0', 'g'))
    || list_transform(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1, 's'), ''), '&'), lambda x: x <> ''), lambda x: 'query:' || split_part(x, '=', 1)))) AS tokens
  FROM (SELECT *, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM {source})"""


def _sets(of: str) -> str:
    """Every non-empty subset of the tokens of each row of `of`."""
    return f"SELECT *, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS s FROM (SELECT *, unnest(range(1, 1 << len(tokens))) AS mask FROM {of})"


def url_filter(rules: list[tuple[str, str, str]], support: float = urls.SUPPORT, confidence: float = urls.CONFIDENCE) -> str:
    hand = ", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in rules)
    return f"""
WITH p AS ({_url_tokens('pages')}),
told AS (SELECT p.tokens, coalesce(l.quality = 0, false) OR coalesce(l.toxic = 1, false) AS block FROM p JOIN labels l ON p.page_id = l.doc_id
  WHERE p.url IS NOT NULL AND (l.quality IS NOT NULL AND l.toxic IS NOT NULL OR l.quality = 0 OR l.toxic = 1)),
n AS (SELECT count(*) AS n FROM told WHERE block OR len(tokens) > 0),
mined AS (SELECT s, count(*) FILTER (WHERE block) / count(*) AS confidence FROM ({_sets('told')}) GROUP BY s
  HAVING count(*) FILTER (WHERE block) >= greatest({urls.LEAST_ROWS}, ceil({support} * (SELECT n FROM n))) AND count(*) FILTER (WHERE block) / count(*) >= {confidence}),
surest AS (SELECT url, max(confidence) AS confidence FROM ({_sets('(SELECT DISTINCT url, tokens FROM p WHERE url IS NOT NULL)')}) JOIN mined USING (s) GROUP BY url),
hand AS (SELECT * FROM (VALUES {hand}) AS r(verdict, h, p)),
fits AS (SELECT page_id, arg_max(h || hand.p, length(h || hand.p)) AS rule, arg_max(verdict, length(h || hand.p)) AS verdict
  FROM p JOIN hand ON (host = h OR suffix(host, '.' || h)) AND prefix(path, hand.p) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, fits.rule, coalesce(fits.verdict, CASE WHEN surest.confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, surest.confidence
FROM p LEFT JOIN fits USING (page_id) LEFT JOIN surest USING (url)"""


def license_scan(texts: dict[str, str] | None = None) -> str:
    templates = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in (texts or licenses.texts()).items())
    words = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')".format
    k = licenses.SHINGLE
    shingles = f"SELECT {{0}}, i, list_slice(w, i + 1, i + {k}) AS s FROM (SELECT {{0}}, w, unnest(range(0, len(w) - {k - 1})) AS i FROM {{1}})".format
    return f"""
WITH raw AS (SELECT * FROM (VALUES {templates}) AS t(license, template)),
tw AS (SELECT license, {words('template')} AS w FROM raw),
own AS (SELECT DISTINCT license, s FROM ({shingles('license', 'tw')})),
size AS (SELECT license, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS longest FROM own GROUP BY license),
dw AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
hits AS (SELECT doc_id, license, i, s, n, longest FROM ({shingles('doc_id', 'dw')}) JOIN own USING (s) JOIN size USING (license)),
runs AS (SELECT a.doc_id, a.license, a.i, any_value(a.n) AS n, count(DISTINCT b.s) AS held, min(b.i) AS start
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.license = b.license AND b.i <= a.i AND b.i > a.i - a.longest GROUP BY a.doc_id, a.license, a.i)
SELECT doc_id, license, max(held) / any_value(n) AS containment, CAST(min(start) FILTER (WHERE held >= {licenses.CONTAINMENT} * n - 1e-9) AS BIGINT) AS first_word
FROM runs GROUP BY doc_id, license HAVING max(held) >= {licenses.CONTAINMENT} * any_value(n) - 1e-9"""


def suffix_dedup(length: int = suffixes.LENGTH, block: int = 400) -> str:
    """Hexadecimal text is cut into blocks first, as finding a place in a string takes time by its length."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, n, k, substr(x, 2 * {block} * k + 1, 2 * ({block} + {length} - 1)) AS y FROM (SELECT *, unnest(range(0, n // {block} + 1)) AS k FROM d WHERE n >= {length})),
w AS (SELECT doc_id, {block} * k + j AS i, md5_number(substr(y, 2 * j + 1, {2 * length})) AS s FROM (SELECT *, unnest(range(0, {block})) AS j FROM b) WHERE {block} * k + j + {length} <= n),
f AS (SELECT s, min({{'doc_id': doc_id, 'i': i}}) AS first FROM w GROUP BY s HAVING count(*) > 1),
again AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN f USING (s) WHERE {{'doc_id': doc_id, 'i': i}} <> first),
runs AS (SELECT doc_id, i, sum(CASE WHEN gap <= {length} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM again),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS z FROM runs GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS y
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _crc32(text: str) -> str:
    """The crc32 of a text's UTF-8, by half bytes of its hexadecimal form and the table of 16 remainders."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (resampling.POLYNOMIAL if x & 1 else 0)
        table.append(x)
    nibbles = f"list_transform(range(0, length(hex(encode({text})))), lambda i: CAST(instr('0123456789ABCDEF', substr(hex(encode({text})), i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END, 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), lambda c, b: xor(c >> 4, (CAST({table} AS BIGINT[]))[(xor(c, b) & 15) + 1])), 4294967295::BIGINT)"


def importance_resampling(percent: int = resampling.PERCENT, least_words: int = resampling.LEAST_WORDS, seed: int = resampling.SEED, buckets: int = resampling.BUCKETS) -> str:
    lower = f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = "SELECT {0}unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM {1}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT r, f, count(*) AS n FROM ({grams.format("r, ", "d")}) GROUP BY r, f), bf AS (SELECT f, count(*) AS n FROM ({grams.format("", "b")}) GROUP BY f),
code AS MATERIALIZED (SELECT f, {_crc32("f")} % {buckets} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
src AS (SELECT bucket, sum(n) AS s FROM df JOIN code USING (f) GROUP BY bucket), tgt AS (SELECT bucket, sum(n) AS t FROM bf JOIN code USING (f) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM src)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM tgt)::DOUBLE AS t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(tgt.t, 0)::DOUBLE + 1) * (total.s + {buckets}) / ((src.s::DOUBLE + 1) * (total.t + {buckets})))) AS BIGINT) AS gain
  FROM src LEFT JOIN tgt USING (bucket), total),
told AS (SELECT r, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM df JOIN code USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN told USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= {least_words} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= {least_words}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {least_words} AND place <= {percent} * n // 100 THEN place END AS rank FROM ranked"""


def spelling_variants(slips: int = spelling.SLIPS, least_length: int = spelling.LEAST_LENGTH, least_count: int = spelling.LEAST_COUNT, ratio: int = spelling.RATIO) -> str:
    """Near words by those that are left when one letter goes: of both words for a replaced one, of the longer for an inserted one."""
    low = f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')"
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({low}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
told AS (SELECT run, count(*) AS n, doc_id FROM runs WHERE length(run) >= {least_length} GROUP BY doc_id, run),
coded AS (SELECT *, {_crc32("doc_id || ':' || run")} AS h FROM told),
slipped AS (SELECT CASE WHEN h % {slips} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM coded),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {least_length} GROUP BY word HAVING sum(n) >= {least_count}),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM less a JOIN words w ON a.rest = w.word UNION SELECT w.word, a.word, a.n FROM less a JOIN words w ON a.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM near GROUP BY word),
forms AS (SELECT w.word, CASE WHEN m >= {ratio} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root AND f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT c.word, c.root FROM chain c JOIN forms r ON r.word = c.root AND r.form IS NULL) c USING (word)"""
