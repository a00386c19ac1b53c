"""The operators as registered queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A dated list for the pages of the test tables, whose hosts are invented.
URL_ENTRIES = [
    ("casino-win.example.com", "block", "2024-02-01"),
    ("casino-win.example.com", "remove", "2024-09-15"),
    ("free-bets.example.com", "block", "2024-01-01"),
    ("cheap-pills.example.com", "block", "2024-03-10"),
    ("cheap-pills.example.com", "allow", "2024-06-01"),
    ("cheap-pills.example.com", "block", "2024-11-01"),
    ("example.org", "block", "2024-05-01"),
    ("example.org", "remove", "2024-05-20"),
    ("blog.tionsh.example.com/en", "block", "2024-04-01"),
    ("tionsh.example.com", "allow", "2024-01-01"),
    ("example.net", "allow", "2024-01-01"),
    ("m.ththth.example.net", "block", "2024-07-01"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no fetch times; each page gets a day of 2024 by its id."""
    from .urls import judge

    entries = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("action"), F.lit(d).cast("date").alias("since")) for p, a, d in URL_ENTRIES))))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_at"))
    return judge(pages, entries).withColumn("fetched_at", F.col("fetched_at").cast("string"))


def _op1_sql() -> str:
    entries = ", ".join(f"('{p}', '{a}', date '{d}')" for p, a, d in URL_ENTRIES)
    return f"""
WITH e(pattern, action, since) AS (VALUES {entries}),
i AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM e),
c AS (SELECT page_id, url, date '2024-01-01' + cast((page_id * 37) % 365 AS int) AS day,
        lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, pattern, action, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC) AS rn FROM c JOIN i
        ON action <> 'remove' AND since <= day AND (until IS NULL OR day < until)
       AND (host = pattern OR ends_with(host, '.' || pattern) OR starts_with(rtrim(host || path, '/') || '/', pattern || '/')))
SELECT c.page_id, url, cast(day AS date)::varchar AS fetched_at, pattern, action, coalesce(action = 'block', false) AS blocked FROM c LEFT JOIN m ON c.page_id = m.page_id AND rn = 1
"""


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import render

    return render(table(spark, sf_dir, "conversations"))


_OP5_SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t),
c AS (SELECT conv_id, list(role || chr(10) || text ORDER BY place) AS l, count(*) AS n FROM s GROUP BY conv_id),
shorter AS (SELECT DISTINCT l[1 : k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id FROM c ANTI JOIN shorter USING (l) GROUP BY l)
SELECT conv_id, cast((place - 1) // 1024 AS int) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM s JOIN kept USING (conv_id) GROUP BY 1, 2
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import digested, pack

    return digested(pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    first, last = (f("places").cast("long") for f in (F.array_min, F.array_max))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _op6_sql() -> str:
    from .licenses import PHRASES, TEMPLATES, THRESHOLD, required, span

    folded = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"regexp_extract_all({folded}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({k}, '{label}', {span(text)}, '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    musts = ", ".join(f"({k}, '{w}')" for k, ws in enumerate(required(TEMPLATES)) for w in sorted(ws))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {split.format('text')} AS w FROM documents),
p(phrase, k, label) AS (VALUES {phrases}),
places AS (SELECT r, label, i - 1 AS pos FROM (SELECT r, w, phrase, k, label, unnest(range(1, len(w) - k + 2)) AS i FROM d, p WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')) WHERE array_to_string(w[i : i + k - 1], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
t0(k, label, width, text) AS (VALUES {templates}),
musts(k, word) AS (VALUES {musts}),
t1 AS (SELECT DISTINCT k, label, width, unnest({split.format('text')}) AS word FROM t0),
t AS (SELECT k, label, width, word, m.word IS NOT NULL AS must, count(*) OVER (PARTITION BY k) AS n, count(m.word) OVER (PARTITION BY k) AS n_must FROM t1 LEFT JOIN musts m USING (k, word)),
dw AS (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
hits AS (SELECT r, k, label, n, n_must, width, pos, word, must FROM dw JOIN t USING (word)),
likely AS (SELECT r, k FROM hits GROUP BY r, k HAVING count(DISTINCT word) >= ceil({THRESHOLD} * any_value(n))),
block AS (SELECT r, label, n, n_must, count(DISTINCT word) OVER run AS c, count(DISTINCT CASE WHEN must THEN word END) OVER run AS c_must FROM hits JOIN likely USING (r, k)
          WINDOW run AS (PARTITION BY r, k ORDER BY pos RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING)),
ok AS (SELECT r, label, c / n AS containment FROM block WHERE c >= ceil({THRESHOLD} * n) AND c_must = n_must),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM ok UNION SELECT r, label FROM places) GROUP BY r),
best AS (SELECT r, max(containment) AS score FROM ok GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_base, 0) AS bigint) AS n_base, cast(first_word AS bigint) AS first_word, cast(last_word AS bigint) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN labels USING (r) LEFT JOIN best USING (r)
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import search

    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about a tenth of the documents go on periodically from some word on, as the contract of op11 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.where(h % 10 == 0).select("doc_id", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w").cast("long")).where("n > 0")
    placed = chosen.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.array_join(F.expr("transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)]))"), " ")
    whole = docs.where(F.coalesce(h % 10 != 0, F.lit(True)) | ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text")
    return whole.union(placed.select("doc_id", text.alias("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import find_runs

    found = find_runs(_with_periods(table(spark, sf_dir, "documents")))
    # Runs are by start and period, so of equal exponents the first one stays.
    longer = "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (m, x) -> if(m is null or x.length * m.period > m.length * x.period, x, m))"
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))))
    best = found.withColumn("b", F.expr(longer))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"b.{c}").alias(c) for c in ("start", "length", "period")), F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


#: A run of period q is a row of words that each come again q words later. DuckDB has no CRC, so it is made bit by bit.
_OP11_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             list_reduce(list_concat([4294967295], flatten([[cast(ascii(c) AS bigint), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(cast(doc_id AS varchar), '')])),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS crc FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, xor(crc, 4294967295) % 10 = 0 AS made, xor(crc, 4294967295) // 10 AS g FROM t),
p AS (SELECT r, doc_id, w, n, made AND n > 0 AS made, g % nullif(n, 0) AS a, 1 + (n - g % nullif(n, 0)) // (3 + g % 8) AS p FROM h),
d AS (SELECT r, doc_id, n, CASE WHEN made THEN [w[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END] FOR i IN range(n)] ELSE w END AS w FROM p),
x AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
eq AS (SELECT u.r, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.r = v.r AND u.word = v.word AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
isl AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM eq),
st AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM isl GROUP BY r, q, grp HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, len, min(q) AS q FROM st GROUP BY r, s, len),
agg AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS txt FROM run GROUP BY r),
best AS (SELECT a.r, a.s, a.len, a.q FROM run a ANTI JOIN run b ON a.r = b.r AND (b.len * a.q > a.len * b.q OR (b.len * a.q = a.len * b.q AND (b.s, b.q) < (a.s, a.q)))),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM run),
coll AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS txt FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::bigint AS n_runs, best.s::bigint AS start, best.len::bigint AS length, best.q::bigint AS period, (1000 * best.len // best.q)::bigint AS exponent_milli,
       sha256(coalesce(agg.txt, '')) AS runs_sha256, sha256(coalesce(coll.txt, '')) AS collapsed_sha256
FROM d LEFT JOIN agg USING (r) LEFT JOIN best USING (r) LEFT JOIN coll USING (r)
"""


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setjoin import similar_sets

    return similar_sets(table(spark, sf_dir, "documents")).drop("kept")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import fit, identity_error, whiten, whole_numbers

    x = whole_numbers(table(spark, sf_dir, "embeddings"))
    f = fit(x)
    rows = whiten(x, f).select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.get(F.array(*(F.lit(float(v / f.trace)) for v in f.values)).cast("array<double>"), F.col("k"))
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(f.sums.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        share.alias("explained"), F.lit(identity_error(x, f)).alias("identity_error"),
    )


def _linked_sql(percent: int, kept: str) -> str:
    """Components of documents whose sets of 5-word shingles are similar; equal sets are one node."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS sh FROM d),
g AS (SELECT sh, min(doc_id) AS node, len(sh) AS n FROM s WHERE len(sh) > 0 AND doc_id IS NOT NULL GROUP BY sh),
it AS (SELECT node, n, unnest(sh) AS item FROM g),
links AS (SELECT x.node AS a, y.node AS b FROM it x JOIN it y USING (item) WHERE x.node < y.node GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS m FROM g UNION SELECT b, m FROM reach JOIN both_ways ON a = node),
comp AS (SELECT node, min(m) AS component_id FROM reach GROUP BY node)
SELECT doc_id, cast(len(s.sh) AS bigint) AS n_shingles, coalesce(component_id, doc_id) AS component_id{kept} FROM s LEFT JOIN g USING (sh) LEFT JOIN comp USING (node)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op5_chat_formatting": op5_chat_formatting,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op6_license_scans": op6_license_scans,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_embedding_whitening": op13_embedding_whitening,
}
SQL: dict[str, str] = {
    "op1_url_filters": _op1_sql(),
    "op5_chat_formatting": _OP5_SQL,
    "op6_license_scans": _op6_sql(),
    "op9_minhash_near_dedup": _linked_sql(85, ", coalesce(component_id, doc_id) = doc_id AS kept"),
    "op11_periodic_runs": _OP11_SQL,
    "op12_ngram_jaccard_join": _linked_sql(80, ""),
    "op7_benchmark_decontamination": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(cast(item_id AS varchar), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[j : j + k - 1], ' ') AS t FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM bw)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, j, k, array_to_string(w[j : j + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, j, k, item FROM dw JOIN win USING (k, t)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(j, j + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
""",
}
