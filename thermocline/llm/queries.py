"""One query per operator, over the whole of its table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.llm import decontaminate, fingerprint, licenses, minhash, mixing, pii, sharding, simhash, spelling, suffixes, tokens, toxicity, trie
from thermocline.llm.common import read

TOKENIZER = "byte_bpe_50k.json"
#: Stands for a secret that a deployment reads from its key store.
PII_KEY = "demonstration key"
SHARDS = 16


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_report(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "license", F.size("unresolved").cast("long").alias("n_unresolved"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), SHARDS, keep=["doc_id", "source"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, weights)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.with_shared_heads(trie.sequences(read(spark, sf_dir, "conversations"))))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_token_files, op3_decontaminate, op4_mix, op5_licenses, op6_shards, op7_pseudonyms, op8_simhash, op9_repeats, op10_toxicity, op11_minhash, op12_prefix_trie, op13_spelling)}


def _license_sql() -> str:
    """Sentences by split and map lookup, then one step per rule: take its matches away, note its name as often."""
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in licenses.SENTENCES.items()) + "}"
    steps = [
        rf"""s AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\n|[.!?;:]\s|[()]'),
          lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS said FROM documents)""",
        f"i AS (SELECT doc_id, list_filter(list_transform(said, lambda x: {known}[x]), lambda x: x IS NOT NULL) AS ids FROM s)",
        "r0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: ' ' || x || ' '), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM i)",
    ]
    for n, (name, ids) in enumerate(licenses.RULES, 1):
        rule = r"((?: \S+ )*?)".join(f" {x} " for x in ids)
        keep = "".join(f"\\{k}" for k in range(1, len(ids)))
        steps.append(
            f"r{n} AS (SELECT doc_id, ids, regexp_replace(rest, '{rule}', '{keep}', 'g') AS rest,"
            f" list_concat(found, list_transform(regexp_extract_all(rest, '{rule}'), lambda x: '{name}')) AS found FROM r{n - 1})"
        )
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses,"
        " found[1] AS license, CAST(len(list_filter(string_split(rest, ' '), lambda x: x <> '')) AS BIGINT) AS n_unresolved"
        f" FROM r{len(licenses.RULES)}"
    )


def _crc32_sql(codes: str) -> str:
    """Unsigned CRC-32 of a list of byte values, four bits at a time."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        table.append(n)
    half = f"(xor(%s >> 4, ({table})[CAST(xor(%s, %s) & 15 AS INTEGER) + 1]))"
    first = half % ("a", "a", "b")
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda a, b: {half % (first, first, '(b >> 4)')}), 4294967295)"


def _latin_codes_sql(s: str) -> str:
    """UTF-8 byte values of a string whose characters are below U+0100."""
    return f"flatten(list_transform(string_split({s}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    # shingle sets, pairs by their common shingles, components by reachability
    "op11_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT reach.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, reach.doc_id = min(r) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
""",
    # rebuilt turns; a prefix is the digests of its turns end to end, so ancestors are its beginnings
    "op12_prefix_trie": rf"""
WITH t AS (SELECT conv_id AS c, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_crc32_sql(_latin_codes_sql("CAST(c AS VARCHAR)"))} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
heads AS (SELECT ids.c, t.i, t.m, t.w FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND t.i <= ids.h),
sizes AS (SELECT ids.c, h, coalesce(n, 0) AS n FROM ids LEFT JOIN (SELECT c, count(*) AS n FROM heads GROUP BY 1) x ON x.c = ids.c),
turns AS (SELECT * FROM heads UNION ALL SELECT t.c, n + t.i - h, m, w FROM t JOIN sizes ON sizes.c = t.c AND t.i > h),
members AS (SELECT c, CAST(0 AS BIGINT) AS d, '' AS k, 0 AS w FROM ids
            UNION ALL SELECT c, i, string_agg(m, '') OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w FROM turns),
lasts AS (SELECT c, max(d) AS last FROM members GROUP BY 1),
node AS (SELECT k, d, min(members.c) AS c, count(*) AS n, max(w) AS w, string_agg(CASE WHEN d = last THEN CAST(members.c AS VARCHAR) END, ',' ORDER BY members.c) AS ends FROM members JOIN lasts ON lasts.c = members.c GROUP BY 1, 2),
kids AS (SELECT substr(k, 1, CAST(32 * (d - 1) AS BIGINT)) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (SELECT substr(x.k, 1, CAST(32 * up AS BIGINT)) AS k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.w) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM node) x LEFT JOIN kids ON kids.k = x.k GROUP BY 1)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below ON below.k = node.k LEFT JOIN kids ON kids.k = node.k LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.k = substr(node.k, 1, CAST(32 * (node.d - 1) AS BIGINT))
""",
    # words one edit apart agree after one deletion: at the same place (replaced), or in one of them only
    "op13_spelling": rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS r FROM documents),
one AS (SELECT doc_id, r, count(*) AS n FROM d WHERE length(r) >= 6 GROUP BY 1, 2),
hashed AS (SELECT r, n, {_crc32_sql(_latin_codes_sql("CAST(doc_id AS VARCHAR) || ':' || r"))} AS h FROM one),
said AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS i FROM pairs),
known AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 5 * words.n THEN b END AS form, CASE WHEN ranked.n >= 5 * words.n THEN ranked.n END AS form_n
          FROM words LEFT JOIN ranked ON ranked.a = words.word AND ranked.i = 1),
steps AS (SELECT word, word AS root FROM known UNION SELECT steps.word, known.form FROM steps JOIN known ON known.word = steps.root WHERE known.form IS NOT NULL),
roots AS (SELECT steps.word, steps.root FROM steps JOIN known ON known.word = steps.root WHERE known.form IS NULL)
SELECT known.word, form, root, n, n_near, form_n FROM known JOIN roots ON roots.word = known.word
""",
    "op5_licenses": _license_sql(),
    # words with their places; windows of 13 (or all words of a shorter item) as strings; hits by join
    "op3_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item FROM grams g JOIN win ON g.s = win.s AND g.n = win.n),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    # every 50-byte string as hex digits, the smallest document it starts in, and the bytes it covers
    "op9_repeats": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
firsts AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM starts),
edges AS (SELECT doc_id, x, sum(c) AS c FROM (SELECT doc_id, p AS x, 1 AS c FROM firsts WHERE f < doc_id UNION ALL SELECT doc_id, p + 50, -1 FROM firsts WHERE f < doc_id) GROUP BY 1, 2),
depth AS (SELECT doc_id, x, sum(c) OVER w AS up FROM edges WINDOW w AS (PARTITION BY doc_id ORDER BY x)),
before AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY doc_id ORDER BY x), 0) AS was FROM depth),
spans AS (SELECT doc_id, x AS a, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY x), -1) AS z, up FROM before WHERE (was = 0) <> (up = 0)),
gone AS (SELECT doc_id, a, z FROM spans WHERE up > 0),
pieces AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM gone),
sums AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS rest, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS kept FROM pieces JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(d.h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
""",
}
