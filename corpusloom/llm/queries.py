"""The operators as registered queries over the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, langid, lexical, license_scan, mixing, ngram_join, periodic, quality, rules, sharding, toxicity, urlfilter
from corpusloom.llm._sample import fold

TOKENIZER = "byte_bpe_50k.json"
N_SHARDS = 40
SEED = 20240501
BLOCK_RULES = ["com/en/", "example.net/de/8", "org/es/"]
ALLOW_RULES = ["example.com/en/7", "net/de/"]
#: Hosts that are blocked with all their subdomains where no rule fits.
BLOCKED_HOSTS = [
    f"{name}.example.{tld}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for tld in ("com", "net", "org")
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grades (see `quality.combined_grades`), learned from rows whose crc32(doc_id as text) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    grades = quality.combined_grades(table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    out = quality.judge(docs, quality.fit(docs, grades, "grade"), at_least=2.0, min_tail=0.4)
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out")
    return out.select("doc_id", held, "expected_grade", "tail_prob", "kept")


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, with_text=False)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), ngram_join.Spec(4, 85, 100))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, docs.where(fold("doc_id", 5) != 0).select("doc_id", "lang"))
    out = langid.identify(docs, model)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    return out.select("doc_id", held, "lang_pred", "score", "second_score", "ambiguous")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.ledger(rules.measure(table(spark, sf_dir, "documents")))
    base = ~rules.verdict("v1")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), rules.verdict("v2").alias("kept"), "fail_bits",
    )


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sharding.document_sizes(table(spark, sf_dir, "documents"))
    out = sharding.shard(sizes, N_SHARDS, ["doc_id", "text_crc32", "size"], SEED)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge_urls(table(spark, sf_dir, "pages"), BLOCK_RULES, ALLOW_RULES, BLOCKED_HOSTS)
    return out.select("page_id", "host", "path", "rule", "verdict", "listed_host")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        "rule", "license", "verdict",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontam.item_digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    out = toxicity.score(docs, toxicity.fit(docs, labels, "toxic"))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")), seed=SEED)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    index = lexical.build_index(table(spark, sf_dir, "documents"), only=lexical.term_bitmap(items))
    return lexical.search(index, items, 20)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(table(spark, sf_dir, "documents"), loop_key="crc32(cast(doc_id as string))")
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", periodic.runs_digest("runs").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the ledger's bits alone."""
    counts = rules.tally(rules.ledger(rules.measure(table(spark, sf_dir, "documents"))))
    parts = [rules.ablations(counts, v).withColumn("policy", F.lit(v)) for v in rules.POLICIES]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_bpe_tree, op3_ngram_jaccard, op4_language_id, op5_quality_rules, op6_feistel_shards,
        op7_url_filter, op8_license_scan, op9_decontamination, op10_toxicity, op11_pareto_mix, op12_lexical_search, op13_periodic_runs,
        rule_ablations,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), " + _AZ + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op3_sql() -> str:
    words = _WORDS.format(f"translate(coalesce(text, ''), {_AZ})")
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS c
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (n - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, k.y FROM reach r JOIN both_ways k ON r.b = k.x),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, low.component_id, coalesce(deg.n, 0)::BIGINT AS n_links
FROM s JOIN low ON low.a = s.doc_id LEFT JOIN deg ON deg.x = s.doc_id"""


def _op5_sql() -> str:
    at = {r.name: k for k, r in enumerate(rules.RULES)}
    bits = " + ".join(f"CASE WHEN {r.failed} THEN {1 << k} ELSE 0 END" for k, r in enumerate(rules.RULES))
    v2 = rules.mask(rules.POLICIES["v2"])
    assert at["too_few_words"] == 0
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS w, generate_subscripts({_WORDS.format('text')}, 1) AS i FROM t),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, CASE WHEN w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 THEN 1 ELSE 0 END AS rep FROM g),
c AS (SELECT doc_id, i, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM r),
rw AS (SELECT doc_id, sum(hit)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
      FROM t LEFT JOIN wc USING (doc_id) LEFT JOIN lc USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (fail_bits & {v2}) = 0 AS kept, fail_bits FROM b"""


def _ablations_sql() -> str:
    """Each rule of each policy tried on the measurements again, not on bits."""
    failed = {r.name: f"({r.failed})" for r in rules.RULES}
    parts = []
    for version, names in rules.POLICIES.items():
        for name in names:
            others = " OR ".join(failed[n] for n in names if n != name) or "false"
            parts.append(f"SELECT '{version}' AS policy, '{name}' AS rule, count(*) FILTER ({failed[name]}) AS n_failed, count(*) FILTER ({failed[name]} AND NOT ({others})) AS n_only, "
                         f"count(*) FILTER (NOT ({others})) AS n_kept_without, count(*) FILTER (NOT ({others}) AND NOT {failed[name]}) AS n_kept FROM m")
    head = _op5_sql()
    return head[: head.index(",\nb AS (")] + "\n" + " UNION ALL ".join(parts)


def _crc_table() -> list[int]:
    crc = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        crc.append(n)
    return crc


def _op6_sql() -> str:
    """CRC-32 by a table over the bytes, row numbers, and the permutation: four rounds, again until the number is in range."""
    crc = _crc_table()

    def rounds(source: str) -> str:
        """(rn, x): x permuted once."""
        out = f"(SELECT rn, x >> b AS l, x & low AS r, b, low FROM {source})"
        for k, key in enumerate(sharding.round_keys(SEED)):
            m1, m2 = (sharding._MULTIPLIERS[(k + j) % 4] for j in (0, 1))
            out = f"(SELECT *, (r * {m1}::BIGINT + {key}) & 2147483647 AS y FROM {out})"
            out = f"(SELECT rn, r AS l, xor(l, ((xor(y, y >> 15) * {m2}::BIGINT) >> 16) & low) AS r, b, low FROM {out})"
        return f"(SELECT rn, (l << b) | r AS x, b, low FROM {out})"

    return f"""
WITH RECURSIVE tab AS (SELECT {crc}::BIGINT[] AS t),
h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))),
  '..'), lambda p: ('0x' || p)::BIGINT) AS bs FROM documents),
c AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, x: xor(a >> 8, t[(xor(a,
  x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM h, tab),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rn FROM c),
z AS (SELECT count(*) AS n, greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2)::BIGINT AS b FROM c),
w AS (SELECT rn, x, b, low FROM {rounds("(SELECT rn, rn AS x, b, (1::BIGINT << b) - 1 AS low FROM o, z)")}
  UNION ALL SELECT rn, x, b, low FROM {rounds("(SELECT w.* FROM w, z WHERE x >= z.n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {N_SHARDS})::INT AS shard, x // {N_SHARDS} AS slot, NULL::INT AS grown_shard FROM o
  JOIN w USING (rn), z WHERE w.x < z.n"""


def _op7_sql() -> str:
    found = []
    for r in [*BLOCK_RULES, *ALLOW_RULES]:
        host, path = r[: r.index("/")], r[r.index("/") :]
        found.append((len(r), r, "block" if r in BLOCK_RULES else "allow",
                      f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"))
    found.sort(key=lambda x: (-x[0], x[2] != "block", x[1]))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for _, r, _, c in found)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for _, _, v, c in found)
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_AZ}) AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
  CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict, ({listed}) AS listed_host FROM u"""


def _op8_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in license_scan.SENTENCES.items())
    cond = [(f"contains(run, ',{','.join(ids)},')", name, lic, verdict) for name, ids, lic, verdict in license_scan.RULES]
    pick = lambda k: " ".join(f"WHEN {c[0]} THEN '{c[k]}'" for c in cond)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS part,
        generate_subscripts(string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT s.doc_id, s.i, known.id FROM s JOIN known ON trim(regexp_replace(s.part, '[^a-z0-9]+', ' ', 'g')) = known.sentence),
q AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM k GROUP BY doc_id),
d AS (SELECT documents.doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, ',' || coalesce(ids, '') || ',' AS run
      FROM documents LEFT JOIN q ON q.doc_id = documents.doc_id)
SELECT doc_id, n::BIGINT AS n_sentences, ids AS sentence_ids, CASE {pick(1)} ELSE NULL END AS rule,
  CASE {pick(2)} ELSE NULL END AS license, CASE {pick(3)} WHEN n > 0 THEN 'unknown' ELSE 'none' END AS verdict FROM d"""


def _op9_sql() -> str:
    return rf"""
WITH iw AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
iv AS (SELECT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1),
  lambda i: array_to_string(ws[i:i + 9], ' '))) AS s
       FROM iw WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM iv),
dw AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
dv AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, unnest(list_transform(range(1, len(ws) - k + 2),
  lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS s
       FROM dw, ks WHERE len(ws) >= k),
h AS (SELECT DISTINCT dv.doc_id, dv.i, dv.k, iv.item_id FROM dv JOIN iv ON dv.k = iv.k AND dv.s = iv.s),
hp AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hp ON hp.doc_id = dw.doc_id LEFT JOIN hi ON hi.doc_id = dw.doc_id"""


def _op11_sql() -> str:
    def level(items: str, by: str, weight: str, cap: str, total: str) -> str:
        """Items that share a total by weight up to their caps: which are full, and what the rest share."""
        own = f"PARTITION BY {by} ORDER BY {cap} / nullif({weight}, 0) NULLS FIRST"
        placed = f"""(SELECT *, row_number() OVER o AS pos, {total} - coalesce(sum({cap}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
          0)::BIGINT AS avail, (sum({weight}) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS sum_w FROM {items} WINDOW o AS ({own}))"""
        fits = f"sum_w > 0 AND avail * {weight} <= {cap} * sum_w"
        firsts = f"(SELECT *, min(pos) FILTER ({fits}) OVER (PARTITION BY {by}) AS fit FROM {placed})"
        pick = f"any_value({{}}) FILTER (pos = fit) OVER (PARTITION BY {by})"
        return f"(SELECT * EXCLUDE (avail, sum_w), fit IS NULL OR pos < fit AS filled, {pick.format('avail')} AS avail, {pick.format('sum_w')} AS sum_w FROM {firsts})"

    goal = level("(SELECT *, (sum(source_size) OVER ())::BIGINT AS total, 3 * source_size AS cap, 1 AS one FROM s)", "one", "weight", "cap", "total")
    inner = level("(SELECT k.*, g.source_size, g.target, words * lev AS w, 3 * words AS cap FROM k JOIN g ON g.source IS NOT DISTINCT FROM k.source)", "source", "w", "cap", "target")
    u = f"((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}'), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
    run = "coalesce(sum({}) OVER (PARTITION BY source ORDER BY rk NULLS FIRST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"
    passes, last = "t0 AS (SELECT *, false AS took, gap AS rest FROM q),\n", "t0"
    for k in range(mixing.PASSES):
        near, new = (2 if k == mixing.PASSES - 1 else 1), f"t{k + 1}"
        may = f"(rk IS NOT NULL AND NOT took AND size <= {near} * rest)"
        words = run.format(f"CASE WHEN {may} THEN size END")
        passes += f"""n{k} AS (SELECT * EXCLUDE (took), took OR {may} AND {near} * {words} + size <= {near} * rest AS took FROM {last}),
{new} AS (SELECT * EXCLUDE (rest), gap - (sum(CASE WHEN took THEN size ELSE 0 END) OVER (PARTITION BY source))::BIGINT AS rest FROM n{k}),\n"""
        last = new
    return rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
c AS (SELECT *, least(8, 1 + size // 8)::BIGINT AS lev, {u} AS u FROM d),
k AS (SELECT source, lev, sum(size)::BIGINT AS words FROM c GROUP BY source, lev),
s AS (SELECT source, sum(words)::BIGINT AS source_size, ([1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT])::BIGINT AS weight
  FROM k GROUP BY source),
g AS (SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE (avail * weight)::DOUBLE / sum_w::DOUBLE END AS target FROM {goal}),
e AS (SELECT *, CASE WHEN words = 0 THEN 0::DOUBLE WHEN filled THEN 3::DOUBLE ELSE avail * lev / sum_w END AS want FROM {inner}),
r AS (SELECT source, any_value(target) - sum(floor(want)::BIGINT * words)::BIGINT AS gap FROM e GROUP BY source),
p AS (SELECT c.doc_id, c.source, c.size, e.source_size, e.target, r.gap, floor(e.want)::BIGINT AS whole, e.want - floor(e.want) AS p, u
  FROM c JOIN e ON e.source IS NOT DISTINCT FROM c.source AND e.lev = c.lev JOIN r ON r.source IS NOT DISTINCT FROM c.source),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rk FROM p),
{passes}z AS (SELECT *, whole + took::BIGINT AS copies FROM {last})
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM z"""


def _op12_sql() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), " + _AZ + r"), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH dt AS (SELECT doc_id, {terms} AS ts FROM documents),
st AS (SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM dt),
qt AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark) GROUP BY item_id, t),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM dt) SEMI JOIN qt USING (t) GROUP BY doc_id, n, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, st),
p AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS v FROM tf JOIN w USING (t), st),
s AS (SELECT item_id, doc_id, sum(r * v)::BIGINT AS score FROM qt JOIN p USING (t) GROUP BY item_id, doc_id),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 20"""


def _op13_sql() -> str:
    """Runs from all pairs of equal words: places i with word i = word i + q in a row, and the smallest q of a stretch."""
    return rf"""
WITH tab AS (SELECT {_crc_table()}::BIGINT[] AS t),
h0 AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(
  hex(encode(doc_id::VARCHAR)), '..'), lambda p: ('0x' || p)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS h
  FROM documents, tab),
h1 AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h0),
h2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM h1),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS ws
  FROM h2),
w AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS w FROM d),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e),
c AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, isle HAVING count(*) >= q AND count(*) + q >= 12),
r AS (SELECT doc_id, start, length, min(q) AS period FROM c GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS txt FROM w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  first(struct_pack(s := start, l := length, q := period) ORDER BY length DESC, start, period) AS best FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""


ORACLES = {
    "op11_pareto_mix": _op11_sql(),
    "op12_lexical_search": _op12_sql(),
    "op13_periodic_runs": _op13_sql(),
    "op3_ngram_jaccard": _op3_sql(),
    "op5_quality_rules": _op5_sql(),
    "op6_feistel_shards": _op6_sql(),
    "rule_ablations": _ablations_sql(),
    "op7_url_filter": _op7_sql(),
    "op8_license_scan": _op8_sql(),
    "op9_decontamination": _op9_sql(),
}
