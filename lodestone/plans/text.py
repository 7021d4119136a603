"""Queries on corpora, decisions and memories, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keywords, models, udtfs
from ..functions import scoring as sc
from ..functions import text as tx
from ..operators import ffd, memory, minhash, mixing
from ..operators.tables import Tables
from ..sources import versions
from .base import read, register

#: Words that the corpus holds; the default keywords of quant code do not occur in it.
WORDS = ["the", "und", "les", "que", "thing", "licensed"]
PATTERNS = [r"\bof\s+the\b", r"licen[cs]e", r"https?://"]


def _sql_word(w: str) -> str:
    return rf"CAST(regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])') AS INT)"


_KW = " + ".join(map(_sql_word, WORDS))
_HV = r"CAST(regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])of\s+the($|[^\p{L}\p{N}_])') AS INT) + CAST(regexp_matches(text, '(?i)licen[cs]e') AS INT) + CAST(regexp_matches(text, '(?i)https?://') AS INT)"
_VERDICT = rf"""
    d AS (
        SELECT doc_id, text, string_split(text, chr(10)) AS l, {_KW} AS kw, {_HV} AS hv FROM documents
    ), f AS (SELECT *, list_filter(l, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '') AS filled FROM d
    ), q AS (
        SELECT *, len(filled) AS n, len(list_filter(filled, lambda x: NOT starts_with(trim(x, ' ' || chr(9) || chr(13)), '#'))) AS code,
               lower(array_to_string(l[:10], chr(10))) AS head, coalesce(list_sum(list_transform(filled, lambda x: length(x))), 0) AS chars FROM f
    ), v AS (
        SELECT doc_id, text, kw, hv, CASE WHEN len(l) < 10 THEN 'too_short' WHEN len(l) > 2000 THEN 'too_long' WHEN kw + 2 * hv < 2 THEN 'no_keywords'
               WHEN n = 0 OR code < 0.3 * n OR contains(head, 'auto-generated') OR contains(head, 'autogenerated') OR contains(head, 'do not edit')
                    OR contains(head, 'generated by') OR contains(head, 'this file was generated') OR chars > 200 * n THEN 'low_quality' ELSE 'pass' END AS verdict FROM q
    )
"""
_PRIORITY = """round(least((least(kw + 2 * hv, 5) + 0.5 * hv + CASE WHEN contains(text, 'class ') THEN 0.5 ELSE 0 END + CASE WHEN contains(text, 'def ') THEN 0.5 ELSE 0 END
    + CASE WHEN contains(text, 'import ') THEN 0.25 ELSE 0 END + CASE WHEN contains(text, '\"\"\"') OR contains(text, '''''''') THEN 0.5 ELSE 0 END
    + CASE WHEN contains(text, ' -> ') OR contains(text, ': ') THEN 0.25 ELSE 0 END) / 10, 1), 6)"""


def _judged(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text", tx.verdict(F.col("text"), WORDS, PATTERNS).alias("verdict"))


@register(f"WITH {_VERDICT} SELECT doc_id, verdict FROM v")
def corpus_filter_verdict(spark, sf):
    return _judged(spark, sf).select("doc_id", "verdict")


@register(f"WITH {_VERDICT} SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 6) AS share FROM v GROUP BY verdict")
def corpus_filter_stats(spark, sf):
    counts = _judged(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("verdict", "n", F.round(F.try_divide("n", "total"), 6).alias("share"))


@register(f"WITH {_VERDICT} SELECT doc_id, CAST({_PRIORITY} AS DOUBLE) AS priority FROM v")
def corpus_priority_score(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(tx.priority(F.col("text"), WORDS, PATTERNS), 6).alias("priority"))


@register(f"WITH {_VERDICT} SELECT doc_id, CAST({_PRIORITY} AS DOUBLE) AS priority FROM v WHERE verdict = 'pass' ORDER BY 2 DESC, 1")
def corpus_filter_ranked(spark, sf):
    """Texts are scored once; the sort moves ids and priorities alone."""
    text, words, high = F.col("text"), F.col("words"), F.col("high")
    counted = read(spark, sf, "documents").select("doc_id", "text", tx.hits(text, [tx.words_pattern(w) for w in WORDS]).alias("words"), tx.hits(text, ["(?i)" + p for p in PATTERNS]).alias("high"))
    passed = counted.where(tx.verdict(text, WORDS, PATTERNS, score=words + 2 * high) == "pass")
    scored = Tables(spark, "ranked").write(passed.select("doc_id", F.round(tx.priority(text, WORDS, PATTERNS, (words, high)), 6).alias("priority")), "scored")
    return scored.orderBy(F.col("priority").desc(), "doc_id")


def _default_sql(column: str) -> str:
    edge = "[^\\p{L}\\p{N}_]"

    def word(w: str) -> str:
        escaped = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in w)
        begin = f"(^|{edge})" if w[0].isalnum() or w[0] == "_" else "[\\p{L}\\p{N}_]"
        end = f"($|{edge})" if w[-1].isalnum() or w[-1] == "_" else "[\\p{L}\\p{N}_]"
        return f"CAST(regexp_matches({column}, '(?i){begin}{escaped}{end}') AS INT)"

    words = " + ".join(map(word, tx.KEYWORDS))
    high = " + ".join(f"CAST(regexp_matches({column}, '(?i){p}') AS INT)" for p in tx.HIGH_VALUE)
    return f"{words} AS words, {high} AS high"


#: What stands behind a document's text in the query on the default lists, by doc_id: most words are tried, some only as parts of others.
_QUANT = ["class MyStrategy(Base):\n  def next ( self", "gramian angular field, GASF", "import talib; TA_RSI(x) bt.Cerebro", "the sharpe_ratio and max drawdown", "self.observation_space; env.step (a)", "def compute_signal(x): def on_bar(", "class ABacktestStrategyTradingEnv", "signals indicators emaX"]
_QUANT_SQL = "text || chr(10) || list_extract(['" + "', '".join(q.replace("\n", "' || chr(10) || '") for q in _QUANT) + "'], CAST(doc_id % 8 AS INT) + 1) || ' ' || list_extract(['" + "', '".join(tx.KEYWORDS) + "'], CAST(doc_id % 71 AS INT) + 1) || ' ' || source"


@register(f"""
    WITH q AS (SELECT doc_id, {_QUANT_SQL} AS t FROM documents), c AS (SELECT doc_id, t, {_default_sql("t")} FROM q)
    SELECT doc_id, CAST(words AS INT) AS words, CAST(high AS INT) AS high, CAST(words + 2 * high AS INT) AS score, words + 2 * high >= 2 AS passes FROM c
""")
def corpus_keywords_default(spark, sf):
    """The default lists, 71 words and 16 patterns, counted in one pass over texts of which some hold them."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    text = F.concat("text", F.lit("\n"), pick(_QUANT, 8), F.lit(" "), pick(tx.KEYWORDS, 71), F.lit(" "), "source")
    found = keywords.scored(read(spark, sf, "documents").select("doc_id", text.alias("text")), tx.KEYWORDS, tx.HIGH_VALUE)
    return found.select("doc_id", "words", "high", "score", (F.col("score") >= 2).alias("passes"))


@register(f"WITH {_VERDICT} SELECT doc_id FROM v WHERE verdict = 'pass' ORDER BY doc_id LIMIT 100")
def filtered_samples(spark, sf):
    """The first 100 documents that pass the filter: the cap counts what passes."""
    return mixing.first_passing(_judged(spark, sf), F.col("verdict") == "pass", "doc_id", 100).select("doc_id")


_CODE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'import talib' || chr(10) || 'class A:' || chr(10) WHEN 1 THEN 'from gymnasium import x' || chr(10) || 'def f(): pass' || chr(10) WHEN 2 THEN 'IMPORT  ccxt' || chr(10) ELSE '' END || text"


def _code(spark, sf):
    head = F.element_at(F.array(F.lit("import talib\nclass A:\n"), F.lit("from gymnasium import x\ndef f(): pass\n"), F.lit("IMPORT  ccxt\n"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("code"))


@register(f"""WITH c AS (SELECT doc_id, {_CODE_SQL} AS code FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(code, '(?i)import\\s+{n}|from\\s+{n}') THEN '{n}' END" for n in tx.IMPORTS)}], lambda x: x IS NOT NULL)), ',') AS imports FROM c""")
def import_extract(spark, sf):
    return _code(spark, sf).select("doc_id", F.array_join(tx.imports(F.col("code")), ",").alias("imports"))


@register(f"""WITH c AS (SELECT doc_id, {_CODE_SQL} AS code FROM documents)
    SELECT doc_id, contains(code, 'class ') AS has_class, contains(code, 'def ') AS has_function, len(string_split(code, chr(10))) AS line_count,
           contains(code, '\"\"\"') OR contains(code, '''''''') AS has_docstring FROM c""")
def content_analysis(spark, sf):
    c = F.col("code")
    return _code(spark, sf).select("doc_id", c.contains("class ").alias("has_class"), c.contains("def ").alias("has_function"), F.size(tx.lines(c)).cast("long").alias("line_count"), tx.docstring(c).alias("has_docstring"))


@register(f"SELECT doc_id, len(string_split(text, chr(10))) BETWEEN 10 AND 1000 AND {_KW} >= 2 AS passes FROM documents")
def corpus_light_filter(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.light_pass(F.col("text"), WORDS).alias("passes"))


#: Replies of a model with and without fences; ~ stands for a line break.
REPLIES = ["Here:~```python~import pandas as pd~def s(d): return 'long'~```~done", 'def s(d): return "flat"', "x = 1```y", "from a import numpy~return"]
_REPLY_SQL = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN replace('{r.replace(chr(39), chr(39) * 2)}', '~', chr(10))" for i, r in enumerate(REPLIES)) + " END"


@register(f"""
    WITH r AS (SELECT event_id, {_REPLY_SQL} AS reply FROM events), b AS (SELECT event_id, CASE WHEN contains(reply, '```python') THEN split_part(reply, '```python', 2) ELSE reply END AS behind FROM r),
    c AS (SELECT event_id, split_part(behind, '```', 1) AS code FROM b),
    p AS (SELECT event_id, CASE WHEN contains(code, 'import pandas as pd') THEN code ELSE 'import pandas as pd' || chr(10) || code END AS code FROM c),
    n AS (SELECT event_id, trim('import numpy as np' || chr(10) || code, ' ' || chr(10)) AS code FROM p)
    SELECT event_id, code, contains(code, 'def ') AND contains(code, 'return') AND (contains(code, '''long''') OR contains(code, chr(34) || 'flat' || chr(34))) AS is_strategy FROM n
""")
def code_cleanup(spark, sf):
    reply = F.element_at(F.array(*(F.lit(r.replace("~", "\n")) for r in REPLIES)), (F.col("event_id") % 4 + 1).cast("int"))
    code = tx.code_block(F.col("reply"))
    return read(spark, sf, "events").select("event_id", reply.alias("reply")).select("event_id", code.alias("code"), tx.strategy_shape(code).alias("is_strategy"))


@register("""
    SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN '### Instruction:' || chr(10) || source || chr(10) || chr(10) || '### Response:' || chr(10) || text
           WHEN 1 THEN '### Question:' || chr(10) || source || chr(10) || chr(10) || '### Answer:' || chr(10) || text WHEN 2 THEN text ELSE '{"other":"' || source || '"}' END) AS md5 FROM documents
""")
def finance_samples(spark, sf):
    k = F.col("doc_id") % 4
    only = lambda n, c: F.when(k == n, F.col(c))
    made = tx.sample_text(only(0, "source"), only(0, "text"), only(1, "source"), only(1, "text"), only(2, "text"), F.struct(F.col("source").alias("other")))
    return read(spark, sf, "documents").select("doc_id", F.md5(made).alias("md5"))


_NORM = r"trim(regexp_replace(lower(text), '[\s\x1c-\x1f]+', ' ', 'g'))"


@register(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {_NORM}")
def dedup_exact(spark, sf):
    norm = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[\s\x1c-\x1f]+", " ")).cast("binary"), 256)
    return read(spark, sf, "documents").groupBy(norm.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


def _signature_sql(grams: str) -> str:
    """CTEs: signatures s of the sets that ``grams`` lists for a normalised text t, their classes c, candidates p, verified pairs v."""
    return f"""
    t AS (SELECT doc_id, {_NORM} AS t FROM documents),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({grams}) AS g FROM t),
    h AS (SELECT g, i, CAST('0x' || substr(sha256(encode(g) || unhex(printf('%02x000000', 42 + i))), 1, 16) AS UBIGINT) AS h FROM (SELECT DISTINCT g FROM g), range(128) r(i)),
    m AS (SELECT doc_id, i, min(h) AS m FROM g JOIN h USING (g) GROUP BY doc_id, i),
    s AS MATERIALIZED (SELECT doc_id, list(m ORDER BY i) AS sig FROM m GROUP BY doc_id),
    c AS MATERIALIZED (SELECT sig, min(doc_id) AS doc_id, count(*) AS copies FROM s GROUP BY sig),
    k AS (SELECT doc_id, b, list_slice(sig, b * 8 + 1, b * 8 + 8) AS key FROM c, range(16) r(b)),
    p AS MATERIALIZED (SELECT DISTINCT x.doc_id AS lo, y.doc_id AS hi FROM k x JOIN k y USING (b, key) WHERE x.doc_id < y.doc_id),
    v AS MATERIALIZED (SELECT * FROM (
        SELECT lo, hi, len(list_filter(range(1, 129), lambda i: a.sig[i] = z.sig[i])) / 128.0 AS similarity FROM p JOIN c a ON a.doc_id = lo JOIN c z ON z.doc_id = hi) WHERE similarity >= 0.7),
    members AS (SELECT s.doc_id, c.doc_id AS representative, c.copies FROM s JOIN c USING (sig))"""


_GRAMS = _signature_sql("CASE WHEN length(t) >= 5 THEN list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) ELSE [t] END")
_WORD_SETS = _signature_sql("string_split(t, ' ')")


def _greedy_sql(pairs: str) -> str:
    """CTE ``decided`` (doc_id, kept): the nodes of the pairs are taken in order, one stays unless a lower one that stays is its partner."""
    return f"""
    e AS (SELECT hi, list(lo) AS lows FROM {pairs} GROUP BY hi),
    o AS MATERIALIZED (SELECT n.doc_id, e.lows, row_number() OVER (ORDER BY n.doc_id) AS r FROM (SELECT lo AS doc_id FROM {pairs} UNION SELECT hi FROM {pairs}) n LEFT JOIN e ON e.hi = n.doc_id),
    turn(r, kept) AS (
        SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
        UNION ALL SELECT o.r, CASE WHEN o.lows IS NOT NULL AND list_has_any(turn.kept, o.lows) THEN turn.kept ELSE list_append(turn.kept, o.doc_id) END FROM turn JOIN o ON o.r = turn.r + 1),
    stays AS (SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM turn ORDER BY r DESC LIMIT 1)),
    decided AS (SELECT doc_id, doc_id = representative AND (doc_id NOT IN (SELECT doc_id FROM o) OR doc_id IN (SELECT doc_id FROM stays)) AS kept FROM members)"""


def _linked_sql(pairs: str, own: str, similarity: str) -> str:
    return f"""WITH {_GRAMS}
    SELECT 'member' AS kind, doc_id, representative AS other, copies{own} FROM members UNION ALL SELECT 'pair', lo, hi, 0{similarity} FROM {pairs}"""


def _linked(spark, sf, pairs):
    tables = Tables(spark, "lsh")
    rows = minhash.signed_rows(read(spark, sf, "documents"), tables, 128, 5, 42, "sha256")
    nodes = minhash.classes(rows, tables)
    return minhash.linked(rows, nodes, pairs(minhash.candidates(tables.write(minhash.buckets(nodes, 128, 0.7), "buckets")), nodes))


@register(_linked_sql("p", "", ""))
def lsh_candidates(spark, sf):
    """Every document with its signature class, and the pairs of class representatives that share a band."""
    return _linked(spark, sf, lambda pairs, nodes: pairs)


@register(_linked_sql("v", ", CAST(1 AS DOUBLE) AS similarity", ", CAST(similarity AS DOUBLE)"))
def lsh_verified_pairs(spark, sf):
    """Every document with its signature class, and the pairs of class representatives that agree in 70 % of the positions."""
    return _linked(spark, sf, lambda pairs, nodes: minhash.similar(pairs, nodes, 128, 0.7))


@register(f"""WITH {_GRAMS} SELECT a.doc_id, len(list_filter(range(1, 129), lambda i: a.sig[i] = z.sig[i])) / CAST(128 AS DOUBLE) AS similarity FROM s a JOIN s z ON z.doc_id = a.doc_id + 1""")
def minhash_pair_similarity(spark, sf):
    """Share of equal positions of each document's signature and that of the next doc_id."""
    sigs = Tables(spark, "similarity").write(minhash.signatures(read(spark, sf, "documents")), "sigs")
    return minhash.pair_similarity(sigs, sigs.select((F.col("doc_id") - 1).alias("doc_id"), "sig"), 128, 128)


@register(f"""WITH {_GRAMS} SELECT source, i, printf('%016x', min(h)) AS low FROM g JOIN h USING (g) JOIN documents USING (doc_id) GROUP BY source, i""")
def minhash_source_signatures(spark, sf):
    """One signature for all texts of a source, from partial signatures that merge by minimum."""
    found = minhash.merged_signatures(read(spark, sf, "documents"), "source")
    return found.select("source", F.col("i").cast("long").alias("i"), F.lower(F.hex("low")).alias("low"))


@register(f"WITH RECURSIVE {_GRAMS}, {_greedy_sql('v')} SELECT doc_id, kept FROM decided")
def dedup_greedy(spark, sf):
    """With the reference's hash family, so that the same documents stay."""
    return minhash.dedup(read(spark, sf, "documents"))


@register(f"""WITH RECURSIVE {_GRAMS}, {_greedy_sql('v')}
    SELECT count(*) AS total, count(*) FILTER (NOT kept) AS duplicates, count(*) FILTER (kept) AS "unique", count(*) FILTER (NOT kept) / CAST(count(*) AS DOUBLE) AS rate FROM decided""")
def dedup_stats(spark, sf):
    return minhash.dedup_stats(minhash.dedup(read(spark, sf, "documents")))


def _mersenne_sql(num_perm: int, seed: int, shape: tuple[int, int]) -> str:
    """The tables of ``_signature_sql`` for word sets, with the other family and shape."""
    a, b = minhash.permutations(num_perm, seed)
    draws = ", ".join(f"({i}, CAST({x} AS HUGEINT), CAST({y} AS HUGEINT))" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    first = "substr(sha1(encode(g)), 7, 2) || substr(sha1(encode(g)), 5, 2) || substr(sha1(encode(g)), 3, 2) || substr(sha1(encode(g)), 1, 2)"
    hashed = f"h AS (SELECT g, i, CAST((a * x + b) % 18446744073709551616 % {minhash.PRIME} % {minhash.MAX_HASH + 1} AS UBIGINT) AS h FROM (SELECT g, CAST(CAST('0x' || {first} AS UBIGINT) AS HUGEINT) AS x FROM (SELECT DISTINCT g FROM g)), (VALUES {draws}) d(i, a, b)),"
    lines = [hashed if line.strip().startswith("h AS") else line.replace("b * 8 + 1, b * 8 + 8", f"b * {shape[1]} + 1, b * {shape[1]} + {shape[1]}").replace("range(16)", f"range({shape[0]})") for line in _WORD_SETS.split("\n")]
    return "\n".join(lines)


@register(f"WITH RECURSIVE {_mersenne_sql(128, 1, minhash.balanced_shape(128, 0.7))}, {_greedy_sql('p')} SELECT doc_id, kept FROM decided")
def dedup_words_balanced(spark, sf):
    """The light variant with its own hash family, permutations modulo a Mersenne prime, and bands that balance both areas of error."""
    return minhash.dedup(read(spark, sf, "documents"), ngram=0, seed=1, family="mersenne", verify=False, shape=minhash.balanced_shape(128, 0.7))


@register(f"WITH RECURSIVE {_WORD_SETS}, {_greedy_sql('p')} SELECT doc_id, kept FROM decided")
def dedup_words(spark, sf):
    """The light variant: words instead of n-grams, and any common band drops."""
    return minhash.dedup(read(spark, sf, "documents"), ngram=0, verify=False)


@register(None)
def corpus_pipeline(spark, sf):
    """Filter, first-wins dedup, priority, training format.

    Documents that pass are the code source, all others the finance source. Both are deduplicated against one index, code
    before finance; 5000 generated samples are added as they are.

    Rows are deduplicated by themselves, whatever their ids: see ``minhash.dedup``. Null texts count as empty. Words and patterns
    are looked for once a text; filter and priority share the counts.
    """
    tables = Tables(spark, "corpus")
    text, words, high = F.col("text"), F.col("words"), F.col("high")
    hits = lambda rows: rows.select("*", tx.hits(text, [tx.words_pattern(w) for w in WORDS]).alias("words"), tx.hits(text, ["(?i)" + p for p in PATTERNS]).alias("high"))
    passed = tx.verdict(text, WORDS, PATTERNS, score=words + 2 * high) == "pass"
    judged = hits(read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("place", F.when(passed, 0).otherwise(1))
    kept = minhash.dedup(judged, family="mix", carry=True, by="place").where("kept")
    rows = kept.select("doc_id", "text", F.when(F.col("place") == 0, "code").otherwise("cot").alias("source"), "words", "high")
    more = hits(mixing.synthetic(spark, 5000).select(F.col("sample_id").alias("doc_id"), "text", F.lit("synthetic").alias("source")))
    written = tables.write(rows.unionByName(more), "rows")
    priority = F.round(tx.priority(text, WORDS, PATTERNS, (words, high)), 6).alias("priority")
    return mixing.shuffled(written, "doc_id").select("doc_id", tx.phi_format(text, F.col("source")).alias("text"), "source", priority)


@register("""
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn, dense_rank() OVER (ORDER BY lang) AS place FROM documents)
    SELECT doc_id, lang, turn, place FROM r WHERE turn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
""")
def interleave_round_robin(spark, sf):
    mixed = mixing.interleave(read(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return mixed.select("doc_id", "lang", F.col("turn").cast("long"), F.col("place").cast("long"))


@register(None)
def ratio_mix(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "code").otherwise("finance").alias("origin"))
    return mixing.ratio_mix(rows, "origin", "doc_id", {"code": 0.5, "finance": 0.4})


@register(None)
def ratio_mix_twister(spark, sf):
    """The same mix by the draws of Python's generator: code where ``random()`` is under 0.5 / 0.9, else finance."""
    rows = read(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "code").otherwise("finance").alias("origin"))
    return mixing.ratio_mix(rows, "origin", "doc_id", {"code": 0.5, "finance": 0.4}, twister=True)


@register(None)
def synthetic_mix(spark, sf):
    return mixing.synthetic(spark, 5000).select("sample_id", "kind", "text")


_SOURCE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'cot' WHEN 2 THEN 'synthetic' ELSE 'x' END"


def _sources():
    return F.element_at(F.array(*map(F.lit, ["code", "cot", "synthetic", "x"])), (F.col("doc_id") % 4 + 1).cast("int"))


def _sql_template(templates: dict[str, str]) -> str:
    lit = lambda t: " || ".join(f"'{p}'" for p in t.split("\n") if True) if "\n" not in t else "replace('" + t.replace("'", "''").replace("\n", "\\n") + "', '\\n', chr(10))"
    arms = " ".join(f"WHEN s = '{k}' THEN {lit(v.split('{}')[0])} || text || {lit(v.split('{}')[1])}" for k, v in templates.items() if k != "other")
    return f"CASE {arms} ELSE {lit(templates['other'].split('{}')[0])} || text || {lit(templates['other'].split('{}')[1])} END"


@register(f"WITH d AS (SELECT doc_id, text, {_SOURCE_SQL} AS s FROM documents) SELECT doc_id, md5({_sql_template(tx.PHI)}) AS phi, md5({_sql_template(tx.DEEPSEEK)}) AS deepseek FROM d")
def format_training(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", _sources().alias("s"))
    return docs.select("doc_id", F.md5(tx.phi_format(F.col("text"), F.col("s"))).alias("phi"), F.md5(tx.templated(F.col("text"), F.col("s"), tx.DEEPSEEK)).alias("deepseek"))


@register("""
    SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role) || '<|assistant|>' || chr(10)) AS prompt_md5
    FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id
""")
def chat_prompt(spark, sf):
    return mixing.chat_prompt(read(spark, sf, "conversations")).select("conv_id", F.md5("prompt").alias("prompt_md5"))


@register("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", ffd.token_estimate(F.col("text")).alias("tokens"))


@register("""
    WITH t AS (SELECT doc_id, length(text) // 4 AS n FROM documents)
    SELECT bucket, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM (
        SELECT n, CASE WHEN n <= 4096 THEN 4096 WHEN n <= 6144 THEN 6144 WHEN n <= 8192 THEN 8192 WHEN n <= 12288 THEN 12288 ELSE 16384 END AS bucket FROM t) GROUP BY bucket
""")
def length_buckets(spark, sf):
    n = ffd.token_estimate(F.col("text"))
    rows = read(spark, sf, "documents").select(n.alias("n"), ffd.bucket_of(n).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


def _samples(spark, sf, target):
    docs = read(spark, sf, "documents").select("doc_id", ffd.clipped(ffd.token_estimate(F.col("text")), target, 5).cast("long").alias("tokens"))
    return ffd.with_shard(docs, "doc_id", 1000)


@register(None)
def pack_buffered(spark, sf):
    """First fit decreasing in buffers of 1000 documents, into 8192 tokens."""
    return ffd.pack_shards(_samples(spark, sf, 8192), ["shard"], 8192, 5)


@register(None)
def pack_table_function(spark, sf):
    """The buffers of ``pack_buffered``, packed by a table function in SQL text."""
    udtfs.register(spark)
    samples = _samples(spark, sf, 8192)
    return spark.sql(
        "SELECT * FROM first_fit(TABLE(SELECT shard, doc_id, tokens, 8192 AS target, 5 AS separator FROM {samples}) PARTITION BY shard ORDER BY (doc_id NULLS FIRST, tokens))", samples=samples
    )


@register("""
    WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\\s\\x1c-\\x1f]+', ' ', 'g')) AS t FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(t) >= 5 THEN list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) ELSE [t] END) AS gram FROM t)
    SELECT gram, count(*) AS docs FROM g GROUP BY gram
""")
def gram_documents(spark, sf):
    """In how many documents each character 5-gram stands: a table function counts those of a partition, SQL adds them up."""
    udtfs.register(spark)
    docs = minhash.spread(read(spark, sf, "documents").select("text"))
    return spark.sql("SELECT gram, sum(docs) AS docs FROM char_gram_counts(TABLE(SELECT text, 5 AS n FROM {docs})) GROUP BY gram", docs=docs)


@register(None)
def pack_ffd(spark, sf):
    """First fit decreasing over each whole source, from the histogram of its lengths."""
    docs = read(spark, sf, "documents").select("source", "doc_id", ffd.clipped(ffd.token_estimate(F.col("text")), 8192, 5).cast("long").alias("tokens"))
    return ffd.pack_groups(docs, ["source"], 8192, 5)


@register(None)
def pack_dynamic(spark, sf):
    n = ffd.token_estimate(F.col("text"))
    docs = read(spark, sf, "documents").select("doc_id", n.alias("n"), ffd.bucket_of(n).alias("bucket"))
    docs = docs.withColumn("tokens", F.least("n", F.col("bucket") - 15).cast("long"))
    return ffd.pack_shards(ffd.with_shard(docs, "doc_id", 1000, ["bucket"]), ["bucket", "shard"], F.col("bucket"), 5)


def _rows(spark, sf):
    """Packed rows over stand-in ids of the words between blanks, CRC-32 modulo 50,000; ``packed_token_rows`` has a tokenizer's own."""
    docs = read(spark, sf, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(50_000)).cast("int")).alias("ids"))
    cut = docs.select("doc_id", F.slice("ids", 1, 2048 - 2 - 10).alias("ids")).withColumn("tokens", F.size("ids").cast("long"))
    sharded = ffd.with_shard(cut.select("doc_id", "tokens"), "doc_id", 1000)
    placed = ffd.pack_shards(sharded, ["shard"], 2048, 2).join(cut.select("doc_id", "ids"), "doc_id")
    return ffd.packed_rows(placed, ["shard"], 2048, [50_001, 50_002], 0)


@register(None)
def packed_token_rows(spark, sf, path: str | None = None):
    """Rows of 2048 ids of a public tokenizer, its end of text between samples; texts are cut to a row, as this packing does."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    ids = models.token_ids(read(spark, sf, "documents").select("doc_id", "text"), path)
    cut = Tables(spark, "tokens").write(ids.select("doc_id", F.slice("ids", 1, 2048 - 1 - 10).alias("ids")).withColumn("tokens", F.size("ids").cast("long")).withColumn("row", F.monotonically_increasing_id()), "ids")
    sharded = ffd.with_shard(cut.select("row", "doc_id", "tokens"), "doc_id", 1000)
    placed = ffd.pack_shards(sharded, ["shard"], 2048, 1, keep=["row"]).join(cut.select("row", "ids"), "row")
    return ffd.packed_rows(placed, ["shard"], 2048, [50_256], 50_256)


@register(None)
def packed_rows(spark, sf):
    return _rows(spark, sf)


@register(None)
def pack_stats(spark, sf):
    return ffd.pack_stats(_rows(spark, sf).select("num_samples", "total_tokens"), 2048)


_ANALYSIS = {
    0: "'ERROR_PROBABILITY: ' || CAST(event_id % 60 AS VARCHAR) || 'e'", 1: "'ERROR_PROBABILITY: 0.' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')",
    2: "'CONFIDENCE_LOW: 0.' || CAST(event_id % 10 AS VARCHAR) || chr(10) || 'CONFIDENCE_HIGH: 0.9 DECISION: short'", 3: "'maybe 0.4 or 0.8, 12 bars; go long'",
    4: "'trend: ' || CAST(event_id % 14 AS VARCHAR) || ' cycle=3 burst 0 DECISION:  FLAT'", 5: "'ERROR_PROBABILITY: 0.1. Trend strength: 8 long or short'", 6: "'no number at all: short'",
}


def _analyses(spark, sf):
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    texts = [
        F.concat(F.lit("ERROR_PROBABILITY: "), s(i % 60), F.lit("e")), F.concat(F.lit("ERROR_PROBABILITY: 0."), F.lpad(s(i % 60), 2, "0")),
        F.concat(F.lit("CONFIDENCE_LOW: 0."), s(i % 10), F.lit("\nCONFIDENCE_HIGH: 0.9 DECISION: short")), F.lit("maybe 0.4 or 0.8, 12 bars; go long"),
        F.concat(F.lit("trend: "), s(i % 14), F.lit(" cycle=3 burst 0 DECISION:  FLAT")), F.lit("ERROR_PROBABILITY: 0.1. Trend strength: 8 long or short"), F.lit("no number at all: short"),
    ]
    return read(spark, sf, "events").select("event_id", "value", F.element_at(F.array(*texts), (i % 7 + 1).cast("int")).alias("t"))


_TEXTS = "a AS (SELECT event_id, value, CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _ANALYSIS.items()) + " END AS t FROM events)"


@register("""
    WITH e AS (SELECT event_id, greatest(0.0, least(0.5, (event_id % 70 - 5) / 100.0)) AS e FROM events)
    SELECT event_id, round(CASE WHEN e = 0 THEN 1.0 WHEN e >= 0.5 THEN 0.5 ELSE 1 + e * log2(e) + (1 - e) * log2(1 - e) END, 6) AS confidence FROM e
""")
def bsc_confidence(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(sc.channel_confidence((F.col("event_id") % 70 - 5) / 100.0), 6).alias("confidence"))


@register(f"""
    WITH {_TEXTS}, p AS (
        SELECT *, regexp_extract(t, 'ERROR_PROBABILITY:\\s*([\\d.]+)', 1) AS er, regexp_extract(t, 'CONFIDENCE_LOW:\\s*([\\d.]+)', 1) AS lo, regexp_extract(t, 'CONFIDENCE_HIGH:\\s*([\\d.]+)', 1) AS hi,
               list_filter(list_transform(regexp_extract_all(t, '(\\d+\\.?\\d*)', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x >= 0 AND x <= 1) AS n,
               CASE WHEN regexp_full_match(regexp_extract(t, 'ERROR_PROBABILITY:\\s*([\\d.]+)', 1), '\\d+(\\.\\d*)?') THEN least(0.5, TRY_CAST(regexp_extract(t, 'ERROR_PROBABILITY:\\s*([\\d.]+)', 1) AS DOUBLE)) END AS e FROM a)
    SELECT event_id, CAST(round(CASE WHEN er <> '' THEN CASE WHEN e IS NULL THEN 0.5 WHEN e = 0 THEN 1 WHEN e >= 0.5 THEN 0.5 ELSE 1 + e * log2(e) + (1 - e) * log2(1 - e) END
           WHEN lo <> '' AND hi <> '' THEN (TRY_CAST(lo AS DOUBLE) + TRY_CAST(hi AS DOUBLE)) / 2 WHEN len(n) > 0 THEN list_avg(n) ELSE 0.5 END, 6) AS DOUBLE) AS confidence FROM p
""")
def confidence_parse(spark, sf):
    return _analyses(spark, sf).select("event_id", F.round(sc.parsed_confidence(F.col("t")), 6).alias("confidence"))


@register(f"""
    WITH {_TEXTS}, d AS (SELECT event_id, value, upper(t) AS u, lower(regexp_extract(upper(t), 'DECISION:\\s*(LONG|SHORT|FLAT)', 1)) AS said FROM a)
    SELECT event_id, CASE WHEN value < 20 THEN 'refine' WHEN said <> '' THEN said WHEN contains(u, 'LONG') AND NOT contains(u, 'SHORT') THEN 'long'
           WHEN contains(u, 'SHORT') AND NOT contains(u, 'LONG') THEN 'short' ELSE 'flat' END AS decision FROM d
""")
def decision_parse(spark, sf):
    return _analyses(spark, sf).select("event_id", sc.gated_decision(F.col("t"), F.col("value"), 20).alias("decision"))


@register(f"WITH {_TEXTS} SELECT event_id, " + ", ".join(f"CAST(CASE WHEN regexp_matches(lower(t), '{n}[:\\s=]+\\d+') THEN greatest(1, least(10, CAST(regexp_extract(lower(t), '{n}[:\\s=]+(\\d+)', 1) AS INT))) ELSE 5 END AS INT) AS {n}" for n in ("trend", "cycle", "burst")) + " FROM a")
def pattern_scores(spark, sf):
    return _analyses(spark, sf).select("event_id", *(sc.pattern_score(F.col("t"), n).alias(n) for n in ("trend", "cycle", "burst")))


@register("""
    WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'short' WHEN 2 THEN 'flat' ELSE 'hold' END AS decision, (event_id * 17 % 61 - 30) / 1000.0 AS change FROM events)
    SELECT event_id, CASE decision WHEN 'long' THEN change > 0 WHEN 'short' THEN change < 0 ELSE abs(change) < 0.01 END AS correct,
           CAST(abs(change) AS DOUBLE) AS magnitude, CASE WHEN decision = 'hold' THEN 'flat' ELSE decision END AS final FROM d
""")
def outcome_eval(spark, sf):
    i = F.col("event_id")
    d = read(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, ["long", "short", "flat", "hold"])), (i % 4 + 1).cast("int")).alias("decision"), ((i * 17 % 61 - 30).cast("double") / 1000).alias("change"))
    return d.select("event_id", sc.outcome_correct(F.col("decision"), F.col("change")).alias("correct"), F.abs("change").alias("magnitude"), sc.final_decision(F.col("decision")).alias("final"))


@register("""
    SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0.5 WHEN event_id % 5 = 1 THEN value / 1000 ELSE 0.5 * value / 1000 + 0.7 * 0.25 END, 6) AS confidence FROM events
""")
def ensemble_confidence(spark, sf):
    i, v = F.col("event_id") % 5, F.col("value") / 1000
    empty = F.array().cast("array<double>")
    c = F.when(i == 0, empty).when(i == 1, F.array(v)).otherwise(F.array(v, F.lit(0.25)))
    w = F.when(i > 1, F.array(F.lit(0.5), F.lit(0.7)))
    return read(spark, sf, "events").select("event_id", F.round(sc.weighted_confidence(c, w), 6).alias("confidence"))


def _memories(spark, sf):
    m = read(spark, sf, "conversations")
    at = F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") * 60)
    return m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("user_id"), F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("session_id"), F.col("text").alias("content"), F.lit("{}").alias("metadata"), at.alias("created_at"))


@register("SELECT conv_id * 1000 + turn AS id, text AS content FROM conversations WHERE role = 'user' AND text ILIKE '%the%' ORDER BY conv_id * 3600 + turn * 60 DESC, 1 DESC LIMIT 20")
def memory_search(spark, sf):
    return memory.search(_memories(spark, sf), "the", "user", limit=20).select("id", "content")


@register("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 1")
def memory_list(spark, sf):
    return memory.all_memories(_memories(spark, sf), "assistant", "s1").select("id")


@register("""
    WITH r AS (SELECT conv_id % 3 AS session, conv_id * 1000 + turn AS id, text, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id * 3600 + turn * 60 DESC, conv_id * 1000 + turn DESC) AS rank FROM conversations),
    s AS (SELECT *, sum(length(text)) OVER (PARTITION BY session ORDER BY rank) AS running FROM r WHERE rank <= 10)
    SELECT 's' || session AS session_id, id, rank, CAST(running AS BIGINT) AS running FROM s WHERE running <= 4000
""")
def memory_context_budget(spark, sf):
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return memory.budgeted(_memories(spark, sf), "session_id", order, "content", 4000).select("session_id", "id", F.col("rank").cast("long"), "running")


@register("""
    WITH t AS (SELECT text, conv_id * 3600 + turn * 60 AS t, conv_id * 1000 + turn AS id FROM conversations WHERE role = 'user' AND text ILIKE '%the%' ORDER BY 2 DESC, 3 DESC LIMIT 5)
    SELECT md5(string_agg(text, chr(10) ORDER BY t DESC, id DESC)) AS context_md5 FROM t
""")
def memory_context(spark, sf):
    found = memory.search(_memories(spark, sf), "the", "user", limit=5)
    return memory.context(found).select(F.md5("context").alias("context_md5"))


@register("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE o_orderpriority END AS symbol, 'flat' AS decision,
           CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE (o_orderkey % 100) / 100.0 END AS DOUBLE) AS confidence, 0 AS refinements, '' AS trend FROM orders
""")
def trading_records(spark, sf):
    o = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(o.cast("string").alias("timestamp"), F.when(o % 5 != 0, F.col("o_orderpriority")).alias("symbol"), F.when(o % 3 != 0, (o % 100).cast("double") / 100).alias("confidence"))
    return memory.trading_records(rows).select(F.col("timestamp").cast("long").alias("o_orderkey"), "symbol", "decision", "confidence", "refinements", "trend")


_TOPK = """
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, round({score}, 9) AS score FROM q, embeddings)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _top(spark, sf, cosine):
    v = read(spark, sf, "embeddings")
    found = memory.top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v, 10, cosine)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@register(_TOPK.format(score=_DOT.format(a="q", b="embedding")))
def vector_topk_ip(spark, sf):
    return _top(spark, sf, False)


@register(_TOPK.format(score=_DOT.format(a="q", b="embedding") + " / (sqrt(" + _DOT.format(a="q", b="q") + ") * sqrt(" + _DOT.format(a="embedding", b="embedding") + "))"))
def vector_topk_cosine(spark, sf):
    return _top(spark, sf, True)


_KNOW = """
    old AS (SELECT o_orderpriority AS category, 'k' || (o_orderkey % 97) AS key, arg_min(o_orderstatus, o_orderkey) AS value, min(o_orderkey) AS t FROM orders GROUP BY 1, 2),
    ch AS (SELECT event_id AS seq, event_id AS t, '1-URGENT' AS category, 'k' || (event_id % 120) AS key, event_type AS value, CASE WHEN event_id % 13 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'add' ELSE 'update' END AS op FROM events)
"""


def _knowledge(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.concat(F.lit("k"), (F.col("o_orderkey") % 97).cast("string")).alias("key"), "o_orderstatus", "o_orderkey")
    return o.groupBy("category", "key").agg(F.min_by("o_orderstatus", "o_orderkey").alias("value"), F.lit("{}").alias("metadata"), F.min("o_orderkey").alias("created_at"), F.min("o_orderkey").alias("updated_at"))


_UPSERTED = f"""
    WITH {_KNOW}, r AS (SELECT category, key, -1 AS seq, 'add' AS op, value, t FROM old UNION ALL SELECT category, key, seq, op, value, t FROM ch),
    c AS (SELECT category, key, coalesce(max(CASE WHEN op = 'delete' THEN seq END), -2) AS cut, coalesce(max(CASE WHEN op = 'add' THEN seq END), -2) AS added, max(seq) AS top FROM r GROUP BY 1, 2)
    SELECT c.category, c.key, (SELECT value FROM r WHERE r.category = c.category AND r.key = c.key AND r.seq = c.top) AS value,
           (SELECT arg_min(t, seq) FROM r WHERE r.category = c.category AND r.key = c.key AND r.seq > c.cut AND r.seq >= c.added) AS created_at,
           (SELECT t FROM r WHERE r.category = c.category AND r.key = c.key AND r.seq = c.top) AS updated_at
    FROM c WHERE c.top > c.cut
"""


def _changes(spark, sf):
    i = F.col("event_id")
    return read(spark, sf, "events").select(
        F.lit("1-URGENT").alias("category"), F.concat(F.lit("k"), (i % 120).cast("string")).alias("key"), F.col("event_type").alias("value"), F.lit("{}").alias("metadata"),
        F.when(i % 13 == 0, "delete").when(i % 3 == 0, "add").otherwise("update").alias("op"), i.alias("at"), i.alias("seq"),
    )


@register(_UPSERTED)
def knowledge_upsert(spark, sf):
    return memory.upsert(_knowledge(spark, sf), _changes(spark, sf)).drop("metadata")


@register(_UPSERTED)
def knowledge_versions(spark, sf):
    """The same changes as two versions of a merged table, then a compaction, and what a reader of the last version sees."""
    table = versions.VersionedTable(spark, f"{Tables(spark, 'versions').root}/knowledge")
    changes = _changes(spark, sf)
    table.create(_knowledge(spark, sf))
    middle = changes.agg(F.expr("max(seq) div 2")).first()[0] or 0
    table.upsert(changes.where(F.col("seq") <= middle))
    table.upsert(changes.where(F.col("seq") > middle))
    table.compact()
    return table.read().drop("metadata")


@register(f"WITH {_KNOW} SELECT category, key, value FROM old WHERE contains(lower(key), 'k1') OR contains(lower(value), 'p')")
def knowledge_search(spark, sf):
    rows = memory.search_knowledge(_knowledge(spark, sf), "K1")
    return rows.unionByName(memory.search_knowledge(_knowledge(spark, sf), "p")).select("category", "key", "value").distinct()


@register("SELECT l_returnflag AS pattern, count(*) AS count, round(avg(CASE WHEN l_discount - l_tax > 0 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(l_discount - l_tax), 6) + 0.0 AS avg_pnl FROM lineitem GROUP BY 1")
def pattern_performance(spark, sf):
    trades = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("pattern"), (F.col("l_discount") - F.col("l_tax")).alias("pnl"))
    return memory.pattern_performance(trades, "pattern", "pnl").select("pattern", "count", F.round("win_rate", 6).alias("win_rate"), (F.round("avg_pnl", 6) + F.lit(0.0)).alias("avg_pnl"))


@register("""
    WITH r AS (SELECT o_orderkey AS id, 'S' || (o_custkey % 50) AS symbol, CASE o_orderkey % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'flat' END AS decision, (o_orderkey % 101) / 100.0 AS confidence FROM orders),
    f AS (SELECT event_id AS ts, 'S' || (user_id % 60) AS symbol, CASE event_id % 2 WHEN 0 THEN 'long' ELSE 'short' END AS decision,
                 CASE event_id % 9 WHEN 0 THEN 'WRONG call' WHEN 1 THEN 'incorrect' ELSE event_type END AS feedback FROM events),
    g AS (SELECT symbol, decision, string_agg(feedback, '; ' ORDER BY ts) AS said, bool_or(contains(lower(feedback), 'wrong') OR contains(lower(feedback), 'incorrect')) AS bad FROM f GROUP BY 1, 2)
    SELECT id, symbol, decision, md5(coalesce(said, '')) AS feedback_md5, CAST(round(least(1.0, greatest(0.0, confidence + CASE WHEN said IS NULL THEN 0 ELSE 0.1 END - CASE WHEN bad THEN 0.2 ELSE 0 END)), 6) AS DOUBLE) AS quality_score
    FROM r LEFT JOIN g USING (symbol, decision)
""")
def flywheel_refine(spark, sf):
    o = F.col("o_orderkey")
    records = read(spark, sf, "orders").select(o.alias("id"), F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"), F.when(o % 3 == 0, "long").when(o % 3 == 1, "short").otherwise("flat").alias("decision"), ((o % 101).cast("double") / 100).alias("confidence"))
    e = F.col("event_id")
    said = read(spark, sf, "events").select(e.alias("ts"), F.concat(F.lit("S"), (F.col("user_id") % 60).cast("string")).alias("symbol"), F.when(e % 2 == 0, "long").otherwise("short").alias("decision"), F.when(e % 9 == 0, "WRONG call").when(e % 9 == 1, "incorrect").otherwise(F.col("event_type")).alias("feedback"))
    folded = memory.folded(said).withColumn("feedback", F.md5("feedback"))  # what goes to every record is short
    found = memory.rated(records, folded)
    return found.select("id", "symbol", "decision", F.coalesce("feedback", F.md5(F.lit(""))).alias("feedback_md5"), F.round("quality_score", 6).alias("quality_score"))
