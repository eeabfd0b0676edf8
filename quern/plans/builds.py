"""Queries that build stored artefacts and datasets: manuscripts as blocks, splits by families, rebuilt chunks, segmented recall,
candidate records and failure causes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import candidates, chunking, curation, manuscript, segment, splits
from quern.plans.memory import _LANES, _capabilities, two_path_recall
from quern.plans.tables import table
from quern.plans.texts import _COLLAPSED, _WINDOWS
from quern.sources import store

QUERIES, ORACLE_SQL = {}, {}

#: How a page becomes markdown: patterns and what stands for them, in order; \1 and \2 are groups.
_MARKDOWN = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(?:title|h1)[^>]*>(.*?)</(?:title|h1)>", "\n\n# \\1\n\n"),
    (r"(?is)<li[^>]*>(.*?)</li>", "\n- \\1"),
    (r'(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[\\2](\\1)"),
    (r"(?is)<b>([^<]*)", "**\\1**"),
    (r"(?i)<br[^>]*>", "\n"),
    (r"(?i)<p[^>]*>|</ul>", "\n\n"),
    (r"(?s)<[^>]*>", ""),
)


def _manuscripts(spark, d):
    """Pages as markdown, and turns as manuscripts of their own: users' as quotes, systems' as fences, assistants' as a table and a
    list that end in an open fence."""
    page = F.coalesce("html", F.lit(""))
    for pattern, by in _MARKDOWN:
        page = F.regexp_replace(page, pattern, by.replace("\\1", "$1").replace("\\2", "$2"))
    x = F.col("text")
    body = (
        F.when(F.col("role") == "user", F.concat(F.lit("> "), F.replace(x, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("role") == "system", F.concat(F.lit("```\n"), x, F.lit("\n```")))
        .otherwise(F.concat(F.lit("| speaker | turn |\n|---|---|\n| assistant | "), F.col("turn").cast("string"), F.lit(" |\n\n1. "), F.replace(x, F.lit("\n"), F.lit("\n2. ")), F.lit("\n\n---\n~~~\nend")))
    )
    turns = table(spark, d, "conversations").select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("id"), F.concat(F.lit("# "), "role", F.lit("\n\n"), body).alias("text"))
    return table(spark, d, "pages").select(F.concat_ws(":", F.lit("page"), "page_id").alias("id"), page.alias("text")).union(turns)


def manuscript_blocks(spark, d):
    """C17: blocks of manuscripts with ids that an insertion elsewhere does not change."""
    b = manuscript.blocks(_manuscripts(spark, d))
    return b.select("id", "section", "section_id", "block", "kind", "level", F.md5(F.coalesce("text", F.lit("-"))).alias("digest"), F.coalesce(F.size("items"), F.lit(-1)).alias("n_items"), F.coalesce(F.size("cells"), F.lit(-1)).alias("n_rows"), F.coalesce(F.size(F.get("cells", F.lit(0))), F.lit(-1)).alias("n_cells"), "block_id", "stable_id")


_CHARS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
_PAGE_MD = "coalesce(html, '')"
for _p, _by in _MARKDOWN:
    _PAGE_MD = f"""regexp_replace({_PAGE_MD}, '{_p}', '{_by.replace(chr(10), "' || chr(10) || '")}', 'g')"""
_MS = f"""md AS (SELECT 'page:' || page_id AS id, {_PAGE_MD} AS text FROM pages UNION ALL SELECT 'turn:' || conv_id || ':' || turn, '# ' || role || chr(10) || chr(10) || CASE role WHEN 'user' THEN '> ' || replace(text, chr(10), chr(10) || '> ') WHEN 'system' THEN '```' || chr(10) || text || chr(10) || '```'
    ELSE '| speaker | turn |' || chr(10) || '|---|---|' || chr(10) || '| assistant | ' || turn || ' |' || chr(10) || chr(10) || '1. ' || replace(text, chr(10), chr(10) || '2. ') || chr(10) || chr(10) || '---' || chr(10) || '~~~' || chr(10) || 'end' END FROM conversations),
  ln AS (SELECT *, trim(line, {_CHARS}) AS bare FROM (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM md))),
  fc AS (SELECT id, n, CASE WHEN starts_with(bare, '```') THEN 1 ELSE 2 END AS p, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM ln WHERE starts_with(bare, '```') OR starts_with(bare, '~~~')),
  st AS (SELECT id, n, k, p AS after FROM fc WHERE k = 1 UNION ALL SELECT fc.id, fc.n, fc.k, CASE WHEN st.after = 0 THEN fc.p WHEN st.after = fc.p THEN 0 ELSE st.after END FROM st JOIN fc ON fc.id = st.id AND fc.k = st.k + 1),
  s1 AS (SELECT ln.*, coalesce(last_value(st.after IGNORE NULLS) OVER (PARTITION BY ln.id ORDER BY ln.n ROWS UNBOUNDED PRECEDING), 0) AS after FROM ln LEFT JOIN st ON st.id = ln.id AND st.n = ln.n),
  s2 AS (SELECT *, coalesce(lag(after) OVER w, 0) AS before, coalesce(regexp_matches(lead(line) OVER w, '(?s){manuscript.SEPARATOR}'), false) AS sep_next FROM s1 WINDOW w AS (PARTITION BY id ORDER BY n)),
  s3 AS (SELECT *, CASE WHEN before <> 0 OR after <> 0 THEN 'code' WHEN bare = '' OR regexp_matches(line, '(?s){manuscript.RULE}') THEN NULL WHEN regexp_matches(line, '(?s){manuscript.HEADING}') THEN 'heading' WHEN starts_with(bare, '|') THEN 'bar'
    WHEN regexp_matches(line, '(?s){manuscript.BULLET}') THEN 'bullet' WHEN regexp_matches(line, '(?s){manuscript.NUMBER}') THEN 'number' WHEN regexp_matches(line, '(?s){manuscript.QUOTE}') THEN 'quote' ELSE 'paragraph' END AS k0 FROM s2),
  s4 AS (SELECT *, sum((k0 IS DISTINCT FROM 'bar')::INT) OVER (PARTITION BY id ORDER BY n) AS run FROM s3),
  s5 AS (SELECT *, min(n) FILTER (k0 = 'bar' AND sep_next) OVER (PARTITION BY id, run) AS top FROM s4),
  s6 AS (SELECT *, CASE WHEN k0 = 'bar' THEN CASE WHEN n >= top THEN 'table' ELSE 'paragraph' END ELSE k0 END AS k FROM s5),
  s7 AS (SELECT *, CASE WHEN k = 'heading' THEN length(regexp_extract(line, '(?s){manuscript.HEADING}', 1)) END AS level, CASE WHEN k IS NULL THEN 0 WHEN k = 'code' THEN (before = 0)::INT WHEN k = 'table' THEN (n = top)::INT ELSE (k = 'heading' OR k IS DISTINCT FROM lag(k) OVER (PARTITION BY id ORDER BY n))::INT END AS starts FROM s6),
  s8 AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY n)::BIGINT AS block, coalesce(sum((level = 1)::INT) OVER (PARTITION BY id ORDER BY n), 0)::BIGINT AS section FROM s7),
  bl AS (SELECT id, block, any_value(k) AS k, max(level)::INT AS level, min(section) AS section, list(line ORDER BY n) AS ls, list(line ORDER BY n) FILTER (before <> 0 AND after <> 0) AS body FROM s8 WHERE k IS NOT NULL GROUP BY id, block)"""
ORACLE_SQL["manuscript_blocks"] = f"""WITH RECURSIVE {_MS},
  tx AS (SELECT *, CASE WHEN k IN ('bullet', 'number') THEN 'list' ELSE k END AS kind, CASE k WHEN 'code' THEN coalesce(array_to_string(body, chr(10)), '') WHEN 'heading' THEN regexp_extract(ls[1], '(?s){manuscript.HEADING}', 2)
      WHEN 'quote' THEN array_to_string(list_transform(ls, lambda x: regexp_extract(x, '(?s){manuscript.QUOTE}', 1)), chr(10)) WHEN 'paragraph' THEN array_to_string(list_transform(ls, lambda x: trim(x, {_CHARS})), ' ') END AS text,
    CASE WHEN k = 'table' THEN list_transform(list_filter(ls, lambda x: NOT regexp_matches(x, '(?s){manuscript.SEPARATOR}')), lambda x: len(string_split(trim(trim(x, {_CHARS}), '|'), '|'))) END AS widths FROM bl),
  ba AS (SELECT *, CASE kind WHEN 'paragraph' THEN 'p' WHEN 'heading' THEN 'h' WHEN 'table' THEN 't' WHEN 'list' THEN 'l' WHEN 'quote' THEN 'q' ELSE kind END || '-' || sha256(CASE WHEN kind = 'table' THEN ls[1] WHEN kind = 'list' THEN ls[-1] ELSE text END)[1:10] AS base, CASE WHEN level = 1 THEN 'sec-' || sha256(text)[1:10] END AS title FROM tx),
  nt AS (SELECT *, CASE WHEN level = 1 THEN row_number() OVER (PARTITION BY id, title ORDER BY block) END AS nth, row_number() OVER (PARTITION BY id, base ORDER BY block) - 1 AS dn, row_number() OVER (PARTITION BY id, section, base ORDER BY block) - 1 AS sn, min(section) OVER (PARTITION BY id) AS least FROM ba),
  sc AS (SELECT *, last_value(CASE WHEN nth = 1 THEN title WHEN nth > 1 THEN title || '-' || nth END IGNORE NULLS) OVER (PARTITION BY id ORDER BY block ROWS UNBOUNDED PRECEDING) AS section_id FROM nt)
  SELECT id, section, section_id, block, kind, level, md5(coalesce(text, '-')) AS digest, CASE WHEN kind = 'list' THEN len(ls) ELSE -1 END::INT AS n_items, CASE WHEN kind = 'table' THEN len(widths) ELSE -1 END::INT AS n_rows, coalesce(widths[1], -1)::INT AS n_cells,
    base || CASE WHEN dn > 0 THEN '-' || dn ELSE '' END AS block_id, section_id || '/' || base || CASE WHEN sn > 0 THEN '-' || sn ELSE '' END AS stable_id FROM sc WHERE least > 0"""


def manuscript_problems(spark, d):
    """C17: manuscripts that cannot be projected and why; here those of pages that lost their titles, and of documents as they are."""
    pages = _manuscripts(spark, d).where("id like 'page:%'")
    cut = pages.select(F.concat(F.lit("cut-"), "id").alias("id"), F.regexp_replace("text", "(?s)^.*?\n# [^\n]*", "").alias("text"))
    docs = table(spark, d, "documents").select(F.concat_ws(":", F.lit("doc"), "doc_id").alias("id"), "text")
    return manuscript.problems(cut.union(docs).union(pages))


ORACLE_SQL["manuscript_problems"] = f"""WITH RECURSIVE {_MS.replace("md AS (", "pg AS (", 1).replace("  ln AS (", "  md AS (SELECT 'cut-' || id AS id, regexp_replace(text, '(?s)^.*?\n# [^\n]*', '') AS text FROM pg WHERE id LIKE 'page:%' UNION ALL SELECT 'doc:' || doc_id, coalesce(text, '') FROM documents UNION ALL SELECT * FROM pg WHERE id LIKE 'page:%'),\n  ln AS (", 1)}
  SELECT id, CASE WHEN size = 0 THEN '{manuscript.EMPTY}' WHEN n > 0 AND least = 0 THEN '{manuscript.EARLY}' WHEN most = 0 THEN '{manuscript.NO_TITLE}' END AS problem FROM (SELECT id, count(k) AS n, min(section) FILTER (k IS NOT NULL) AS least, max(section) AS most, max(length(bare)) AS size FROM s8 GROUP BY id) WHERE problem IS NOT NULL"""


def manuscript_inlines(spark, d):
    """C17: bold and code spans and citations of the paragraphs and list items of pages; two markers are words that many
    of them hold."""
    b = manuscript.blocks(_manuscripts(spark, d).where("id like 'page:%'")).where("kind in ('paragraph', 'list')")
    each = b.select("id", "block", F.posexplode(F.when(F.col("kind") == "list", F.col("items")).otherwise(F.array("text"))).alias("item", "text"))
    y = manuscript.with_inlines(each, "text", F.create_map(F.lit(" that "), F.lit("c1"), F.lit(" the "), F.lit("c2")))
    return y.select("id", "block", "item", F.size("spans").alias("spans"), F.size(F.filter("spans", lambda s: s["bold"])).alias("bold"), F.md5(F.array_join(F.transform("spans", lambda s: s["text"]), "")).alias("digest"), F.array_join(F.array_sort("citations"), ",").alias("cites"))


ORACLE_SQL["manuscript_inlines"] = f"""WITH RECURSIVE {_MS},
  ok AS (SELECT * FROM (SELECT *, min(section) OVER (PARTITION BY id) AS least FROM bl) WHERE least > 0 AND id LIKE 'page:%' AND k IN ('paragraph', 'bullet', 'number')),
  it AS (SELECT id, block, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS item FROM (SELECT id, block, CASE k WHEN 'bullet' THEN list_transform(ls, lambda x: regexp_extract(x, '(?s){manuscript.BULLET}', 1)) WHEN 'number' THEN list_transform(ls, lambda x: regexp_extract(x, '(?s){manuscript.NUMBER}', 1)) ELSE [array_to_string(list_transform(ls, lambda x: trim(x, {_CHARS})), ' ')] END AS ts FROM ok)),
  lk AS (SELECT *, replace(replace(replace(regexp_replace(text, '{manuscript.LINK}', '\\1' || chr(4) || '\\2' || chr(5), 'g'), chr(4) || chr(5), ''), chr(4), ' ('), chr(5), ')') AS t FROM it),
  c1 AS (SELECT *, list_sort(list_filter([{{'a': instr(t, ' that '), 'n': 6}}, {{'a': instr(t, ' the '), 'n': 5}}], lambda y: y.a > 0)) AS h FROM lk),
  c2 AS (SELECT *, CASE len(h) WHEN 0 THEN t WHEN 1 THEN t[1:h[1].a - 1] || chr(6) || t[h[1].a + h[1].n:] ELSE t[1:h[1].a - 1] || chr(6) || t[h[1].a + h[1].n:h[2].a - 1] || chr(6) || t[h[2].a + h[2].n:] END AS v FROM c1),
  sp AS (SELECT *, list_transform(string_split(v, chr(6)), lambda s: list_filter(string_split(regexp_replace(s, '(?s){manuscript.BOLD}', chr(1) || chr(2) || '\\1' || chr(1), 'g'), chr(1)), lambda y: y <> '' AND y <> chr(2))) AS parts FROM c2),
  fl AS (SELECT *, flatten(parts) AS f FROM sp)
  SELECT id, block, item::INT AS item, greatest(len(list_filter(f, lambda y, i: i = 1 OR starts_with(y, chr(2)) <> starts_with(f[i - 1], chr(2)))), 1)::INT AS spans, len(list_filter(f, lambda y, i: starts_with(y, chr(2)) AND (i = 1 OR NOT starts_with(f[i - 1], chr(2)))))::INT AS bold, md5(replace(array_to_string(f, ''), chr(2), '')) AS digest,
    array_to_string(list_filter([CASE WHEN instr(t, ' that ') > 0 THEN 'c1' END, CASE WHEN instr(t, ' the ') > 0 THEN 'c2' END], lambda y: y IS NOT NULL), ',') AS cites FROM fl"""

def _families(spark, d):
    """Families of documents of equal bare text with their rows in each stratum, a language and source."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws("/", F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-"))).alias("stratum"))
    g = curation.exact_groups(docs, T.bare(F.col("text"))).join(docs.select("id", "stratum"), "id")
    return g.groupBy(F.col("keep").alias("family"), "stratum").agg(F.count("*").alias("n"))


def split_targets(spark, d):
    """Rows of each language and source for validation, test and training, with the rule for small strata."""
    return splits.stratum_targets(_families(spark, d))


ORACLE_SQL["split_targets"] = """WITH s AS (SELECT coalesce(lang, '-') || '/' || coalesce(source, '-') AS stratum, count(*) AS n FROM documents GROUP BY 1),
  t AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, floor(n * 0.05 + 0.5)) ELSE 0 END::BIGINT AS v, CASE WHEN n >= 3 THEN greatest(1, floor(n * 0.2 + 0.5)) WHEN n = 2 THEN 1 ELSE 0 END::BIGINT AS t FROM s)
  SELECT stratum, split, CASE split WHEN 'val' THEN v WHEN 'test' THEN t ELSE n - v - t END::BIGINT AS target FROM t, (SELECT unnest(['val', 'test', 'train']) AS split)"""


def family_split(spark, d):
    """A split for every family of equal documents so that each language's and source's rows come near the targets (rounds of bids:
    no SQL beside it; tests hold it against a serial search)."""
    m = curation.checkpointed(_families(spark, d))
    return m.join(splits.family_splits(m, "s4")[0], "family").select("family", "stratum", "n", "split")


def chunk_rebuild(spark, d):
    """Chunks of all documents stored by source; then the sources whose texts mention their own language are rebuilt with smaller
    chunks, one language's sources go, and all of it is replayed. Stored rows by source: number, last seq and a digest."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")

    def rows(x, size):
        c = chunking.fixed_windows(x, size, size // 10)
        return store.chunk_rows(c.select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"), F.col("seq").alias("position"), F.lit(None).cast("int").alias("parent"), F.lit("leaf").alias("kind"), F.col("chunk").alias("content")))

    s = store.chunk_store(spark, f"{curation.shared_dir(spark)}/chunks-{curation.unique()}", 16)
    s.replace(rows(docs, 700), batch=("import", 1))
    again = rows(docs.where("lang in ('de', 'fr')"), 300)
    gone = docs.where("lang = 'es'").select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"))
    for _ in range(2):  # the second time is a replay
        s.replace(again, gone, batch=("import", 2))
    return s.read().groupBy("source_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.sum(F.length("content")).alias("chars"), F.countDistinct("chunk_id").alias("ids"))


ORACLE_SQL["chunk_rebuild"] = f"""WITH c AS (SELECT id, start // 270 AS seq, length(substring(t, start + 1, 300)) AS n FROM ({_WINDOWS.format(size=300, step=270, c=_COLLAPSED)}) WHERE id IN (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr'))
    UNION ALL SELECT id, start // 630, length(substring(t, start + 1, 700)) FROM ({_WINDOWS.format(size=700, step=630, c=_COLLAPSED)}) WHERE id NOT IN (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr', 'es')))
  SELECT id AS source_id, count(*) AS n, max(seq)::INT AS last_seq, sum(n)::BIGINT AS chars, count(*) AS ids FROM c GROUP BY 1"""


#: Han characters that stand for letters: the given texts have none of such scripts.
_HAN = "".join(chr(0x4E00 + 37 * i) for i in range(26))


def _han(text):
    """A text as it would be written in Han characters, without spaces or digits."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "abcdefghijklmnopqrstuvwxyz", _HAN), "[0-9 ]+", "")


def _lexicon(spark, d):
    """Words of two to six letters of users' turns, in Han."""
    words = table(spark, d, "conversations").where("role = 'user'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])[a-z]{2,6}(?![a-z])"), F.lit(0))).alias("w")).distinct()
    return segment.lexicon(words.select(F.translate("w", "abcdefghijklmnopqrstuvwxyz", _HAN).alias("term")))


def segmented_tokens(spark, d):
    """Benchmark items in Han cut into the lexicon's longest terms and pairs of characters."""
    b = table(spark, d, "benchmark").select("item_id", _han(F.col("text")).alias("content"))
    c = segment.content_search(b, _lexicon(spark, d))
    return c.select("item_id", F.size(F.split("content_search", " ")).alias("tokens"), F.md5("content_search").alias("digest"))


ORACLE_SQL["segmented_tokens"] = f"""WITH RECURSIVE lx AS (SELECT DISTINCT translate(w, 'abcdefghijklmnopqrstuvwxyz', '{_HAN}') AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations WHERE role = 'user') WHERE length(w) BETWEEN 2 AND 6),
  b AS (SELECT item_id, regexp_replace(translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', '{_HAN}'), '[0-9 ]+', '', 'g') AS t FROM benchmark),
  p AS (SELECT item_id, t, i, contains('{_HAN}', t[i]) AS han FROM (SELECT item_id, t, unnest(range(1, length(t) + 1)) AS i FROM b)),
  m AS (SELECT item_id, i, max(length(term)) AS n FROM (SELECT item_id, i, t[i:i + k - 1] AS s FROM p, (SELECT unnest(range(2, 7)) AS k) WHERE i + k - 1 <= length(t)) JOIN lx ON s = term GROUP BY ALL),
  ch AS (SELECT item_id, 1::BIGINT AS i FROM b UNION ALL SELECT ch.item_id, ch.i + coalesce(m.n, 1) FROM ch JOIN p ON p.item_id = ch.item_id AND p.i = ch.i LEFT JOIN m ON m.item_id = ch.item_id AND m.i = ch.i),
  tk AS (SELECT p.item_id, p.i, m.n, p.t, p.han FROM ch JOIN p USING (item_id, i) LEFT JOIN m USING (item_id, i)),
  lo AS (SELECT *, i - row_number() OVER (PARTITION BY item_id ORDER BY i) AS isle FROM tk WHERE n IS NULL AND han),
  pr AS (SELECT item_id, i, t, count(*) OVER w AS size, row_number() OVER (w ORDER BY i) AS k FROM lo WINDOW w AS (PARTITION BY item_id, isle)),
  al AS (SELECT item_id, i, t[i:i + n - 1] AS token FROM tk WHERE n IS NOT NULL UNION ALL SELECT item_id, i, CASE WHEN size = 1 THEN t[i] ELSE t[i:i + 1] END FROM pr WHERE size = 1 OR k < size)
  SELECT item_id, count(*)::INT AS tokens, md5(string_agg(token, ' ' ORDER BY i)) AS digest FROM al GROUP BY 1"""


def segmented_recall(spark, d):
    """Documents in Han that hold all tokens of a query, here the first words of benchmark items (longest matches: no SQL beside
    it; a test compares brute force)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), _han(F.col("text")).alias("text"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), _han(F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("text"))
    return segment.segmented_recall(docs, q, _lexicon(spark, d), 10)


def _scored(spark, d):
    """Queries with the capability that is right for them (none where it may be no card) and every capability's best recall score."""
    hits = two_path_recall(spark, d).groupBy("query_id", "capability").agg(F.max("score").alias("score"))
    e = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    caps = _capabilities(spark, d).select("capability", (F.col("enabled") & ~F.col("research")).alias("ok"))
    q = e.join(F.broadcast(caps), e["label"] == caps["capability"], "left").select(F.col("vec_id").alias("query_id"), F.when(F.col("ok"), F.col("label")).alias("gold"), F.coalesce(~F.col("ok"), F.lit(False)).alias("hard"))
    return q, hits


_SC = f"""{_LANES}, bs AS (SELECT query_id, capability, max(score) AS score FROM hits GROUP BY ALL), gq AS (SELECT vec_id AS query_id, CASE WHEN label IN (SELECT capability FROM cap) THEN label END AS gold, label IN (3, 7) AS hard FROM embeddings WHERE vec_id % 50 = 0),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capability::VARCHAR) AS n FROM bs)"""


def failure_causes(spark, d):
    """Why routing decisions are wrong at three floors, from the cascade's own scores. The decision is the best admitted
    capability, or none where the second comes within 0.005 of it; causes with their shares of a floor's decisions."""
    q, hits = _scored(spark, d)
    m = hits.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("capability", "score"))).alias("scores"))
    x = q.join(m, "query_id", "left").withColumn("scores", F.coalesce("scores", F.expr("cast(map() as map<int,double>)"))).withColumn("floor", F.explode(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))))
    best = F.array_sort(F.transform(F.filter(F.map_entries("scores"), lambda e: e["value"] >= F.col("floor")), lambda e: F.struct((-e["value"]).alias("m"), e["key"].cast("string").alias("name"), e["key"].alias("c"))))
    x = x.withColumn("b", F.slice(best, 1, 3)).withColumn("admitted", F.transform("b", lambda s: s["c"]))
    sure = (F.size("b") > 0) & F.coalesce(F.get("b", F.lit(1))["m"] - F.get("b", F.lit(0))["m"] >= 0.005, F.lit(True))
    x = x.withColumn("took", F.when(sure, F.get("b", F.lit(0))["c"]))
    cause = candidates.failure_cause(F.when(F.col("gold").isNotNull(), "TOOL").otherwise("AGENT"), F.col("gold"), F.when(F.col("took").isNotNull(), "TOOL").otherwise("AGENT"), F.col("took"), F.col("hard"), F.col("scores"), F.col("admitted"), margin=0.02, near=0.15)
    g = x.groupBy("floor", F.coalesce(cause, F.lit("-")).alias("cause")).agg(F.count("*").alias("n"))
    total = g.groupBy("floor").agg(F.sum("n").alias("all"))
    return g.join(total, "floor").select("floor", "cause", "n", F.round(100 * F.col("n") / F.col("all"), 2).alias("percent"))


ORACLE_SQL["failure_causes"] = f"""WITH {_SC}, fl AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS floor),
  ad AS (SELECT floor, rk.* FROM rk, fl WHERE score >= floor AND n <= 3), tp AS (SELECT floor, query_id, max(capability) FILTER (n = 1) AS c1, max(score) FILTER (n = 1) AS s1, max(score) FILTER (n = 2) AS s2 FROM ad GROUP BY ALL),
  dc AS (SELECT gq.*, fl.floor, CASE WHEN s2 IS NULL OR -s2 - -s1 >= 0.005 THEN c1 END AS took, (SELECT score FROM bs WHERE bs.query_id = gq.query_id AND bs.capability = gold) AS own,
    EXISTS (SELECT 1 FROM ad WHERE ad.query_id = gq.query_id AND ad.floor = fl.floor AND ad.capability = gold) AS shown, (SELECT max(score) FROM ad WHERE ad.query_id = gq.query_id AND ad.floor = fl.floor AND ad.capability <> gold) AS rival
    FROM gq JOIN fl ON true LEFT JOIN tp ON tp.query_id = gq.query_id AND tp.floor = fl.floor),
  cs AS (SELECT floor, CASE WHEN gold IS NULL THEN CASE WHEN took IS NULL THEN '-' WHEN hard THEN 'E' ELSE 'C' END WHEN took = gold THEN '-' WHEN own IS NULL THEN 'D' WHEN NOT shown THEN CASE WHEN own >= 0.15 THEN 'A' ELSE 'D' END WHEN rival - own < 0.02 THEN 'B' ELSE 'C' END AS cause FROM dc)
  SELECT floor, cause, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY floor), 2) AS percent FROM cs GROUP BY floor, cause"""


def _records(spark, d, threshold):
    q, hits = _scored(spark, d)
    return candidates.candidate_records(q, hits, threshold, 3, "s5")


def candidate_records(spark, d):
    """Labelled records of queries at a threshold: candidates, label with its reason, and options in an order of their own."""
    r = _records(spark, d, 0.2)
    return r.select("query_id", "gold", F.array_join("candidates", ",").alias("candidates"), "k", F.size("retrieved").alias("n_retrieved"), "gold_rank", "label", "label_reason", "detail", F.array_join("options", ",").alias("options"), "gold_index", "reject_index", "decision_state")


_REC = f"""{_SC}, re AS (SELECT query_id, list(capability::VARCHAR ORDER BY n) FILTER (score >= THR) AS r FROM rk GROUP BY 1), r0 AS (SELECT gq.*, coalesce(r, []) AS r FROM gq LEFT JOIN re USING (query_id)),
  r1 AS (SELECT *, r[1:3] AS c, CASE WHEN list_position(r, gold::VARCHAR) > 0 THEN list_position(r, gold::VARCHAR) END AS gold_rank FROM r0),
  r2 AS (SELECT *, CASE WHEN gold IS NULL THEN 'no_action' WHEN len(c) = 0 THEN 'no_candidates' WHEN gold_rank <= 3 THEN 'gold_in_candidates' ELSE 'gold_not_retrieved' END AS label_reason, coalesce(CASE WHEN gold_rank <= 3 THEN gold::VARCHAR END, 'REJECT') AS label,
    list_transform(list_sort(list_transform(list_append(c, 'REJECT'), lambda x: sha256('s5|' || query_id || '|' || x) || '|' || x)), lambda y: string_split(y, '|')[2]) AS o FROM r1)"""
ORACLE_SQL["candidate_records"] = f"""WITH {_REC.replace("THR", "0.2")} SELECT query_id, gold, array_to_string(c, ',') AS candidates, len(c)::INT AS k, len(r)::INT AS n_retrieved, gold_rank::BIGINT AS gold_rank, label, label_reason,
  CASE label_reason WHEN 'no_action' THEN 'source_no_action' WHEN 'no_candidates' THEN 'no_capability_above_threshold' WHEN 'gold_in_candidates' THEN 'gold_in_top3' ELSE CASE WHEN gold_rank IS NULL THEN 'gold_below_threshold' ELSE 'gold_outside_top3' END END AS detail,
  array_to_string(o, ',') AS options, (list_position(o, label) - 1)::BIGINT AS gold_index, (list_position(o, 'REJECT') - 1)::BIGINT AS reject_index, CASE WHEN len(c) = 0 THEN 'direct_reject' ELSE 'choose' END AS decision_state FROM r2"""


def candidate_cohorts(spark, d):
    """What those records hold, by right capability and over all."""
    return candidates.cohort(_records(spark, d, 0.2), ["gold"])


ORACLE_SQL["candidate_cohorts"] = f"""WITH {_REC.replace("THR", "0.2")} SELECT gold, count(*) AS rows, count(*) FILTER (gold IS NOT NULL) AS action_rows, round(avg(len(c)), 6) AS mean_k, count(*) FILTER (gold IS NOT NULL AND gold_rank IS NOT NULL) AS gold_in, count(*) FILTER (gold_rank = 1) AS gold_top1, count(*) FILTER (gold_rank <= 3) AS gold_top3,
  count(*) FILTER (label_reason = 'gold_not_retrieved') AS gold_not_retrieved, count(*) FILTER (label_reason = 'no_candidates') AS no_candidates, count(*) FILTER (label_reason = 'no_action') AS no_action, round(CASE WHEN count(*) FILTER (gold IS NOT NULL) > 0 THEN 100 * count(*) FILTER (gold IS NOT NULL AND gold_rank IS NOT NULL) / count(*) FILTER (gold IS NOT NULL) END, 6) AS gold_in_pct
  FROM r2 GROUP BY ROLLUP (gold)"""


def candidate_counts(spark, d):
    """How many records have no, one, two and three candidates, by reason of their label, noughts included."""
    return candidates.k_distribution(_records(spark, d, 0.3), "label_reason", 3)


ORACLE_SQL["candidate_counts"] = f"""WITH {_REC.replace("THR", "0.3")}, n AS (SELECT label_reason, len(c)::INT AS k, count(*) AS n FROM r2 GROUP BY ALL), t AS (SELECT label_reason, sum(n) AS t FROM n GROUP BY 1)
  SELECT t.label_reason, x.k, coalesce(n.n, 0) AS n, round(100 * coalesce(n.n, 0) / t.t, 6) AS percent FROM t JOIN (SELECT unnest(range(4))::INT AS k) x ON true LEFT JOIN n ON n.label_reason = t.label_reason AND n.k = x.k"""

for _f in (manuscript_blocks, manuscript_problems, manuscript_inlines, split_targets, family_split, chunk_rebuild, segmented_tokens, segmented_recall, failure_causes, candidate_records, candidate_cohorts, candidate_counts):
    QUERIES[_f.__name__] = _f
