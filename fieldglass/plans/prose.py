"""Registered queries over texts: retrieval, keywords, watch lists, entities, extraction, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.fixed import BETWEEN_KILLED, BETWEEN_WOUNDED, COUNTRIES, EVENT_TYPES, GENERIC_ACTOR_WORDS, KILLED_WORDS, LESSON_STOPWORDS, MONTHS, NUMBER_WORDS, PLATFORM_TERMS, PLATFORMS, TYPE_HINTS, TYPE_TERMS, UNIT_WORDS, WATCHLIST_STOPWORDS, WOUNDED_WORDS
from ..operators import knowledge as K
from ..operators import text as T
from .bridge import EV_ORDERS, ev_orders

Q, O = {}, {}


def _add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


_table = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_STOP = _quoted(LESSON_STOPWORDS)
_WORDS = lambda c: f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '([a-z0-9][a-z0-9-]*)', 1), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
_POST = lambda table, key: f"dw AS (SELECT {key} AS doc, {_WORDS('text')} AS w FROM {table}), po AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM dw) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1), sz AS (SELECT count(*) AS n, sum(len(w)) AS dl FROM dw)"
_IDF = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
_SCORE = f"{_IDF} * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * po.dl / (sz.dl::DOUBLE / sz.n)))"

#: Words of the invented prose; one of them twice, which counts twice.
SEARCH = "hered than erent hered whst"
_add("bm25_topk", lambda s, d: T.bm25(_table(s, d, "documents"), SEARCH, k=20), f"WITH {_POST('documents', 'doc_id')}, q(term, qn) AS (VALUES ('hered', 2), ('than', 1), ('erent', 1), ('whst', 1)) SELECT doc, round(sum(qn * {_SCORE}), 9) AS score FROM po JOIN q USING (term) JOIN df USING (term), sz GROUP BY doc ORDER BY score DESC, doc LIMIT 20")
_TF = lambda table, key: f"WITH {_POST(table, key)}, pn AS (SELECT count(DISTINCT doc) AS n FROM po), we AS (SELECT doc, term, tf, tf * {_IDF} AS weight FROM po JOIN df USING (term), pn), no AS (SELECT doc, greatest(sqrt(sum(weight * weight)), 1.0) AS norm FROM we GROUP BY 1)"
_bench = lambda s, d: T.postings(_table(s, d, "benchmark"), "item_id", F.col("text"))
_add("tf_idf", lambda s, d: T.tf_idf(_bench(s, d)).select("doc", "term", "tf", F.round("weight", 6).alias("weight"), F.round("norm", 6).alias("norm")), _TF("benchmark", "item_id") + " SELECT doc, term, tf, round(weight, 6) AS weight, round(norm, 6) AS norm FROM we JOIN no USING (doc)")
_add("keywords", lambda s, d: T.keywords(_bench(s, d)), _TF("benchmark", "item_id") + " SELECT doc, CAST(rank AS INT) AS rank, term FROM (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY round(weight, 9) DESC, term) AS rank FROM we) WHERE rank <= 6")
_add("related_docs", lambda s, d: T.related(_bench(s, d), _bench(s, d).select("doc")), _TF("benchmark", "item_id") + " SELECT \"of\", doc, cosine, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY \"of\" ORDER BY cosine DESC, doc) AS rank FROM (SELECT a.doc AS \"of\", b.doc, round(sum(a.weight * b.weight) / max(m.norm) / max(k.norm), 9) AS cosine FROM we a JOIN we b ON a.term = b.term AND a.doc <> b.doc JOIN no k ON k.doc = a.doc JOIN no m ON m.doc = b.doc GROUP BY 1, 2)) WHERE rank <= 3")
_add("snippets", lambda s, d: _table(s, d, "documents").select("doc_id", T.snippet(F.col("text"), ["hered", "than"]).alias("snippet")), r"""WITH fl AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
hp AS (SELECT *, greatest(0, coalesce(list_min(list_filter([strpos(lower(t), 'hered'), strpos(lower(t), 'than')], lambda p: p > 0)), 1) - 1 - 40) AS pos FROM fl)
SELECT doc_id, concat(CASE WHEN pos > 0 THEN '…' ELSE '' END, regexp_replace(substring(t, pos + 1, 120), '(?i)\b(hered|than)\b', '**\1**', 'g'), CASE WHEN length(t) > pos + 120 THEN '…' ELSE '' END) AS snippet FROM hp""")

# Watch lists and entities ---------------------------------------------------------------------------------------------
_TOK = lambda c: f"list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', ' ', 'g')), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_quoted(WATCHLIST_STOPWORDS)})))"
_listed = lambda s, d: _table(s, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("all_names")).agg(F.min("p_partkey").cast("string").alias("ent_num"))
_LIST = f"li AS (SELECT concat_ws(' ', p_name, p_type) AS all_names, CAST(min(p_partkey) AS STRING) AS listed_id FROM part GROUP BY 1), b AS (SELECT listed_id, {_TOK('all_names')} AS t FROM li)"
_MATCH = f"WITH {_LIST}, a AS (SELECT DISTINCT p_name AS name, {_TOK('p_name')} AS t FROM part), mt AS (SELECT name, listed_id, len(list_intersect(a.t, b.t)) AS shared, len(a.t) AS na, len(b.t) AS nb FROM a, b), wm AS (SELECT name, listed_id, shared, shared = na OR shared = nb AS strong FROM mt WHERE shared > 0 AND (shared = na OR shared = nb OR shared >= 2))"
_add("watchlist_match", lambda s, d: T.watchlist_match(_table(s, d, "part").select(F.col("p_name").alias("name")), _listed(s, d)), _MATCH + " SELECT name, listed_id, CAST(shared AS BIGINT) AS shared, strong FROM wm")
_add("watchlist_screen", lambda s, d: T.screen(_table(s, d, "part").selectExpr("p_partkey AS seq", "p_name AS actor1", "'' AS actor2"), _listed(s, d)).select("seq", F.col("n").cast("long").alias("n"), F.array_join("ids", ",").alias("ids")), _MATCH + " SELECT p_partkey AS seq, count(*) AS n, string_agg(listed_id, ',' ORDER BY NOT strong, shared DESC, listed_id, name) AS ids FROM part JOIN wm ON wm.name = p_name GROUP BY 1")
#: Actors in several spellings, one of them known by an acronym; tags are platforms and a remark.
_surface = lambda s, d: ev_orders(s, d).withColumn("actor1", F.concat(F.lit("the "), F.lower("actor1"), F.lit(" forces,"))).withColumn("actor2", F.when(F.col("actor2") == "F", F.lit("Suspected IDF.")).otherwise(F.concat(F.lit("Suspected "), "actor2"))).withColumn("tags", F.expr("CASE seq % 3 WHEN 0 THEN array('armor', 'merged:2') WHEN 1 THEN array('drone-uas', 'armor') ELSE array() END"))
_SECOND = "CASE actor2 WHEN 'F' THEN 'Israel Defense Forces' ELSE actor2 END"
_FIRST = "concat(upper(actor1[1]), lower(actor1[2:]), ' Forces')"
_TAGS = "CASE seq % 3 WHEN 0 THEN ['armor'] WHEN 1 THEN ['drone-uas', 'armor'] ELSE [] END AS tags"
_ENT = f"WITH {EV_ORDERS}, sl AS (SELECT date, country, event_type, source, concat(lower(actor1), ' forces') AS surface, {_FIRST} AS entity, {_TAGS} FROM evo UNION ALL SELECT date, country, event_type, source, CASE actor2 WHEN 'F' THEN 'IDF' ELSE actor2 END, {_SECOND}, {_TAGS} FROM evo)"
_add("entity_registry", lambda s, d: T.entity_registry(_surface(s, d)), _ENT + " SELECT entity, count(*) AS mentions, min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT country) AS countries, count(DISTINCT event_type) AS types, count(DISTINCT surface) AS surfaces FROM sl GROUP BY 1")
_add("entity_facets", lambda s, d: T.entity_facets(_surface(s, d)), _ENT + " SELECT entity, facet, key, count(*) AS n FROM (SELECT entity, unnest(['country', 'type', 'source', 'surface']) AS facet, unnest([country, event_type, source, surface]) AS key FROM sl UNION ALL SELECT entity, 'platform', unnest(tags) FROM sl) WHERE key <> '' GROUP BY 1, 2, 3")
_add("entity_co_actors", lambda s, d: T.co_actors(_surface(s, d), 10), f"WITH {EV_ORDERS}, n AS (SELECT {_FIRST} AS x, {_SECOND} AS y FROM evo) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS weight FROM n WHERE x <> y GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
_add("canonical_actors", lambda s, d: T.canonical_actors(_surface(s, d), s.createDataFrame([("building forces", "Builders"), ("Building Forces", "Constructors"), ("machinery forces", "Machinists")], "alias string, name string")).groupBy("actor1", "actor2").agg(F.count("*").alias("events")), f"WITH {EV_ORDERS} SELECT CASE lower(actor1) WHEN 'building' THEN 'Builders' WHEN 'machinery' THEN 'Machinists' ELSE {_FIRST} END AS actor1, CASE actor2 WHEN 'F' THEN 'IDF' ELSE actor2 END AS actor2, count(*) AS events FROM evo GROUP BY 1, 2")
_add("known_actors", lambda s, d: T.canonical_actors(_surface(s, d)).groupBy("actor1", "actor2").agg(F.count("*").alias("events")), f"WITH {EV_ORDERS} SELECT {_FIRST} AS actor1, {_SECOND} AS actor2, count(*) AS events FROM evo GROUP BY 1, 2")
_CONTENT = f"list_distinct(list_filter(regexp_extract_all(lower(entity), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_quoted(GENERIC_ACTOR_WORDS)})))"
_names = lambda s, d: _table(s, d, "part").select(F.concat_ws(" ", "p_name", "p_type", F.lit("item")).alias("entity"))
_add("resolve_entities", lambda s, d: T.resolve_entities(_names(s, d)), f"WITH n AS (SELECT DISTINCT concat_ws(' ', p_name, p_type, 'item') AS entity FROM part), t AS (SELECT entity, {_CONTENT} AS t FROM n), p AS (SELECT a.entity, b.entity AS other, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE AS score FROM t a, t b WHERE a.entity <> b.entity), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, other) AS r FROM p WHERE score > 0.6::DOUBLE OR (score = 0.6::DOUBLE AND other < entity)) SELECT n.entity, CASE WHEN other < n.entity THEN other ELSE n.entity END AS resolved FROM n LEFT JOIN k ON k.entity = n.entity AND r = 1")

# Extraction -----------------------------------------------------------------------------------------------------------
_any = lambda low, words: " OR ".join(f"contains({low}, '{w}')" for w in words)
_KIND = lambda c: f"CASE WHEN {c} IN ({_quoted(EVENT_TYPES)}) THEN {c} " + " ".join(f"WHEN {_any(f'lower({c})', ws)} THEN '{n}'" for ws, n in TYPE_HINTS) + " ELSE 'other' END"
_add("document_types", lambda s, d: _table(s, d, "documents").groupBy(X.event_type(F.col("text")).alias("event_type")).agg(F.count("*").alias("documents")), f"SELECT {_KIND("coalesce(text, '')")} AS event_type, count(*) AS documents FROM documents GROUP BY 1")
_PLAT = lambda low: "list_filter([" + ", ".join(f"CASE WHEN {_any(low, ws)} THEN '{tag}' END" for ws, tag in PLATFORMS) + "], lambda p: p IS NOT NULL)"
_add("document_platforms", lambda s, d: _table(s, d, "documents").select(F.array_join(T.platforms(F.lower("text")), ",").alias("platforms")).groupBy("platforms").agg(F.count("*").alias("documents")), f"SELECT array_to_string({_PLAT('lower(text)')}, ',') AS platforms, count(*) AS documents FROM documents GROUP BY 1")

# Everything that extraction finds, as SQL over a table tx(key, t), in RE2's spelling of the patterns.
_first = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_NUM = r"(\d[\d,]*|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|dozens?|scores)"
_VALUE = "CASE w " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in NUMBER_WORDS.items()) + " ELSE coalesce(try_cast(replace(w, ',', '') AS INT), 0) END"
_MONTH, _UNITS = "(?:" + "|".join(MONTHS) + ")", "|".join(sorted(UNIT_WORDS, key=len, reverse=True))


def _toll(words, between):
    said, filler = "(?:" + "|".join(words) + ")", "(?:" + "|".join(rf"{w}\s+" for w in between) + ")*"
    found = rf"list_concat(regexp_extract_all(low, '{_NUM}\s+{filler}{said}', 1), regexp_extract_all(low, '{said}\s+(?:at least |up to |some |about )?{_NUM}', 1))"
    return f"coalesce(list_max(list_transform({found}, lambda w: {_VALUE})), 0)"


_day = lambda pattern, form: rf"list_transform(regexp_extract_all(t, '(?i)\b({pattern})\b', 1), lambda x: CAST(try_strptime(replace(regexp_replace(x, '\s+', ' ', 'g'), ',', ''), '{form}') AS DATE))"
_DAYS = "list_filter(list_concat(list_concat(" + _day(r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d") + ", " + _day(rf"\d{{1,2}}\s+{_MONTH}\s+\d{{4}}", "%d %B %Y") + "), list_concat(" + _day(rf"{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}", "%B %d %Y") + ", " + _day(r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y") + ")), lambda x: x IS NOT NULL)"
_PLACES = rf"list_filter(regexp_extract_all(t, '\b(?:in|near|at|outside|around)\s+([A-Z][\w''\-]+(?:\s+[A-Z][\w''\-]+){{0,2}})', 1), lambda p: regexp_extract(p, '^(\S+)', 1) NOT IN ({_quoted([*(m.capitalize() for m in MONTHS), 'The', 'A', 'An'])}) AND NOT regexp_matches(lower(p), '(?:{_UNITS})$'))"
_RUNS = rf"list_filter(list_transform(regexp_extract_all(t, '(?i)\b((?:[A-Z][\w.\-]+\s+){{0,3}}(?:{_UNITS}))\b', 1), lambda r: regexp_replace(r, '\s+', ' ', 'g')), lambda r: regexp_matches(r, '(?:^| )[\p{{Lu}}\d]\S* ') AND NOT starts_with(lower(r), 'forces of'))"
_ACTORS = rf"list_concat(list_transform(regexp_extract_all(t, '\bForces of ([A-Z][\w\-]*(?:\s+(?:of|the|and|[A-Z][\w\-]*))*)', 1), lambda n: 'Forces of ' || rtrim(n)), {_RUNS})"
_NATION = "CASE " + " ".join(rf"WHEN regexp_matches(t, '(?i)\b{n}\b') THEN '{n}'" for n in sorted(COUNTRIES, key=len, reverse=True)) + " END"
_EXTRACT = f""", lw AS (SELECT key, trim(coalesce(t, '')) AS t, lower(trim(coalesce(t, ''))) AS low FROM tx), x1 AS (SELECT key, {_KIND('t')} AS event_type, {_toll(KILLED_WORDS, BETWEEN_KILLED)} AS magnitude, {_toll(WOUNDED_WORDS, BETWEEN_WOUNDED)} AS wounded,
{_DAYS} AS d, {_PLAT('low')} AS platforms, {_ACTORS} AS a, {_PLACES} AS p, {_NATION} AS country FROM lw),
x2 AS (SELECT key, event_type, magnitude, wounded, {_first('d')} AS d, platforms, {_first('a')} AS a, {_first('p')} AS p, country FROM x1), x3 AS (SELECT *, list_filter(p, lambda q: q IS DISTINCT FROM country)[1] AS location FROM x2),
x4 AS (SELECT *, CAST(len(d) > 0 AS INT) + CAST(len(a) > 0 AS INT) + CAST(country IS NOT NULL OR location IS NOT NULL AS INT) + CAST(magnitude > 0 OR wounded > 0 AS INT) + CAST(event_type <> 'other' AS INT) AS points FROM x3)
SELECT key, event_type, CAST(magnitude AS INT) AS magnitude, CAST(wounded AS INT) AS wounded, array_to_string(d, ',') AS dates, array_to_string(platforms, ',') AS platforms, array_to_string(a, ';') AS actors, array_to_string(p, ';') AS places, country, location, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM x4"""
_extracted = lambda df: T.extract(df, "t").drop("t").withColumns({"dates": F.array_join(F.transform("dates", lambda x: x.cast("string")), ","), "platforms": F.array_join("platforms", ","), "actors": F.array_join("actors", ";"), "places": F.array_join("places", ";")})
_add("extract", lambda s, d: _extracted(_table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("t"))), "WITH tx AS (SELECT doc_id AS key, text AS t FROM documents)" + _EXTRACT)
#: A report for each order, in five forms that mean the same in Spark and DuckDB.
_REPORT = """CASE CAST(seq % 5 AS INT) WHEN 0 THEN concat('At least ', CAST(magnitude AS STRING), ' people were killed and ', CAST(seq % 40 AS STRING), ' others wounded near ', location, ' Crossing in ', country, ' on ', CAST(date AS STRING), '.')
WHEN 1 THEN concat('A dozen soldiers dead after shelling at Camp ', actor1, '; Forces of ', country, ' and the ', actor1, ' Brigade withdrew in June, 6/12/2026.')
WHEN 2 THEN concat('An FPV drone hit a tank outside ', location, ': 1,', CAST(100 + seq % 900 AS STRING), ' perished, injured some scores. 12 June 2026, then june 13, 2026 and 2026-13-45.')
WHEN 3 THEN concat('Protest in The Square of ', location, ' and around Lake ', country, '; the national army of Sudan and the South Sudan militia stayed away') ELSE concat('quiet day for ', actor2) END"""
_add("extract_reports", lambda s, d: _extracted(ev_orders(s, d).selectExpr("seq AS key", f"{_REPORT} AS t")), f"WITH {EV_ORDERS}, tx AS (SELECT seq AS key, {_REPORT} AS t FROM evo)" + _EXTRACT)
_TO_EVENT = f"WITH {EV_ORDERS}, tx AS (SELECT seq AS key, {_REPORT} AS t FROM evo)" + _EXTRACT.replace("\nSELECT key", ", xs AS (SELECT key", 1) + ")"
_add("report_events", lambda s, d: T.to_events(ev_orders(s, d).selectExpr("seq", f"{_REPORT} AS text"), source="wire", default_date="2026-06-01").select("seq", "id", "date", "event_type", "actor1", "actor2", "country", "location", "magnitude", "source", F.md5("notes").alias("notes"), F.array_join("tags", ",").alias("tags")),
     _TO_EVENT + """, ev AS (SELECT key AS seq, coalesce(try_cast(string_split(dates, ',')[1] AS DATE), DATE '2026-06-01') AS date, event_type, string_split(actors, ';')[1] AS actor1, coalesce(string_split(actors, ';')[2], '') AS actor2, coalesce(country, '') AS country, coalesce(location, '') AS location, magnitude, t[:280] AS notes,
concat_ws(',', nullif(platforms, ''), 'extracted:' || confidence, CASE WHEN wounded > 0 THEN 'wounded:' || wounded END) AS tags FROM xs JOIN tx USING (key))
SELECT seq, sha1(concat_ws('|', CAST(date AS STRING), event_type, country, location, actor1, notes[:60]))[:16] AS id, date, event_type, actor1, actor2, country, location, magnitude, 'wire' AS source, md5(notes) AS notes, tags FROM ev""")
_add("page_text", lambda s, d: _table(s, d, "pages").select("page_id", F.md5(X.strip_html(F.col("html"))).alias("digest")), r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&amp;', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS digest FROM pages")
_add("page_hosts", lambda s, d: _table(s, d, "pages").groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages")), "SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")

# Recommendations: turns of conversations as events, benchmark items as lessons ------------------------------------------
_KIND_OF = "CASE turn % 5 WHEN 0 THEN 'battle' WHEN 1 THEN 'drone/uas' WHEN 2 THEN 'protests' WHEN 3 THEN 'riots' ELSE 'other' END"
_CATEGORY = "CASE CAST(item_id % 4 AS INT) WHEN 0 THEN 'casualty-care' WHEN 1 THEN 'counter-uas' WHEN 2 THEN 'mobility' ELSE 'logistics' END"
_TAGGED = "CASE CAST(conv_id % 4 AS INT) WHEN 1 THEN {l}'drone-uas'{r} WHEN 2 THEN {l}'armor', 'merged:2'{r} ELSE {l}{r} END"
_lessons = lambda s, d: _table(s, d, "benchmark").selectExpr("item_id AS doc", "text", f"{_CATEGORY} AS category")
_turns = lambda s, d: _table(s, d, "conversations").selectExpr(f"{_KIND_OF} AS event_type", f"{_TAGGED.format(l='array(', r=')')} AS tags", "text AS notes", "CAST(conv_id % 3 AS INT) AS magnitude")
_recommended = lambda s, d: K.recommend_all(_turns(s, d), _lessons(s, d)).withColumn("tags", F.array_join("tags", ","))
_terms = lambda table, key: f"CASE {key} " + " ".join(f"WHEN '{t}' THEN {list(ws)}" for t, ws in table.items()) + " ELSE [] END"
_TERMS = _first(f"list_concat(flatten(list_transform(tags, lambda g: {_terms(PLATFORM_TERMS, 'g')})), {_terms(TYPE_TERMS, 'event_type')})")
_REC = f"""WITH {_POST('benchmark', 'item_id')}, ev AS (SELECT {_KIND_OF} AS event_type, {_TAGGED.format(l='[', r=']')} AS tags, coalesce(text, '') AS notes, conv_id % 3 > 0 AS hurt FROM conversations), qe AS (SELECT event_type, tags, notes, hurt, count(*) AS events FROM ev GROUP BY 1, 2, 3, 4),
qt AS (SELECT event_type, tags, notes, hurt, term, count(*) AS qn FROM (SELECT event_type, tags, notes, hurt, unnest(list_concat({_TERMS}, {_WORDS('notes')})) AS term FROM qe) GROUP BY 1, 2, 3, 4, 5),
sc AS (SELECT event_type, tags, notes, hurt, doc, round(sum(qn * {_SCORE}), 9) AS score FROM qt JOIN po USING (term) JOIN df USING (term), sz GROUP BY 1, 2, 3, 4, 5),
pl AS (SELECT *, row_number() OVER (PARTITION BY event_type, tags, notes, hurt ORDER BY score DESC, doc) AS r FROM sc), bo AS (SELECT pl.*, {_CATEGORY} AS category FROM pl JOIN benchmark ON item_id = doc WHERE r <= 12),
to_ AS (SELECT *, round(score + CASE WHEN category = 'counter-uas' AND list_contains(tags, 'drone-uas') THEN 0.5::DOUBLE WHEN category = 'mobility' AND list_contains(tags, 'armor') THEN 0.5::DOUBLE WHEN hurt AND category = 'casualty-care' THEN 0.4::DOUBLE ELSE 0.0 END, 9) AS total FROM bo),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_type, tags, notes, hurt ORDER BY total DESC, score DESC, doc) AS rank FROM to_), re AS (SELECT rk.*, events FROM rk JOIN qe USING (event_type, tags, notes, hurt) WHERE rank <= 3)"""
_add("recommend", lambda s, d: _recommended(s, d).withColumn("notes", F.md5("notes")), _REC + " SELECT event_type, array_to_string(tags, ',') AS tags, md5(notes) AS notes, hurt, events, CAST(rank AS INT) AS rank, doc, category, score, total FROM re")
_add("lesson_brief", lambda s, d: K.brief(_recommended(s, d), 5), _REC + " SELECT doc, category, round(sum(total * events), 6) AS total_score, CAST(sum(events) AS BIGINT) AS hits FROM re GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5")
