"""Queries over texts: filters, classes, redaction, formatting, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, text as T
from ..operators import curation
from ..sources.tables import EXCHANGES_SQL, MEMORIES_SQL, exchanges, memories, table
from .registry import query

EX = "WITH " + EXCHANGES_SQL
WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]"


def trim_sql(c):
    return rf"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def ratio_sql(c):
    return rf"(CASE WHEN octet_length(encode({c})) > 0 THEN length(regexp_replace({c}, '[^\p{{L}}\p{{Nd}}]', '', 'g')) / octet_length(encode({c})) ELSE 0 END)"


DOCS = f"WITH d AS (SELECT doc_id, {trim_sql('text')} AS t FROM documents) "


@query("noise_filter", DOCS + f"SELECT doc_id, octet_length(encode(t)) < 40 OR {ratio_sql('t')} < 0.40 AS noise, round({ratio_sql('t')}, 6) AS ratio FROM d")
def noise_filter(spark, sf):
    text = T.trim_white(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", gates.is_noise(F.col("text")).alias("noise"), F.round(T.alnum_ratio(text), 6).alias("ratio"))


@query("short_answers", EX + f"SELECT id, octet_length(encode({trim_sql('answer')})) < 400 AS short FROM ex")
def short_answers(spark, sf):
    return exchanges(spark, sf).select("id", gates.is_short(F.col("answer"), 400).alias("short"))


def either_sql(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ROUTINE = f"(lower({trim_sql('u')}) IN ({either_sql(gates.ACKNOWLEDGMENTS)}) AND list_bool_or(list_transform([{either_sql(gates.PROCEDURAL)}], lambda p: starts_with(lower({trim_sql('r')}), p))))"
SAID = ", a AS (SELECT *, CASE WHEN turn % 4 = 0 THEN ' Thanks! ' ELSE user_msg END AS u, CASE WHEN conv_id % 2 = 0 THEN 'Done. ' || answer ELSE answer END AS r FROM ex)"


@query("routine_exchanges", EX + SAID + f" SELECT id, {ROUTINE} AS routine FROM a")
def routine_exchanges(spark, sf):
    user = F.when(F.col("turn") % 4 == 0, F.lit(" Thanks! ")).otherwise(F.col("user_msg"))
    answer = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Done. "), "answer")).otherwise(F.col("answer"))
    return exchanges(spark, sf).select("id", gates.is_acknowledged_routine(user, answer).alias("routine"))


LED = "WITH " + EXCHANGES_SQL + ", a AS (SELECT id, CASE conv_id % 4 WHEN 0 THEN 'It seems ' || answer WHEN 1 THEN 'Based on oneTwo ' || answer ELSE answer END AS r FROM ex) "


def _led():
    return F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("It seems "), "answer")).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("Based on oneTwo "), "answer")).otherwise(F.col("answer"))


SPECIFIC = (
    r"(contains(t, '```') OR (length(t) - length(replace(t, '(', '')) > 2 AND length(t) - length(replace(t, ')', '')) > 2) OR length(t) - length(replace(t, '/', '')) > 2 "
    r"OR contains(t, 'Error:') OR contains(t, 'error:') OR contains(t, 'Exception') OR contains(t, 'panic:') "
    r"OR len(list_filter(list_transform(regexp_split_to_array(t, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{L}\p{Nd}]+', ''), '[^\p{L}\p{Nd}]+$', '')), "
    r"lambda w: octet_length(encode(w)) >= 4 AND (regexp_matches(w, '^.+[A-Z]') OR regexp_matches(w, '_.*_')))) > 0)"
)


@query("specific_content", f"WITH d AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, {SPECIFIC} AS is_specific FROM d")
def specific_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", gates.is_specific(F.col("text")).alias("is_specific"))


@query("response_class", LED + f", c AS (SELECT id, {trim_sql('r')} AS t FROM a) SELECT id, CASE WHEN octet_length(encode(t)) < 20 OR {ratio_sql('t')} < 0.40 THEN 'noise' WHEN starts_with(lower(t), 'it seems') OR starts_with(lower(t), 'based on ') THEN CASE WHEN {SPECIFIC} THEN 'substantive' ELSE 'explanation' END WHEN octet_length(encode(t)) >= 60 AND {ratio_sql('t')} >= 0.50 THEN 'substantive' ELSE 'noise' END AS class FROM c")
def response_class(spark, sf):
    return exchanges(spark, sf).select("id", gates.response_class(_led()).alias("class"))


@query("heuristic_label", LED + f", c AS (SELECT id, {trim_sql('r')} AS t FROM a) SELECT id, CASE WHEN length(t) < 80 THEN 'noise' WHEN length(t) < 200 AND regexp_matches(lower(t), '^(let me |i''ll |i need to |searching|running|checking|looking at |reading|now |opening|executing |starting |sure|ok|done|got it|understood|i''ve |i have |here''s the |proceeding|continuing)') THEN 'noise' WHEN length(t) > 400 AND contains(t, '```') THEN 'substantive' WHEN length(t) > 800 AND ((length(t) - length(replace(t, chr(10) || '- ', ''))) / 3 >= 3 OR (length(t) - length(replace(t, chr(10) || '* ', ''))) / 3 >= 3 OR ((length(t) - length(replace(t, chr(10) || '1.', ''))) / 3 >= 1 AND (length(t) - length(replace(t, chr(10) || '2.', ''))) / 3 >= 1)) THEN 'substantive' WHEN length(t) > 1200 THEN 'substantive' ELSE 'low' END AS label FROM c")
def heuristic_label(spark, sf):
    return exchanges(spark, sf).select("id", gates.heuristic_label(_led()).alias("label"))


JUNK = "WITH c AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Let me try ' || text WHEN 1 THEN 'Command: grep x' || text WHEN 2 THEN text || ' key findings' WHEN 3 THEN '<filepaths>' || text WHEN 4 THEN 'permission of a repository ' || text WHEN 5 THEN 'Warmup ' || text WHEN 6 THEN text || ' hyperswitch' ELSE text END AS t FROM documents) "


@query("junk_class", JUNK + "SELECT CASE WHEN contains(lower(t), 'permission') AND contains(lower(t), 'repository') THEN 'permission_check' WHEN contains(lower(t), '<filepaths>') THEN 'grep_output_xml' WHEN contains(lower(t[:50]), 'command:') AND contains(lower(t[:100]), 'grep') THEN 'command_output' WHEN contains(lower(t[:80]), 'let me') AND regexp_matches(lower(t[:150]), 'search|check|look|try|examine') THEN 'let_me_search' WHEN contains(lower(t[:100]), 'warmup') THEN 'warmup_boilerplate' WHEN contains(lower(t), 'hyperswitch') THEN 'codebase_exploration' WHEN regexp_matches(lower(t), 'implementation|based on my|key findings|here''s what') THEN 'implementation_detail' ELSE 'other' END AS kind, count(*) AS n FROM c GROUP BY 1")
def junk_class(spark, sf):
    d = F.col("doc_id") % 8
    text = (
        F.when(d == 0, F.concat(F.lit("Let me try "), "text")).when(d == 1, F.concat(F.lit("Command: grep x"), "text")).when(d == 2, F.concat("text", F.lit(" key findings")))
        .when(d == 3, F.concat(F.lit("<filepaths>"), "text")).when(d == 4, F.concat(F.lit("permission of a repository "), "text")).when(d == 5, F.concat(F.lit("Warmup "), "text"))
        .when(d == 6, F.concat("text", F.lit(" hyperswitch"))).otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").groupBy(gates.junk_class(text).alias("kind")).agg(F.count("*").alias("n"))


RELEVANT = ", ".join(f"count(*) FILTER (WHERE list_bool_or(list_transform([{either_sql(words)}], lambda w: contains(text, w)))) AS \"{topic}\"" for topic, words in gates.TOPICS.items())


@query("topic_relevance", f"SELECT lang, {RELEVANT} FROM documents GROUP BY lang")
def topic_relevance(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(*[F.count_if(gates.is_relevant(F.col("text"), topic)).alias(topic) for topic in gates.TOPICS])


THINK = "WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>' || substr(text, 1, 40) || '</think> ' || substr(text, 41) WHEN 1 THEN substr(text, 1, 60) || ' <think>' || substr(text, 61) ELSE text END AS t FROM documents) "


@query("without_thinking", THINK + f"SELECT doc_id, {trim_sql('''regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '')''')} AS t FROM c")
def without_thinking(spark, sf):
    d = F.col("doc_id") % 3
    text = (
        F.when(d == 0, F.expr("concat('<think>', substr(text, 1, 40), '</think> ', substr(text, 41))"))
        .when(d == 1, F.expr("concat(substr(text, 1, 60), ' <think>', substr(text, 61))"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", T.without_thinking(text).alias("t"))


HTML_TEXT = (
    "b AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', '', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages), "
    "u AS (SELECT page_id, url, html, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM b), "
    "page AS (SELECT page_id, url, html, " + trim_sql(r"regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS content FROM u)"
)


@query("html_text", f"WITH {HTML_TEXT} SELECT page_id, sha256(content) AS hash FROM page")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.html_to_text(F.col("html")), 256).alias("hash"))


def encoded_sql(url: str) -> str:
    """A URL whose path is percent-coded where it has to be, without fragment."""
    return rf"regexp_extract({url}, '^([a-z]+://[^/?#]*)', 1) || replace(replace(url_encode(regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '%2F', '/'), '%2C', ',') || regexp_extract({url}, '^[^?#]*(\?[^#]*)', 1)"


TARGET = encoded_sql("(CASE WHEN starts_with(l, '/') THEN site || l ELSE l END)")
LINKS = (
    r"h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, unnest(regexp_extract_all(html, '(?i)href\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]', 1)) AS l FROM pages), "
    f"link AS (SELECT DISTINCT page_id, {TARGET} AS link FROM h WHERE NOT regexp_matches(l, '^(#|javascript:|mailto:)'))"
)


@query("html_links", f"WITH {LINKS} SELECT page_id, link FROM link")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(T.links(F.col("html"), F.col("url"))).alias("link"))


@query("url_scope", r"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) = 'blog.tionsh.example.net' AND starts_with(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/en') AS inside FROM pages")
def url_scope(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.in_scope(F.col("url"), F.lit("http://blog.tionsh.example.net/en")).alias("inside"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def secrets_sql(column: str) -> str:
    """The redaction patterns in the dialect of SQL's regular expressions, one around the other."""
    for pattern, said in T.SECRETS:
        plain = pattern.replace(T.EDGE, r"\b").replace("(?iu)", "(?i)").replace("'", r"\x27").replace('"', r"\x22")
        column = f"regexp_replace({column}, '{plain}', '{said.replace('$', chr(92))}', 'g')"
    return column


@query("redacted_emails", f"SELECT doc_id, sha256({secrets_sql('text')}) AS hash FROM documents")
def redacted_emails(spark, sf):
    """The first pass of redaction, all its patterns, over every document."""
    from functools import reduce

    return table(spark, sf, "documents").select("doc_id", F.sha2(reduce(lambda t, p: F.regexp_replace(t, *p), T.SECRETS, F.col("text")), 256).alias("hash"))


@query("redacted_sections", None)
def redacted_sections(spark, sf):
    return curation.sections(table(spark, sf, "documents"))


@query("truncated_texts", None)
def truncated_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncated(F.col("text"), 1000).alias("text"))


@query("response_text", "WITH r AS (SELECT conv_id, list(text ORDER BY turn) AS said FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, array_to_string(said, chr(10)) AS reply FROM r")
def response_text(spark, sf):
    """Replies as a service gives them, in JSON, and the text in them."""
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(said.alias("said"))
    body = F.to_json(F.struct(F.lit("message").alias("type"), F.transform("said", lambda x: F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    return rows.select("conv_id", T.response_text(body).alias("reply"))


VALUE = r"regexp_extract(substr(v, strpos(lower(v), k) + length(k)), '^[ \t\x22\x27]*[=:][ \t\x22\x27]*([^ \t\n\x22\x27,;]+)', 1)"
VALUES = (
    "list_reduce(list_prepend(line, [" + ", ".join(f"'{k}'" for k in T.SENSITIVE) + f"]), lambda v, k: CASE WHEN contains(lower(v), k) AND length({VALUE}) >= 4 AND NOT starts_with({VALUE}, '[REDACTED') "
    f"THEN substr(v, 1, strpos(v, {VALUE}) - 1) || '[REDACTED]' || substr(v, strpos(v, {VALUE}) + length({VALUE})) ELSE v END)"
)


@query("redacted_documents", f"WITH p AS (SELECT doc_id, {secrets_sql('text')} AS t FROM documents) SELECT doc_id, sha256(array_to_string(list_transform(string_split(t, chr(10)), lambda line: CASE WHEN regexp_matches(line, '[^\\x00-\\x7e]') THEN line ELSE {VALUES} END), chr(10))) AS hash FROM p")
def redacted_documents(spark, sf):
    """Both passes of redaction over every document."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("hash"))


@query("first_words", rf"SELECT lower(regexp_extract({trim_sql('text')}, '^([^ \t\n.,!?;:]*)', 1)) AS word, count(*) AS n FROM documents GROUP BY 1")
def first_words(spark, sf):
    return table(spark, sf, "documents").groupBy(T.first_word(F.col("text")).alias("word")).agg(F.count("*").alias("n"))


@query("first_lines", DOCS + ", l AS (SELECT doc_id, split_part(t, chr(10), 1) AS f FROM d) SELECT doc_id, CASE WHEN length(f) > 80 THEN substr(f, 1, 77) || '...' ELSE f END AS line FROM l")
def first_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


@query("file_names", r"WITH u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(translate(url, '/ :', '---'), '[^A-Za-z0-9_-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS f FROM pages) SELECT page_id, CASE WHEN f = '' THEN 'unnamed' ELSE f END AS name FROM u")
def file_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


@query("message_text", "WITH m AS (SELECT conv_id, turn, to_json([{'type': 'text', 'text': text}, {'type': 'image', 'text': 'no'}, {'type': 'text', 'text': role}]) AS body FROM conversations) SELECT conv_id, turn, json_extract_string(body, '$[0].text') || chr(10) || json_extract_string(body, '$[2].text') AS content FROM m")
def message_text(spark, sf):
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    body = F.to_json(F.array(block("text", F.col("text")), block("image", F.lit("no")), block("text", F.col("role"))))
    blocks = F.from_json(body, "array<struct<type: string, text: string>>")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n").alias("content"))


@query("last_user_message", "SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user') AS message FROM conversations GROUP BY conv_id")
def last_user_message(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("message"))


@query("turn_pairs", "WITH p AS (SELECT conv_id, least(count(*) FILTER (WHERE role = 'user'), count(*) FILTER (WHERE role = 'assistant')) AS pairs FROM conversations GROUP BY conv_id) SELECT conv_id, pairs, pairs >= 3 AND (pairs = 3 OR pairs % 5 = 0) AS due FROM p")
def turn_pairs(spark, sf):
    role = F.col("role")
    pairs = F.least(F.count_if(role == "user"), F.count_if(role == "assistant"))
    counted = table(spark, sf, "conversations").groupBy("conv_id").agg(pairs.alias("pairs"))
    return counted.withColumn("due", (F.col("pairs") >= 3) & ((F.col("pairs") == 3) | (F.col("pairs") % 5 == 0)))


@query("transcripts", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id")
def transcripts(spark, sf):
    rows = table(spark, sf, "conversations").filter("role in ('user', 'assistant') and text <> ''")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("said"))))
    return rows.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.array_join(F.transform("parts", lambda p: p["said"]), "\n\n").alias("transcript"))


@query("exchange_format", EX + f"SELECT id, '**Q:** ' || {trim_sql('user_msg')} || chr(10) || chr(10) || '**A:** ' || {trim_sql('answer')} AS qa FROM ex")
def exchange_format(spark, sf):
    return exchanges(spark, sf).select("id", T.qa_pair(F.col("user_msg"), F.col("answer")).alias("qa"))


@query("conversation_turns", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''")
def conversation_turns(spark, sf):
    """The turns of requests in JSON, in which every other message is a list of blocks."""
    blocks = F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text"))).alias("content"))
    message = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", F.col("text").alias("content")))).otherwise(F.to_json(blocks))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("m"))
    request = F.concat(F.lit('{"model": "any", "messages": ['), F.array_join(F.transform("m", lambda x: x["m"]), ","), F.lit("]}"))
    return rows.select("conv_id", F.posexplode(T.turns(request)).alias("place", "t")).select("conv_id", F.col("place").cast("bigint").alias("place"), "t.role", "t.content")


TOPICS = (
    "WITH RECURSIVE x AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, octet_length(encode(text)) AS size, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON vec_id = doc_id), "
    "st AS (SELECT label, pos, 1 AS topic, size, e FROM x WHERE pos = 0 UNION ALL SELECT label, pos, CASE WHEN o THEN topic + 1 ELSE topic END, CASE WHEN o THEN grown ELSE size + 2 + grown END, e "
    "FROM (SELECT x.label, x.pos, st.topic, st.size, x.size AS grown, x.e, list_cosine_similarity(st.e, x.e) < -0.05 OR st.size + 2 + x.size > 20000 AS o FROM st JOIN x ON x.label = st.label AND x.pos = st.pos + 1)) "
    "SELECT label AS doc_id, pos, topic FROM st"
)


@query("topic_groups", TOPICS)
def topic_groups(spark, sf):
    """Groups of neighbours, by likeness and size; documents that have a vector, in order, a sequence for each label."""
    from pyspark.sql import Window

    from ..operators.chunking import topic_groups as grouped

    rows = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    pos = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("pos")
    return grouped(rows.select(F.col("label").alias("doc_id"), pos, "text", "embedding"), -0.05, 20_000)


@query("skip_replies", EX + "SELECT id, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS skip FROM ex")
def skip_replies(spark, sf):
    d = F.col("id") % 4
    reply = F.when(d == 0, F.lit(" SKIP ")).when(d == 1, F.concat(F.lit("SKIP\n"), "answer")).when(d == 2, F.concat(F.lit("STAGE 2: "), "answer")).otherwise(F.concat(F.lit("SKIPPED "), "answer"))
    return exchanges(spark, sf).select("id", gates.is_skip(reply).alias("skip"))


FATES = (
    DOCS + f", n AS (SELECT doc_id, octet_length(encode(t)) < 80 OR {ratio_sql('t')} < 0.60 AS noise FROM d), "
    "f AS (SELECT doc_id, source, lang, CASE WHEN noise THEN 'filtered' WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'duplicate' ELSE 'stored' END AS fate FROM documents JOIN n USING (doc_id)), "
    "s AS (SELECT {by}, count(*) FILTER (WHERE fate = 'stored') AS stored, count(*) FILTER (WHERE fate = 'duplicate') AS duplicates, count(*) FILTER (WHERE fate = 'filtered') AS filtered FROM f GROUP BY {by}) "
)


def _fate_counts(spark, sf, by):
    """How many documents are noise, copies of an earlier one, or neither; equal texts are one row before they are looked at."""
    docs = table(spark, sf, "documents").select("doc_id", by, "text", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = docs.withColumn("noise", gates.is_noise(F.col("text"), 80, 0.60)).join(first, ["digest", "doc_id"], "left")
    fate = F.when(F.col("noise"), "filtered").when(F.col("first"), "stored").otherwise("duplicate")
    of = lambda kind: F.count_if(F.col("fate") == kind)
    return told.select(by, fate.alias("fate")).groupBy(by).agg(of("stored").alias("stored"), of("duplicate").alias("duplicates"), of("filtered").alias("filtered"))


@query("write_counters", FATES.replace("{by}", "source") + "SELECT * FROM s")
def write_counters(spark, sf):
    return _fate_counts(spark, sf, "source")


@query("tier_summaries", FATES.replace("{by}", "lang") + "SELECT lang AS tier, stored + duplicates + filtered AS sent, stored, duplicates, filtered, round(stored * 1.0 / (stored + duplicates + filtered), 6) AS rate FROM s")
def tier_summaries(spark, sf):
    """Sent, stored and left out, by tier; here the tiers are the languages."""
    sent = F.col("stored") + F.col("duplicates") + F.col("filtered")
    return _fate_counts(spark, sf, "lang").select(F.col("lang").alias("tier"), sent.alias("sent"), "stored", "duplicates", "filtered", F.round(F.col("stored") / sent, 6).alias("rate"))


@query("write_summaries", FATES.replace("{by}", "source") + "SELECT source, CASE WHEN stored + duplicates + filtered = 0 THEN 'Nothing to store.' ELSE concat_ws(', ', CASE WHEN stored > 0 THEN stored || ' stored' END, CASE WHEN duplicates > 0 THEN duplicates || ' skipped (duplicate)' END, CASE WHEN filtered > 0 THEN filtered || ' skipped (too short/noisy)' END) || '.' END AS summary, duplicates FROM s")
def write_summaries(spark, sf):
    said = _fate_counts(spark, sf, "source").withColumn("summary", T.write_summary(F.col("stored"), F.lit(0), F.col("duplicates"), F.lit(0), F.col("filtered")))
    return said.select("source", "summary", T.summary_count(F.col("summary"), r"skipped \(duplicate\)").cast("bigint").alias("duplicates"))


@query("delta_texts", "SELECT conv_id, string_agg(delta, '' ORDER BY turn, part) AS said FROM (SELECT conv_id, turn, unnest([1, 2]) AS part, unnest([substr(text, 1, 20), substr(text, 21)]) AS delta FROM conversations WHERE role = 'assistant') GROUP BY conv_id")
def delta_texts(spark, sf):
    """Replies put together again from the events of a stream, two pieces a reply."""
    from ..streaming.streams import joined_pieces, text_pieces

    said = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.array(F.substring("text", 1, 20), F.expr("substr(text, 21)"))).alias("part", "text"))
    event = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), "text").alias("delta")))
    events = said.select(F.col("conv_id").alias("message"), (F.col("turn") * 2 + F.col("part")).cast("bigint").alias("place"), event.alias("data"), F.lit(None).cast("timestamp").alias("at"))
    return joined_pieces(text_pieces(events)).select(F.col("message").alias("conv_id"), "said")


@query("heading_sections", "WITH s AS (SELECT doc_id, pos, 'H' || ((pos // 2) % 3) AS heading, line AS text FROM (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''), o AS (SELECT *, CASE WHEN lag(heading) OVER w IS NULL OR lag(heading) OVER w <> heading THEN 1 ELSE 0 END AS opens FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM o) SELECT doc_id, section::BIGINT AS section, any_value(heading) AS heading, '## ' || any_value(heading) || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM g GROUP BY doc_id, section")
def heading_sections(spark, sf):
    from ..operators.curation import heading_groups

    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return heading_groups(lines.withColumn("heading", F.concat(F.lit("H"), (F.floor(F.col("pos") / 2) % 3).cast("string"))))


@query("system_prompts", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'context' ELSE 'context' || chr(10) || chr(10) || url END AS prompt FROM pages")
def system_prompts(spark, sf):
    d = F.col("page_id") % 3
    prompt, context = F.when(d == 1, "").otherwise(F.col("url")), F.when(d == 0, "").otherwise("context")
    return table(spark, sf, "pages").select("page_id", T.with_context(prompt, context).alias("prompt"))


@query("joined_topics", "SELECT conv_id, turn // 2 AS topic, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL")
def joined_topics(spark, sf):
    """What a topic's chunks come to without a model: joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id", F.expr("turn div 2").alias("topic")).agg(parts.alias("p"))
    return rows.select("conv_id", "topic", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


@query("noise_prototypes", EX + "SELECT id, substr(answer, 1, 500) AS prototype FROM ex WHERE score < 0.35 ORDER BY id DESC LIMIT 150")
def noise_prototypes(spark, sf):
    """The last 150 rejected answers, which become the noise prototypes; the limit is the size of that set."""
    return exchanges(spark, sf).filter("score < 0.35").orderBy(F.desc("id")).limit(150).select("id", F.substring("answer", 1, 500).alias("prototype"))


@query("database_results", "WITH " + MEMORIES_SQL + "SELECT CASE WHEN source = 'mcp' THEN 'first' ELSE 'second' END AS database, count(*) AS n, sum(hit_count)::BIGINT AS hits FROM mem GROUP BY 1")
def database_results(spark, sf):
    """Rows of several databases as one table with the database's name."""
    rows = memories(spark, sf)
    both = rows.filter("source = 'mcp'").withColumn("database", F.lit("first")).unionByName(rows.filter("source <> 'mcp'").withColumn("database", F.lit("second")))
    return both.groupBy("database").agg(F.count("*").alias("n"), F.sum("hit_count").alias("hits"))
