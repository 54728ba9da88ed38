"""Mixtures, scores and text statistics over documents, labels, pages and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import above_chance, clr, cosine, entropy, replace_zeros, share
from ..functions import html, tables
from ..operators import frequent, fuzzy_matches, inverted, nearest, sampling
from ..operators.matching import matched_once
from .registry import registrar

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


@query("select source, count(*) as docs, count(quality) as labelled, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic, round(sum(n_chars) / sum(sum(n_chars)) over (), 6) as char_share from documents left join labels using (doc_id) group by source")
def mixture_quality_by_source(t):
    one = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = t.documents.select("doc_id", "source", "n_chars").join(one, "doc_id", "left")
    by = rows.groupBy("source").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.sum("n_chars").alias("c"))
    return by.withColumn("char_share", F.round(share(F.col("c")), 6)).drop("c")


@query("select source, lang, round(sum(n_chars) / sum(sum(n_chars)) over (partition by source), 6) as part, round(sum(n_chars) / sum(sum(n_chars)) over (), 8) as whole from documents group by source, lang")
def mixture_share(t):
    by = t.documents.groupBy("source", "lang").agg(F.sum("n_chars").alias("c"))
    return by.select("source", "lang", F.round(share(F.col("c"), "source"), 6).alias("part"), F.round(share(F.col("c")), 8).alias("whole"))


@query("with p as (select source, sum(n_chars) / sum(sum(n_chars)) over (partition by source) as p from documents group by source, lang) select source, round(-sum(p * ln(p)), 6) as entropy, round(sum(p * p), 6) as hhi, round(exp(-sum(p * ln(p))), 6) as effective from p where p > 0 group by source")
def mixture_entropy_hhi(t):
    p = t.documents.groupBy("source", "lang").agg(F.sum("n_chars").alias("c")).withColumn("p", share(F.col("c"), "source")).filter("p > 0")
    return p.groupBy("source").agg(F.round(entropy(F.col("p")), 6).alias("entropy"), F.round(F.sum(F.col("p") * F.col("p")), 6).alias("hhi"), F.round(F.exp(entropy(F.col("p"))), 6).alias("effective"))


_LANGS = ["de", "en", "es", "fr"]  # of the given tables, for the SQL alone
_MOST_LANGS = 1000
_WIDE = ", ".join(f"coalesce(sum(n_chars) filter (where lang = '{x}'), 0)::bigint as {x}" for x in _LANGS)


def _langs(t) -> list[str]:
    """The languages of the table, null as "null"; a column each, so more than _MOST_LANGS of them are refused."""
    found = [r[0] for r in t.documents.select(F.coalesce("lang", F.lit("null"))).distinct().limit(_MOST_LANGS + 1).collect()]
    if len(found) > _MOST_LANGS:
        raise ValueError(f"more than {_MOST_LANGS} languages")
    return sorted(found)


def _wide(t, langs: list[str]):
    lang = F.coalesce("lang", F.lit("null")).alias("lang")
    return t.documents.select("source", lang, "n_chars").groupBy("source").pivot("lang", langs).agg(F.sum("n_chars")).fillna(0, langs)


@query(f"select source, {_WIDE} from documents group by source")
def mixture_pivot(t):
    return _wide(t, _langs(t))


@query(f"select source, lang, chars from (select source, {_WIDE} from documents group by source) unpivot (chars for lang in (de, en, es, fr))")
def mixture_unpivot(t):
    langs = _langs(t)
    return _wide(t, langs).unpivot("source", [f"`{x}`" for x in langs], "lang", "chars")


_PARTS = f"""with u as (select source, lang, chars from (select source, {_WIDE} from documents group by source) unpivot (chars for lang in (de, en, es, fr))),
p as (select *, chars / sum(chars) over (partition by source) as p, sum((chars = 0)::int) over (partition by source) as z from u),
q as (select source, lang, case when p = 0 then 0.0005 else p * (1 - z * 0.0005) end as p from p),
c as (select source, lang, ln(p) - avg(ln(p)) over (partition by source) as clr from q)"""


def _clr(t):
    p = mixture_unpivot(t).withColumn("p", share(F.col("chars"), "source"))
    p = p.withColumn("q", replace_zeros(F.col("p"), 0.0005, "source"))
    return p.select("source", "lang", clr(F.col("q"), "source").alias("clr"))


@query(f"{_PARTS} select source, lang, round(clr, 6) as clr from c")
def mixture_clr(t):
    return _clr(t).withColumn("clr", F.round("clr", 6))


@query(f"{_PARTS}, m as (select lang, avg(clr) as m from c group by lang) select source, round(sqrt(sum((clr - m) * (clr - m))), 6) as distance from c join m using (lang) group by source")
def mixture_aitchison(t):
    """Distance of each source's composition to the centre of all."""
    c = _clr(t)
    mean = c.groupBy("lang").agg(F.avg("clr").alias("m"))
    return c.join(mean, "lang").groupBy("source").agg(F.round(F.sqrt(F.sum((F.col("clr") - F.col("m")) * (F.col("clr") - F.col("m")))), 6).alias("distance"))


_SCORE = "select source, lang, avg(quality)::double as s from documents join labels using (doc_id) group by source, lang"


def _scores(t):
    return t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("s"))


_CHANCE = {"de": 0.5, "en": 0.2, "es": 1 / 3, "fr": 0.1}


@query(f"select source, lang, round(greatest(0, (s - b) / (1 - b)) * 100, 4) as score from ({_SCORE}) left join (values ('de', 0.5::double), ('en', 0.2::double), ('es', 1.0::double / 3), ('fr', 0.1::double)) v(l, b) on l = lang")
def score_normalize(t):
    """Each score above the chance level of its language, from a dimension; null where the dimension has none."""
    chance = t.spark.createDataFrame(list(_CHANCE.items()), "lang string, b double")
    return _scores(t).join(F.broadcast(chance), "lang", "left").select("source", "lang", F.round(above_chance(F.col("s"), F.col("b")), 4).alias("score"))


@query(f"select source, round(avg(greatest(0, (s - 0.25) / 0.75) * 100), 4) as mean_score, count(*) as parts from ({_SCORE}) group by source")
def score_group_mean(t):
    return _scores(t).groupBy("source").agg(F.round(F.avg(above_chance(F.col("s"), 0.25)), 4).alias("mean_score"), F.count("*").alias("parts"))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by sha256(text)")
def exact_dedup(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("select doc_id, len(x) as n_lines, round(1 - len(list_distinct(x)) / len(x), 6) as repeated from (select doc_id, string_split(text, chr(10)) as x from documents)")
def line_repeat_ratio(t):
    x = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n_lines"), F.round(1 - F.size(F.array_distinct(x)) / F.size(x), 6).alias("repeated"))


@query("select doc_id, length(text) as chars, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) as words, round(len(regexp_extract_all(text, '[0-9]')) / length(text), 6) as digits, round(len(regexp_extract_all(text, '[^A-Za-z0-9 \\t\\n\\r]')) / length(text), 6) as symbols from documents")
def text_stats(t):
    n = F.length("text")
    return t.documents.select("doc_id", n.cast("long").alias("chars"), F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("long").alias("words"), F.round(F.regexp_count("text", F.lit("[0-9]")) / n, 6).alias("digits"), F.round(F.regexp_count("text", F.lit(r"[^A-Za-z0-9 \t\n\r]")) / n, 6).alias("symbols"))


_FLAGS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"[+]?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "license": r"[Ll]icen[sc]e"}


@query("select doc_id, " + ", ".join(f"regexp_matches(text, '{p}') as {k}" for k, p in _FLAGS.items()) + " from documents")
def pii_flags(t):
    return t.documents.select("doc_id", *[F.col("text").rlike(p).alias(k) for k, p in _FLAGS.items()])


#: Rows of one long up to which a side is broadcast.
_BROADCAST_KEYS = 2_000_000
_GRAMS = "select distinct {id}, array_to_string(w[i:i+7], ' ') as g from (select *, unnest(range(1, len(w) - 6)) as i from (select {id}, string_split(lower(text), ' ') as w from {t}))"


@query(f"with b as ({_GRAMS.format(id='item_id', t='benchmark')}), d as ({_GRAMS.format(id='doc_id', t='documents')}) select doc_id, item_id, count(*) as shared from d join b using (g) group by all")
def contamination_ngram(t):
    """Windows of eight words that documents share with benchmark items, by pair.

    Texts are split once. Windows travel as hashes, and those that the benchmark lacks go before any shuffle; the
    rest are cut from their documents again and compared as text.
    """
    def each(at, made):
        """made(words, i) for each i of at(words), in texts of eight words and more."""
        w = F.split(F.lower("text"), " ")
        return F.when(F.size(w) >= 8, F.transform(F.array(w), lambda x: F.transform(at(x), lambda i: made(x, i)))[0])

    def starts(x):
        return F.sequence(F.lit(1), F.greatest(F.size(x) - 7, F.lit(1)))

    def hashed(x, i):
        return F.xxhash64(F.slice(x, i, 8))

    def joined(x, i):
        return F.array_join(F.slice(x, i, 8), " ")

    asked = t.benchmark.select("item_id", F.explode(each(starts, joined)).alias("g")).distinct()
    keys = t.benchmark.select(F.explode(each(starts, hashed)).alias("k")).distinct()
    keys = F.broadcast(keys) if keys.count() <= _BROADCAST_KEYS else keys
    windows = t.documents.select("doc_id", F.posexplode(each(starts, hashed)).alias("i", "h"))
    found = windows.join(keys, F.col("h") == F.col("k"), "left_semi").groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.col("i") + 1).alias("at"))
    hit = t.documents.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("of")))
    texts = hit.select("doc_id", F.explode(each(lambda x: F.col("at"), joined)).alias("g")).distinct()
    return texts.join(asked, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("select page_id, length(x) as n, md5(x) as digest from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') as x from pages)")
def html_text(t):
    x = F.regexp_replace(F.regexp_replace("html", "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]*>", " ")
    x = F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))
    return t.pages.select("page_id", F.length(x).cast("long").alias("n"), F.md5(x).alias("digest"))


@query()
def html_blocks(t):
    """Pages cut into blocks by their tags, and the text that is left without boilerplate."""
    found = t.pages.select("page_id", html.blocks(F.col("html")).alias("b"))
    kept = F.size(F.filter(html.is_content(F.col("b")), lambda x: x)).cast("long")
    return found.select("page_id", F.size("b").cast("long").alias("blocks"), kept.alias("kept"), F.length(html.content(F.col("b"))).cast("long").alias("chars"), F.md5(html.content(F.col("b"))).alias("digest"))


@query("select conv_id, count(*) as turns, count(*) filter (where role = 'user') as user_turns, sum(length(text))::bigint as chars, arg_min(role, turn) as first_role from conversations group by conv_id")
def conversation_turns(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"), F.min_by("role", "turn").alias("first_role"))


_NEAREST = "with e as (select * from embeddings where vec_id is not null and list_inner_product(embedding::double[], embedding::double[]) > 0), s as (select q.vec_id as query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as sim from e as q join e on q.vec_id % 20 = 0) select query_id, row_number() over (partition by query_id order by sim desc, vec_id) as rank, vec_id, label, sim from s qualify rank <= 20"


@query(_NEAREST)
def vector_cosine_search(t):
    """The 20 nearest rows of every query; the queries are all rows whose id is divisible by 20."""
    return nearest(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 20, "label")


@query(_NEAREST)
def vector_list_search(t):
    """The same by an inverted file: lists near a query first, then those that by their radius could still hold a nearer row."""
    return inverted.search(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 20, "label", exact=True)


@query(f"select query_id, vec_id, label, sim from ({_NEAREST})")
def vector_cosine_topk(t):
    """The nearest rows of every query without their ranks; the cosines are computed once more, by expression, for the pairs found alone."""
    pairs = vector_list_search(t).select("query_id", "vec_id", "label")
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return pairs.join(asked, "query_id").join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("query_id", "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))


@query("select event_type, json_extract_string(props, '$.k') as k, count(*) as n, round(sum(value), 4) as total from events group by all")
def json_props(t):
    return t.events.groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select lower(w) as word, count(*) as n from (select unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as w from documents) group by 1")
def explode_words(t):
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


@query("select source, lang, count(*) as docs, round(quantile_cont(n_chars, 0.5), 2) as median_chars, round(avg(n_chars), 4) as avg_chars from documents group by all")
def domain_text_summary(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.round(F.median("n_chars"), 2).alias("median_chars"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("select doc_id, source from documents where ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint < 429496729")
def hash_sample(t):
    """A deterministic tenth of the documents, by hash threshold: sampling is what the query is for."""
    return t.documents.filter(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") < 429496729).select("doc_id", "source")


@query("select d.lang, l.label, rk from (select lang, row_number() over (order by count(*) desc, lang)::int as rk from documents group by lang) d join (values ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish')) l(code, label) on d.lang = l.code")
def broadcast_dimension(t):
    names = t.spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish")], "code string, label string")
    by = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    ranked = by.withColumn("rk", F.row_number().over(Window.orderBy(F.col("n").desc(), "lang")))
    return ranked.join(F.broadcast(names), F.col("lang") == F.col("code")).select("lang", "label", "rk")


@query("with e as (select event_id, json_extract(props, '$.k')::int as k from events where props is not null) select 'k' as key, k // 10 as tens, count(*) as n, min(k) as least, max(k) as most from e group by all")
def map_entries(t):
    """JSON as a map: its entries, a value by key, and the same by variant access."""
    m = t.events.select(F.from_json("props", "map<string,int>").alias("m"), F.variant_get(F.parse_json("props"), "$.k", "int").alias("v"))
    rows = m.select(F.explode(F.map_entries("m")).alias("e"), F.element_at("m", "k").alias("k"), "v").filter("k <=> v and e.value = k")
    return rows.groupBy(F.col("e.key").alias("key"), F.expr("k div 10").alias("tens")).agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("e.value").alias("most"))


@query("select event_type, nullif(domain, '(none)') as domain, nullif(domain, '(none)') is not null as mapped, count(*) as n from events left join (values ('view', 'reading'), ('click', 'acting'), ('purchase', 'acting'), ('error', '(none)')) m(k, domain) on k = event_type group by all")
def domain_mapping(t):
    """A small mapping with a sentinel: what it does not know, or maps to (none), stays null."""
    table = t.spark.createDataFrame([("view", "reading"), ("click", "acting"), ("purchase", "acting"), ("error", "(none)")], "k string, to string")
    d = t.events.join(F.broadcast(table), F.col("event_type") == F.col("k"), "left").select("event_type", F.nullif(F.col("to"), F.lit("(none)")).alias("domain"))
    return d.groupBy("event_type", "domain", F.col("domain").isNotNull().alias("mapped")).agg(F.count("*").alias("n"))


@query("select split_part(p_name, ' ', 1) as first_word, regexp_extract(p_type, '^([A-Z]+)', 1) as kind, upper(trim(replace(p_brand, 'Brand#', ' '))) as brand, count(*) as n from part group by all")
def string_parts(t):
    return t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), F.regexp_extract("p_type", "^([A-Z]+)", 1).alias("kind"), F.upper(F.trim(F.replace("p_brand", F.lit("Brand#"), F.lit(" ")))).alias("brand")).agg(F.count("*").alias("n"))


_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_NAMES = "with a as (select distinct p_name as n from part), b as (select distinct substr(p_name, 2) as m from part)"


@query(f"{_NAMES} select n, m, levenshtein({_PLAIN.format('n')}, {_PLAIN.format('m')}) as edits from a, b where levenshtein({_PLAIN.format('n')}, {_PLAIN.format('m')}) <= 2")
def fuzzy_names(t):
    """Names within two edits of names that have lost a letter."""
    a, b = t.part.select(F.col("p_name").alias("n")).distinct(), t.part.select(F.substr("p_name", F.lit(2)).alias("m")).distinct()
    plain = [F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in "nm"]
    return fuzzy_matches(a, b, "n", "m", 2).select("n", "m", F.levenshtein(*plain).alias("edits"))


@query("with w as (select unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as word from documents) select word, count(*) as n from w group by word having count(*) >= 0.002 * (select count(*) from w)")
def heavy_words(t):
    """Words that make up two in a thousand or more, counted exactly in a second pass over what a bounded sketch has found."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return frequent.frequent_items(words, "word", 0.002).select(F.col("item").alias("word"), "n")


@query("with k as (select doc_id, source, -ln((('0x' || substr(md5('42:' || doc_id), 1, 13))::bigint + 0.5) / 4503599627370496) / n_chars as e from documents where n_chars > 0) select doc_id, source from k qualify row_number() over (partition by source order by e, doc_id) <= 12")
def stratified_documents(t):
    """Twelve documents of each source, drawn by their characters: the sample is what the query is for."""
    return sampling.stratified(t.documents.select("doc_id", "source", "n_chars"), "source", "doc_id", 12, "n_chars").select("doc_id", "source")


@query(f"{_NAMES}, p as (select n, m, levenshtein({_PLAIN.format('n')}, {_PLAIN.format('m')}) as edits from a, b where levenshtein({_PLAIN.format('n')}, {_PLAIN.format('m')}) <= 2), s as (select list({{'n': [n], 'm': [m], 'e': [edits]}} order by edits, n, m) as x from p), r as (select list_reduce(x, lambda u, v: case when list_has_any(u.n, v.n) or list_has_any(u.m, v.m) then u else {{'n': list_concat(u.n, v.n), 'm': list_concat(u.m, v.m), 'e': list_concat(u.e, v.e)}} end) as t from s) select unnest(t.n) as n, unnest(t.m) as m, unnest(t.e) as edits from r")
def matched_names(t):
    """Names matched one to one with names that have lost a letter, the fewest edits first."""
    return matched_once(t.part.select(F.col("p_name").alias("n")), t.part.select(F.substr("p_name", F.lit(2)).alias("m")), "n", "m", 2)


@query("with x as (select doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9.]+)@([a-z0-9]+)[.]example', 1)) as name, unnest(regexp_extract_all(text, '([A-Za-z0-9.]+)@([a-z0-9]+)[.]example', 2)) as host from documents) select host, count(*) as n, count(distinct doc_id) as docs, min(name) as least from x group by host")
def lateral_matches(t):
    """A table function whose columns come from the named groups of its pattern, joined laterally to whole texts."""
    tables.register(t.spark)
    pattern = r"(?P<name>[A-Za-z0-9.]+)@(?P<host>[a-z0-9]+)[.]example"
    found = t.spark.sql("select doc_id, m.name, m.host from {docs} d, lateral named_matches(d.text, {pattern}) m", docs=t.documents.select("doc_id", "text"), pattern=pattern)
    return found.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("name").alias("least"))
