"""Readers on files that queries write from the tables first: CSV, JSON lines, xz lines and result cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators.scores import PARTS, SCORES, card_scores, row_mean
from ..scratch import folder
from ..sources.variants import leaves
from ..sources.xz import XzLines
from .registry import registrar

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


@query("""select c_custkey, 'a "' || c_name || '",' || chr(10) || c_mktsegment as name, c_acctbal from customer""")
def csv_round_trip(t):
    """Quoted line feeds, commas and doubled quotes, written and read back."""
    name = F.concat(F.lit(' a "'), "c_name", F.lit('",\n'), "c_mktsegment", F.lit(" \n"))
    out = folder(t.spark, "csv")
    sources.write_csv(t.customer.select("c_custkey", name.alias("name"), "c_acctbal"), out)
    return sources.read_csv(t.spark, out, "c_custkey long, name string, c_acctbal double")


@query("select l_linenumber::double as run, count(*) as points, sum(l_quantity) as total from lineitem where l_linenumber <= 5 group by all")
def csv_glob_runs(t):
    """One folder of CSV files for each run; a glob picks some, the run's number comes from the path, and Spark splits files."""
    out = folder(t.spark, "csv")
    sources.write_csv(t.lineitem.select("l_orderkey", "l_quantity", F.concat(F.lit("trajectory_"), "l_linenumber", F.lit("B")).alias("run")), out, "run")
    rows = t.spark.read.schema("l_orderkey long, l_quantity double").option("header", True).csv(f"{out}/run=trajectory_[1-5]B")
    return rows.groupBy(sources.number_in_path("trajectory_([0-9.]+)B").alias("run")).agg(F.count("*").alias("points"), F.sum("l_quantity").alias("total"))


@query("select event_type, json_extract(props, '$.k')::int % 7 as k, count(*) as n from events group by all")
def jsonl_round_trip(t):
    out = folder(t.spark, "json")
    t.events.select("event_type", F.from_json("props", "k int").alias("props")).write.json(out)
    rows = t.spark.read.schema("event_type string, props struct<k: int>").json(out)
    return rows.groupBy("event_type", (F.col("props.k") % 7).alias("k")).agg(F.count("*").alias("n"))


@query("select doc_id, length(text) as chars, md5(text) as digest from documents")
def xz_lines(t):
    """JSON lines in .xz files of many blocks, written and read back: partitions are runs of blocks."""
    t.spark.dataSource.register(XzLines)
    out = folder(t.spark, "xz")
    lines = t.documents.select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    lines.write.format("xz_lines").option("blockBytes", 1 << 18).mode("append").save(out)
    read = t.spark.read.format("xz_lines").option("splitBytes", 1 << 20).load(out).select(F.from_json("value", "doc_id long, text string").alias("d"))
    return read.select("d.doc_id", F.length("d.text").cast("long").alias("chars"), F.md5("d.text").alias("digest"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by all")
def partitioned_sink(t):
    """Parquet by two partition columns, read back with the folders' values."""
    out = folder(t.spark, "parquet")
    t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity").write.partitionBy("l_returnflag", "l_linestatus").parquet(out)
    rows = t.spark.read.schema("l_quantity double, l_returnflag string, l_linestatus string").parquet(out)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def _cards(t) -> str:
    """A card for each source in a folder of its own: front matter and the raw rates of all tasks, made up of the source's characters."""
    tasks = t.spark.createDataFrame([(f"leaderboard_{task}", metric, i + 1) for i, (_, task, metric, _) in enumerate(PARTS)], "task string, metric string, i int")
    by = t.documents.groupBy("source").agg(F.sum("n_chars").alias("c"))
    rates = by.join(F.broadcast(tasks)).select("source", "task", "metric", ((F.col("c") * F.col("i")) % 1000 / 1000).alias("rate"))
    metrics = rates.groupBy("source", "task").agg(F.map_from_entries(F.collect_list(F.struct("metric", "rate"))).alias("m"))
    whole = metrics.groupBy("source").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("task", "m")))).alias("body"))
    head = F.concat(F.lit("---\nconfigs:\n- config_name: "), "source", F.lit("\n  data_files:\n  - split: latest\n    path:\n    - '**/samples_"), "source", F.lit(".json'\n---\n# Results\n"))
    text = F.concat(head, F.lit('```python\n{"all": {"x": {"acc,none": 1.0}},\n'), F.expr("substring(body, 2)"), F.lit("\n```\n"))
    out = folder(t.spark, "cards")
    whole.select("source", text.alias("value")).repartition("source").write.partitionBy("source").text(out)
    return out


_RATE = "greatest(0, (c * i % 1000 / 1000.0::double - b) / (1 - b)) * 100"
_CARDS = f"with p(score, i, b) as (values {', '.join(f'({s!r}, {i + 1}, {b!r}::double)' for i, (s, _, _, b) in enumerate(PARTS))}), d as (select source, sum(n_chars) as c from documents group by source), s as (select source, {', '.join(f'avg({_RATE}) filter (where score = {s!r}) as {s}' for s in SCORES)} from d, p group by source)"


@query(f"{_CARDS} select source, {', '.join(f'round({s}, 4) as {s}' for s in SCORES)} from s")
def card_results(t):
    """Cards read back, each task above its own chance level, averaged to scores."""
    rows = sources.read_cards(t.spark, f"{_cards(t)}/*", "file_path").withColumn("source", F.regexp_extract("file_name", "/source=([^/]+)/", 1))
    return card_scores(rows, "source").select("source", *[F.round(s, 4).alias(s) for s in SCORES])


@query(f"{_CARDS} select source, round((ifeval + bbh + gpqa + musr + mmlu_pro + 10) / 6, 4) as mean from s")
def card_mean(t):
    """The mean of six scores; the sixth cannot come from cards and is given."""
    rows = sources.read_cards(t.spark, f"{_cards(t)}/*", "file_path").withColumn("source", F.regexp_extract("file_name", "/source=([^/]+)/", 1))
    return card_scores(rows, "source").select("source", F.round(row_mean(*[F.col(s) for s in SCORES], F.lit(10.0)), 4).alias("mean"))


@query("select source, 'latest' as split, '**/samples_' || source || '.json' as path from (select distinct source from documents)")
def card_front_matter(t):
    return sources.read_front_matter(t.spark, f"{_cards(t)}/*", "file_path").select(F.col("config_name").alias("source"), "split", "path")


@query("select l_linenumber as run, count(*) as rows, case when l_linenumber = 7 then 'missing' when l_linenumber = 6 then 'other_size' else 'present' end as state from lineitem group by all")
def catalog_states(t):
    """A catalog of the written files, one of which is gone and one of which has grown."""
    out = folder(t.spark, "catalog")
    counts = t.lineitem.groupBy(F.col("l_linenumber").alias("run")).agg(F.count("*").alias("rows"))
    t.lineitem.filter("l_linenumber <= 6").select(F.col("l_linenumber").alias("run"), "l_orderkey").repartition("run").write.partitionBy("run").json(out)
    found = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out).select(F.regexp_extract("path", "(run=.*)$", 1).alias("file"), "length")
    listed = found.select(F.lit("A").alias("problem"), "file", (F.col("length") + F.when(F.col("file").startswith("run=6"), 1).otherwise(0)).alias("bytes"))
    gone = t.spark.range(1).select(F.lit("A").alias("problem"), F.lit("run=7/part.json").alias("file"), F.lit(1).cast("long").alias("bytes"))
    states = sources.missing_files(listed.unionByName(gone), out).select(F.regexp_extract("file", "run=([0-9]+)", 1).cast("int").alias("r"), "state").distinct()
    return counts.join(states, F.col("run") == F.col("r")).select("run", "rows", "state")


@query("with s as (select source, sum(n_chars)::bigint as bytes from documents group by source) select bytes % 3 = 0 as noted, count(*) as files, sum(bytes)::bigint as bytes, count(*) filter (where bytes % 3 = 0) as notes from s group by all")
def catalog_document(t):
    """A catalog as one JSON document, in which some entries lack a note, written and read."""
    out = folder(t.spark, "catalog")
    by = t.documents.groupBy("source").agg(F.sum("n_chars").alias("bytes"))
    entry = F.struct(F.lit("A").alias("problem"), F.concat("source", F.lit(".jsonl.xz")).alias("file"), "bytes", F.when(F.col("bytes") % 3 == 0, F.concat(F.lit("a \n note on "), "source")).alias("note"))
    by.agg(F.to_json(F.collect_list(entry)).alias("value")).coalesce(1).write.text(out)  # an entry for each source
    rows = sources.read_catalog(t.spark, out)
    return rows.groupBy((F.col("bytes") % 3 == 0).alias("noted")).agg(F.count("file").alias("files"), F.sum("bytes").alias("bytes"), F.count("note").alias("notes"))


@query("select source, case when n % 2 = 0 then 'pointer' else 'data' end as state from (select source, count(*) as n, sum(n_chars) as c from documents group by source) s where true")
def storage_pointers(t):
    """Files of which some are pointers to large-file storage: told apart by length first, then by their first line."""
    out = folder(t.spark, "pointers")
    by = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    text = F.when(F.col("n") % 2 == 0, F.lit(f"{sources.POINTER}\noid sha256:0\nsize 1")).otherwise(F.lit("{}"))
    by.select("source", text.alias("value")).repartition("source").write.partitionBy("source").text(out)
    return sources.pointer_states(t.spark, out).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "state")


_LEAVES = """with s as (select source, sum(n_chars)::bigint as c from documents group by source),
l as (
  select '$.results.task_' || i || case when c % 2 = 1 then '[''acc,none'']' else '.acc' end as path, 'number' as kind, (c * i % 1000)::varchar as value from s, range(1, 6) r(i)
  union all select '$.results.task_' || i || '.alias', case when c % 2 = 0 then 'string' else 'null' end, case when c % 2 = 0 then 'task ' || i end from s, range(1, 6) r(i)
  union all select '$.config.shots[' || i || ']', 'number', i::varchar from s, range(0, 3) r(i) where c % 2 = 1
  union all select '$.config.shots', 'array', null from s where c % 2 = 0
  union all select '$.config.model.name', 'string', source from s)"""


@query(f"{_LEAVES} select path, kind, count(*) as cards, count(distinct value) as differ, min(value) as least from l group by path, kind")
def variant_leaves(t):
    """Cards of two generations, nested to several depths, as variants: a row for each leaf, then counts by path."""
    by = t.documents.groupBy("source").agg(F.sum("n_chars").alias("c"))
    odd = F.col("c") % 2 == 1
    rates = {i: (F.col("c") * i % 1000).cast("string") for i in range(1, 6)}
    tasks = [F.concat(F.lit(f'"task_{i}":{{"'), F.when(odd, "acc,none").otherwise("acc"), F.lit('":'), rates[i], F.lit(',"alias":'), F.when(odd, "null").otherwise(f'"task {i}"'), F.lit("}")) for i in rates]
    card = F.concat(F.lit('{"results":{'), F.concat_ws(",", *tasks), F.lit('},"config":{"shots":'), F.when(odd, "[0,1,2]").otherwise("[]"), F.lit(',"model":'), F.to_json(F.struct(F.col("source").alias("name"))), F.lit("}}"))
    found = leaves(by.select(card.alias("card")), "card")
    return found.groupBy("path", "kind").agg(F.count("*").alias("cards"), F.count_distinct("value").alias("differ"), F.min("value").alias("least"))
