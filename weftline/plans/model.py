"""The given tables seen as those of a code graph, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from ..streaming import tracking


class Model:
    """Projections of the tables in ``sf_dir``; each is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files."""
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.sf_dir}/{name}.parque[t]")  # a pattern may name a file as well as a folder

    def streamed(self, rows: DataFrame, name: str) -> DataFrame:
        """All that a stream with a state store of column families has put out once it has read its source, as a table."""
        key = "spark.sql.streaming.stateStore.providerClass"
        before, folder = self.spark.conf.get(key), shared_folder(self.spark, name)
        tracking.use_rocksdb(self.spark)
        try:
            query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(rows.schema).parquet(f"{folder}/rows")

    def files(self) -> DataFrame:
        content = F.coalesce("text", F.lit(""))
        return self.table("documents").select(
            F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
            F.substring(F.substring_index(content, "\n", 1), 1, 200).alias("summary"), content.alias("content"), "doc_id", "source", "lang",
        )

    def symbols(self) -> DataFrame:
        path = F.concat(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "_")), F.lit("/"), F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "_")), F.lit(".ts"))
        return self.table("part").select(
            path.alias("path"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"),
            F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), (F.col("p_partkey") % 2 == 0).alias("exported"),
        )

    def symbol_files(self) -> DataFrame:
        return self.symbols().select("path").distinct().select("path", F.lit("").alias("summary"), F.lit("").alias("content"))

    def edges(self) -> DataFrame:
        a = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("x"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
        b = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("y"), "l_linenumber")
        name = lambda c: F.concat(F.lit("p"), F.lpad(F.col(c).cast("string"), 9, "0"), F.lit(".ts"))
        return a.join(b, ["l_orderkey", "l_linenumber"]).where("x <> y").select(name("x").alias("src"), name("y").alias("dst")).distinct()

    def nodes(self) -> DataFrame:
        return self.table("part").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".ts")).alias("path"), F.col("p_name").alias("name"), "p_partkey", F.col("p_type").alias("kind"))

    def elements(self) -> DataFrame:
        tags = F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)[\s/>]"), F.lit(1))
        rows = self.table("pages").select(F.col("page_id").alias("path"), F.posexplode(tags).alias("ord", "tag"))
        return rows.select("path", "ord", "tag", F.lit(False).alias("has_id"))

    def events(self) -> DataFrame:
        outcome = F.when(F.col("event_type") == "error", "error").otherwise("success")
        return self.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "event_type", outcome.alias("outcome"))

    def groups(self) -> DataFrame:
        return self.table("region").select(F.col("r_name").alias("name"), F.concat(F.lit("Region "), F.col("r_name")).alias("description"), F.col("r_regionkey").alias("id"))

    def group_members(self) -> DataFrame:
        regions = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name"))
        return self.table("nation").join(regions, "n_regionkey").select("name", F.lit("file").alias("member_type"), F.col("n_name").alias("path"))

    def source_members(self) -> DataFrame:
        return self.files().select(F.concat(F.lit("group "), F.col("source")).alias("name"), "path")

    def label_store(self) -> DataFrame:
        return self.spark.createDataFrame([("lbl_quality", "good"), ("lbl_toxic", "toxic"), ("lbl_unused", "unused")], "id string, name string")

    def assignments(self) -> DataFrame:
        paths = self.files().select("doc_id", "path")
        labels = self.table("labels").join(paths, "doc_id")
        one = lambda c, i: labels.where(F.col(c) == 1).select(F.lit(i).alias("label_id"), F.col("path").alias("target"), F.lit("file").alias("target_type"))
        return one("quality", "lbl_quality").unionByName(one("toxic", "lbl_toxic"))

    def history(self) -> DataFrame:
        return self.table("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")

    def turns(self) -> DataFrame:
        """User turns as failed queries of the assistant turn after them, but for the last one of a conversation."""
        c = self.table("conversations").select("conv_id", "turn", "role", "text")
        last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
        reason = F.when(F.col("turn") % 4 == 0, "read_but_abandoned").otherwise("shown_not_read")
        return c.where("role = 'user'").join(last, "conv_id").where("turn < last").select(F.concat(F.lit("conv"), (F.col("conv_id") % 20).cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("phrase"), reason.alias("reason"))


#: The same projections as common table expressions.
CTE = {
    "files": """files as (select source || '/' || lang || '/doc_' || doc_id || '.txt' as path, left(str_split(coalesce(text, ''), chr(10))[1], 200) as summary,
        coalesce(text, '') as content, doc_id, source, lang from documents)""",
    "symbols": """symbols as (select lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) || '/' || lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) || '.ts' as path,
        p_partkey as ord, p_name as name, p_type as kind, p_size as start_line, p_size + 10 as end_line, p_partkey % 2 = 0 as exported from part)""",
    "symbol_files": "symbol_files as (select distinct path, '' as summary, '' as content from symbols)",
    "edges": """edges as (select distinct 'p' || lpad(a.l_partkey::varchar, 9, '0') || '.ts' as src, 'p' || lpad(b.l_partkey::varchar, 9, '0') || '.ts' as dst
        from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
        where a.l_partkey <> b.l_partkey)""",
    "nodes": "nodes as (select 'p' || lpad(p_partkey::varchar, 9, '0') || '.ts' as path, p_name as name, p_partkey, p_type as kind from part)",
    "elements": """tags as (select page_id as path, regexp_extract_all(html, '<([a-z][a-z0-9]*)[\\s/>]', 1) as t from pages),
        elements as (select path, i - 1 as ord, t[i] as tag, false as has_id from tags, unnest(range(1, len(t) + 1)) u(i))""",
    "ev": "ev as (select event_id, ts, 'u' || user_id as path, event_type, case when event_type = 'error' then 'error' else 'success' end as outcome from events)",
    "groups": "groups_ as (select r_name as name, 'Region ' || r_name as description, r_regionkey as id from region)",
    "group_members": "group_members as (select r_name as name, 'file' as member_type, n_name as path from nation join region on n_regionkey = r_regionkey)",
    "source_members": "source_members as (select 'group ' || source as name, path from files)",
    "label_store": "label_store as (select * from (values ('lbl_quality', 'good'), ('lbl_toxic', 'toxic'), ('lbl_unused', 'unused')) t(id, name))",
    "assignments": """assignments as (select 'lbl_quality' as label_id, path as target, 'file' as target_type from labels join files using (doc_id) where quality = 1
        union all select 'lbl_toxic', path, 'file' from labels join files using (doc_id) where toxic = 1)""",
    "history": "history as (select 'c' || o_custkey as path, o_orderdate as ts, o_orderkey as id, o_orderstatus, o_orderpriority from orders)",
    "turns": """turns as (select 'conv' || (conv_id % 20) as path, coalesce(text, '') as phrase, case when turn % 4 = 0 then 'read_but_abandoned' else 'shown_not_read' end as reason
        from conversations join (select conv_id, max(turn) as last from conversations group by conv_id) using (conv_id) where role = 'user' and turn < last)""",
    "lines": "lines as (select path, i as line_no, l[i] as line from (select path, str_split(content, chr(10)) as l from files), unnest(range(1, len(l) + 1)) u(i))",
}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(CTE[n] for n in names.split())} {body}"
