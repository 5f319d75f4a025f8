"""Corpora derived from the test tables, each as a Spark plan and as equal DuckDB SQL.

Prose hits few rules, so source trees, manifests and advisory feeds are derived from business rows by
arithmetic on their keys; every corpus of code holds all documents, pages and conversations, whole, as well.
Every row of a driving table yields one file, nothing is filtered, and a third of all derived files sits in one project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import sql_text
from ..sources.files import normalise_files
from .pools import CODE_POOL, CSRF_EXCUSES, CSRF_POOL, FORM_POOL

CODE_EXTS = [".php", ".js", ".py", ".java", ".rb", ".go", ".html", ".vue", ".ts", ".jsx", ".tsx",
             ".c", ".xml", ".sh", ".php", ".py", ".js"]
CSRF_EXTS = [".php", ".js", ".py", ".ts", ".vue", ".java"]
FUNC_EXTS = [".py", ".js", ".php", ".java", ".py"]
FUNC_DECLS = ["    def run_@@(self, a):", "function run_@@(a) {", "public function run_@@($a) {",
              "    public void run_@@(int a) {", "def top_@@(a):"]
FUNC_BODY = ["        total = total + step_@@", "        call(a)", "        ", "", "        return a",
             "VALUE = 1"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a driving table, dealt out evenly to as many tasks as any shuffle has: a row becomes a whole file, whatever it takes to store."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _array(items: list[str]) -> Column:
    return F.expr(f"array({', '.join(map(sql_text, items))})")


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(sql_str(i) for i in items) + "]"


def _pick(items: list[str], index: Column) -> Column:
    return F.element_at(_array(items), (index % len(items) + 1).cast("int"))


def _path(no: Column, sub: Column, ext: Column) -> list[Column]:
    project = F.concat(F.lit("proj"), F.when(no % 3 == 0, 0).otherwise(sub % 50))
    folder = (F.when(no % 11 == 0, "node_modules/pkg").when(no % 13 == 0, "tests")
              .otherwise("src"))
    name = F.concat(F.when(no % 37 == 0, "_f").otherwise("f"), no,
                    F.when(no % 29 == 0, ".min").otherwise(""), ext)
    return [project.alias("project"), F.concat_ws("/", folder, name).alias("path")]


_SQL_PATH = """'proj' || (case when no % 3 = 0 then 0 else sub % 50 end) as project,
    (case when no % 11 = 0 then 'node_modules/pkg' when no % 13 = 0 then 'tests' else 'src' end)
      || '/' || (case when no % 37 = 0 then '_f' else 'f' end) || no
      || (case when no % 29 = 0 then '.min' else '' end) || ext as path, ext"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived code and all texts."""
    return derived_code(spark, sf_dir).unionByName(prose_files(spark, sf_dir))


def derived_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file of 8 to 20 lines per order."""
    src = spread(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("no"), F.col("o_custkey").alias("sub")))
    no, sub = F.col("no"), F.col("sub")

    def line(k: Column) -> Column:
        return _pick(CODE_POOL, no * 31 + k * k * 7 + k * 3 + sub)

    body = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), 8 + no % 13), line), "\n")
    files = src.select(*_path(no, sub, _pick(CODE_EXTS, no)),
                       F.replace(body, F.lit("@@"), sub.cast("string")).alias("content"))
    return normalise_files(files)


def _and_prose_sql(derived: str) -> str:
    """CTE ``lines`` (project, path, ext, line_no, line) of a derived corpus and all texts."""
    return f"""
  derived as (with {derived} select project, path, ext, line_no, line from lines),
  texts_too as (with {prose_lines_sql()} select project, path, ext, line_no, line from lines),
  lines as (select * from derived union all select * from texts_too)"""


def code_lines_sql() -> str:
    """The same corpus by line: ``project, path, ext, line_no, line``."""
    return _and_prose_sql(derived_lines_sql())


def derived_lines_sql() -> str:
    return f"""
  base as (select o_orderkey as no, o_custkey as sub,
             ({sql_list(CODE_EXTS)})[1 + o_orderkey % {len(CODE_EXTS)}] as ext from orders),
  pool as (select {sql_list(CODE_POOL)} as items),
  lines as (select {_SQL_PATH}, no, k as line_no,
      replace(items[1 + (no * 31 + k * k * 7 + k * 3 + sub) % {len(CODE_POOL)}], '@@',
              sub::varchar) as line
    from base cross join pool cross join lateral unnest(range(1, 9 + no % 13)) as u(k))"""


def function_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, and one file per part with functions of 20 to 119 lines; declarations, bodies, top-level lines."""
    src = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("no"),
                                              F.col("p_size").cast("bigint").alias("sub")))
    no, sub = F.col("no"), F.col("sub")
    period = 20 + (no * 7 + sub) % 100

    def line(k: Column) -> Column:
        raw = (F.when(k % period == 1, _pick(FUNC_DECLS, no))
               .when((k * 13 + no) % 97 == 0, FUNC_BODY[5])
               .otherwise(_pick(FUNC_BODY[:5], k * 3 + no)))
        return F.replace(raw, F.lit("@@"), k.cast("string"))

    body = F.transform(F.sequence(F.lit(1).cast("bigint"), 150 + no % 60), line)
    return normalise_files(src.select(*_path(no, sub, _pick(FUNC_EXTS, no)),
                                      F.array_join(body, "\n").alias("content"))).unionByName(prose_files(spark, sf_dir))


def function_lines_sql() -> str:
    return _and_prose_sql(f"""
  base as (select p_partkey as no, p_size::bigint as sub,
             ({sql_list(FUNC_EXTS)})[1 + p_partkey % {len(FUNC_EXTS)}] as ext from part),
  lines as (select {_SQL_PATH}, no, k as line_no, replace(
      case when k % (20 + (no * 7 + sub) % 100) = 1
             then ({sql_list(FUNC_DECLS)})[1 + no % {len(FUNC_DECLS)}]
           when (k * 13 + no) % 97 = 0 then {sql_str(FUNC_BODY[5])}
           else ({sql_list(FUNC_BODY[:5])})[1 + (k * 3 + no) % 5] end, '@@', k::varchar) as line
    from base cross join lateral unnest(range(1, 151 + no % 60)) as u(k))""")


def endpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, and one file of 30 to 89 lines per customer: routes, handlers and, in every third, an excuse."""
    src = spread(table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("no"), F.col("c_nationkey").cast("bigint").alias("sub")))
    no, sub = F.col("no"), F.col("sub")

    def line(k: Column) -> Column:
        raw = (F.when((no % 3 == 0) & (k % 40 == 15), _pick(CSRF_EXCUSES, no))
               .otherwise(_pick(CSRF_POOL, no * 17 + k * k * 5 + k * sub)))
        return F.replace(raw, F.lit("@@"), sub.cast("string"))

    body = F.transform(F.sequence(F.lit(1).cast("bigint"), 30 + no % 60), line)
    return normalise_files(src.select(*_path(no, sub, _pick(CSRF_EXTS, no)),
                                      F.array_join(body, "\n").alias("content"))).unionByName(prose_files(spark, sf_dir))


def endpoint_lines_sql() -> str:
    return _and_prose_sql(f"""
  base as (select c_custkey as no, c_nationkey::bigint as sub,
             ({sql_list(CSRF_EXTS)})[1 + c_custkey % {len(CSRF_EXTS)}] as ext from customer),
  pool as (select {sql_list(CSRF_POOL)} as items, {sql_list(CSRF_EXCUSES)} as excuses),
  lines as (select {_SQL_PATH}, no, k as line_no, replace(
      case when no % 3 = 0 and k % 40 = 15 then excuses[1 + no % {len(CSRF_EXCUSES)}]
           else items[1 + (no * 17 + k * k * 5 + k * sub) % {len(CSRF_POOL)}] end,
      '@@', sub::varchar) as line
    from base cross join pool cross join lateral unnest(range(1, 31 + no % 60)) as u(k))""")


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every web page, whole, followed by 6 to 16 form lines."""
    src = spread(table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("no"), (F.col("page_id") * 7).alias("sub"), "html"))
    no, sub = F.col("no"), F.col("sub")

    def line(k: Column) -> Column:
        raw = _pick(FORM_POOL, no * 5 + k * k * 3 + k * 2)
        return F.replace(raw, F.lit("@@"), no.cast("string"))

    tail = F.transform(F.sequence(F.lit(1).cast("bigint"), 6 + no % 11), line)
    content = F.concat(F.col("html"), F.lit("\n"), F.array_join(tail, "\n"))
    return normalise_files(src.select(*_path(no, sub, _pick([".html", ".vue", ".php"], no)),
                                      content.alias("content")))


def html_files_sql() -> str:
    """``project, path, ext, no, content`` of the page corpus."""
    return f"""
  base as (select page_id as no, page_id * 7 as sub, html,
             (['.html', '.vue', '.php'])[1 + page_id % 3] as ext from pages),
  pool as (select {sql_list(FORM_POOL)} as items),
  tails as (select no, string_agg(replace(items[1 + (no * 5 + k * k * 3 + k * 2)
                % {len(FORM_POOL)}], '@@', no::varchar), chr(10) order by k) as tail
    from base cross join pool cross join lateral unnest(range(1, 7 + no % 11)) as u(k)
    group by no),
  files as (select {_SQL_PATH}, no,
      regexp_replace(html || chr(10) || tail, chr(13) || chr(10) || '?', chr(10), 'g') as content
    from base join tails using (no))"""


def prose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, conversation turn and page, whole, as a source file."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")).select(
        F.col("source").alias("project"),
        F.concat(F.lit("docs/d"), "doc_id", _pick([".py", ".js", ".php", ".java"],
                                                  F.col("doc_id"))).alias("path"),
        F.col("text").alias("content"))
    talk = spread(table(spark, sf_dir, "conversations")).select(
        F.lit("talk").alias("project"),
        F.concat(F.lit("talk/c"), "conv_id", F.lit("_"), "turn", F.lit(".py")).alias("path"),
        F.col("text").alias("content"))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.lit("pages").alias("project"), F.concat(F.lit("pages/p"), "page_id", F.lit(".html")).alias("path"),
        F.col("html").alias("content"))
    return normalise_files(docs.unionByName(talk).unionByName(pages))


def prose_lines_sql() -> str:
    return """
  prose as (
    select source as project, 'docs/d' || doc_id
        || (['.py', '.js', '.php', '.java'])[1 + doc_id % 4] as path,
      (['.py', '.js', '.php', '.java'])[1 + doc_id % 4] as ext, text as content from documents
    union all
    select 'talk', 'talk/c' || conv_id || '_' || turn || '.py', '.py', text from conversations
    union all
    select 'pages', 'pages/p' || page_id || '.html', '.html', html from pages),
  lines as (select project, path, ext, generate_subscripts(parts, 1) as line_no,
      unnest(parts) as line
    from (select project, path, ext, string_split(regexp_replace(content,
            chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)) as parts from prose))"""
