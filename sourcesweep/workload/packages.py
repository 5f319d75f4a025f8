"""Manifests and advisory feeds derived from the test tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GHSA_RAW, NVD_RAW, OSV_RAW
from ..sources.files import normalise_files
from .corpus import _pick, prose_files, prose_lines_sql, spread, sql_list, table

NAMES = ["package.json", "requirements.txt", "composer.json", "Gemfile", "pom.xml",
         "build.gradle", "Cargo.toml", "Dockerfile", "README.md", "package.json",
         "requirements.txt", "Gemfile"]
ADJECTIVES = ["large", "small", "hot", "blue", "new", "red", "cold", "old"]
NOUNS = ["gear", "plate", "rod", "ring", "bolt", "anvil", "widget", "gizmo"]
PREFIXES = ["^", "~", ">=", "", "", "<"]
TEMPLATES = ["SQL injection in {p} {v} by crafted input", "Stored XSS in {p} {v}",
             "Remote code execution in {p} {v}", "Heap buffer overflow in {p} {v}",
             "Privilege escalation in {p} {v}", "Information disclosure in {p} {v}",
             "A denial of service in {p} {v}", "CSRF in {p} {v}: settings",
             "Memory issue in open source lib {p} {v}", "Moderate flaw in {p}, fixed after {v}."]
RATINGS = ["CRITICAL", "HIGH", "MODERATE", "LOW", "odd"]
OSV_ECO = ["npm", "PyPI", "Packagist", "RubyGems"]
GHSA_ECO = ["NPM", "PIP", "COMPOSER", "RUBYGEMS"]
#: A stage before a release as each of these ecosystems writes it.
TAGS = ["-next.1", "rc2", "-RC2", ".beta2"]
#: Versions in rising order by ecosystem, equal ones together; ``@`` stands for a number.
ORDERED = {
    "npm": [["@.0.0-0"], ["@.0.0-alpha"], ["@.0.0-alpha.1"], ["@.0.0-alpha.beta"], ["@.0.0-beta"], ["@.0.0-beta.2"], ["@.0.0-beta.11"],
            ["@.0.0-canary.5"], ["@.0.0-next.1"], ["@.0.0-rc.1"], ["@.0.0", "v@.0.0", "@.0.0+build.7", "@"], ["@.0.1-0"], ["@.0.1"], ["@.1.9"],
            ["@.1.10"], ["@.10.0"]],
    "PyPI": [["@.0.dev1"], ["@.0a1.dev2"], ["@.0a1", "@.0.alpha-1"], ["@.0a1.post1"], ["@.0b2"], ["@.0rc1", "@.0.0c1", "@.0-pre1"],
             ["@.0", "@", "v@.0.0"], ["@.0+ubuntu.1"], ["@.0.post1.dev3"], ["@.0.post1", "@.0-1", "@.0.r1"], ["@.0.1.dev1"], ["@.0.1"], ["@.1"],
             ["@.10"], ["1!0.@"]],
    "Packagist": [["@.0.0-dev"], ["@.0.0-alpha1"], ["@.0.0-beta2", "@.0b2"], ["@.0.0-beta10"], ["@.0-RC1"], ["@.0.0", "v@.0", "@.0.0.0"],
                  ["@.0.0-patch1", "@.0-pl1"], ["@.0.1"], ["@.1"], ["@.10"]],
    "RubyGems": [["@.0.0.a"], ["@.0.0.beta2"], ["@.0.0.beta10"], ["@.0.0.pre"], ["@.0.0.pre.1"], ["@.0.0.rc1"], ["@.0.0", "@", "@.0"],
                 ["@.0.1.alpha"], ["@.0.1"], ["@.1"], ["@.10"]],
    "Maven": [["@.0-alpha-2"], ["@.0-beta1"], ["@.0-M1"], ["@.0-rc1"], ["@.0-SNAPSHOT"], ["@.0", "@"], ["@.0.1"], ["@.2"], ["@.10"]]}


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per order with 3 to 8 entries; a third of them in one project."""
    src = spread(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("no"), F.col("o_custkey").alias("sub")))
    no, sub = F.col("no"), F.col("sub")
    name = _pick(NAMES, no)

    def dep(j: Column) -> Column:
        return F.concat(_pick(ADJECTIVES, no + j), F.lit("-"), _pick(NOUNS, no * 3 + j),
                        F.lit("-"), (no * 7 + j * 5 + sub) % 40)

    def version(j: Column) -> Column:
        return F.concat(_pick(PREFIXES, no + j), (no + j * 3) % 50, F.lit("."), (no + j) % 10,
                        F.lit(".0"), F.when((no + j) % 13 == 0, "-beta").when((no + j) % 13 == 1, "rc1").otherwise(""))

    def rows(first: int, last: Column, text) -> Column:
        return F.transform(F.sequence(F.lit(first).cast("bigint"), last), text)

    count = 3 + no % 6

    def pair(j: Column) -> Column:
        return F.concat(F.lit('"'), dep(j), F.lit('": "'), version(j), F.lit('"'))

    def section(first: int, last: Column) -> Column:
        return F.concat(F.lit("{"), F.array_join(rows(first, last, pair), ", "), F.lit("}"))

    def pypi(j: Column) -> Column:
        return (F.when((no + j) % 7 == 0, dep(j)).when((no + j) % 7 == 1, F.concat(
            F.lit("# "), dep(j))).when((no + j) % 7 == 2, F.concat(dep(j), F.lit(">=1.0")))
            .otherwise(F.concat(F.lit("  "), dep(j), F.lit(" == "), version(j))))

    def gem(j: Column) -> Column:
        return (F.when((no + j) % 5 == 0, F.concat(F.lit('gem "'), dep(j), F.lit('"')))
                .when((no + j) % 5 == 1, F.lit("source 'https://rubygems.example'"))
                .otherwise(F.concat(F.lit("  gem '"), dep(j), F.lit("', '"), version(j),
                                    F.lit("'"))))

    content = (
        F.when(name == "package.json", F.concat(
            F.lit('{"name": "x", "dependencies": '), section(1, count),
            F.when(no % 5 == 0, F.lit(', "devDependencies": null}')).otherwise(
                F.concat(F.lit(', "devDependencies": '), section(9, F.lit(9).cast("bigint")
                                                                 + no % 2), F.lit("}")))))
        .when(name == "composer.json", F.concat(F.lit('{"require": '), section(1, count),
                                                F.lit(', "require-dev": {"z/z": "1"}}')))
        .when(name == "requirements.txt", F.array_join(rows(1, count, pypi), "\n"))
        .when(name == "Gemfile", F.array_join(rows(1, count, gem), "\n"))
        .otherwise(F.lit("text")))
    project = F.concat(F.lit("proj"), F.when(no % 3 == 0, 0).otherwise(sub % 50))
    return normalise_files(src.select(
        project.alias("project"), F.concat(F.lit("m"), no, F.lit("/"), name).alias("path"),
        content.alias("content")))


_SQL_DEP = f"""({sql_list(ADJECTIVES)})[1 + (no + j) % 8] || '-' ||
    ({sql_list(NOUNS)})[1 + (no * 3 + j) % 8] || '-' || (no * 7 + j * 5 + sub) % 40"""
_SQL_VERSION = f"""({sql_list(PREFIXES)})[1 + (no + j) % 6] || (no + j * 3) % 50 || '.' ||
    (no + j) % 10 || '.0' || (case (no + j) % 13 when 0 then '-beta' when 1 then 'rc1' else '' end)"""


def manifests_sql() -> str:
    """``project, path, name, content`` of the manifest corpus."""
    return f"""
  base as (select o_orderkey as no, o_custkey as sub,
      ({sql_list(NAMES)})[1 + o_orderkey % {len(NAMES)}] as name from orders),
  entries as (select no, j, {_SQL_DEP} as dep, {_SQL_VERSION} as ver
    from base cross join lateral unnest(range(1, 11)) as u(j)),
  rendered as (select b.no,
      string_agg('"' || dep || '": "' || ver || '"', ', ' order by j)
        filter (j <= 3 + b.no % 6) as main,
      string_agg('"' || dep || '": "' || ver || '"', ', ' order by j)
        filter (j >= 9 and j <= 9 + b.no % 2) as dev,
      string_agg(case (b.no + j) % 7 when 0 then dep when 1 then '# ' || dep
          when 2 then dep || '>=1.0' else '  ' || dep || ' == ' || ver end, chr(10) order by j)
        filter (j <= 3 + b.no % 6) as pypi,
      string_agg(case (b.no + j) % 5 when 0 then 'gem "' || dep || '"'
          when 1 then 'source ''https://rubygems.example'''
          else '  gem ''' || dep || ''', ''' || ver || '''' end, chr(10) order by j)
        filter (j <= 3 + b.no % 6) as gem
    from base b join entries using (no) group by b.no),
  manifests as (select
      'proj' || (case when no % 3 = 0 then 0 else sub % 50 end) as project,
      'm' || no || '/' || name as path, name,
      case name
        when 'package.json' then '{{"name": "x", "dependencies": {{' || main || '}}' ||
          (case when no % 5 = 0 then ', "devDependencies": null}}'
                else ', "devDependencies": {{' || dev || '}}}}' end)
        when 'composer.json' then '{{"require": {{' || main || '}}, "require-dev": {{"z/z": "1"}}}}'
        when 'requirements.txt' then pypi when 'Gemfile' then gem else 'text' end as content
    from base join rendered using (no))"""


# --- advisories -----------------------------------------------------------------------------

def _advisory_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    k = F.col("p_partkey")
    package = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), k % 40)
    version = F.concat("p_size", F.lit("."), k % 10, F.lit(".0"))
    text = F.replace(F.replace(_pick(TEMPLATES, k), F.lit("{p}"), package), F.lit("{v}"), version)
    return part.select(k.alias("k"), package.alias("p"), version.alias("v"), text.alias("text"),
                       ((k % 101).cast("double") / 10).alias("score"))


def advisory_sql() -> str:
    return f"""
  adv as (select p_partkey as k, replace(lower(p_name), ' ', '-') || '-' || p_partkey % 40 as p,
      p_size || '.' || p_partkey % 10 || '.0' as v,
      (p_partkey % 101)::double / 10 as score from part),
  advt as (select *, replace(replace(({sql_list(TEMPLATES)})[1 + k % {len(TEMPLATES)}],
      '{{p}}', p), '{{v}}', v) as text from adv)"""


def _typed(df: DataFrame, schema: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                       for f in _parse_datatype_string(schema).fields])


def nvd_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed page per part with one item."""
    k, score = F.col("k"), F.col("score")
    metric = F.array(F.struct(F.struct(score.alias("baseScore")).alias("cvssData")))
    cve = F.struct(
        F.concat(F.lit("CVE-2024-"), k).alias("id"),
        F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("published"),
        F.when(k % 17 != 0, F.array(F.struct(F.lit("en").alias("lang"),
                                             F.col("text").alias("value"))))
        .alias("descriptions"),
        F.struct(F.when(k % 4 == 0, F.when(k % 8 == 0, F.slice(metric, 1, 0)).otherwise(metric))
                 .alias("cvssMetricV31"),
                 F.when(k % 4 == 1, metric).alias("cvssMetricV30"),
                 F.when((k % 4 == 2) | (k % 8 == 0), metric).alias("cvssMetricV2")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), k % 900).alias("value")),
                                 F.struct(F.lit("NVD-CWE-noinfo").alias("value")))
                         .alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.concat(F.lit("https://a.example/"), k).alias("url"))).alias("references"))
    page = F.array(F.struct(cve.alias("cve")))
    return _typed(_advisory_base(spark, sf_dir).select(page.alias("vulnerabilities")), NVD_RAW)


def _vector(k: Column) -> Column:
    """A version 3.1 vector; every eleventh lacks its last metrics."""
    j = F.floor(k / 5)
    metrics = [("AV", "NALP", j), ("AC", "LH", F.floor(j / 4)), ("PR", "NLH", F.floor(j / 3)), ("UI", "NR", F.floor(j / 7)), ("S", "UC", F.floor(j / 2)),
               ("C", "HLN", F.floor(j / 5)), ("I", "NLH", F.floor(j / 6)), ("A", "LHN", F.floor(j / 8))]
    parts = [F.concat(F.lit(f"{name}:"), F.substring(F.lit(values), (i % len(values) + 1).cast("int"), F.lit(1))) for name, values, i in metrics]
    return F.concat_ws("/", F.lit("CVSS:3.1"), *parts[:5], F.when(j % 11 != 0, F.concat_ws("/", *parts[5:])))


def vector_sql() -> str:
    """The score of the same vector, from the weights of its metrics."""
    def pick(weights, index):
        return f"({weights})[1 + ({index}) % {len(weights)}]"
    ease = f"8.22 * {pick([0.85, 0.62, 0.55, 0.2], 'j')} * {pick([0.77, 0.44], 'j // 4')} * {pick([0.85, 0.62], 'j // 7')}"
    iss = f"1 - (1 - {pick([0.56, 0.22, 0.0], 'j // 5')}) * (1 - {pick([0.0, 0.22, 0.56], 'j // 6')}) * (1 - {pick([0.22, 0.56, 0.0], 'j // 8')})"
    return f"""(select case when j % 11 = 0 or impact <= 0 then 0.0 else ceil(round(least(total, 10) * 100000) / 10000) / 10 end::double
      from (select *, case when changed then 1.08 * (impact + ease * pc) else impact + ease * pu end as total
      from (select *, case when changed then 7.52 * (s - 0.029) - 3.25 * power(s - 0.02, 15) else 6.42 * s end as impact
      from (select j, (j // 2) % 2 = 1 as changed, ({iss})::double as s, ({ease})::double as ease,
          {pick([0.85, 0.62, 0.27], 'j // 3')}::double as pu, {pick([0.85, 0.68, 0.5], 'j // 3')}::double as pc from (select k // 5 as j)))))"""


def osv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part: listed versions, ranges of versions or commits, or neither; every tenth names the package twice."""
    k, v = F.col("k"), F.col("v")
    score = F.col("score").cast("string")
    extra = (F.when(k % 5 == 0, F.create_map(F.lit("cvss"), score, F.lit("cwe_ids"),
                                             F.concat(F.lit('["CWE-'), k % 900, F.lit('"]'))))
             .when(k % 5 == 1, F.create_map(F.lit("severity"), _pick(RATINGS, k)))
             .when(k % 5 == 2, F.create_map(F.lit("note"), F.lit("x"))))
    levels = F.when(k % 5 == 2, F.array(F.struct(F.lit("CVSS_V3").alias("type"),
                                                 score.alias("score")))).when(
        k % 5 == 3, F.array(F.struct(F.lit("CVSS_V3").alias("type"),
                                     _vector(k).alias("score"))))
    fixed = F.concat(k % 50, F.lit("."), k % 7, F.when(k % 5 == 2, F.concat(F.lit(".0"), _pick(TAGS, k))).otherwise(""))
    events = F.array(F.create_map(F.lit("introduced"), F.when(k % 2 == 0, "0").otherwise("3.2")),
                     F.create_map(F.when(k % 11 == 0, "last_affected").otherwise("fixed"), fixed))
    commits = F.struct(F.lit("GIT").alias("type"), F.array(F.create_map(F.lit("introduced"), F.lit("0")), F.create_map(F.lit("fixed"), F.lit("0a1b2c"))).alias("events"))
    numbers = F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))
    package = F.struct(F.col("p").alias("name"), _pick(OSV_ECO, k).alias("ecosystem")).alias("package")
    ranges = F.when(k % 9 == 2, F.array(commits, numbers)).when(k % 3 != 1, F.array(numbers)).when(k % 6 == 4, F.array(commits))
    item = F.struct(package, F.when(k % 3 == 0, F.array(v, F.lit("1.0.0"))).alias("versions"), ranges.alias("ranges"))
    again = F.struct(package, F.array(F.lit("7.7.0"), F.lit("9.9.0")).alias("versions"), F.lit(None).cast(
        "array<struct<type: string, events: array<map<string, string>>>>").alias("ranges"))
    return _typed(_advisory_base(spark, sf_dir).select(
        F.concat(F.when(k % 2 == 0, "GHSA-").otherwise("OSV-"), k).alias("id"),
        F.when(k % 7 != 0, F.col("text")).alias("summary"),
        F.concat(F.lit("Details: "), "text").alias("details"), F.lit("2024-02-01").alias("published"),
        levels.alias("severity"), extra.alias("database_specific"),
        F.when(k % 10 == 7, F.array(item, again)).otherwise(F.array(item)).alias("affected"),
        F.array(F.concat(F.lit('{"type": "WEB", "url": "https://o.example/'), k, F.lit('"}')),
                F.lit("https://p.example")).alias("references")), OSV_RAW)


def ghsa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per part, two branches of versions for every third; ids overlap with both other feeds."""
    k = F.col("k")
    adv = F.struct(
        F.concat(F.when(k % 3 == 0, "CVE-2024-").otherwise("GHSA-"), k).alias("ghsaId"),
        F.col("text").alias("summary"), F.when(k % 4 == 0, "").otherwise(
            F.concat(F.lit("Long: "), "text")).alias("description"),
        F.lower(_pick(RATINGS, k)).alias("severity"), F.lit("2024-03-01").alias("publishedAt"),
        F.array(F.struct(F.concat(F.lit("https://g.example/"), k).alias("url"))).alias("references"),
        F.when(k % 6 != 0, F.struct(F.col("score").alias("score"))).alias("cvss"),
        F.struct(F.transform(F.sequence(F.lit(1), F.lit(7)),
                             lambda i: F.struct(F.concat(F.lit("CWE-"), i).alias("cweId")))
                 .alias("nodes")).alias("cwes"))
    def branch(held: Column, patched: Column) -> Column:
        return F.struct(held.alias("vulnerableVersionRange"), patched.alias("firstPatchedVersion"))

    def version(text: Column) -> Column:
        return F.struct(text.alias("identifier"))

    one = branch(F.concat(F.lit(">= 1.0, < "), k % 50, F.lit(".0")), F.when(k % 2 == 0, version(F.concat(k % 50, F.lit(".0")))))
    two = branch(F.concat(F.lit(">= "), k % 50, F.lit(".1.0, < "), k % 50 + 5, F.lit(".0.0"), _pick(TAGS, k)), version(F.concat(k % 50 + 5, F.lit(".0.0"))))
    branches = F.when(k % 3 == 1, F.array(two, one)).otherwise(F.array(one))
    return _typed(_advisory_base(spark, sf_dir).select(
        F.col("p").alias("package"), _pick(GHSA_ECO, k).alias("ecosystem"),
        F.when(k % 19 != 0, adv).alias("advisory"), F.inline(branches)), GHSA_RAW)


def own_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advisory per part for the dependency type as it stands; every sixth has no id."""
    k = F.col("k")
    return _advisory_base(spark, sf_dir).select(
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("OWN-"), k % 500)).alias("id"), F.lit("own").alias("source"), F.col("text").alias("description"),
        F.col("score").alias("cvss_score"), F.lit("LOW").alias("severity"), F.array(F.lit("u")).alias("references"), F.lit("").alias("published"),
        F.array().cast("array<string>").alias("cwe"), F.lit("").alias("affected_versions"), F.concat(F.lit("Ask team "), k % 500 % 7).alias("remediation"),
        F.col("p").alias("package"), _pick(["npm", "pypi", "gem", "composer"], k).alias("ecosystem"))


def ordered_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k``, ecosystem and two versions ``a`` and ``b`` of one part, from the ordered lists with the part's number."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    names, out = list(ORDERED), None
    for i, name in enumerate(names):
        pool = [v for same in ORDERED[name] for v in same]
        pair = F.struct(F.lit(name).alias("ecosystem"), _pick(pool, k).alias("a"), _pick(pool, k * 7 + size).alias("b"))
        out = pair if out is None else F.when(k % len(names) == i, pair).otherwise(out)
    part = table(spark, sf_dir, "part")
    number = (size * 3).cast("string")
    return part.select(k.alias("k"), out.alias("pair"), number.alias("n")).select(
        "k", "pair.ecosystem", F.replace("pair.a", F.lit("@"), F.col("n")).alias("a"), F.replace("pair.b", F.lit("@"), F.col("n")).alias("b"))


def ordered_sql() -> str:
    """The places of both versions in the lists, compared."""
    pools, places = [], []
    for name, classes in ORDERED.items():
        pools.append(sql_list([v for same in classes for v in same]))
        places.append("[" + ", ".join(str(i) for i, same in enumerate(classes) for _ in same) + "]")
    names = list(ORDERED)

    def arm(items, index):
        return "case " + " ".join(f"when k % {len(names)} = {i} then ({x})[1 + ({index}) % len({x})]" for i, x in enumerate(items)) + " end"
    return f"""with parts as (select p_partkey as k, p_size::bigint as s from part),
  pairs as (select k, ({sql_list(names)})[1 + k % {len(names)}] as ecosystem,
      replace({arm(pools, 'k')}, '@', (s * 3)::varchar) as a, replace({arm(pools, 'k * 7 + s')}, '@', (s * 3)::varchar) as b,
      {arm(places, 'k')} as i, {arm(places, 'k * 7 + s')} as j from parts)
  select k, ecosystem, a, b, sign(i - j)::integer as compared from pairs"""


# --- damaged inputs and feeds as files ------------------------------------------------------

def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts and the manifests as bytes; some manifests are cut, empty, not UTF-8 or hold sections of another kind."""
    kind = F.substring_index(F.substring_index("path", "/", 1), "m", -1).cast("bigint") % 8
    text = (F.when(kind == 0, F.expr("left(content, length(content) div 2)"))
            .when(kind == 3, F.replace(F.replace("content", F.lit('"dependencies": {'), F.lit('"dependencies": [7], "other": {')),
                                       F.lit('"require": {'), F.lit('"require": "x", "other": {'))).otherwise(F.col("content")))
    raw = F.when(kind == 1, F.lit(None)).when(kind == 2, F.concat(text.cast("binary"), F.unhex(F.lit("FF")))).otherwise(text.cast("binary"))
    texts = prose_files(spark, sf_dir).select("project", "path", F.col("content").cast("binary").alias("content"))
    return manifest_files(spark, sf_dir).select("project", "path", raw.alias("content")).unionByName(texts)


def osv_texts(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """``k`` and the JSON text of each OSV document."""
    raw = osv_raw(spark, sf_dir)
    return raw.select(F.substring_index("id", "-", -1).cast("bigint").alias("k"), F.to_json(F.struct(*raw.columns), options).alias("text"))


def damaged_osv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed file per document; some are cut, lack the id, or hold a number for a list."""
    text = (F.when(F.col("k") % 9 == 0, F.left("text", F.lit(25)))
            .when(F.col("k") % 9 == 1, F.regexp_replace("text", '"id":"[^"]*",', ""))
            .when(F.col("k") % 9 == 3, F.concat(F.lit("[\n"), "text", F.lit("\n]")))
            .when(F.col("k") % 9 == 5, F.replace("text", F.lit('"affected":['), F.lit('"affected":7,"other":['))).otherwise(F.col("text")))
    return osv_texts(spark, sf_dir).select(F.concat(F.lit("osv/"), "k", F.lit(".json")).alias("path"), text.alias("content"))


def write_osv_dump(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The OSV documents as files: most one a line; every tenth printed over many lines, in lists of a file for each 10,000 documents,
    but every thousandth in a file of its own."""
    k = F.col("k")
    osv_texts(spark, sf_dir).where(k % 10 != 0).select("text").write.text(f"{path}/lines")
    pretty = osv_texts(spark, sf_dir, pretty="true").where(k % 10 == 0)
    pretty.where(k % 1000 == 10).select("text").write.option("maxRecordsPerFile", 1).text(f"{path}/single")
    lists = pretty.where(k % 1000 != 10).groupBy(F.floor(k / 10_000)).agg(F.array_join(F.collect_list("text"), ",\n").alias("items"))
    lists.select(F.concat(F.lit("[\n"), "items", F.lit("\n]"))).write.option("maxRecordsPerFile", 1).text(f"{path}/lists")


def write_feed_documents(spark: SparkSession, sf_dir: str, path: str, files: int) -> None:
    """The documents of all three feeds as parquet files (kind, path, text), dealt out by their texts."""
    raws = {"nvd": nvd_raw(spark, sf_dir), "osv": osv_raw(spark, sf_dir), "github-advisory": ghsa_raw(spark, sf_dir)}
    texts = [raw.select(F.lit(kind).alias("kind"), F.lit(f"{kind}.json").alias("path"), F.to_json(F.struct(*raw.columns)).alias("text")) for kind, raw in raws.items()]
    texts[0].unionByName(texts[1]).unionByName(texts[2]).repartition(files, "text").write.parquet(path)


def problems_sql() -> str:
    """Problems of the damaged files, by how they were damaged."""
    return f"""with {manifests_sql()}, {advisory_sql()},
  damaged as (select *, regexp_extract(path, '^m([0-9]+)/', 1)::bigint % 8 as kind,
      regexp_extract(path, '^m([0-9]+)/', 1)::bigint % 5 = 0 as no_dev from manifests)
  select project, path, 'read' as stage, case kind when 1 then 'no content' else 'not UTF-8, invalid bytes dropped' end as reason
    from damaged where kind = 1 or kind = 2 and name <> 'README.md'
  union all select project, path, 'manifest', case when kind = 0 then 'not a JSON object'
      when name = 'composer.json' then 'not an object: require'
      when kind = 3 then 'not an object: dependencies' || (case when no_dev then ', devDependencies' else '' end)
      else 'not an object: devDependencies' end
    from damaged where kind <> 1 and (name in ('package.json', 'composer.json') and kind in (0, 3)
      or name = 'package.json' and no_dev)
  union all select * from (with {prose_lines_sql()} select project, path, 'read', 'no content' from prose where content is null)
  union all select null, 'osv/' || k || '.json', 'osv', case k % 9 when 0 then 'not a JSON document'
      when 1 then 'line 1: no id' else 'line 1: a field has another type' end from adv where k % 9 in (0, 1, 5)"""
