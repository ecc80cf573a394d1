"""A code graph over the driver's tables, as SQL that Spark and DuckDB both read.

Parts are functions, suppliers classes, customers methods, documents files; an order's lines are calls
and a co-change commit. `chain` has calls between the parts of an order and so has cycles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.plans.lineage import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages")

#: Each view may use the tables in braces and the views before it.
VIEWS: dict[str, str] = {
    "nodes": """
        select 'function:tpch:src/parts/' || p_brand || ':' || cast(p_partkey as string) as id, 'function' as kind, replace(p_name, ' ', '_') as name,
               'src/parts/' || p_brand || '/' || p_type as path, 1 as start_line, p_size as end_line, 'python' as language,
               case when p_partkey % 3 = 0 then null when p_partkey % 7 = 0 then 'Deprecated, use instead ' || p_name else 'Handles ' || p_name end as summary,
               case when p_partkey % 4 = 0 then 'agent' end as summary_author,
               cast(p_partkey % 5 as string) as content_hash, case when p_partkey % 3 = 0 then null when p_partkey % 8 = 0 then 'old' else cast(p_partkey % 5 as string) end as summary_hash,
               p_brand as community_id, cast(1700000000 + p_partkey * 600 as bigint) as updated_at,
               case when p_partkey % 17 = 0 then cast(1700000000 + p_partkey * 700 as bigint) end as deleted_at, p_size * 15 as token_count
        from {part}
        union all
        select 'class:tpch:src/suppliers/' || n_name || ':' || cast(s_suppkey as string), 'class', replace(s_name, '#', '_'), 'src/suppliers/' || n_name || '/models', 1, 40, 'java',
               case when s_suppkey % 2 = 0 then 'Supplies from ' || n_name end, null, 'h', case when s_suppkey % 2 = 0 then 'h' end, n_name, cast(1700000000 + s_suppkey as bigint), cast(null as bigint), 600
        from {supplier} join {nation} on s_nationkey = n_nationkey
        union all
        select 'method:tpch:src/customers/' || r_name || ':' || cast(c_custkey as string), 'method', replace(c_name, '#', '_'), 'src/customers/' || r_name || '/' || n_name || '/api', 1, 12, 'java',
               case when c_custkey % 3 = 0 then 'Orders for ' || c_mktsegment end, null, 'h', case when c_custkey % 3 = 0 then 'h' end, r_name, cast(1700000000 + c_custkey as bigint), cast(null as bigint), 180
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
        union all
        select 'file:tpch:' || lang || '/' || source || '/doc_' || cast(doc_id as string), 'file', 'doc_' || cast(doc_id as string), lang || '/' || source || '/doc_' || cast(doc_id as string), null, null, 'text',
               text, null, sha2_hex(text), null, null, cast(1700000000 + doc_id as bigint), cast(null as bigint), cast(null as int)
        from {documents}""",
    "lines": "select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int) as quantity, cast(round(l_discount * 100) as bigint) as cents from {lineitem}",
    "part_ids": "select p_partkey, 'function:tpch:src/parts/' || p_brand || ':' || cast(p_partkey as string) as pid from {part}",
    "calls": """
        select 'method:tpch:src/customers/' || r_name || ':' || cast(c_custkey as string) as from_id, pid as to_id, 'CALLS' as kind, (50 + 5 * min(cents)) / 100.0 as confidence
        from lines join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
             join {region} on n_regionkey = r_regionkey join part_ids on l_partkey = p_partkey
        where quantity >= 45 group by 1, 2
        union all
        select pid, 'class:tpch:src/suppliers/' || n_name || ':' || cast(s_suppkey as string), 'CALLS', (50 + 5 * min(cents)) / 100.0
        from lines join part_ids on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey
        where quantity >= 45 group by 1, 2""",
    "steps": """
        select l_orderkey, l_partkey, quantity, lead(l_partkey) over (partition by l_orderkey order by ln, l_partkey) as nxt
        from (select l_orderkey, l_partkey, min(l_linenumber) as ln, max(quantity) as quantity from lines group by l_orderkey, l_partkey) as p""",
    "chain": "select distinct a.pid as from_id, b.pid as to_id, 'CALLS' as kind from steps join part_ids a on l_partkey = a.p_partkey join part_ids b on nxt = b.p_partkey",
    "thin": """
        select distinct a.pid as from_id, b.pid as to_id, 'CALLS' as kind
        from (select l_partkey, lead(l_partkey) over (partition by l_orderkey order by ln, l_partkey) as nxt
              from (select l_orderkey, l_partkey, min(l_linenumber) as ln from lines where quantity >= 45 group by l_orderkey, l_partkey) as p) as s
             join part_ids a on l_partkey = a.p_partkey join part_ids b on nxt = b.p_partkey""",
    "contains": """
        select 'region:' || r_name as from_id, 'nation:' || n_name as to_id, 'CONTAINS' as kind from {nation} join {region} on n_regionkey = r_regionkey
        union all
        select 'nation:' || n_name, 'class:tpch:src/suppliers/' || n_name || ':' || cast(s_suppkey as string), 'CONTAINS' from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "tags": """
        select pid as node_id, lower(p_type) as tag, 'system' as source from {part} join part_ids using (p_partkey)
        union all select pid, lower(p_brand), 'system' from {part} join part_ids using (p_partkey)
        union all select pid, case when p_size <= 15 then 'small-size' when p_size <= 35 then 'medium-size' else 'large-size' end, 'agent' from {part} join part_ids using (p_partkey)
        union all select pid, 'api-endpoint', 'system' from {part} join part_ids using (p_partkey) where p_partkey % 11 = 0""",
    "visits": """
        select cast(user_id as string) || '-' || substring(cast(ts as string), 1, 10) as session_id, pid as node_id, event_type as tool, unix_seconds_of(ts) as visited_at
        from {events} join part_ids on p_partkey = event_id % 50""",
    "sessions": "select session_id as id, split_part(session_id, '-', 1) as agent_id, min(visited_at) as started_at from visits group by session_id",
    "savings": """
        select unix_seconds_of(ts) as ts, pid as node_id, event_type as query, cast(floor(value) as int) as tokens_saved, case when event_id % 3 = 0 then 'agent' else 'auto' end as summary_type
        from {events} join part_ids on p_partkey = event_id % 50 where event_type in ('purchase', 'view')""",
    "old_files": "select lang || '/' || source || '/doc_' || cast(doc_id as string) as file_path, sha2_hex(text) as content_sha, doc_id as mtime_ns from {documents} where doc_id % 10 <> 9",
    "new_files": """
        select lang || '/' || source || '/doc_' || cast(doc_id as string) as file_path, case when doc_id % 10 = 3 then sha2_hex(text || '!') else sha2_hex(text) end as content_sha,
               case when doc_id % 10 in (3, 5) then doc_id + 1 else doc_id end as mtime_ns
        from {documents} where doc_id % 10 <> 7""",
}
#: Calls of the order lines of quantity >= 45 only, for the dead-code queries: else no part would be uncalled.
VIEWS["few_calls"] = VIEWS["calls"]
VIEWS["calls"] = VIEWS["calls"].replace("where quantity >= 45 ", "")
#: Parts as functions with source files, and a test for every fifth part that says what it tests in one or more ways.
VIEWS["code"] = """
    select 'code:' || cast(p_partkey as string) as id, 'function' as kind, 'make_' || replace(p_name, ' ', '_') || '_' || cast(p_partkey as string) as name, 'src/' || replace(p_brand, '#', '') || '/part_' || cast(p_partkey as string) || '.py' as path,
           'python' as language, cast(null as string) as text
    from {part}
    union all
    select 'test:' || cast(p_partkey as string), 'function', 'test_make_' || replace(p_name, ' ', '_') || '_' || cast(case when p_partkey % 2 = 0 then p_partkey else p_partkey + 1 end as string),
           'tests/test_part_' || cast(case when p_partkey % 3 = 0 then p_partkey else p_partkey + 2 end as string) || '.py', 'python', 'from src import part_' || cast(p_partkey as string)
    from {part} where p_partkey % 5 = 0"""
VIEWS["code_calls"] = "select 'test:' || cast(p_partkey as string) as from_id, 'code:' || cast(case when p_partkey % 7 = 0 then p_partkey + 1 else p_partkey end as string) as to_id, 'CALLS' as kind from {part} where p_partkey % 5 = 0 and p_partkey % 4 <> 0"
#: Source files of parts: Python that calls into the next part's file, TypeScript and Java that call within one.
VIEWS["sources"] = """
    select 'm/part_' || k || '.py' as path, 'python' as language, 'import os' || nl || nl || '@app.get(1)' || nl || 'def make_' || k || '(x):' || nl || '    print(len(x))' || nl || '    return helper_' || next || '(x)' || nl || nl
           || '@api.router.post' || nl || 'async def helper_' || k || '(y):' || nl || '    return make_' || k || '(y)' || nl as text
    from (select cast(p_partkey as string) as k, cast(p_partkey + 3 as string) as next, chr(10) as nl, chr(123) as lb, chr(125) as rb from {part} where p_partkey % 3 = 0) as a
    union all
    select 'm/part_' || k || '.ts', 'typescript', 'export function make_' || k || '(x) ' || lb || '' || nl || '  console.log(x)' || nl || '  return helper_' || k || '(x)' || nl || '' || rb || '' || nl
           || 'const helper_' || k || ' = async (y) => ' || lb || '' || nl || '  return this.make_' || k || '(y)' || nl || '' || rb || '' || nl
    from (select cast(p_partkey as string) as k, chr(10) as nl, chr(123) as lb, chr(125) as rb from {part} where p_partkey % 3 = 1) as a
    union all
    select 'm/Part_' || k || '.java', 'java', 'class Part_' || k || ' ' || lb || '' || nl || '  int make_' || k || '(int x) ' || lb || '' || nl || '    return helper_' || k || '(x);' || nl || '  ' || rb || '' || nl
           || '  Item_' || k || ' helper_' || k || '(int y) ' || lb || '' || nl || '    items.add(y);' || nl || '    return new Item_' || k || '();' || nl || '  ' || rb || '' || nl || '' || rb || '' || nl || 'class Item_' || k || ' ' || lb || ' ' || rb || '' || nl
    from (select cast(p_partkey as string) as k, chr(10) as nl, chr(123) as lb, chr(125) as rb from {part} where p_partkey % 3 = 2) as a"""


def _dialect(text: str, duck: bool) -> str:
    import re

    if duck:
        return re.sub(r"unix_seconds_of\((\w+)\)", r"cast(floor(epoch(\1)) as bigint)", re.sub(r"sha2_hex\(([^()]*)\)", r"sha256(\1)", text))
    return re.sub(r"unix_seconds_of\((\w+)\)", r"unix_timestamp(cast(\1 as timestamp))", re.sub(r"sha2_hex\(([^()]*)\)", r"sha2(\1, 256)", text))


def _needed(names: tuple[str, ...]) -> list[str]:
    import re

    need: set[str] = set()
    todo = list(names)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += [w for w in VIEWS if w != v and re.search(rf"\b{w}\b", VIEWS[v].replace("{" + w + "}", ""))]
    return [v for v in VIEWS if v in need]


def duck(query: str, *views: str) -> str:
    """The query for DuckDB, after the views that it uses (found by name)."""
    import re

    used = tuple(v for v in VIEWS if v in views or re.search(rf"\b{v}\b", query))
    ctes = ", ".join(f"{v} as ({_dialect(VIEWS[v], True)})" for v in _needed(used)).format(**{t: t for t in TABLES})
    recursive = "recursive " if re.match(r"\s*with\s+recursive", query) else ""
    rest = re.sub(r"^\s*with\s+(recursive\s+)?", "", query)
    if rest != query:
        return f"with {recursive}{ctes}, {rest}" if ctes else query
    return f"with {ctes} {query}" if ctes else query


#: Order lines in a partition of the views that are made of them.
PART_ROWS = 250_000


@dataclass
class View:
    """The views as DataFrames.

    Views of order lines have the rows of their SQL, but keys are dealt out, grouped and made distinct as numbers, over
    partitions that grow in number with the table and not in size; names are joined to the results.
    """

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _tables(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in TABLES}

    @cached_property
    def n_parts(self) -> int:
        return max(self.spark.sparkContext.defaultParallelism, -(-self._tables["lineitem"].count() // PART_ROWS))

    @cached_property
    def _named(self) -> bool:
        """Whether every name that an id is made of is there, so that one key has one id."""
        return all(self._tables[t].where(F.col(c).isNull()).isEmpty() for t, c in (("part", "p_brand"), ("nation", "n_name"), ("region", "r_name")))

    @cached_property
    def keyed(self) -> bool:
        """Whether the keys of customers and suppliers stand for their ids."""
        return self._named and all(self._tables[t].groupBy(c).count().where(F.col("count") > 1).isEmpty() for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey")))

    def _lines(self) -> DataFrame:
        rows = self._tables["lineitem"].selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_quantity as int) as quantity", "cast(round(l_discount * 100) as bigint) as cents")
        return rows.repartition(self.n_parts, "l_orderkey").distinct()

    def _steps(self, lines: DataFrame | None = None) -> DataFrame:
        each = (self.lines if lines is None else lines).groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("ln"), F.max("quantity").alias("quantity"))
        return each.select("l_orderkey", "l_partkey", "quantity", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("ln", "l_partkey")).alias("nxt"))

    def _with_id(self, rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
        """The rows with an id in place of a key. ids: (key, id), one table for all sizes, so it isn't broadcast."""
        ids = ids.distinct().toDF("_key", name).repartition(self.n_parts, "_key")
        return rows.repartition(self.n_parts, key).join(ids.hint("shuffle_hash"), F.col(key) == F.col("_key")).drop(key, "_key")

    def _pairs(self, steps: DataFrame) -> DataFrame:
        """Distinct pairs of parts that follow each other, by their keys."""
        return steps.where("l_partkey is not null and nxt is not null").select("l_partkey", "nxt").repartition(self.n_parts, "l_partkey").distinct()

    def _chain(self, pairs: DataFrame | None = None) -> DataFrame:
        pairs = self._pairs(self.steps) if pairs is None else pairs
        rows = self._with_id(self._with_id(pairs, "l_partkey", self.part_ids, "from_id"), "nxt", self.part_ids, "to_id")
        return rows.select("from_id", "to_id", F.lit("CALLS").alias("kind"))

    def _thin(self) -> DataFrame:
        return self._chain(self._pairs(self._steps(self.lines.where("quantity >= 45"))))

    @cached_property
    def customer_ids(self) -> DataFrame:
        t = self._tables
        rows = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))  # one row a country
        return rows.selectExpr("c_custkey", "'method:tpch:src/customers/' || r_name || ':' || cast(c_custkey as string) as cid")

    @cached_property
    def supplier_ids(self) -> DataFrame:
        rows = self._tables["supplier"].join(F.broadcast(self._tables["nation"]), F.col("s_nationkey") == F.col("n_nationkey"))  # one row a country
        return rows.selectExpr("s_suppkey", "'class:tpch:src/suppliers/' || n_name || ':' || cast(s_suppkey as string) as sid")

    def bought(self, lines: DataFrame) -> DataFrame:
        """(o_custkey, l_partkey, cents): parts that customers buy."""
        orders = self._tables["orders"].select("o_orderkey", "o_custkey").repartition(self.n_parts, "o_orderkey")
        rows = lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "cents")
        return rows.repartition(self.n_parts, "o_custkey").groupBy("o_custkey", "l_partkey").agg(F.min("cents").alias("cents"))

    def supplied(self, lines: DataFrame) -> DataFrame:
        """(l_partkey, l_suppkey, cents): suppliers of parts."""
        return lines.select("l_partkey", "l_suppkey", "cents").repartition(self.n_parts, "l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.min("cents").alias("cents"))

    def _calls(self, lines: DataFrame | None = None) -> DataFrame:
        lines = self.lines if lines is None else lines
        first = self._with_id(self._with_id(self.bought(lines), "o_custkey", self.customer_ids, "from_id"), "l_partkey", self.part_ids, "to_id")
        second = self._with_id(self._with_id(self.supplied(lines), "l_partkey", self.part_ids, "from_id"), "l_suppkey", self.supplier_ids, "to_id")
        return first.unionByName(second).select("from_id", "to_id", F.lit("CALLS").alias("kind"), F.expr("(50 + 5 * cents) / 100.0").alias("confidence"))

    def _few_calls(self) -> DataFrame:
        return self._calls(self.lines.where("quantity >= 45"))

    def stored(self, name: str) -> DataFrame:
        """A view that a query reads more than once, made once and written."""
        if (key := f"stored_{name}") not in self.__dict__:
            self.__dict__[key] = written(getattr(self, name))
        return self.__dict__[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name in ("lines", "steps", "chain", "thin", "calls", "few_calls") and self._named:
            self.__dict__[name] = (df := getattr(self, f"_{name}")())
            return df
        ctes = ", ".join(f"{v} as ({_dialect(VIEWS[v], False)})" for v in _needed((name,)))
        text = f"with {ctes} select * from {name}"
        df = self.spark.sql(text, **{t: self._tables[t] for t in TABLES if "{" + t + "}" in text})
        self.__dict__[name] = df
        return df
