"""More registered queries over the graph view: writes, packets, test links, search over four columns, tags, git lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.operators import packets, scan, search, structure, testlinks, traversal, writes
from basalt.plans.catalog import INDEG, LIVE, NOW, View, _BLAST, _GAP, _LPAIRS, _LAYERED, _SCORE, _UNCALLED, _pid, entry, part_id
from basalt.plans import index
from basalt.plans.lineage import written
from basalt.sources import parsers
from basalt.streaming import activity

# scans, predicates, projections

entry("sc15_file_hash", "select content_hash from nodes where path = 'src/suppliers/NATION_3/models' order by id limit 1")(lambda v: scan.file_hash(v.nodes, "src/suppliers/NATION_3/models"))
_META = "case when token_count is not null then '{\"size\": ' || token_count || case when token_count % 2 = 0 then ', \"signature\": \"f()\"' else '' end || '}' end"
entry("pr05_json_key", f"select id from (select id, {_META} as metadata from nodes) where metadata like '%\"signature\"%'")(lambda v: v.nodes.withColumn("metadata", F.expr(_META)).where(scan.has_key(F.col("metadata"), "signature")).select("id"))
entry("pr06_json_extract", f"select id, cast(json_extract(metadata, '$.size') as int) as size from (select id, {_META} as metadata from nodes) where metadata is not null")(lambda v: v.nodes.withColumn("metadata", F.expr(_META)).where("metadata is not null").select("id", scan.json_int(F.col("metadata"), "size").alias("size")))
entry("pr09_brief", "select id, name, path, kind, language, summary, start_line, end_line from nodes where kind <> 'file'")(lambda v: packets.brief(v.nodes.where("kind <> 'file'")))

# writes

entry("delete_edges_by_path", "select from_id, to_id from chain where not (from_id ilike '%brand#1%' or to_id ilike '%brand#1%')")(lambda v: writes.delete_edges_by_path(v.chain, "brand#1").select("from_id", "to_id"))
entry("column_updates", "select id, case when kind = 'class' then 'data' else community_id end as community_id, end_line from nodes")(lambda v: writes.update_columns(v.nodes, v.nodes.where("kind = 'class'").select("id", F.lit("data").alias("community_id"))).select("id", "community_id", "end_line"))
entry("fingerprint_put", "select file_path, content_sha, mtime_ns from new_files union all select file_path, content_sha, mtime_ns from old_files where file_path not in (select file_path from new_files)")(lambda v: writes.put(v.old_files, v.new_files, ["file_path"]))
entry("fingerprint_delete", "select file_path from old_files where mtime_ns % 10 <> 3")(lambda v: writes.remove(v.old_files, v.old_files.where("mtime_ns % 10 = 3").select("file_path")).select("file_path"))
entry("fingerprint_touch", "select o.file_path, case when n.content_sha = o.content_sha then n.mtime_ns else o.mtime_ns end as mtime_ns from old_files o left join new_files n using (file_path)")(lambda v: writes.touch_fingerprints(v.old_files, v.new_files).select("file_path", "mtime_ns"))
entry("sync_paths", "select n.file_path from new_files n left join old_files o using (file_path) where o.content_sha is distinct from n.content_sha")(lambda v: writes.changed_paths(v.old_files, v.new_files))
entry("visits_prune", f"select node_id, count(*) as n from visits where node_id in (select id from nodes where {LIVE}) group by 1")(lambda v: writes.prune_orphan_visits(v.visits, scan.live(v.nodes)).groupBy("node_id").agg(F.count("*").alias("n")))
_TOTALS = "select 'total_tokens_saved' as name, sum(tokens_saved) as value from savings where tokens_saved > 0 union all select 'total_hits', count(*) from savings where tokens_saved > 0 union all select 'tokens_saved_' || summary_type, sum(tokens_saved) from savings where tokens_saved > 0 group by summary_type"
entry("savings_log", f"select name, cast(value as bigint) as value from ({_TOTALS})")(lambda v: writes.log_savings(writes.savings_counters(v.savings.where("ts % 2 = 0")), v.savings.where("ts % 2 <> 0")))
entry("meta_put", "select 'k' || (p_partkey % 50) as key, cast(max(p_partkey) as string) as value from part_ids group by 1")(
    lambda v: writes.put(v.part_ids.select(F.concat(F.lit("k"), F.col("p_partkey") % 50).alias("key"), F.lit("old").alias("value")).distinct(), v.part_ids.groupBy(F.concat(F.lit("k"), F.col("p_partkey") % 50).alias("key")).agg(F.max("p_partkey").cast("string").alias("value")), ["key"])
)
entry("fill_summaries", "select id, case when summary is null and kind not in ('file', 'community') then 'made' else summary end as summary, summary is null and kind not in ('file', 'community') as filled from nodes")(lambda v: writes.fill_summaries(v.nodes, v.nodes.select("id", F.lit("made").alias("text"))))
entry("file_merge_nodes", "select id, summary from nodes where path <> 'src/suppliers/NATION_3/models' union all select id, coalesce(nullif('new', case when name is not null then 'new' end), summary) from nodes where path = 'src/suppliers/NATION_3/models' and id not like '%1'")(lambda v: _merged(v)[0].select("id", "summary"))
entry("file_merge_edges", "select from_id, to_id from calls where from_id not in (select id from nodes where path = 'src/suppliers/NATION_3/models')")(lambda v: _merged(v)[1].select("from_id", "to_id"))


def _merged(v: View) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A file comes in again without some of its nodes, without summaries and twice; nothing is called from it."""
    path = "src/suppliers/NATION_3/models"
    new = v.nodes.where((F.col("path") == path) & ~F.col("id").like("%1")).withColumns({"summary": F.lit(None).cast("string"), "seq": F.lit(0)})
    return writes.merge_file(v.nodes, v.calls, v.tags, new.unionByName(new.withColumns({"seq": F.lit(1), "name": F.lit("second")})), v.calls.withColumn("seq", F.lit(0)).where("false"), path)


# packets, sessions

entry("status", f"select count(*) as n_nodes, max(updated_at) as last_analyzed, cast(floor(({NOW} - max(updated_at)) / 86400) as bigint) || 'd' as age from nodes where {LIVE}")(lambda v: packets.status(v.nodes, NOW))
entry("recent_summaries", "select id, name, summary, updated_at from nodes where summary is not null order by updated_at desc, id limit 20")(lambda v: packets.recent_summaries(v.nodes))
_LAST = "(select id from sessions where agent_id = (select min(agent_id) from sessions) order by started_at desc, id desc limit 1)"
entry("start_session", f"""select 'unannotated' as part, id from nodes where {LIVE} and {_GAP} and id in (select node_id from visits where session_id = {_LAST})
    union all select 'gap', id from (select n.id from (select node_id, count(*) as visits from visits group by 1) s join nodes n on n.id = s.node_id where n.{LIVE} and {_GAP} order by visits desc, n.id limit 5)""", "nodes", "visits", "sessions")(
    lambda v: packets.start_session(v.sessions, v.visits, v.nodes, v.sessions.agg(F.min("agent_id")).first()[0])
)
entry("blast_payload", f"""{_BLAST}, m as (select id, min(depth) as depth from r where id <> {_pid()} group by id), p as (select id from m order by depth, id limit 20 offset 10)
    select (select count(*) from m) as total, (select count(*) from m) > 30 as truncated, case when (select count(*) from m) > 30 then 30 end as next_offset,
           coalesce((select string_agg(m.id, ',' order by m.depth, m.id) from m join p using (id) join nodes n on n.id = m.id where n.{LIVE}), '') as ids""", "chain", "nodes")(lambda v: packets.blast_payload(v.nodes, traversal.blast_radius_paths(v.stored("chain"), part_id(v), 3), 20, 10))
entry("packet_lists", f"""select (select string_agg(id, ',' order by in_degree desc, id) from (select n.id, coalesce(d.in_degree, 0) as in_degree from calls e join nodes n on n.id = e.from_id left join {INDEG} d on d.id = n.id where e.to_id = {_pid(7)} order by in_degree desc, n.id limit 3)) as callers,
    (select count(*) from calls where to_id = {_pid(7)}) as callers_total, (select string_agg(id, ',' order by id) from (select to_id as id from calls where from_id = {_pid(7)} order by to_id limit 3)) as callees, (select count(*) from calls where from_id = {_pid(7)}) as callees_total""")(
    lambda v: packets.packet(v.nodes, v.calls, v.tags, part_id(v, 7), NOW, 3, 3).select(F.array_join("callers", ",").alias("callers"), "callers_total", F.array_join("callees", ",").alias("callees"), "callees_total")
)
entry("primer_text", f"""select 1 as line, 'Nodes: ' || count(*) || ', files: ' || count(distinct path) || ', languages: ' || count(distinct language) as text from nodes where {LIVE}
    union all select 4, 'Summaries: ' || count(summary) || '/' || count(*) || ' (' || cast(floor(count(summary) / count(*) * 100) as bigint) || '%)' from nodes where {LIVE}
    union all select 5, 'Last analyzed: ' || strftime(to_timestamp(max(updated_at)) at time zone 'UTC', '%Y-%m-%d %H:%M') from nodes where {LIVE}""")(lambda v: packets.primer(v.nodes, v.calls).where("line not in (2, 3)"))

# traversal and structure

entry("neighbors_by_kind", f"""with recursive e as (select from_id, to_id, kind from chain union all select from_id, to_id, kind from contains), r(id, depth) as (select from_id, 1 from e where to_id = {_pid()} and kind = 'CALLS' union select e.from_id, depth + 1 from r join e on e.to_id = r.id where depth < 2 and e.kind = 'CALLS')
    select n.id, min(depth) as depth from r join nodes n on n.id = r.id where n.{LIVE} and r.id <> {_pid()} group by 1""", "chain", "contains", "nodes", "part_ids")(lambda v: traversal.neighbors(v.nodes, v.stored("chain").unionByName(v.contains), part_id(v), 2, "in", ("CALLS",)).select("id", "depth"))
entry("shortest_path_ids", f"""with recursive r(id, path, depth) as (select to_id, from_id || ' ' || to_id, 1 from thin where from_id = {_pid(3)} union select to_id, path || ' ' || to_id, depth + 1 from r join thin on from_id = id where depth < 3),
    g as (select max(id) as id from r where depth = 3), b as (select min(path) as path from r where id = (select id from g) and depth = (select min(depth) from r where id = (select id from g)))
    select unnest(range(len(string_split(path, ' '))))::int as step, unnest(string_split(path, ' ')) as id from b where path is not null""", "thin")(lambda v: _path(v))


def _path(v: View) -> DataFrame:
    goal = traversal.levels(v.stored("thin"), part_id(v, 3), 3, "out").where("depth = 3").agg(F.max("id")).first()[0]
    return traversal.shortest_path(v.stored("thin"), part_id(v, 3), goal or "none", 3)


_DEG = "(select id, sum(i) as i, sum(o) as o from (select to_id as id, 1 as i, 0 as o from few_calls union all select from_id, 0, 1 from few_calls) group by id)"
entry("bridges_by_score", f"select id, cast(i as double) as score from {_DEG} where i > 0 and i > (select avg(i) + 2 * stddev_samp(i) from {_DEG})", "few_calls")(lambda v: structure.bridges_by_score(traversal.degrees(v.few_calls).select("id", F.col("in_degree").cast("double").alias("score"))))
_FILES = "(select 'p' || (p_partkey % 40) as project, case p_partkey % 9 when 0 then 'go.mod' when 1 then 'manage.py' when 2 then 'requirements.txt' else 'x.txt' end as name, case when p_partkey % 4 = 0 then 'Flask==1' when p_partkey % 4 = 1 then 'FastAPI' else 'none' end as text from part_ids where p_partkey % 40 < 60)"
_FRAME = "case name when 'manage.py' then 3 when 'go.mod' then 7 when 'requirements.txt' then case when text in ('Flask==1', 'FastAPI') then 9 end end"
entry("framework", f"select project, case arg_min(name, {_FRAME}) when 'manage.py' then 'django' when 'go.mod' then 'go' else arg_min(case text when 'Flask==1' then 'flask' else 'fastapi' end, ({_FRAME}) * 10 + case text when 'FastAPI' then 0 else 1 end) end as framework from {_FILES} where {_FRAME} is not null group by project", "part_ids")(lambda v: structure.framework(_root_files(v)))


def _root_files(v: View) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 9 == 0, "go.mod").when(k % 9 == 1, "manage.py").when(k % 9 == 2, "requirements.txt").otherwise("x.txt")
    return v.part_ids.select(F.concat(F.lit("p"), k % 40).alias("project"), name.alias("name"), F.when(k % 4 == 0, "Flask==1").when(k % 4 == 1, "FastAPI").otherwise("none").alias("text"))


entry("graph_tags", f"""select node_id, tag from tags where not (tag in ('hub', 'bridge', 'entry-point', 'dead-code') and source = 'system')
    union select id, tag from ({_UNCALLED})
    union select n.id, 'hub' from nodes n left join {_DEG} d on d.id = n.id where n.{LIVE} and n.kind in ('function', 'method') and coalesce(d.i, 0) > (select avg(coalesce(d.i, 0)) + 2 * stddev_samp(coalesce(d.i, 0)) from nodes n left join {_DEG} d on d.id = n.id where n.{LIVE} and n.kind in ('function', 'method'))
    union select n.id, 'bridge' from nodes n join {_DEG} d on d.id = n.id where n.{LIVE} and n.kind in ('function', 'method') and d.i > 3 and d.o > 3""", "nodes", "few_calls", "tags")(lambda v: structure.graph_tags(v.nodes, v.few_calls, v.tags).select("node_id", "tag"))
entry("architecture", f"select 'layer' as section, layer as a, count(*) as n from {_LAYERED} where layer is not null group by 2 union all select 'dependency', from_layer || '>' || to_layer, n from {_LPAIRS}", "nodes", "calls")(
    lambda v: structure.architecture(v.nodes, v.calls).where("section in ('layer', 'dependency')").select("section", F.when(F.col("section") == "layer", F.col("a")).otherwise(F.concat_ws(">", "a", "b")).alias("a"), "n")
)

# test links

_TESTED = """(select t.id as test_id, c.id, regexp_extract(t.path, 'test_(.+)\\.py$', 1) = regexp_extract(c.path, '([^/]+)\\.py$', 1) as p, list_contains(string_split_regex(t.text, '[^A-Za-z0-9_]+'), regexp_extract(c.path, '([^/]+)\\.py$', 1)) as i,
    substring(t.name, 6) = c.name as n, exists (select 1 from code_calls e where e.from_id = t.id and e.to_id = c.id) as c from (select * from code where id like 'test:%') t, (select * from code where id like 'code:%') c)"""
_LINKED = f"(select test_id, id, round(least(1.0, case when p then 0.3 else 0.0 end + case when i then 0.3 else 0.0 end + case when n then 0.25 else 0.0 end + case when c then 0.4 else 0.0 end), 6)::double as score from {_TESTED})"
entry("test_links", f"select test_id, id, score, case when score >= 0.55 then 'high' else 'medium' end as tier from {_LINKED} where score >= 0.3", "code", "code_calls")(lambda v: testlinks.link_tests(v.code, v.code_calls))
entry("tested_nodes", f"select l.id, l.test_id, t.name, t.path from {_LINKED} l join code t on t.id = l.test_id where score >= 0.55", "code", "code_calls")(
    lambda v: testlinks.tested_by(v.code, testlinks.link_tests(v.code, v.code_calls).where("tier = 'high'").select(F.col("test_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("TESTED_BY").alias("kind")))
)

# search over four columns

_BODY = "(select n.id, n.name, n.deleted_at, n.name || ' ' || coalesce(n.summary || ' ', '') || n.path || coalesce(' ' || t.named, '') as body from nodes n left join (select node_id, string_agg(distinct tag, ' ' order by tag) as named from tags group by 1) t on t.node_id = n.id where n.kind <> 'file')"
_PARTS4 = f"with w as (select id, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as words from {_BODY}), t as (select id, len(words) as length, unnest(words) as term from w), p as (select id, length, term, count(*) as tf from t group by 1, 2, 3), c as (select count(*) as n, avg(len(words)) as mean from w)"
entry("search_facade", f"""{_PARTS4}, d as (select term, count(*) as df from p where term in ('handles', 'src') group by term), s as (select id, round({_SCORE}, 6) as score, count(*) as found from p join d using (term), c group by id)
    select n.id, n.name, s.score, coalesce(i.in_degree, 0) as caller_count from s join nodes n on n.id = s.id left join {INDEG} i on i.id = n.id where s.found = 2 and n.{LIVE} and n.id in (select node_id from tags where tag = 'promo') order by s.score desc, n.id limit 10""", "nodes", "tags", "calls")(
    lambda v: search.facade(v.nodes.where("kind <> 'file'"), v.tags, v.calls, "tag:promo handles src")
)

# streams

entry("change_feed", "select cast(user_id as bigint) as user_id, max(epoch_us(ts)) as newest_us from events group by 1")(lambda v: _feed(v))


def _feed(v: View) -> DataFrame:
    import uuid

    from basalt.plans.lineage import shared_folder

    table = f"{shared_folder(v.spark)}/feed-{uuid.uuid4().hex[:12]}"
    changes = activity.event_stream(v.spark, v.sf_dir).select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros("ts").alias("newest_us"))
    activity.run_feed(changes, table, ["user_id"], "newest_us")
    return v.spark.read.parquet(f"{table}/0")


# source files to nodes and edges

_KEYS = "(select cast(p_partkey as string) as k, cast(p_partkey + 3 as string) as nk, p_partkey % 3 as m, p_partkey + 3 in (select p_partkey from part_ids) as more from part_ids)"
_MADE = "case m when 0 then 'function:p:m/part_' || k || '.py:make_' || k when 1 then 'function:p:m/part_' || k || '.ts:make_' || k else 'method:p:m/Part_' || k || '.java:Part_' || k || '.make_' || k end"
_HELPS = f"replace({_MADE}, 'make_', 'helper_')"
entry("code_nodes", f"""select {_MADE} as id, case m when 0 then 4 when 1 then 1 else 2 end as start_line, case m when 0 then 6 else 4 end as end_line, case m when 0 then 'fastapi_route' end as framework_hint, case m when 0 then 'Flask/FastAPI route' end as notes, 'simple' as complexity from {_KEYS}
    union all select {_HELPS}, case m when 0 then 9 when 1 then 5 else 5 end, case m when 0 then 10 when 1 then 7 else 8 end, case m when 0 then 'fastapi_route' end, case m when 0 then 'async function' when 1 then 'async/await' end, 'simple' from {_KEYS}
    union all select 'class:p:m/Part_' || k || '.java:Part_' || k, 1, 9, null, null, null from {_KEYS} where m = 2
    union all select 'class:p:m/Part_' || k || '.java:Item_' || k, 10, 10, null, null, null from {_KEYS} where m = 2
    union all select 'file:p:m/' || case m when 2 then 'Part_' else 'part_' end || k || case m when 0 then '.py' when 1 then '.ts' else '.java' end, 1, case m when 0 then 11 when 1 then 8 else 11 end, null, null, null from {_KEYS}""", "part_ids")(
    lambda v: index.nodes_of(parsers.parse_files(v.sources), "p", NOW).select("id", "start_line", "end_line", "framework_hint", F.col("language_notes").alias("notes"), "complexity")
)
entry("code_edges", f"""select {_MADE} as from_id, case when m = 0 then replace({_HELPS}, k, nk) else {_HELPS} end as to_id, 'CALLS' as kind, 1.0::double as confidence, case m when 0 then 'return helper_' || nk || '(x)' else 'return helper_' || k || '(x)' end as context from {_KEYS} where m <> 0 or more
    union all select {_HELPS}, case m when 2 then 'class:p:m/Part_' || k || '.java:Item_' || k else {_MADE} end, 'CALLS', case m when 0 then 1.0 else 0.8 end::double, case m when 0 then 'return make_' || k || '(y)' when 1 then 'return this.make_' || k || '(y)' else 'return new Item_' || k || '()' end from {_KEYS}
    union all select 'file:p:m/part_' || k || case m when 0 then '.py' else '.ts' end, x, 'CONTAINS', 1.0, null from (select m, k, unnest([{_MADE}, {_HELPS}]) as x from {_KEYS} where m <> 2)
    union all select 'file:p:m/Part_' || k || '.java', x, 'CONTAINS', 1.0, null from (select k, unnest(['class:p:m/Part_' || k || '.java:Part_' || k, 'class:p:m/Part_' || k || '.java:Item_' || k]) as x from {_KEYS} where m = 2)""", "part_ids")(
    lambda v: index.edges_of(written(parsers.parse_files(v.sources)), written(parsers.call_sites(v.sources)), "p").select("from_id", "to_id", "kind", "confidence", "context")
)
_INDEXED = f"select {_MADE} as id, k, m from {_KEYS} union all select {_HELPS}, k, m from {_KEYS}"
entry("index_sync", f"""select id, m = 1 as is_gone, m = 0 as is_kept from ({_INDEXED})""", "part_ids")(lambda v: _synced(v))


def _synced(v: View) -> DataFrame:
    """All files are indexed; then those of TypeScript are gone and those of Java have a line more."""
    import uuid

    from basalt.plans.lineage import shared_folder

    root = f"{shared_folder(v.spark)}/index-{uuid.uuid4().hex[:12]}"
    files = v.sources.withColumns({"content_sha": F.sha2("text", 256), "mtime_ns": F.lit(1).cast("long")})
    later = files.where("language <> 'typescript'").withColumn("text", F.when(F.col("language") == "java", F.regexp_replace("text", "\\{\n", "{\n  // more\n")).otherwise(F.col("text"))).withColumn("content_sha", F.sha2("text", 256))
    first = index.index(files, f"{root}/1", "p", NOW - 100)
    second = index.index(later, f"{root}/2", "p", NOW, first)
    return second.nodes.where("kind in ('function', 'method')").select("id", F.col("deleted_at").isNotNull().alias("is_gone"), (F.col("deleted_at").isNull() & (F.col("updated_at") < NOW)).alias("is_kept"))
