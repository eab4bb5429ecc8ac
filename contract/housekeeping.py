"""Projects, files, snapshots, listings, event logs, windows and sets."""

from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from contract.scalars import CLASSIFIED
from plumbline.operators import ordered as O
from plumbline.plans import lifecycle as L
from plumbline.plans import merge as M
from plumbline.plans import reports as R
from plumbline.session import scratch_path


@query(f"WITH {S.FILES} SELECT file_id, name FROM files WHERE NOT processed")
def pending_files(spark, sf):
    return L.pending(S.file_register(spark, sf)).select("file_id", "name")


@query(f"WITH {S.FILES} SELECT file_id, project_id FROM files WHERE file_id NOT IN (SELECT doc_id FROM labels)")
def pending_files_by_ledger(spark, sf):
    done = S.read(spark, sf, "labels").select(F.col("doc_id").alias("file_id"))
    return L.pending(S.file_register(spark, sf), done=done).select("file_id", "project_id")


SNAPSHOTS = """snapshots AS (SELECT o_custkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS is_active, o_orderkey FROM orders)"""


def snapshots(spark, sf):
    numbered = O.renumber(S.read(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey"),
                          ["project_id"], "o_orderkey", "version")
    return L.latest_flags(numbered)


@query(f"WITH {SNAPSHOTS} SELECT project_id, version, o_orderkey FROM snapshots WHERE is_active")
def active_snapshots(spark, sf):
    return L.active_snapshots(snapshots(spark, sf)).select("project_id", "version", "o_orderkey")


@query(f"""WITH {SNAPSHOTS}, changed AS (SELECT DISTINCT c_custkey AS project_id FROM customer WHERE c_acctbal > 5000)
  SELECT s.project_id, s.version, s.is_active AND c.project_id IS NULL AS is_active FROM snapshots s LEFT JOIN changed c USING (project_id)
  UNION ALL SELECT c.project_id, coalesce(max(version), 0) + 1, true FROM changed c LEFT JOIN snapshots s USING (project_id) GROUP BY 1""")
def next_snapshot_versions(spark, sf):
    changed = S.read(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("project_id"))
    return L.next_versions(snapshots(spark, sf).drop("o_orderkey"), changed)


@query(f"""WITH {S.FILES}, p AS (SELECT id FROM range(0, 25) r(id))
  SELECT p.id AS project_id, CASE WHEN bool_and(processed) THEN 'validated' WHEN bool_or(NOT processed AND error <> '') THEN 'error' ELSE 'processing' END AS status
  FROM (SELECT n_nationkey AS id FROM nation) p LEFT JOIN files f ON f.project_id = p.id GROUP BY p.id""")
def project_status(spark, sf):
    projects = S.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    return L.project_status(projects, S.file_register(spark, sf))


@query("""SELECT l_suppkey % 25 AS project_id, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N",
  count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def extracted_entity_counts(spark, sf):
    rows = S.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).alias("project_id"), F.col("l_returnflag").alias("kind"))
    return L.extracted_counts(rows, ["A", "N", "R"])


SIZE = f"""{S.spaces_sql()}, {S.systems_sql()}, {S.equipment_sql(25)}, size AS (SELECT project_id, count(*) FILTER (k = 1) AS spaces, count(*) FILTER (k = 2) AS systems,
  count(*) FILTER (k = 3) AS equipment, count(*) FILTER (k = 1 AND coalesce(area, 0) = 0) AS spaces_without_area FROM (
  SELECT project_id, 1 AS k, area_m2 AS area FROM spaces UNION ALL SELECT project_id, 2, NULL FROM systems UNION ALL SELECT project_id, 3, NULL FROM equipment) GROUP BY 1)"""


def size(spark, sf):
    return R.project_size(S.spaces(spark, sf), S.systems(spark, sf), S.equipment(spark, sf, 25))


@query(f"WITH {SIZE} SELECT * FROM size")
def project_sizes(spark, sf):
    return size(spark, sf)


@query("""WITH e AS (SELECT doc_id AS file_id, lang AS key, length(text) AS n FROM documents), m AS (SELECT doc_id AS file_id, 'en' AS key, 900 + quality AS n FROM labels)
  SELECT file_id, key, e.n AS extracted, m.n AS merged, CASE WHEN m.n IS NULL THEN 'missing' ELSE 'shrunk' END AS loss
  FROM e FULL JOIN m USING (file_id, key) WHERE e.n IS NOT NULL AND (m.n IS NULL OR e.n > m.n)""")
def merge_reconciliation(spark, sf):
    extracted = S.read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("key"), F.length("text").cast("long").alias("n"))
    merged = S.read(spark, sf, "labels").select(F.col("doc_id").alias("file_id"), F.lit("en").alias("key"), (F.col("quality") + 900).cast("long").alias("n"))
    return L.reconcile(extracted, merged)


@query("""WITH s AS (SELECT l_orderkey % 500 AS file_id, l_returnflag AS entity_kind, 'G' || l_partkey AS entity_id FROM lineitem
    UNION ALL SELECT l_suppkey, l_returnflag, 'G' || l_partkey FROM lineitem)
  SELECT d.doc_id AS file_id, d.lang, s.entity_kind, s.entity_id FROM documents d LEFT JOIN (SELECT DISTINCT * FROM s) s ON s.file_id = d.doc_id""")
def entities_by_file(spark, sf):
    """Entities with two sources show under both files, once each."""
    rows = S.read(spark, sf, "lineitem").select(
        F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("id"), "l_returnflag",
        F.array(F.struct((F.col("l_orderkey") % 500).alias("file_id")), F.struct(F.col("l_suppkey").alias("file_id"))).alias("sources"))
    lineage = rows.select(F.col("l_returnflag").alias("entity_kind"), F.col("id").alias("entity_id"), F.explode("sources.file_id").alias("file_id"))
    files = S.read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    return L.entities_by_file(files, lineage).select("file_id", "lang", "entity_kind", "entity_id")


DETAIL = f"""{S.FILES}, {SNAPSHOTS}, detail AS (
  SELECT c_custkey AS project_id, 'project' AS section, c_custkey::VARCHAR AS item, c_name AS label FROM customer UNION ALL
  SELECT project_id, 'file', file_id::VARCHAR, name FROM files UNION ALL
  SELECT project_id, 'snapshot', version::VARCHAR, is_active::VARCHAR FROM snapshots UNION ALL
  SELECT l_suppkey, 'issue', l_orderkey::VARCHAR, 'V21' FROM lineitem WHERE l_quantity < 3 UNION ALL
  SELECT o_custkey, 'report', o_orderkey::VARCHAR, o_orderstatus FROM orders WHERE o_orderstatus = 'F')"""


def _detail(spark, sf):
    projects = S.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    issues = S.read(spark, sf, "lineitem").filter("l_quantity < 3").select(
        F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("pos"), F.lit("V21").alias("rule_id"))
    reports = S.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("report"))
    return projects, L.project_detail(projects, S.file_register(spark, sf), snapshots(spark, sf), issues, reports)


@query(f"WITH {DETAIL} SELECT * FROM detail")
def project_detail(spark, sf):
    return _detail(spark, sf)[1]


@query(f"""WITH {DETAIL} SELECT c_custkey AS project_id, c_name AS name, count(*) FILTER (section = 'file') AS files, count(*) FILTER (section = 'snapshot') AS snapshots,
  count(*) FILTER (section = 'issue') AS issues, count(*) FILTER (section = 'report') AS reports FROM customer LEFT JOIN detail ON project_id = c_custkey GROUP BY ALL""")
def project_detail_counts(spark, sf):
    return L.project_detail_counts(*_detail(spark, sf))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT 'orders' AS child, count(*) AS kept FROM orders WHERE o_custkey NOT IN (FROM gone) UNION ALL
  SELECT 'conversations', count(*) FROM conversations WHERE conv_id NOT IN (FROM gone)""")
def cascade_delete(spark, sf):
    gone = S.read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("project_id"))
    kept = L.delete_projects(gone, {
        "orders": S.read(spark, sf, "orders").withColumnRenamed("o_custkey", "project_id"),
        "conversations": S.read(spark, sf, "conversations").withColumnRenamed("conv_id", "project_id")})
    one = [df.groupBy(F.lit(name).alias("child")).agg(F.count(F.lit(1)).alias("kept")) for name, df in kept.items()]
    return one[0].unionByName(one[1])


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 20")
def project_listing(spark, sf):
    return L.listing(S.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id", 20, 50)


@query("SELECT id, balance, place FROM (SELECT c_custkey AS id, c_acctbal AS balance, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place BETWEEN 101 AND 160")
def project_listing_page(spark, sf):
    """A page far into a sorted listing, found by the counts of its partitions."""
    path = scratch_path(spark, "listing")
    rows = S.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    L.write_listing(rows, [F.desc("balance"), F.asc("id")], path)
    return L.listing_page(spark, path, "id bigint, balance double", 100, 60)


def _placed(rows):
    """Sorted rows with their place from 1."""
    at = O.dense_ranks(rows.withColumn("_m", F.monotonically_increasing_id()), ["_m"], [], "place")
    return at.withColumn("place", F.col("place") + 1).drop("_m")


@query(f"WITH {S.PROJECTS} SELECT id, coalesce(location, '') AS location, row_number() OVER (ORDER BY coalesce(location, '') DESC, id) AS place FROM projects")
def projects_by_location(spark, sf):
    rows = L.sort_projects(S.projects(spark, sf), "location", ascending=False)
    return _placed(rows.select("id", F.coalesce("location", F.lit("")).alias("location")))


@query(f"""WITH {S.PROJECTS} SELECT id, description,
  row_number() OVER (ORDER BY trim(coalesce(regexp_extract(description, 'Projektnummer:\\s*(.+)', 1), '')), id) AS place FROM projects""")
def projects_by_number(spark, sf):
    return _placed(L.sort_projects(S.projects(spark, sf), "number").select("id", "description"))


LOG = """log AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 'Request FAILED' WHEN 'view' THEN 'Warning: slow' WHEN 'click' THEN 'error and warn'
  ELSE event_type END AS message FROM events)"""


def log_rows(spark, sf):
    t = F.col("event_type")
    message = F.when(t == "error", "Request FAILED").when(t == "view", "Warning: slow").when(t == "click", "error and warn").otherwise(t)
    return S.read(spark, sf, "events").select("event_id", "user_id", "ts", message.alias("message"))


@query(f"""WITH {LOG} SELECT user_id, count(*) AS total, count(*) FILTER (contains(lower(message), 'error') OR contains(lower(message), 'failed')) AS errors,
  count(*) FILTER (contains(lower(message), 'warn')) AS warnings FROM log GROUP BY 1""")
def log_summary(spark, sf):
    return L.log_summary(log_rows(spark, sf), ["user_id"])


@query("""SELECT lang AS batch, count(*) FILTER (n_chars >= 1000) AS generated, count(*) FILTER (n_chars < 1000) AS failed, count(*) FILTER (n_chars >= 1000) > 0 AS success
  FROM documents GROUP BY 1""")
def batch_results(spark, sf):
    rows = S.read(spark, sf, "documents").withColumnRenamed("lang", "batch")
    return R.batch_result(rows, ["batch"], F.col("n_chars") >= 1000)


@query("""SELECT conv_id AS project_id, sum(len(string_split(text, ' ')))::BIGINT AS entries FROM conversations WHERE len(string_split(text, ' ')) > 3 GROUP BY 1""")
def section_entries(spark, sf):
    sections = S.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("project_id"), F.filter(F.split("text", " "), lambda w: F.lit(True)).alias("data"))
    sections = sections.withColumn("data", F.when(F.size("data") > 3, F.col("data")).otherwise(F.array()))
    return L.total_entries(L.filled_sections(sections))


# --- windows ---------------------------------------------------------------------------


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def renumbering(spark, sf):
    return O.renumber(S.read(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", "n", width=64)


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM events""")
def forward_fill(spark, sf):
    e = S.read(spark, sf, "events").select("user_id", "event_id", "event_type")
    return O.fill_down(e, ["user_id"], "event_id", F.when(F.col("event_type") == "view", F.col("event_id")), "last_view", width=64).drop("event_type")


@query("""WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
  SELECT user_id, event_id, event_type, sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM p""")
def document_islands(spark, sf):
    return O.islands(S.read(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", "run", width=64)


@query("""WITH g AS (SELECT user_id, event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) - 1 AS gap FROM events),
  s AS (SELECT user_id, min(event_id) AS stop FROM g WHERE gap >= 500 GROUP BY 1)
  SELECT g.user_id, event_id FROM g LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id < stop""")
def stop_after_empty_rows(spark, sf):
    e = S.read(spark, sf, "events").select("user_id", "event_id")
    return O.stop_after_gap(e, ["user_id"], "event_id", F.lit(0), 500, width=64)


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10""")
def newest_ten(spark, sf):
    return O.newest(S.read(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "value")


@query("""SELECT k, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM (
  SELECT *, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS k FROM documents) GROUP BY k""")
def exact_dedup(spark, sf):
    from plumbline.functions.text import strip
    d = S.read(spark, sf, "documents").withColumn("k", F.lower(strip("text"))).select("doc_id", "source", "k")
    return O.keep_first(d, ["k"], "doc_id").select("k", "doc_id", "source")


@query("""WITH p AS (SELECT c_custkey, i AS phase_no, 30 * i AS days, sum(30 * i) OVER (PARTITION BY c_custkey ORDER BY i) AS until FROM customer, range(1, 4) r(i))
  SELECT c_custkey, phase_no, strftime(DATE '2026-03-01' + (until - days)::INT, '%d.%m.%Y') AS starts, strftime(DATE '2026-03-01' + until::INT, '%d.%m.%Y') AS ends FROM p""")
def running_phase_dates(spark, sf):
    from plumbline.functions.text import german_date
    p = S.read(spark, sf, "customer").select("c_custkey", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("phase_no"))
    p = p.withColumn("days", F.col("phase_no") * 30)
    out = R.running_phase_days(p, ["c_custkey"], "phase_no", "days", F.lit("2026-03-01").cast("date"))
    return out.select("c_custkey", "phase_no", german_date("starts").alias("starts"), german_date("ends").alias("ends"))


# --- sets and maps ---------------------------------------------------------------------------


@query("""WITH k AS (SELECT n_nationkey AS project_id, 'Customer#' || lpad(n_nationkey::VARCHAR, 9, '0') AS name, -1 AS file_id FROM nation),
  n AS (SELECT c_nationkey AS project_id, c_name AS name, min(c_custkey) AS file_id FROM customer GROUP BY 1, 2)
  SELECT * FROM k UNION ALL SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.project_id = n.project_id AND k.name = n.name)""")
def file_list_add_if_absent(spark, sf):
    known = S.read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("project_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"), F.lit(-1).cast("long").alias("file_id"))
    new = S.read(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("file_id"))
    return M.register_files(known, new)


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(['S' || l_suppkey, 'R' || l_partkey] || ['S' || (l_suppkey + l_linenumber - 1), 'R1'])), ',') AS ids,
  array_to_string(list_sort(list_intersect([l_returnflag, l_linestatus], ['A', 'F', 'N'])), ',') AS shared FROM lineitem""")
def id_list_union(spark, sf):
    s, r = F.col("l_suppkey"), F.col("l_partkey")
    a = F.array(F.concat(F.lit("S"), s.cast("string")), F.concat(F.lit("R"), r.cast("string")))
    b = F.array(F.concat(F.lit("S"), (s + F.col("l_linenumber") - 1).cast("string")), F.lit("R1"))
    shared = F.array_sort(F.array_intersect(F.array("l_returnflag", "l_linestatus"), F.array(F.lit("A"), F.lit("F"), F.lit("N"))))
    return S.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", M.union_ids(a, b)).alias("ids"), F.concat_ws(",", shared).alias("shared"))


@query("""SELECT c_custkey, c_name AS file, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_nationkey::VARCHAR AS nation FROM customer""")
def map_overlay(spark, sf):
    """The own map wins, also where its value is null."""
    base = F.create_map(F.lit("file"), F.lit("base"), F.lit("segment"), F.lit("base"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    own = F.create_map(F.lit("file"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment")))
    m = M.overlay_maps(base, own)
    return S.read(spark, sf, "customer").select("c_custkey", m.alias("m")).select(
        "c_custkey", F.col("m")["file"].alias("file"), F.col("m")["segment"].alias("segment"), F.col("m")["nation"].alias("nation"))


@query("""SELECT doc_id AS project_id, NULL::BIGINT AS entry, text AS content FROM documents WHERE trim(text) <> '' UNION ALL
  SELECT item_id, NULL, text FROM benchmark UNION ALL
  SELECT conv_id, i - 1, l[i] FROM (SELECT conv_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations) WHERE trim(l[i]) <> ''""")
def full_text_append(spark, sf):
    """Benchmark items are the known passages, documents the new texts, turns the new lists."""
    texts = S.read(spark, sf, "documents").select(F.col("doc_id").alias("project_id"), F.col("text").alias("content"))
    lists = S.read(spark, sf, "conversations").select(F.col("conv_id").alias("project_id"), F.split("text", "\n").alias("contents"))
    known = S.read(spark, sf, "benchmark").select(
        F.col("item_id").alias("project_id"), F.col("text").alias("content"), F.lit(None).cast("int").alias("entry"))
    return M.append_passages(known, texts, lists).select("project_id", F.col("entry").cast("long").alias("entry"), "content")
